"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from factloom.llm.bpe_stream import op3_bpe
from factloom.llm.hamming_topk import OP6_SQL, op6_topk
from factloom.llm.html_paths import op4_html
from factloom.llm.packing import op1_packing
from factloom.llm.prefix_trie import op11_prefix_trie
from factloom.llm.quality_gbt import op9_quality
from factloom.llm.quote_threads import OP2_SQL, op2_chat
from factloom.llm.simhash_dedup import op7_simhash
from factloom.llm.spot_signatures import op13_spot_signatures
from factloom.llm.token_attribution import op5_token_counts
from factloom.llm.toxicity_cnn import op10_toxicity
from factloom.llm.turn_repair import op12_turn_repair
from factloom.llm.warc_store import OP8_SQL, op8_warc


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_chat": op2_chat,
        "op3_bpe": op3_bpe,
        "op4_html": op4_html,
        "op5_token_counts": op5_token_counts,
        "op6_topk": op6_topk,
        "op7_simhash": op7_simhash,
        "op8_warc": op8_warc,
        "op9_quality": op9_quality,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_turn_repair": op12_turn_repair,
        "op13_spot_signatures": op13_spot_signatures,
    }


def oracle_sql():
    return {"op2_chat": OP2_SQL, "op6_topk": OP6_SQL, "op8_warc": OP8_SQL}
