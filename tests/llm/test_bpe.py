import random
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe_stream
from tests.llm.helpers import SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
EXACT = Tokenizer.from_file(PATH)
ENCODER = bpe_stream.codec("word_bpe_49k")
DECODER = bpe_stream.Decoder(ENCODER.merges)


def same(text):
    ids = EXACT.encode(text, add_special_tokens=False).ids
    got = ENCODER.encode(text)
    assert got == " ".join(map(str, ids))
    assert DECODER.decode(got) == EXACT.decode(ids, skip_special_tokens=False)
    DECODER.reset()
    assert "".join(map(DECODER.step, ids)) == DECODER.decode(got)
    out = bpe_stream.Outputs(contents=True)
    for piece in ENCODER.pieces(text):
        out.take(piece)
    assert out.row()[0] == len(ids) and out.row()[3:] == (got, EXACT.decode(ids, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " \n\t", "It's THE cat's 123 　x", "a<|endoftext|>B<|startoftext|>", "ΑΣ Σ İ ß ﬁ é", "word" * 2000, "!?" * 500, "\x00\x1c\x85", "한국어 텍스트"])
def test_edges(text):
    same(text)


def test_streaming_with_a_small_buffer():
    small = bpe_stream.Codec(PATH, block=8)
    rng = random.Random(5)
    for _ in range(60):
        word = "".join(rng.choices("thereanoinssaaeellgmwo", k=rng.randint(150, 900)))
        assert [int(i) for _, i, _ in small.through(word)] == EXACT.encode(word, add_special_tokens=False).ids
        held = bpe_stream.Transducer(small.merges, 8)
        for b in word.encode():
            list(held.feed(bytes([b])))
            assert len(held.held) <= 8 + small.merges.lookahead + 1


def test_byte_level_decoder():
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    decoder = bpe_stream.Decoder(bpe_stream.Merges(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("plain text", "ééà 😀 한국", "a<|endoftext|>b"):
        ids = encoder.encode(text, add_special_tokens=False).ids
        assert decoder.decode(" ".join(map(str, ids))) == encoder.decode(ids, skip_special_tokens=False) == text
    cut = encoder.encode("😀", add_special_tokens=False).ids[:-1]
    assert "�" in decoder.decode(" ".join(map(str, cut)))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in bpe_stream.op3_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = EXACT.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(EXACT.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_extra_columns_and_empty_tables(spark):
    docs = documents(spark, None, "", "A a", "A a", extra=True)
    rows = sorted(bpe_stream.transcode(docs).collect())
    assert [r.n_tokens for r in rows] == [0, 0, 2, 2] and [r.decoded for r in rows][:2] == ["", ""]
    assert bpe_stream.transcode(docs.where("false")).count() == 0


@pytest.mark.parametrize("chars", [1, 5, 40])
def test_small_blocks(monkeypatch, chars):
    monkeypatch.setattr(bpe_stream, "CHARS", chars)
    rng = random.Random(chars)
    alphabet = ["a", "B", " ", "\n", "\u0301", "e", "é", "Σ", "1", "'s", "<|endoftext|>", "\u3000", "…", "ﬁ", "\x85", "\r\n", "x" * 70]
    for _ in range(200):
        same("".join(rng.choices(alphabet, k=40)))


def test_every_id_goes_through_both_machines(monkeypatch):
    fed, stepped = [], []
    monkeypatch.setattr(bpe_stream.Transducer, "feed", lambda self, data, f=bpe_stream.Transducer.feed: fed.append(data) or f(self, data))
    monkeypatch.setattr(bpe_stream.Decoder, "step", lambda self, i, f=bpe_stream.Decoder.step: stepped.append(i) or f(self, i))
    fresh = bpe_stream.Codec(PATH)
    text = "It's a plain sentence of words, and " + "longer" * 40
    ids = EXACT.encode(text, add_special_tokens=False).ids
    out = bpe_stream.Outputs(contents=False)
    for piece in fresh.pieces(text):
        out.take(piece)
    assert b"".join(fed).decode() == "".join(w for w, _ in fresh.split(fresh.normal(text))) and stepped == ids
    assert out.row() == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(EXACT.decode(ids).encode()).hexdigest())


def test_memory_does_not_grow_with_the_text():
    import tracemalloc

    def peak(text):
        out = bpe_stream.Outputs(contents=False)
        tracemalloc.start()
        for piece in ENCODER.pieces(text):
            out.take(piece)
        return tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    words = "some plain words, and more of them\n" * 3000
    peak(words)
    assert peak(words * 20)[0] < 1.5 * peak(words * 2)[0]
    assert peak(words * 20)[0] < 20_000_000


def test_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe_stream, "REMEMBERED", 3)
    small = bpe_stream.Codec(PATH)
    text = "one two three four five six one two"
    assert small.encode(text) == ENCODER.encode(text) and len(small.remembered) <= 3
