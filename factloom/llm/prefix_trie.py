"""The trie of conversation prefixes: which turns do conversations share, and what does sharing save?

Conversations are sequences of turns (role, text). Equal ones are put together first, so a copy costs a number and no turns. The rest are
hash-partitioned by the digest of their first turn, and each partition builds dictionary tries with parent pointers in ``applyInPandas`` and sums
them up in iterative postorder. A first turn with more than ``LIMIT`` turns below it is no unit for a task: its subtrie is
split by the next turn, again and again, over one, two, four, ... turns a round, until the parts fit. The nodes above the
parts ("tops") are counted by grouping instead.

A prefix has a Zobrist key: the exclusive or of the digests of (place, turn) over its turns, 120 bits. It can be summed in any
order, and the key of the parent is the key without the last turn.

Sums over the subtree of a top need no walk either. Every node belongs to its smallest member, its owner, and a member other than the smallest owns nodes
only below. So a top's sum over its subtree is that of all that its members own, less what its own owner owns above it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored, table
from factloom.llm.ordering import numbered, sequence_digests

#: Turns below one split point that a task takes as a whole, and the most turns of a conversation that one round splits by.
LIMIT, STRIDE = 1 << 11, 1 << 12
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, p1 long, p2 long"


def _lanes(digest: Column) -> list[Column]:
    """Two longs of 60 bits from a SHA-256 in hex."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, words``: the turns of each conversation, numbered from 1 by turn (null first, then the digest of role and text).

    Null roles and texts are empty. Rows without a conversation id belong to none and are left out. Repeated rows are turns of their own.
    Other columns are not read. Texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).substr(1, 32).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("digest"), name="turns").drop("turn")


def rebuilt(turns: DataFrame, block: int = 20, shared: int = 4) -> DataFrame:
    """``turns`` with each conversation c begun anew: the first h turns of conversation c - c % ``block``, h = crc32(c) % ``shared``, then its own after the first h.

    A conversation that is left without a turn has one row with a null ``digest``.
    """
    heads = turns.where(F.col("pos") < shared).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    met = own.join(heads.withColumnRenamed("conv_id", "base"), F.col("base") == F.col("conv_id") - F.col("conv_id") % block, "left")
    met = stored(met.select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")).alias("head")), "heads")
    first = met.select("conv_id", F.inline("head")).select("conv_id", "pos", "digest", "words")
    bare = met.where((F.size("head") == 0) & (F.col("n") <= F.col("h"))).select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    rest = turns.join(met.select("conv_id", "h", F.size("head").alias("k")), "conv_id").where("pos > h")
    return first.unionByName(bare).unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words"))


def build(group: pd.DataFrame) -> pd.DataFrame:
    """Dictionary tries of one partition. ``group``: a row for each turn of a conversation's part below its split point.

    A node's number is its place in the lists; ``up`` points to its parent. Conversations come by ascending number, so who makes a node is its smallest member.
    """
    up, below, conv, depth, count, words, ends, keys = [], [], [], [], [], [], [], []
    tops: dict[tuple, int] = {}
    at = before = None
    group = group.sort_values(["rep", "pos"], kind="stable")
    for rep, pos, digest, word, n, length, sha, k1, k2, p1, p2 in group[["rep", "pos", "digest", "words", "n", "length", "sha256", "k1", "k2", "p1", "p2"]].itertuples(index=False):
        if rep != before:
            at, before, children, name = -1, rep, tops, (k1, k2)
        else:
            children, name = below[at], digest
        node = children.get(name)
        if node is None:
            node = children[name] = len(up)
            up.append(at), below.append({}), conv.append(rep), depth.append(pos), count.append(0), words.append(word), ends.append(None), keys.append((p1, p2))
        at = node
        count[at] += n
        if pos == length:
            ends[at] = sha
    order, stack = [], list(tops.values())
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(below[at].values())
    leaves = [0 if b else 1 for b in below]
    saved = [(n - 1) * w for n, w in zip(count, words)]
    for at in reversed(order):
        if up[at] >= 0:
            leaves[up[at]] += leaves[at]
            saved[up[at]] += saved[at]
    rows = [
        (conv[i], depth[i], conv[up[i]] if up[i] >= 0 else None, count[i], len(below[i]), leaves[i], saved[i], ends[i], up[i] < 0, *keys[i]) for i in order
    ]
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])
    return out.astype({"parent_conv_id": "Int64"})


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations``: ``conv_id, pos`` (from 1 without gaps), ``digest, words``; a row with a null digest stands for a conversation without turns. An empty table
    gives no rows.
    """
    z = _lanes(F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "digest"), 256))
    rows = conversations.withColumns({"z1": F.coalesce(z[0], F.lit(0)), "z2": F.coalesce(z[1], F.lit(0))})
    rows = stored(rows, "rebuilt")
    whole = rows.groupBy("conv_id").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.max("pos").alias("length"))
    whole = whole.withColumn("name", F.col("conv_id").cast("string").cast("binary"))
    classes = sequence_digests(whole, ["x1", "x2", "length"], "conv_id", "name", b",")
    classes = stored(classes.select(F.col("first").alias("rep"), "n", "length", "sha256"), "classes")
    own = rows.where("digest is not null").join(classes.select("rep"), F.col("conv_id") == F.col("rep"), "left_semi")
    own = stored(own.withColumnRenamed("conv_id", "rep"), "own")

    zero = F.lit(0).cast("long")
    over = classes.withColumns({"at": zero, "k1": zero, "k2": zero, "p1": zero, "p2": zero, "words": zero})
    tops, parts, stride = [], [], 1
    while True:
        # members at a split point give a top for each turn of this round, and a place behind it
        steps = own.join(over.select("rep", "at", F.col("k1").alias("from1"), F.col("k2").alias("from2")), "rep").where((F.col("pos") > F.col("at")) & (F.col("pos") <= F.col("at") + stride))
        run = Window.partitionBy("rep").orderBy("pos")
        for k in "12":
            steps = steps.withColumn(f"k{k}", F.col(f"from{k}").bitwiseXOR(F.bit_xor(f"z{k}").over(run))).withColumn(f"p{k}", F.col(f"k{k}").bitwiseXOR(F.col(f"z{k}")))
        steps = stored(steps.join(over.select("rep", "n", "length", "sha256"), "rep").select("rep", "n", "length", "sha256", "at", "pos", "k1", "k2", "p1", "p2", "words"), "steps")
        tops += [over, steps.where(F.col("pos") < F.col("at") + stride).withColumn("at", F.col("pos")).drop("pos")]
        ahead = steps.where(F.col("pos") == F.col("at") + stride).withColumn("at", F.col("pos")).drop("pos")
        sizes = stored(ahead.groupBy("k1", "k2").agg(F.sum(F.col("length") - F.col("at") + 1).alias("size")), "sizes")
        ahead = stored(ahead.join(sizes, ["k1", "k2"]), "ahead")
        parts.append(ahead.where(F.col("size") <= limit))
        over = ahead.where(F.col("size") > limit).drop("size")
        if over.isEmpty():
            break
        stride = min(2 * stride, STRIDE)

    columns = ["rep", "n", "length", "sha256", "at", "k1", "k2", "p1", "p2"]
    part = parts[0].select(*columns, "size")
    for more in parts[1:]:
        part = part.unionByName(more.select(*columns, "size"))
    turns_in = part.agg(F.sum(F.col("length") - F.col("at") + 1)).first()[0] or 0
    bucket = F.pmod(F.xxhash64("k1", "k2"), F.lit(turns_in // limit + 1))
    fed = own.select("rep", "pos", "digest", "words").join(part.select(*columns, bucket.alias("bucket")), "rep").where("pos >= at")
    built = stored(fed.groupBy("bucket").applyInPandas(build, NODES), "built")
    if not tops:
        return built
    members = tops[0].select(*columns, "words")
    for more in tops[1:]:
        members = members.unionByName(more.select(*columns, "words"))
    members = members.withColumnRenamed("at", "depth")

    ended = F.col("length") == F.col("depth")
    top = members.groupBy("k1", "k2", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("words").alias("words"), F.max(F.when(ended, F.col("sha256"))).alias("ends_sha256"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    top = stored(top, "tops")
    part_tops = built.where("top")
    above = top.where("depth > 0").select("p1", "p2", "depth").unionByName(part_tops.select("p1", "p2", "depth"))
    above = above.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    top = top.join(above, ["k1", "k2", "depth"], "left").fillna(0, ["n_children"])
    owned = top.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"), "k1", "k2", "n_children")
    owned = owned.unionByName(part_tops.select("conv_id", "depth", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")), allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    owned = stored(owned.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("saved", "leaves")}), "owned")
    sums = owned.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    inside = members.select("rep", "k1", "k2", "depth").join(stored(sums, "sums"), "rep").groupBy("k1", "k2", "depth").agg(F.sum("saved").alias("saved_all"), F.sum("leaves").alias("leaves_all"))
    same = ["k1", "k2", "depth"]
    counted = top.drop("n_children").join(inside, same).join(owned.where("k1 is not null").select(*same, "n_children", "saved_above", "leaves_above"), same)
    counted = stored(
        counted.select(
            *same, "conv_id", "n_convs", "n_children", (F.col("leaves_all") - F.col("leaves_above")).alias("n_leaves"),
            (F.col("saved_all") - F.col("saved_above")).alias("saved_tokens"), "ends_sha256", "p1", "p2",
        ), "counted",
    )
    parents = counted.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    linked = counted.drop("k1", "k2").withColumn("top", F.lit(True)).unionByName(part_tops.drop("parent_conv_id"))
    linked = linked.join(parents, ["p1", "p2", "depth"], "left").withColumnRenamed("parent", "parent_conv_id")
    return linked.select(*names).unionByName(built.where("not top").select(*names)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))
