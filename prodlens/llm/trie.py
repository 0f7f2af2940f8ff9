"""A trie of conversation prefixes by collapsing whole sequences.

Conversations are rebuilt first: the first ``h`` turns come from the first
conversation of their group of ``group`` ids, the rest from the conversation
itself, ``h`` = crc32 of the id modulo ``heads``. A rebuilt conversation is a
sequence of turns (role, text); identical ones collapse into one weighted
sequence with the list of conversations that end there. Only one conversation
of each sequence is then spread over its prefixes, so a conversation that is
repeated a million times costs its prefixes once.

A prefix is named by its depth and four running sums of 32-bit pieces of
(position, turn) hashes: 128 bits that need no text and no list. A node is the
group of equal names. A sequence whose own node is a proper prefix of another
sequence is no leaf (anti-join of the sequences with the inner nodes).

What a shared cache of prefixes saves below a node u, the sum of
(members - 1) x words of the last turn over u's subtree, needs no pairs of
nodes and ancestors. Every sequence s through u has weight m(s), words W(s),
and owns the nodes whose smallest member it holds, a tail of its path with
O(s) words; before(u) are the words above u. Then

* members x words over the subtree = sum of m(s) W(s) - members(u) before(u)
* words over the subtree = sum of O(s), the owner of u counted with
  W(s) - before(u) in place of O(s)

and both are plain sums over the sequences through u.

Scale: texts are read once and become 128-bit hashes. Positions and running
sums are taken in blocks of ``BLOCK`` turns (``ranking.prefix_sums``), so a
long conversation isn't one task; sums by node combine before the shuffle;
joins on a hot node or conversation are split by AQE. The list of conversations
that end at a node is joined to text in blocks of ``IDS`` ids, and a node's
digest is streamed over its blocks (a digest of one list is serial by nature).

Edge cases: a null role or text is empty; null turns come first; rows that tie
in turn are ordered by the MD5 of role and text, equal rows all count; a
conversation whose base is absent or short has fewer head turns; a rebuilt
conversation without turns ends at the root; rows without a conversation id
belong to no conversation and are left out; an empty table has no nodes; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import materialise, pick, words
from prodlens.operators.ranking import prefix_sums

#: Turns per block of a running sum; ids per block of an end list.
BLOCK, IDS = 1024, 4096
KEYS = ["k1", "k2", "k3", "k4"]


def turns(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(c, pos, id, words): the turns of each conversation, numbered from 1;
    ``id`` is the MD5 of role and text."""
    role, text = (F.coalesce(pick(convs, n, "string"), F.lit("")) for n in ("role", "text"))
    d = convs.select(pick(convs, key, "long").alias("c"), pick(convs, "turn", "long").alias("turn"),
                     F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
                     words(text).alias("words")).where("c is not null")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2 ** 54)))  # does not fall along the turns
    out = prefix_sums(d, ["c"], [F.col("turn").asc_nulls_first(), F.col("id")], block,
                      {"pos": F.lit(1).cast("long")}, inclusive=True)
    return out.select("c", "pos", "id", "words")


def pieces(pos: Column, turn: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at its position."""
    low = F.lit((1 << 32) - 1).cast("long")
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), pos, turn)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(low)]
    return out


def rebuild(t: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, pos, k1 to k4, words) of the rebuilt conversations, and (c) of all."""
    size = t.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads))
    base = size.select(F.col("c").alias("b"), F.col("n").alias("have"))
    plan = size.select("c", h.alias("h"), (F.col("c") - F.col("c") % group).alias("b")).join(base, "b", "left")
    plan = materialise(plan.select("c", "b", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("m")))
    own = t.join(plan, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "words")
    first = t.where(F.col("pos") < heads).where(F.col("c") % group == 0).withColumnRenamed("c", "b")
    head = plan.join(first, "b").where("pos <= m").select("c", "pos", "id", "words")
    both = own.unionByName(head)
    return (both.select("c", "pos", *[p.alias(k) for p, k in zip(pieces(F.col("pos"), F.col("id")), KEYS, strict=True)], "words"),
            plan.select("c"))


def _node(depth: Column) -> Column:
    return F.concat_ws("-", depth, *[F.hex(k) for k in KEYS])


def sequences(rebuilt: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weighted sequences (node, length, rep, weight, total) and the ends
    (node, c): the node where each conversation ends."""
    s = rebuilt.groupBy("c").agg(F.count(F.lit(1)).alias("length"), *[F.sum(k).alias(k) for k in KEYS],
                                 F.sum("words").alias("total"))
    none = {n: 0 for n in ("length", *KEYS, "total")}
    s = ids.join(s, "c", "left").fillna(none)
    ends = materialise(s.select("c", _node(F.col("length")).alias("node"), "length", "total"))
    seq = ends.groupBy("node").agg(F.min("length").alias("length"), F.min("c").alias("rep"),
                                   F.count(F.lit(1)).alias("weight"), F.min("total").alias("total"))
    return materialise(seq), ends.select("node", "c")


def prefixes(rebuilt: DataFrame, seq: DataFrame) -> DataFrame:
    """(rep, depth, node, parent, upto, last): every prefix of every sequence,
    spread over one conversation of it; ``upto`` counts its words."""
    rows = rebuilt.join(seq.select(F.col("rep").alias("c")), "c", "left_semi")
    run = prefix_sums(rows.withColumnRenamed("words", "last"), ["c"], [F.col("pos")], F.floor(F.col("pos") / BLOCK),
                      {"r" + k: F.col(k) for k in KEYS} | {"upto": F.col("last")}, inclusive=True)
    sums = [F.col("r" + k).alias(k) for k in KEYS]
    before = [(F.col("r" + k) - F.col(k)).alias(k) for k in KEYS]
    run = run.select("c", "pos", "upto", "last", F.struct(*sums).alias("at"), F.struct(*before).alias("up"))

    def name(s: str, depth: Column) -> Column:
        return F.concat_ws("-", depth, *[F.hex("%s.%s" % (s, k)) for k in KEYS])
    deep = run.select(F.col("c").alias("rep"), F.col("pos").alias("depth"), name("at", F.col("pos")).alias("node"),
                      name("up", F.col("pos") - 1).alias("parent"), "upto", "last")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    root = seq.select("rep", zero.alias("depth"), F.lit("-".join(["0"] * (len(KEYS) + 1))).alias("node"), none.alias("parent"),
                      zero.alias("upto"), zero.alias("last"))
    return materialise(deep.unionByName(root))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal ids that end at a node,
    ascending and comma-joined."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def rows(out):
            return pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("node", pa.string()), ("at", pa.int64()), ("ids", pa.string())]))

        def block():
            return {"node": node, "at": ids[0], "ids": ",".join(map(str, ids))}
        for b in batches:
            out = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == IDS):
                    out.append(block())
                    ids = []
                node = n
                ids.append(c)
            yield rows(out)
        if ids:
            yield rows([block()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def rows(out):
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("node", pa.string()), ("ends_sha256", pa.string())]))
        for b in batches:
            out = []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node:
                    if sha:
                        out.append({"node": node, "ends_sha256": sha.hexdigest()})
                    node, sha = n, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield rows(out)
        if sha:
            yield rows([{"node": node, "ends_sha256": sha.hexdigest()}])
    cut = (ends.select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c")
           .mapInArrow(blocks, "node string, at long, ids string"))
    return (cut.repartition("node").sortWithinPartitions("node", "at").select("node", "ids")
            .mapInArrow(digest, "node string, ends_sha256 string"))


def conversation_trie(convs: DataFrame, key: str = "conv_id", group: int = 20, heads: int = 4) -> DataFrame:
    """A row per node: its smallest member, depth, the parent's smallest
    member, members, children, leaves, tokens saved and the digest of the
    conversations that end there."""
    t = materialise(turns(convs, key))
    rebuilt, ids = rebuild(t, group, heads)
    rebuilt = materialise(rebuilt)
    seq, ends = sequences(rebuilt, ids)
    pre = prefixes(rebuilt, seq)

    who = seq.select("rep", "weight", "total", "length")
    node = pre.join(who, "rep").groupBy("node").agg(
        F.min("rep").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.sum("weight").alias("n_convs"), F.min(F.col("upto") - F.col("last")).alias("before"),
        F.sum(F.col("weight") * F.col("total")).alias("member_words"),
        F.max(F.col("depth") < F.col("length")).alias("inner"))
    node = materialise(node)

    # the leaves, and the words that each sequence owns
    leaf = seq.join(node.where("inner").select("node"), "node", "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    owned = node.groupBy(F.col("conv_id").alias("rep")).agg(F.min_by("before", "depth").alias("above"))
    share = seq.select("rep", "total").join(owned, "rep", "left").join(leaf, "rep", "left").select(
        "rep", "total", F.coalesce(F.col("total") - F.col("above"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = pre.select("rep", "node").join(materialise(share), "rep").groupBy("node").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("own").alias("own_words"),
        F.min(F.struct("rep", "total", "own")).alias("first"))

    up = node.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = node.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    out = (node.join(sums, "node").join(kids, "node", "left").join(end_digests(ends), "node", "left")
           .join(up, "parent", "left"))
    once = F.col("own_words") - F.col("first.own") + F.col("first.total") - F.col("before")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", (F.col("member_words") - F.col("n_convs") * F.col("before") - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
