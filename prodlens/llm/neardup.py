"""Near duplicates by weighted MinHash from thrown darts, and banded joins.

A text is the set of its five-word shingles (``weights="set"``), or their
multiset (``"count"``). Similarity is the (weighted) Jaccard similarity.

*Signature.* Each shingle has a Poisson stream of darts over (weight, rank),
generated by hashing the shingle alone, strip by strip of the weight axis; a
dart hits a text if its weight lies below the shingle's weight there. Each
dart is hashed to one of ``k`` coordinates, and a coordinate keeps the hit of
the lowest rank. Ranks are only thrown up to the level where all coordinates
are expected to be filled (about ``k ln k + 2 k`` darts, however many shingles
there are); texts with an empty coordinate go on to twice that level. Two
texts agree in a coordinate with a probability equal to their similarity.

*Bands.* ``bands`` x ``rows`` coordinates; two texts meet if a band agrees.
At similarity 0.8 with 36 x 7, a pair is missed with probability 0.0002.

*Links.* Equal texts are one node (64-bit hash of the text; two texts of n
collide with probability n^2 / 2^65). In every band bucket all nodes are
compared with one of them, the one that meets the most nodes over all bands
(a star, so a bucket of m nodes gives m - 1 pairs). Nodes are then joined into components, and for buckets that still
hold several components the pairs across components are compared too, each
node outside the bucket's largest component against the others: those that
share an element of at most ``RARE`` nodes, and those that can reach the
threshold without such elements, by their sizes and by what each has in common
with the bucket's pivot (exact bounds). So no link between different components is lost, and a large
group of near copies costs one comparison per node and band, not the square.
Every pair is verified on its whole shingle sets (``>= threshold``).

*Components* by alternating large-star and small-star steps on the links,
each step written to the shared folder. Nothing per document or link reaches
the driver; a frame is broadcast only if its counted size is in bounds.

Edge cases: a text of one to four words is one shingle; texts without words
equal each other only if their characters are equal; a null text is a
class of its own; repeated rows share a class; a class's id is its smallest
key, null if all its keys are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm import kernels as K
from prodlens.llm.common import counted, hint_small, materialise, observed, pick

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of ``n`` weighted sets. ``element`` holds 64-bit
    hashes, ``weight`` positive weights, ``owner`` ascending set numbers.
    Sets without elements keep ``EMPTY``."""
    sig = np.full((n, k), EMPTY, dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    level = np.divide(k * np.log(max(k, 2)) + 2.0 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        sel = todo[owner]
        _throw(sig, element[sel], weight[sel], owner[sel], level)
        todo &= (sig == EMPTY).any(axis=1)
        sig[todo] = EMPTY
        level[todo] *= 2.0
    return sig


def _throw(sig: np.ndarray, element: np.ndarray, weight: np.ndarray, owner: np.ndarray, level: np.ndarray) -> None:
    """All darts of rank up to ``level`` (by set) that hit; the earliest per
    coordinate is kept, packed as rank (float32 bits) and dart number."""
    k = sig.shape[1]
    flat = sig.reshape(-1)
    strip, low = 0, 0.0
    while len(element):
        width = 1.0 if strip == 0 else low  # [0, 1), [1, 2), [2, 4), ...
        e, w, o = element, weight, owner
        rank = np.zeros(len(e))
        turn = 0
        base = K.mix(e + U(strip * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        while len(e):
            h = K.mix(base + U((turn + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(K.unit(h)) / width
            live = rank <= level[o]
            e, w, o, base, rank, h = e[live], w[live], o[live], base[live], rank[live], h[live]
            at = K.mix(h ^ U(0x5851F42D4C957F2D))
            hit = low + K.unit(K.mix(at)) * width < w
            cell = o[hit] * k + (at[hit] % U(k)).astype(np.int64)
            dart = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (at[hit] >> U(32))
            np.minimum.at(flat, cell, dart)
            turn += 1
        low += width
        strip += 1
        more = weight > low
        element, weight, owner = element[more], weight[more], owner[more]


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, (n, bands); the band's number is mixed in."""
    acc = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        acc = K.mix(acc) * U(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands]
    return K.mix(acc)


def shingle_sets(s: K.Slice, width: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight) of the distinct shingles of each text."""
    h, who = K.shingles(s, width)
    g, v, c = K.runs(who, h)
    return g, v, (c if weights == "count" else np.ones(len(c))).astype(np.float64)


def node_of(text: Column) -> Column:
    return F.xxhash64(text)


def signatures(docs: DataFrame, key: str, text: str, bands: int, rows: int, width: int, weights: str) -> DataFrame:
    """(key, node, total, bands): a row per document; node is null for a null text."""
    t = pick(docs, text, "string")
    d = docs.select(t.alias("text"), pick(docs, key, "long").alias("id"),
                    F.when(t.isNotNull(), node_of(t)).alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in K.slices(b.column(0)):
                g, v, w = shingle_sets(s, width, weights)
                sig = dart_signatures(v, w, g, s.n, bands * rows)
                full = sig[:, 0] != EMPTY
                hashes = band_hashes(sig[full], bands, rows).view(np.int64)
                offs = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                part = b.slice(s.lo, s.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(np.bincount(g, weights=w, minlength=s.n)),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(hashes.reshape(-1)))],
                    names=["id", "node", "total", "bands"])
    return d.mapInArrow(run, "id long, node long, total double, bands array<long>")


def node_shingles(docs: DataFrame, nodes: DataFrame, n_nodes: int, text: str, width: int, weights: str) -> DataFrame:
    """(node, elements): the shingle set of each node; with ``count`` weights
    the j-th occurrence of a shingle is an element of its own."""
    t = pick(docs, text, "string")
    d = docs.select(t.alias("text"), node_of(t).alias("node")).where("text is not null")
    d = d.join(hint_small(nodes, n_nodes, 16), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in K.slices(b.column(0)):
                g, v, w = shingle_sets(s, width, weights)
                if weights == "count":
                    c = w.astype(np.int64)
                    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    g, v = np.repeat(g, c), K.mix(np.repeat(v, c) + nth.astype(np.uint64))
                offs = np.searchsorted(g, np.arange(s.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(s.lo, s.n), pa.ListArray.from_arrays(pa.array(offs), pa.array(v.view(np.int64)))],
                    names=["node", "elements"])
    d = d.select("text", "node").mapInArrow(run, "node long, elements array<long>")
    return d.groupBy("node").agg(F.first("elements").alias("elements"))


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with ``i``, the number of common elements, and ``link``,
    whether the sets are at least ``threshold`` similar."""
    sa = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    sb = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    j = pairs.join(sb, "b").join(sa, "a")
    j = j.select("a", "b", F.size(F.array_intersect("ea", "eb")).alias("i"), (F.size("ea") + F.size("eb")).alias("n"))
    return j.select("a", "b", "i", (F.col("i") >= threshold * (F.col("n") - F.col("i")) - 1e-9).alias("link"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    return compared(pairs, sets, threshold).where("link").select("a", "b")


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b) that are not the smallest
    of their component; root is that smallest node. Large-star and small-star
    steps until both leave the links as they are."""
    e, state = _step(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(max_steps):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e, now = _step(small)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle in %d steps" % max_steps)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _step(e: DataFrame) -> tuple[DataFrame, dict]:
    """The links, written, and what tells whether they changed."""
    return observed(e, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("sum"),
                    F.bit_xor(F.xxhash64("u", "v")).alias("xor"))


#: Elements that at most so many nodes have are rare.
RARE = 8


def rare_elements(sets: DataFrame) -> DataFrame:
    """(e, node, n): the elements that at most ``RARE`` nodes have."""
    e = sets.select("node", F.explode("elements").alias("e"))
    few = e.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= RARE)
    return e.join(few, "e")


def _slab(size: Column) -> Column:
    """Sizes in steps of one per cent."""
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.lit(float(np.log(1.01)))).cast("int")


def links(sigs: DataFrame, docs: DataFrame, text: str, threshold: float, width: int, weights: str) -> tuple[DataFrame, DataFrame]:
    """(verified links, components) between nodes."""
    reps = materialise(sigs.where("node is not null").groupBy("node").agg(
        F.first("total").alias("total"), F.first("bands").alias("bands")))
    rows = reps.select(F.explode("bands").alias("bucket"), "node", "total")
    crowded = (rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("m"))
               .where("lo != hi").select("bucket", "m"))
    members = materialise(rows.join(crowded, "bucket"))
    # the pivot of a bucket is its node with the most company over all bands:
    # in a group of near copies that is the text the others were made from
    nodes, n_nodes = counted(members.groupBy("node").agg(F.sum("m").alias("company"), F.first("total").alias("total")))
    pivots = (members.select("bucket", "node").join(nodes.select("node", "company"), "node")
              .groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("p"))
              .select("bucket", F.col("p.node").alias("pivot")))
    members = materialise(members.select("bucket", "node", "total").join(pivots, "bucket"))
    sets = materialise(node_shingles(docs, nodes.select("node"), n_nodes, text, width, weights))

    def near(p: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the threshold."""
        return p.where(F.least("ta", "tb") >= threshold * F.greatest("ta", "tb") - 1e-9).select("a", "b")

    size_a = nodes.select(F.col("node").alias("a"), F.col("total").alias("ta"))
    star = (members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("total").alias("tb"))
            .distinct().join(size_a, "a"))
    arms = materialise(compared(near(star), sets, threshold))
    first = arms.where("link").select("a", "b")
    comp = components(first)

    # buckets that hold several components: compare across them
    m = members.join(comp, "node", "left").select("bucket", "pivot", "node", "total", F.coalesce("root", "node").alias("root"))
    split = (m.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket"))
    # what each member has in common with its bucket's pivot, where they were compared
    arm = arms.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "i")
    m, n_split = counted(m.join(split, "bucket").join(arm, ["pivot", "node"], "left"))
    if not n_split:
        return first, comp
    count = m.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("x")).select("bucket", F.col("x.root").alias("main"))
    left = materialise(m.join(main, "bucket").where("root != main")
                       .select("bucket", "pivot", F.col("node").alias("x"), F.col("root").alias("rx"),
                               F.col("total").alias("ta"), F.col("i").alias("ix"), "main"))
    rare = materialise(rare_elements(sets))
    own = materialise(rare.groupBy("node").agg(F.count(F.lit(1)).alias("u")))
    # pairs that share a rare element: at most RARE - 1 for each such element
    roots = (nodes.join(comp, "node", "left").select("node", "total", F.coalesce("root", "node").alias("root")))
    shared = rare.where("n > 1").select("e", "node").join(roots, "node")
    astray = left.select(F.col("x").alias("node")).distinct()
    one = shared.join(astray, "node", "left_semi").select("e", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("total").alias("ta"))
    two = shared.select("e", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("total").alias("tb"))
    kin = (one.join(two, (one["e"] == two["e"]) & F.expr("rx != ry") & (F.least("ta", "tb") >= threshold * F.greatest("ta", "tb") - 1e-9))
           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ta", "tb"))
    kin = materialise(near(kin).distinct())  # each kind by itself: a smaller plan, fewer joins at a time
    # other pairs share no rare element: each node has only ``total - u`` to share
    left = left.join(own.withColumnRenamed("node", "x"), "x", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    of_pivot = own.select(F.col("node").alias("pivot"), F.col("u").alias("up"))
    left = left.join(of_pivot, "pivot", "left").withColumn("up", F.coalesce("up", F.lit(0)))
    # which partner sizes can reach the threshold?
    c = F.col("ta") - F.col("u")
    top = F.greatest(c, c / threshold - F.col("u"))
    left = (left.where(F.col("u") <= (1 - threshold) * F.col("ta") + 1e-9).withColumn("top", top)
            .withColumn("slab", F.explode(F.sequence(_slab(threshold * F.col("ta")), _slab(F.col("top"))))))
    right = m.join(own, "node", "left").select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("total").alias("tb"),
                                               F.col("i").alias("iy"), F.coalesce("u", F.lit(0)).alias("v"), _slab(F.col("total")).alias("slab"))
    # elements that x and y can share: not the rare ones; inside the pivot's set
    # at most what either has of it, outside at most what is left of either
    def out(t: str, i: str, u: str) -> Column:
        rest = F.col(t) - F.col(i)
        return F.greatest(F.least(rest, rest - F.col(u) + F.col("up")), F.lit(0))
    most = F.least(F.col("ta") - F.col("u"), F.col("tb") - F.col("v"))
    inside = F.least("ix", "iy") + F.least(out("ta", "ix", "u"), out("tb", "iy", "v"))
    most = F.when(F.col("ix").isNotNull() & F.col("iy").isNotNull(), F.least(most, inside)).otherwise(most)
    cross = (left.join(right, (left["bucket"] == right["bucket"]) & (left["slab"] == right["slab"]) & F.expr(
                "rx != ry and (ry = main or x < y) and x != pivot and y != pivot")
                & (most >= threshold * (F.col("ta") + F.col("tb") - most) - 1e-9))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ta", "tb"))
    cross = materialise(near(cross).distinct())
    second, n_second = counted(verified(cross.unionByName(kin).distinct(), sets, threshold))
    known = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return first.unionByName(second), (components(known.unionByName(second)) if n_second else comp)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 36,
            rows: int = 7, width: int = 5, weights: str = "set") -> DataFrame:
    """Per document: key, ``node`` (hash of its text), ``class`` (smallest node
    of its class), ``class_id`` (smallest key of its class) and ``class_size``."""
    sigs = materialise(signatures(docs, key, text, bands, rows, width, weights))
    _, comp = links(sigs, docs, text, threshold, width, weights)
    ids = sigs.where("node is not null").select("id", "node").join(comp, "node", "left")
    ids = ids.select("id", "node", F.coalesce("root", "node").alias("class"))
    per = ids.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = ids.join(per, "class").select("id", "node", "class", "class_id", "class_size")
    alone = sigs.where("node is null").select("id", "node", F.col("node").alias("class"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone).withColumnRenamed("id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest key
    (null keys last). Of rows that agree in key and text one stays."""
    c = materialise(classes(docs, key, text, **kw).withColumnRenamed(key, "id"))
    big = c.where("class_size > 1 and node is not null")
    # the winner of a class has the class's key and, among such rows, the smallest node
    first = big.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("node").alias("_n"))
    lose = big.join(first, "class").where(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_n"))))
    lose, n_lose = counted(lose.select(F.col("id").alias("i"), F.col("node").alias("n")).distinct())
    t = pick(docs, text, "string")
    # the row is a struct, so that no name of its columns meets one of ours
    d = docs.select(F.struct("*").alias("row"), pick(docs, key, "long").alias("did"), F.when(t.isNotNull(), node_of(t)).alias("dnode"))
    hit = (F.col("dnode") == F.col("n")) & F.col("did").eqNullSafe(F.col("i"))
    d = d.join(hint_small(lose, n_lose, 24), hit, "left_anti")
    twice, n_twice = counted(c.where("node is not null").groupBy(F.col("id").alias("i"), F.col("node").alias("n"))
                             .agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    if not n_twice:
        return d.select("row.*")
    again = hint_small(twice, n_twice, 24)
    rest = d.join(again, hit, "left_anti")
    one = d.join(again, hit, "left_semi").dropDuplicates(["did", "dnode"])
    return rest.unionByName(one).select("row.*")


def class_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per document: key, class_id, class_size."""
    return classes(docs, key, text, **kw).select(key, "class_id", "class_size")
