"""Mixing sources to target weights (a multivariate-hypergeometric splitting tree).

Every source is cut into blocks: the documents are permuted by a keyed hash,
and block ``b`` of ``P`` holds the documents whose hash lies in the b-th of
``P`` equal ranges; ``P`` is proportional to the source's words, so blocks
have about equal numbers of words. A source whose target is ``r`` times its
size is drawn ``floor(r)`` times in full; a last pass takes the blocks in
a permuted order up to the target, the last block document by document, plus
the one untaken document whose size fits the rest best.

The block draws of all sources are then dealt to the output shards: a
binary tree over the shards splits the vector of draws by source with one
multivariate-hypergeometric draw in each node, which gives the same
distribution as shuffling all draws and cutting the list, but on counts only.
Each shard takes its next draws from each source's permuted list (disjoint by
construction), and its rows are ordered by a keyed hash inside the shard. What
a document is taken is the sum of what the shards drew.

Documents that agree in id and text share a place. Their copies are counted;
where the last block ends inside a place, or the place fills the rest, as many
of its copies are taken as fit (the copies of such a place are numbered from a
written table of just these rows, in parts, so a place may be large).

Bounds: the driver holds one row per source and one per block (``n_blocks``
plus the number of sources), never rows per document. Everything per
document is a hash expression and a join with the broadcast block plan, so
texts are not shuffled. All choices are functions of the seed, the document
and these counts: reruns agree.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, last in order; of rows that agree in id and text
any may be taken; an empty table gives no rows; columns of the
input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.llm.common import local_rows, materialise, pick, without, words
from prodlens.operators.ranking import prefix_sums

#: Sources of a mix are configured by name; this bounds the driver's list.
MAX_SOURCES = 100_000
#: Words of an output shard where the caller sets no number of shards.
SHARD_WORDS = 50_000_000


def default_weights(sources: list) -> dict:
    """Weights 1, 2, 3, 1, 2, 3, ... over the sources in code-point order,
    null last."""
    order = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def targets(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Share ``sum(sizes)`` by weight; a source stops at ``cap`` times its
    size and the excess is shared again by weight until none is above."""
    left, open_ = float(sum(sizes.values())), sorted(sizes, key=lambda s: (s is None, s or ""))
    out = {}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * unit > cap * sizes[s]]
        if not full:
            return out | {s: weights[s] * unit for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def splitting_tree(draws: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Split a vector of draws by source over ``n_shards`` shards of equal
    size (at most one apart): an array (shards, sources) whose rows have the
    distribution of a shuffled list of all draws cut into shards."""
    out = np.zeros((n_shards, len(draws)), dtype=np.int64)
    total = int(draws.sum())
    edges = [total * k // n_shards for k in range(n_shards + 1)]
    stack = [(0, n_shards, draws.astype(np.int64))]
    while stack:
        a, b, c = stack.pop()
        if b - a == 1:
            out[a] = c
            continue
        m = (a + b) // 2
        take = edges[m] - edges[a]
        left = rng.multivariate_hypergeometric(c, take, method="marginals") if take else np.zeros_like(c)
        stack += [(a, m, left), (m, b, c - left)]
    return out


@dataclass
class MixPlan:
    """The driver's plan: one row per source, per block, and per place that is
    taken in part (at most two a source)."""
    sources: DataFrame
    blocks: DataFrame
    parts: DataFrame


def _key(docs: DataFrame, key: str, text: str, seed: int) -> Column:
    """63-bit place of a document in the keyed permutation."""
    h = F.xxhash64(F.lit(seed), pick(docs, key, "string"), pick(docs, text, "string"))
    return F.shiftrightunsigned(h, 1)


def _block(k: Column, p: Column) -> Column:
    """Block of a place among ``p`` equal ranges."""
    return F.shiftright(F.shiftright(k, 32) * p, 31).cast("int")


def shards_for(total: int, n_shards: int | None) -> int:
    """``n_shards``, or shards of about ``SHARD_WORDS`` words, 64 at least."""
    return n_shards or max(64, -(-total // SHARD_WORDS))


def plan_mix(thin: DataFrame, weights=default_weights, cap: float = 3.0, n_shards: int | None = None,
             n_blocks: int = 16_384, seed: int = 42) -> MixPlan:
    """Plan over ``thin`` (source string, size long, k long)."""
    spark = thin.sparkSession
    found = thin.groupBy("source").agg(F.sum("size").alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError("a mix lists its sources; more than %d found" % MAX_SOURCES)
    size = {r["source"]: int(r["w"]) for r in found}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = targets(size, weights(names), cap) if names else {}
    total = max(1, sum(size.values()))
    n_shards = shards_for(total, n_shards)
    src = [(i, s, max(1, round(n_blocks * size[s] / total)), size[s], want[s])
           for i, s in enumerate(names)]
    sources = local_rows(spark, src, "sid int, source string, p long, source_size long, target double")
    placed = thin.join(F.broadcast(sources.withColumnRenamed("source", "s")),
                       F.col("source").eqNullSafe(F.col("s"))).select(
        "sid", _block(F.col("k"), F.col("p")).alias("block"), "k", "size")
    held: dict[int, dict[int, int]] = {i: {} for i in range(len(src))}
    for r in placed.groupBy("sid", "block").agg(F.sum("size").alias("w")).collect():
        held[r["sid"]][r["block"]] = int(r["w"])

    # block quotas of each source: full passes, then permuted blocks up to the target
    lists: list[list[tuple[int, int]]] = []
    edge: dict[int, tuple[int, int]] = {}  # the block where a source ends, words wanted of it
    last: dict[int, int] = {}              # and the pass in which it does
    taken: list[set] = []
    for i, _, _, w, t in src:
        rng = np.random.default_rng([seed, i])
        blocks = np.array(sorted(held[i]), dtype=np.int64)
        full = int(np.floor(t / w + 1e-9)) if w else 0
        rest = max(0, round(t - full * w))
        seq = [(int(b), p) for p in range(full) for b in rng.permutation(blocks)]
        got: set[int] = set()
        if rest:
            for b in map(int, rng.permutation(blocks)):
                seq.append((b, full))
                if held[i][b] > rest:
                    edge[i], last[i] = (b, rest), full
                    break
                got.add(b)
                rest -= held[i][b]
        lists.append(seq)
        taken.append(got)

    # the tree deals the quotas; each shard draws its next blocks of every source
    quotas = splitting_tree(np.array([len(x) for x in lists], dtype=np.int64), n_shards,
                            np.random.default_rng([seed, 1 << 30])) if src else np.zeros((n_shards, 0), np.int64)
    drawn_by: list[dict[int, list]] = [{b: [] for b in held[i]} for i in range(len(src))]
    edge_shard: dict[int, int] = {}
    at = [0] * len(src)
    for shard, quota in enumerate(quotas):
        for i, n in enumerate(quota):
            for b, p in lists[i][at[i]:at[i] + int(n)]:
                if i in edge and (b, p) == (edge[i][0], last[i]):
                    edge_shard[i] = shard
                else:
                    drawn_by[i][b].append((p, shard))
            at[i] += int(n)
    rows = [(i, b, draws) for i, by in enumerate(drawn_by) for b, draws in by.items()]
    blocks = local_rows(spark, rows, "sid int, block int, draws array<struct<pass:int,shard:int>>")
    cut, parts = _ends(spark, placed, edge, taken)
    src = [(*x, edge.get(x[0], (None,))[0], cut.get(x[0]), last.get(x[0]), edge_shard.get(x[0])) for x in src]
    sources = local_rows(spark, src, "sid int, source string, p long, source_size long, target double,"
                                     " edge_block int, cut_k long, edge_pass int, edge_shard int")
    return MixPlan(sources, blocks, local_rows(spark, parts, "sid int, k long, copies long"))


def _ends(spark, placed: DataFrame, edge: dict, taken: list[set]) -> tuple[dict, list]:
    """For each source with an end block: the last place that is taken whole
    in it, and the places that are taken in part (sid, k, copies): the one
    where the block ends, and the one whose size fits the remaining words best."""
    if not edge:
        return {}, []
    e = F.broadcast(local_rows(spark, [(i, b, rest) for i, (b, rest) in edge.items()], "sid int, block int, rest long"))
    places = placed.join(e, ["sid", "block"]).where("size > 0").groupBy("sid", "k", "rest").agg(
        F.count(F.lit(1)).alias("c"), F.min("size").alias("size"))
    run = places.withColumn("cum", F.sum(F.col("c") * F.col("size")).over(Window.partitionBy("sid").orderBy("k")))
    before = F.col("cum") - F.col("c") * F.col("size")
    rows = run.where(before <= F.col("rest")).groupBy("sid").agg(
        F.max(F.when(F.col("cum") <= F.col("rest"), F.col("k"))).alias("cut"),
        F.min(F.when(F.col("cum") > F.col("rest"), F.struct("k", "size", (F.col("rest") - before).alias("rest")))).alias("end"),
        F.min(F.col("rest") - F.col("cum")).alias("left")).collect()
    cut, left, part = {}, {}, {}
    for r in rows:
        i = r["sid"]
        cut[i] = -1 if r["cut"] is None else r["cut"]
        if r["end"] is None:
            left[i] = r["left"]
            continue
        n, rem = divmod(r["end"]["rest"], r["end"]["size"])
        left[i] = rem
        if n:
            part[i, r["end"]["k"]] = n
    want = [(i, edge[i][0], int(left[i]), cut[i]) for i in left if left[i] > 0]
    if want:
        s = F.broadcast(local_rows(spark, want, "sid int, eb int, rest long, k0 long"))
        d = F.broadcast(local_rows(spark, [(x[0], b) for x in want for b in taken[x[0]]], "sid int, block int"))
        # the place where the block ends has a copy left, too: fewer than all were taken
        off = F.abs(F.col("size") - F.col("rest"))
        open_ = (placed.join(s, "sid").join(d, ["sid", "block"], "left_anti").where("(block != eb or k > k0) and size > 0")
                 .withColumn("off", off).where("off < rest"))
        for r in open_.groupBy("sid").agg(F.min(F.struct("off", "k")).alias("b")).collect():
            at = (r["sid"], r["b"]["k"])
            part[at] = part.get(at, 0) + 1
    return cut, [(i, k, int(n)) for (i, k), n in part.items()]


def drawn(docs: DataFrame, plan: MixPlan, source: Column, k: Column) -> DataFrame:
    """(row, k, draws, target, source_size): ``row`` holds the columns of
    ``docs``, ``draws`` the pass and shard of each time the row is taken. Only
    rows of places that are taken in part are shuffled."""
    t = docs.select(F.struct("*").alias("row"), source.alias("src"), k.alias("k"))
    t = t.join(F.broadcast(plan.sources), F.col("src").eqNullSafe(F.col("source")), "left")
    t = t.withColumn("block", _block(F.col("k"), F.col("p")))
    t = t.join(F.broadcast(plan.blocks), ["sid", "block"], "left")
    t = t.join(F.broadcast(plan.parts), ["sid", "k"], "left")
    whole = F.coalesce((F.col("block") == F.col("edge_block")) & (F.col("k") <= F.col("cut_k")), F.lit(False))
    one = F.array(F.struct(F.col("edge_pass").alias("pass"), F.col("edge_shard").alias("shard")))

    def out(d: DataFrame, more: Column) -> DataFrame:
        return d.select("row", "k", F.when(more, F.concat("draws", one)).otherwise(F.col("draws")).alias("draws"), "target", "source_size")
    rest = out(t.where("copies is null"), whole)
    some = materialise(t.where("copies is not null").withColumn("uid", F.monotonically_increasing_id()))
    some = prefix_sums(some, ["sid", "k"], [F.col("uid")], F.shiftright("uid", 16), {"nth": F.lit(1).cast("long")}, inclusive=True)
    return rest.unionByName(out(some, F.col("nth") <= F.col("copies")))


def _thin(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(pick(docs, key, "long").alias("id"), pick(docs, source, "string").alias("source"),
                       words(pick(docs, text, "string")).alias("size"),
                       _key(docs, key, text, seed).alias("k"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=default_weights, cap: float = 3.0, n_shards: int | None = None, n_blocks: int = 16_384,
        seed: int = 42) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each time it is taken, plus
    ``mix_shard``, ``mix_pass`` and ``mix_order`` (order inside the shard)."""
    docs = without(docs, "mix_shard", "mix_pass", "mix_order")
    plan = plan_mix(materialise(_thin(docs, key, text, source, seed)), weights, cap, n_shards,
                    n_blocks, seed)
    out = drawn(docs, plan, pick(docs, source, "string"), _key(docs, key, text, seed))
    out = out.select("row", "k", F.explode("draws").alias("draw"))
    return out.select("row.*", F.col("draw.shard").alias("mix_shard"), F.col("draw.pass").alias("mix_pass"),
                      F.xxhash64(F.lit(seed + 1), "k", "draw.pass").alias("mix_order"))


def in_shard_order(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix`, each shard in one partition and shuffled by its
    order; shards hold about ``SHARD_WORDS`` words."""
    return mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write the shards as folders ``mix_shard=N``, each locally shuffled."""
    in_shard_order(mixed).write.partitionBy("mix_shard").parquet(path)


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               **kw) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words that the
    shards draw of it, repeats counted), source, and what each shard draws:
    ``shards``, an array of (shard, copies). Same plan and draws as :func:`mix`."""
    seed = kw.get("seed", 42)
    thin = materialise(_thin(docs, key, text, source, seed))
    d = drawn(thin, plan_mix(thin, **kw), F.col("source"), F.col("k"))
    shard = F.transform("draws", lambda x: x["shard"])
    by = F.transform(F.array_sort(F.array_distinct(shard)), lambda s: F.struct(
        s.alias("shard"), F.size(F.filter("draws", lambda x: x["shard"] == s)).alias("copies")))
    d = d.withColumn("shards", by)
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["copies"])
    return d.select(F.col("row.id").alias(key), F.col("row.size").alias("size"), "source_size", "target",
                    (taken * F.col("row.size")).alias("taken"), F.col("row.source").alias("source"),
                    taken.cast("int").alias("copies"), "shards")
