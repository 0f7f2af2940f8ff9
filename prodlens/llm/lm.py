"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words with A-Z lower-cased, and an end token after each text.
Unigrams and bigrams of the training texts are counted exactly (per task in
numpy, then summed in Spark). A count ``c`` is quantised to ``q = 1 +
floor(log2 c)`` and the n-gram is entered ``q`` times, as (n-gram, 1) ..
(n-gram, q). The filter is broadcast; a lookup probes levels 1, 2, .. until
one is missing, and the level reached stands for the count. Errors are
one-sided: a false hit can only raise a level. A level's value is the mean
count of the training n-grams on it, taken apart for tokens and for bigrams, so
that the estimates add up to the counts.

``score`` is the log10 probability of the text in the model
``P(w | v) = k(v) c(v, w) / c(v) + (1 - k(v)) P(w)``, with all counts from
the filter, ``k(v) = share * c(v) / (c(v) + PRIOR)`` and add-0.1 unigrams.
Over the vocabulary ``P(w)`` adds up to 1, and ``P(w | v)`` to 1 within
a hundredth or two on average; a single context is off by ``k(v)`` times what
its own count and those of its bigrams differ from their levels' means.
``base_score`` is the exact add-0.1 unigram score: the most frequent
``head`` tokens are looked up in a broadcast table (its number of rows is a
parameter), the occurrences of all others are joined with the count table.
Tokens beyond the head are rare, so this join has no hot key.

The filter is built by segments: n-grams are dealt by segment, each task sets
the bits of its segments. The number of segments follows the number of entries
(``bits_per_entry``) at every size. Up to ``max_bits`` the finished segments
are broadcast; a larger filter stays a table, and the distinct n-grams of
each block of texts are sent to their segments by a shuffle, packed in order, and
only their levels come back, a byte each, in that order (the ``head`` most
frequent n-grams are answered from a broadcast instead). The blocks go in
``ROUNDS`` rounds, and the shuffle files of a round are gone before the next.
Both ways look into the same bits and give the same scores.
All counted bigrams are entered (``min_bigram`` = 1); a larger value leaves
out those seen less often.

Edge cases: a null or empty text has one token, the end; null keys are held
out (crc32 of the empty text); repeated rows are learnt from and scored one
by one; with no training text all counts are 0 and N and V are 0; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm import kernels as K
from prodlens.llm.common import discard, materialise, pick

U = np.uint64
END, START = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
SEGMENT_BITS = 1 << 20
PROBES = 5
PRIOR = 50.0
#: Of the filter that is looked up by a shuffle: bytes of text in a block,
#: segments that are looked up together, rounds of blocks.
BLOCK_BYTES, GROUP_SEGMENTS, ROUNDS = 8 << 20, 8, 4


def held_out(key: Column, modulus: int = 10) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == 0


def tokens(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, text of each token), the end token last in each text.
    The lowest bit of a token's hash is 0."""
    n = len(s.starts) + s.n
    h = np.empty(n, dtype=np.uint64)
    ends = s.first[1:] + np.arange(s.n)
    mask = np.ones(n, dtype=bool)
    mask[ends] = False
    h[mask] = s.word_hashes(fold=True)
    h[ends] = END
    return h & ~U(1), np.repeat(np.arange(s.n), s.n_words + 1)


def bigrams(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous token, bigram hash) of each token; lowest bit 1."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[np.r_[True, owner[1:] != owner[:-1]]] = START & ~U(1)
    return prev, K.mix(prev * U(0x9E3779B97F4A7C15) + h) | U(1)


def count_ngrams(texts: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(h, c): counts of tokens (even h), bigrams (odd h) and of the start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for s in K.slices(b.column(0)):
                h, owner = tokens(s)
                held += [h, bigrams(h, owner)[1], np.full(s.n, START & ~U(1))]
                size += 2 * len(h) + s.n
                if size >= 2 * flush:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    rows = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "h long, c long")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    v, c = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])


class LogFrequencyFilter:
    """Quantised counts in one Bloom filter of equal segments; ``top`` is the
    largest level entered (a count has 63 bits at most)."""

    def __init__(self, bits: np.ndarray, top: int = 63):
        self.bits = bits  # (segments, SEGMENT_BITS / 8) uint8
        self.top = top

    @staticmethod
    def segment(h: np.ndarray, n: int) -> np.ndarray:
        return ((h >> U(20)) % U(n)).astype(np.int64)

    @staticmethod
    def places(h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Bit places inside the segment, one array per probe."""
        x = K.mix(h + U(level * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        step = K.mix(x) | U(1)
        for _ in range(PROBES):
            yield (x >> U(44)).astype(np.int64)  # 20 bits
            x = x + step

    def levels(self, h: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """The level each n-gram reaches; 0 if it isn't there. ``row``: where
        each one's segment is in ``bits``, if these are not all segments."""
        out = np.zeros(len(h), dtype=np.int64)
        at, level = np.arange(len(h)), 0
        while len(at) and level < self.top:
            level += 1
            g = h[at]
            seg = self.segment(g, len(self.bits)) if row is None else row[at]
            ok = np.ones(len(at), dtype=bool)
            for p in self.places(g, level):
                ok &= (self.bits[seg, p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            at = at[ok]
            out[at] = level
        return out


def quantised(c: Column) -> Column:
    return (F.floor(F.log2(c.cast("double")) + F.lit(1e-9)) + 1).cast("int")


@dataclass
class Estimates:
    """What levels stand for: the mean count of tokens and of bigrams by level
    (0 at level 0)."""
    token: np.ndarray
    bigram: np.ndarray


def level_values(grams: DataFrame) -> Estimates:
    """Mean counts of the training n-grams ``grams`` (h, c); at most 64 levels."""
    q = quantised(F.col("c"))
    out = np.zeros((2, 65))
    for r in grams.groupBy(F.col("h").bitwiseAND(F.lit(1)).alias("odd"), q.alias("q")).agg(F.avg("c").alias("c")).collect():
        out[r["odd"], r["q"]] = r["c"]
    for v in out:  # a level that no n-gram has is only reached by a false hit
        for i in range(1, 65):
            v[i] = v[i] or (1.0 if i == 1 else 1.5 * 2.0 ** (i - 1))
    return Estimates(out[0], out[1])


def build_segments(grams: DataFrame, bits_per_entry: int = 12) -> tuple[DataFrame, int, int]:
    """((seg, bits), segments, largest level) of the filter of ``grams`` (h, c).
    A segment without entries has no row."""
    g = grams.select("h", quantised(F.col("c")).alias("q"))
    r = g.agg(F.sum("q"), F.max("q")).first()
    n = max(1, -(-(r[0] or 0) * bits_per_entry // SEGMENT_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            q = b.column(1).to_numpy()
            for level in range(1, int(q.max(initial=0)) + 1):
                x = h[q >= level]
                seg = LogFrequencyFilter.segment(x, n)
                order = np.argsort(seg, kind="stable")
                x, seg = x[order], seg[order]
                edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
                for a, e in zip(edges[:-1], edges[1:], strict=True):
                    if int(seg[a]) not in made:
                        made[int(seg[a])] = np.zeros(SEGMENT_BITS, dtype=bool)
                    m = made[int(seg[a])]
                    for p in LogFrequencyFilter.places(x[a:e], level):
                        m[p] = True
        for k, m in made.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())],
                names=["seg", "bits"])

    tasks = max(1, n // 8)  # about eight segments, a megabyte, in a task
    return materialise(g.repartition(tasks, segment_of("h", n)).mapInArrow(run, "seg int, bits binary"), lean=True), n, int(r[1] or 0)


def segment_of(h: str, n: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(n)).cast("int")


def collect_segments(segments: DataFrame, n: int) -> np.ndarray:
    """The filter's bits as (segments, bytes)."""
    t = segments.toArrow()
    bits = np.zeros((n, SEGMENT_BITS // 8), dtype=np.uint8)
    for k, m in zip(t.column("seg").to_pylist(), t.column("bits"), strict=True):
        bits[k] = np.frombuffer(m.as_buffer(), dtype=np.uint8)
    return bits


def build_filter(grams: DataFrame, bits_per_entry: int = 12) -> np.ndarray:
    """Bits of the filter of ``grams`` (h, c), as (segments, bytes)."""
    segments, n, _ = build_segments(grams, bits_per_entry)
    return collect_segments(segments, n)


def frequent(grams: DataFrame, head: int) -> np.ndarray:
    """The most frequent n-grams, ``head`` at most."""
    return grams.where(F.col("c") >= head_cut(grams, head)).select("h").toArrow().column("h").to_numpy().view(np.uint64)


def known_levels(segments: DataFrame, h: np.ndarray, n: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams ``h`` in order, and their levels: looked up where the segments are."""
    h = np.sort(h)
    held = segments.sparkSession.sparkContext.broadcast(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogFrequencyFilter.segment(held.value, n)
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = np.flatnonzero(own == k)
                level = LogFrequencyFilter(np.frombuffer(m.as_buffer(), np.uint8)[None, :], top).levels(held.value[at], np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(level)], names=["at", "level"])

    t = segments.select("seg", "bits").mapInArrow(run, "at long, level long").toArrow()
    levels = np.zeros(len(h), dtype=np.uint8)
    levels[t.column("at").to_numpy()] = t.column("level").to_numpy()
    held.destroy()
    return h, levels


def group_probes(texts: pa.Array, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, where they are in ``known`` or -1, order to send the others
    in): the distinct n-grams of the texts, sorted; those to be sent are dealt
    by group of segments."""
    found = [np.array([START & ~U(1)])]
    for s in K.slices(texts):
        h, owner = tokens(s)
        found.append(np.unique(np.r_[h, bigrams(h, owner)[1]]))
    grams = np.unique(np.concatenate(found))
    at = np.full(len(grams), -1)
    if len(known):
        near = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        at = np.where(known[near] == grams, near, -1)
    ask = np.flatnonzero(at < 0)
    group = LogFrequencyFilter.segment(grams[ask], n) // GROUP_SEGMENTS
    return grams, at, ask[np.argsort(group, kind="stable")]


def lookup(probes: DataFrame, segments: DataFrame, n: int, top: int) -> DataFrame:
    """(block, part, levels) of packed n-grams ``probes`` (part, block, grams): a
    part is a group of segments and meets all its n-grams in one place."""
    def run(seg: pa.Table, probe: pa.Table) -> pa.Table:
        levels = []
        if probe.num_rows:
            first = probe.column("part")[0].as_py() * GROUP_SEGMENTS
            bits = np.zeros((GROUP_SEGMENTS, SEGMENT_BITS // 8), dtype=np.uint8)
            for k, m in zip(seg.column("seg").to_pylist(), seg.column("bits"), strict=True):
                bits[k - first] = np.frombuffer(m.as_buffer(), dtype=np.uint8)
            lff = LogFrequencyFilter(bits, top)
            for m in probe.column("grams"):
                h = np.frombuffer(m.as_buffer(), dtype=np.uint64)
                levels.append(lff.levels(h, LogFrequencyFilter.segment(h, n) - first).astype(np.uint8).tobytes())
        return pa.table({"block": probe.column("block"), "part": probe.column("part"), "levels": pa.array(levels, pa.binary())})

    s = segments.select(F.floor(F.col("seg") / GROUP_SEGMENTS).cast("int").alias("part"), "seg", "bits")
    return s.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(run, "block long, part int, levels binary")


def token_probabilities(h: np.ndarray, owner: np.ndarray, levels, est: Estimates, total: int, kinds: int, share: float) -> np.ndarray:
    """``P(w | v)`` of every token; ``levels`` gives the level of each n-gram."""
    distinct, back = np.unique(h, return_inverse=True)
    uni = est.token[levels(distinct)][back]
    p0 = (uni + 0.1) / (total + 0.1 * (kinds + 1))
    prev, bi = bigrams(h, owner)
    pairs, pback = np.unique(bi, return_inverse=True)
    cb = est.bigram[levels(pairs)][pback]
    ctx = np.empty_like(uni)
    ctx[1:] = uni[:-1]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ctx[first] = est.token[levels(prev[first[:1]])]
    k = share * ctx / (ctx + PRIOR)
    cond = np.minimum(1.0, np.divide(cb, ctx, out=np.zeros_like(cb), where=ctx > 0))
    return k * cond + (1.0 - k) * p0


def model_scores(h: np.ndarray, owner: np.ndarray, n: int, levels, est: Estimates, total: int, kinds: int, share: float) -> np.ndarray:
    """``score`` of ``n`` texts."""
    p = token_probabilities(h, owner, levels, est, total, kinds, share)
    return np.bincount(owner, weights=np.log10(p), minlength=n)


def shuffled_scores(blocks: DataFrame, segments: DataFrame, n: int, top: int, common: tuple[np.ndarray, np.ndarray],
                    est: Estimates, total: int, kinds: int, share: float) -> DataFrame:
    """(row, score) of ``blocks`` (block, number, row, text), by lookups in the
    filter's table; ``common`` are n-grams whose levels are known."""
    known = blocks.sparkSession.sparkContext.broadcast(common)

    def ask(part: pa.Table) -> pa.Table:
        grams, _, order = group_probes(part.column("text"), known.value[0], n)
        h = grams[order]
        group = LogFrequencyFilter.segment(h, n) // GROUP_SEGMENTS
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(h) else np.zeros(1, np.int64)
        packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(h)])
        return pa.table({"part": pa.array(group[edges[:-1]].astype(np.int32)),
                         "block": pa.array(np.full(len(edges) - 1, part.column("block")[0].as_py())), "grams": packed})

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        hashes, levels = known.value
        grams, at, order = group_probes(part.column("text"), hashes, n)
        level = levels[at] if len(levels) else np.zeros(len(grams), np.uint8)
        got = answers.sort_by("part").column("levels").to_pylist()
        level[order] = np.frombuffer(b"".join(got), dtype=np.uint8)
        score = np.zeros(part.num_rows)
        for s in K.slices(part.column("text")):
            h, owner = tokens(s)
            score[s.lo:s.hi] = model_scores(h, owner, s.n, lambda g: level[np.searchsorted(grams, g)].astype(np.int64),
                                            est, total, kinds, share)
        return pa.table({"row": part.column("row"), "score": pa.array(score)})

    scores = None
    for k in range(ROUNDS):
        own = blocks.where(F.pmod("number", F.lit(ROUNDS)) == k)
        # other names on each side, as both come from ``blocks``; their exchange is the same
        asked, texts = (own.select(F.col("block").alias(b), "row", "text") for b in ("block", "of"))
        probes = asked.groupBy("block").applyInArrow(ask, "part int, block long, grams binary")
        found = lookup(probes, segments, n, top)
        done = materialise(texts.groupBy("of").cogroup(found.groupBy("block")).applyInArrow(run, "row long, score double"), lean=True)
        scores = done if scores is None else scores.unionByName(done)
    return scores


def head_cut(words: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` tokens reach it."""
    c = F.col("c").cast("double")
    bucket = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2(c) * 64) + 1024)
    rows = sorted(words.groupBy(bucket.alias("b")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).collect(),
                  key=lambda r: -r["b"])
    cut, n = 1 << 62, 0
    for r in rows:  # a few thousand buckets at most
        n += r["n"]
        if n > head:
            break
        cut = r["c"]
    return cut


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = 1 << 20, min_bigram: int = 1,
                share: float = 0.3, bits_per_entry: int = 12, max_bits: int = 1 << 31, modulus: int = 10) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Rows whose key is held out are not learnt from.
    A filter of more than ``max_bits`` bits is not broadcast."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.coalesce(pick(docs, text, "string"), F.lit("")).alias("text"), pick(docs, key, "long").alias("id"))
    d = d.withColumn("held", held_out(F.col("id"), modulus))
    even = F.col("h").bitwiseAND(F.lit(1)) == 0
    grams = materialise(count_ngrams(d.where(~F.col("held"))).where(even | (F.col("c") >= min_bigram)), lean=True)
    begin = int((START & ~U(1)).view(np.int64))
    words = materialise(grams.where(even & (F.col("h") != begin)), lean=True)
    r = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, kinds = int(r[0] or 0), int(r[1])
    cut = head_cut(words, head)
    top = words.where(F.col("c") >= cut).toArrow()
    hh = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hh)
    known = sc.broadcast((hh[order], top.column("c").to_numpy()[order]))
    est = level_values(grams)
    segments, n_seg, top_level = build_segments(grams, bits_per_entry)
    local = n_seg * SEGMENT_BITS <= max_bits
    bits = sc.broadcast(collect_segments(segments, n_seg)) if local else None
    common = None if local else known_levels(segments, frequent(grams, head), n_seg, top_level)
    discard(grams)  # all that follows is in ``words`` and the filter
    norm = float(np.log10(total + 0.1 * (kinds + 1)))

    schema = ("row long, id long, held boolean, n long, known long, base double, tail array<struct<h:long,tf:long>>, "
              + ("score double" if local else "block long, number long, text string"))
    names = ["row", "id", "held", "n", "known", "base", "tail", *(["score"] if local else ["block", "number", "text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, counts = known.value
        lff = LogFrequencyFilter(bits.value, top_level) if local else None
        task = TaskContext.get().partitionId()
        row, block, number, size = task << 40, task << 40, task, 0
        for b in batches:
            for s in K.slices(b.column(0)):
                if size >= BLOCK_BYTES:
                    block, number, size = row, number + 1, 0
                size += len(s.buf)
                h, owner = tokens(s)
                distinct, back = np.unique(h, return_inverse=True)
                at = np.searchsorted(heads, distinct)
                at[at == len(heads)] = 0
                found = heads[at] == distinct if len(heads) else np.zeros(len(distinct), bool)
                logs = np.where(found, np.log10(np.where(found, counts[at] if len(heads) else 0, 0) + 0.1), 0.0)
                in_head = found[back]
                base = np.bincount(owner, weights=logs[back], minlength=s.n)
                n_known = np.bincount(owner[in_head], minlength=s.n)
                # the rest, once per text with its number
                g, v, c = K.runs(owner[~in_head], h[~in_head])
                offs = np.searchsorted(g, np.arange(s.n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays(
                    [pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "tf"]))
                part = b.slice(s.lo, s.n)
                cols = [pa.array(np.arange(row, row + s.n)), part.column(1), part.column(2),
                        pa.array((s.n_words + 1).astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), tail]
                if local:  # the model, all counts from the filter
                    cols.append(pa.array(model_scores(h, owner, s.n, lff.levels, est, total, kinds, share)))
                else:
                    cols += [pa.array(np.full(s.n, block)), pa.array(np.full(s.n, number)), part.column(0)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                row += s.n

    # written once: row numbers are those of the attempts that were kept
    out = materialise(d.mapInArrow(run, schema), lean=True)
    rest = out.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.tf")
    rare = words.where(F.col("c") < cut).select("h", "c")
    rest = rest.join(rare, "h", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("also"))
    if not local:
        scores = shuffled_scores(out, segments, n_seg, top_level, common, est, total, kinds, share)
        out = out.drop("block", "number", "text").join(scores, "row")
    out = out.drop("tail").join(rest, "row", "left")
    return out.select(F.col("id").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
                      (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n") * F.lit(norm)).alias("base_score"), "score")
