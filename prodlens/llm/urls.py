"""URL rules: a blocked Bloom filter of the listed canonical URLs, then an
exact hash join that removes its false positives.

A listed entry is ``host`` + ``path`` in canonical form (lower-case host;
``net/``, ``www.example.com/en/``) with a verdict. It fits its host and all
subdomains of it, for paths that start with its path. The entries that can
fit a URL are therefore the suffixes of its host (cut at dots) joined to the
prefixes of its path; only prefix lengths that some entry has are tried.
Every such string is looked up in the filter (one 256-bit block each), the
hits go to a hash join with the list, and the longest true entry decides.

The filter has 16 bits per entry up to ``max_filter_bytes`` (its proven size
bound); beyond that it passes more false hits and the join removes more.

Edge cases: a null URL, or one without ``://``, has empty host and path and
gets the default verdict; repeated entries with different verdicts block;
entries of equal length rank by the longer host, then by code points; empty
frames give no rows or the default verdict; repeated pages are judged alike;
columns of the input are not passed on, apart from the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import BROADCAST_BYTES, materialise, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Odd multipliers below 2^31 (products stay in a long), one for each 32-bit word of a block.
SALTS = (0x1E3779B1, 0x05EBCA77, 0x42B2AE3D, 0x27D4EB2F, 0x165667B1, 0x53A2646D, 0x7D7046C5, 0x355A4F09)


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(_raw_host(url), UPPER, LOWER)


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*", 0)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _bits(h: Column, i: int) -> Column:
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftright((low * F.lit(SALTS[i])).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")


class BlockedBloom:
    """256-bit blocks of eight 32-bit words; a key sets one bit in each word
    of its block."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, 8) uint32

    @staticmethod
    def build(keys: DataFrame, col: str, max_filter_bytes: int = 16 << 20) -> BlockedBloom:
        """From a column of strings; the OR of bits by block runs in Spark,
        and at most ``max_filter_bytes`` reach the driver."""
        n = keys.count()
        blocks = int(min(max(1, -(-n * 16 // 256)), max(1, max_filter_bytes // 32)))
        h = keys.select(F.xxhash64(col).alias("h"))
        top = F.shiftrightunsigned("h", 32)
        d = h.select(F.shiftright(top * F.lit(blocks), 32).cast("int").alias("b"),
                     *[F.call_function("shiftleft", F.lit(1).cast("long"), _bits(F.col("h"), i)).alias("w%d" % i)
                       for i in range(8)])
        t = d.groupBy("b").agg(*[F.bit_or("w%d" % i).alias("w%d" % i) for i in range(8)]).toArrow()
        words = np.zeros((blocks, 8), dtype=np.uint32)
        b = t.column("b").to_numpy()
        for i in range(8):
            words[b, i] = t.column("w%d" % i).to_numpy().astype(np.uint32)
        return BlockedBloom(words)

    def __contains__(self, key: str) -> bool:
        return bool(self.test([key])[0])

    def test(self, keys: list[str]) -> np.ndarray:
        """Which of the keys may be listed."""
        import xxhash
        h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys))
        block = ((h >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        low, ok = h & np.uint64(0x7FFFFFFF), np.ones(len(keys), dtype=bool)
        for i, s in enumerate(SALTS):
            bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            ok &= (self.words[block.astype(np.int64), i] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return ok


def entries_for(host: str, path: str, lengths: list[int]) -> list[str]:
    """The entries that would fit a URL: host suffixes x path prefixes of the
    given lengths."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path[:n] for n in lengths if n <= len(path) for h in hosts]


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
          default: str = "allow", max_filter_bytes: int = 16 << 20) -> DataFrame:
    """Verdict for every page. ``rules``: (host, path, verdict), any size."""
    spark = pages.sparkSession
    listed = rules.select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"),
        F.length("host").alias("hl"), F.length("path").alias("pl"), "verdict")
    listed = listed.where("rule is not null").groupBy("rule", "hl", "pl").agg(F.max("verdict").alias("verdict"))
    listed = materialise(listed)
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("rule") + 40).alias("b")).first()
    lengths = sorted(r["pl"] for r in listed.select("pl").distinct().collect())  # URL lengths: a short list
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(listed, "rule", max_filter_bytes).words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = BlockedBloom(bloom.value)
        for batch in batches:
            ks, where = [], [0]
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                ks += entries_for(h, p, lengths) if h else []
                where.append(len(ks))
            ok = b.test(ks)
            hits = [[ks[j] for j in range(s, e) if ok[j]] for s, e in zip(where, where[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))],
                                             names=[*batch.schema.names, "hits"])

    u = pick(pages, url, "string")
    thin = pages.select(pick(pages, key, "long").alias("id"), u.alias("url"), host_of(u).alias("host"),
                        path_of(u).alias("path"))
    thin = materialise(thin.mapInArrow(probe, "id long, url string, host string, path string, hits array<string>"))
    listed = F.broadcast(listed) if (size["b"] or 0) <= BROADCAST_BYTES else listed
    best = (thin.where(F.size("hits") > 0).select("url", F.explode("hits").alias("rule"))
            .join(listed, "rule")
            .groupBy("url").agg(F.max(F.struct(F.length("rule"), "hl", "rule", "verdict")).alias("best")))
    hit = thin.where(F.size("hits") > 0).join(best, "url", "left")
    none = thin.where(F.size("hits") == 0).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    both = hit.select("id", "host", "path", "best").unionByName(none.select("id", "host", "path", "best"))
    return both.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
