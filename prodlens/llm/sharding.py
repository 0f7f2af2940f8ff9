"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the highest score ``-weight / ln(u)``, where
``u`` in (0, 1) is a hash of the record's key and the shard's number. Scores
of the other shards do not depend on how many shards there are, so one more
shard takes rows only into itself (a share equal to its part of the weight).
The rule is a column expression: no shuffle, no state.

``slot`` numbers the records of a shard from 0 without gaps. Records are
spread over ``buckets`` hash buckets inside each shard; per-bucket counts
give offsets, and only a bucket is ever numbered in one task.

Edge cases: a null key is one key of its own (all such records share
a shard; buckets also hash the text, so they still spread); a null text has
0 bytes and checksum 0; repeated rows get slots of their own; columns of the
input named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.llm.common import pick, without


def shard_of(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """Shard (int) of a key among ``len(weights)`` weighted shards."""
    k = F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\x00null")))
    scores = []
    for i, w in enumerate(weights):
        if w <= 0:
            continue
        h = F.shiftrightunsigned(F.xxhash64(k, F.lit(i)), 11).cast("double")
        u = (h + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-i).alias("shard")))
    if not scores:
        raise ValueError("no shard has a positive weight")
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def add_shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id", seed: int = 17) -> DataFrame:
    """``df`` plus ``shard`` (a map: nothing is shuffled)."""
    s = shard_of(pick(df, key, "string"), weights, seed)
    return without(df, "shard").withColumn("shard", s)


def add_slots(df: DataFrame, buckets: int = 256, salt: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each ``shard`` from 0 (``slot``). Offsets come from
    counts by (shard, bucket); the window runs inside a bucket. The order is
    by the hash of ``salt`` columns, then all of them, so reruns agree."""
    h = F.xxhash64(*salt)
    d = df.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 7), F.lit(buckets)).cast("int"))
    n = d.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = n.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("shard", "_b").orderBy("_h", *salt)
    d = d.withColumn("_rn", F.row_number().over(inside))
    d = d.join(offs, ["shard", "_b"])
    return d.select(*["`%s`" % c for c in df.columns], (F.col("_off") + F.col("_rn") - 1).cast("long").alias("slot"))


def shard_report(df: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text",
                 seed: int = 17) -> DataFrame:
    """Per record: key, size (bytes of the text plus 16), checksum, the law
    that holds (``key``), shard, slot, and the shard with one more shard."""
    k, t = pick(df, key, "string"), pick(df, text, "string")
    d = df.select(pick(df, key, "long").alias(key),
                  (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
                  F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
                  F.lit("key").alias("law"), shard_of(k, [1.0] * n_shards, seed).alias("shard"),
                  shard_of(k, [1.0] * (n_shards + 1), seed).alias("grown_shard"),
                  F.xxhash64(t).alias("_t"))
    return add_slots(d, salt=(key, "_t", "text_crc32")).drop("_t")
