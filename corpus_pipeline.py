"""A training corpus from raw documents: quality, near duplicates,
benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns
a frame that is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``docs``:

* ``quality_classifier`` drops documents that the rule ensemble rejects
  (fitted to the labelled rows of ``labels`` that are not held out)
* ``near_duplicates`` keeps one document of each class
* ``decontaminate`` drops texts that hold a benchmark item, also with other
  numbers, names or units
* ``mix_sources`` repeats or leaves out documents so that the sources have
  weights 1, 2, 3, ... by words; a repeated document is a repeated row; the
  rows of a mixed shard stand together in shuffled order
* ``shard`` adds ``shard`` (0 to 39) by rendezvous hashing of ``doc_id``

Missing labels or benchmark rows leave the documents as they are; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prodlens.llm import decontam, mixing, neardup, quality, sharding
from prodlens.llm.common import materialise, table

N_SHARDS = 40


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("quality_ok").select(*["`%s`" % c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), fold_case=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.in_shard_order(mixing.mix(docs))
    return mixed.select(*["`%s`" % c for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.add_shard(docs, [1.0] * N_SHARDS)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Model fits, signatures and hashed draws have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialise(docs) if i + 1 < len(STAGES) else docs
    return docs
