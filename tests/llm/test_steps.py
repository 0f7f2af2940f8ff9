"""Steps that write their rows: what is counted on the way, and how many jobs
the near-duplicate classes cost the driver."""

from pyspark.sql import functions as F

from prodlens.llm import neardup
from prodlens.llm.common import counted, local_rows, observed

#: 105 before rows were counted while they are written, 87 since.
JOBS = 95


def last_job(spark):
    spark.range(1).collect()
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_rows_are_counted_while_written(spark):
    d = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") % 10)
    before = last_job(spark)
    out, n = counted(d)
    assert last_job(spark) - before == 2  # the write, and last_job's own
    assert n == 1000 == out.count() and out.dtypes == d.dtypes
    out, seen = observed(d.where("x = 3"), F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    assert seen == {"s": sum(range(3, 1000, 10)), "n": 100} and out.count() == 100
    # shuffled, joined and empty frames: each row once
    assert counted(d.groupBy("x").count().join(d, "x"))[1] == 1000
    for none in (d.limit(0), d.where("false"), d.join(d.where("id < 0").select("id"), "id"), spark.createDataFrame([], "a long")):
        out, n = counted(none)
        assert n == 0 and out.count() == 0


def test_components_by_smallest_node(spark):
    pairs = [(i, i + 1) for i in range(100, 130)] + [(7, 3), (7, 9), (9, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in neardup.components(local_rows(spark, pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 131)}, 7: 3, 9: 3, 200: 3}
    assert neardup.components(local_rows(spark, [], "a long, b long")).count() == 0


def test_jobs_of_near_duplicates(spark):
    from test_llm import family
    d = local_rows(spark, list(enumerate(family())), "doc_id long, text string")
    before = last_job(spark)
    assert neardup.keep_one(d).count() > 10
    assert last_job(spark) - before <= JOBS
