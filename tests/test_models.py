"""Model jobs: the active-learning loop's bookkeeping and a learnable task
(documents.lang) beating the majority class on held-out rows."""

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql import functions as F

from prodlens.operators import active, models
from prodlens.plans import catalog, jobs

SF = "/root/testdata/sf0.001"


def _pool(spark, n=60):
    rows = [(i, i % 2, Vectors.dense([1.0 + (i % 2) * 2, 1.0 + (i % 3), 0.5 + (i % 5) / 5.0]))
            for i in range(n)]
    schema = StructType([StructField("k", LongType()), StructField("label", IntegerType()),
                         StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("strategy", ["entropy", "margin", "least_confidence", "random"])
def test_al_loop_conserves_rows(spark, strategy):
    df = _pool(spark)
    lab, pool = active.split_pool(df, "k", frac=10)
    fit = lambda d: models.estimator("naive_bayes", 60).fit(d)
    score = lambda m, d: models.score(m, d, "k").select("k", "probs")
    evaluate = lambda m, d: models._acc_f1(models.score(m, d, "k"))[1]
    hist, lab2, pool2 = active.al_loop(lab, pool, df, "k", fit, score, evaluate, iterations=3,
                                       n=5, strategy=strategy)
    h = hist.orderBy("iteration").collect()
    assert [r["train_size"] for r in h] == [11, 16, 21]
    assert all(r["train_size"] + r["unlabeled_size"] == 60 for r in h)
    assert all(0.0 <= r["val_f1"] <= 1.0 for r in h)
    keys = [r[0] for r in lab2.select("k").collect()] + [r[0] for r in pool2.select("k").collect()]
    assert sorted(keys) == list(range(60))


def test_active_learning_runs_the_reference_rounds(spark, monkeypatch):
    seen = {}

    def loop(labelled, pool, val, key, fit, score, evaluate, iterations, n, strategy):
        seen.update(iterations=iterations, n=n)
        raise StopIteration
    monkeypatch.setattr(active, "al_loop", loop)
    with pytest.raises(StopIteration):
        catalog.QUERIES["active_learning"](spark, SF)
    assert seen == {"iterations": 5, "n": 500}


def test_unknown_strategy_raises(spark):
    with pytest.raises(ValueError):
        active.score_uncertainty(_pool(spark).withColumn("probs", F.array(F.lit(0.5))), "bogus")


def test_language_is_learnable(spark):
    prep = catalog._prepared(spark, SF)
    res = jobs.run_baselines(prep, "doc_id", "text", names=["naive_bayes"]).first()
    counts = prep.where("split = 'test'").groupBy("label").count().collect()
    majority = max(r["count"] for r in counts) / sum(r["count"] for r in counts)
    assert res["test_acc"] > majority


def test_embed_brute_force(spark):
    texts = [None, "", "ab", "abc", "a naïve 😀 text", "abc" * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = dict(models.embed(got, "t", dim=8).select("k", "embedding").collect())
    m = models.hash_multipliers(3, 42)
    for k, t in enumerate(texts):
        want = [0.0] * 8
        for i in range(len(t or "") - 2):
            h = sum(ord(c) * x for c, x in zip(t[i:i + 3], m)) % models.HASH_PRIME
            want[h % 8] += -1.0 if h // 8 % 2 else 1.0
        z = sum(v * v for v in want) ** 0.5 or 1.0
        assert [v / z for v in want] == pytest.approx(got[k])
