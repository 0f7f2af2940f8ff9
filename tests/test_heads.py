"""Fused heads, class weights, projections at full size, and the model store."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prodlens.operators import fusion, labels, models
from prodlens.plans import catalog, jobs
from prodlens.sources.store import ModelStore, fingerprint

SF = "/root/testdata/sf0.001"


def two_halves(spark, n=900, seed=0):
    """Label = 2a + b; the text tells a, the image b; a tenth has no image."""
    r = np.random.default_rng(seed)
    rows, text, image = [], [], []
    for k in range(n):
        a, b = int(r.integers(0, 2)), int(r.integers(0, 2))
        rows.append((k, 2 * a + b, "test" if k % 5 == 0 else "val" if k % 5 == 1 else "train"))
        text.append((k, [float(x) for x in r.normal(0, 0.4, 6) + (2 * a - 1) * np.array([1, 0, 1, 0, 0, 0])]))
        if k % 10 != 3:
            image.append((k, [float(x) for x in r.normal(0, 0.4, 4) + (2 * b - 1) * np.array([0, 1, 0, 1])]))
    return (spark.createDataFrame(rows, "id long, label int, split string"),
            spark.createDataFrame(text, "id long, text_emb array<double>"),
            spark.createDataFrame(image, "id long, image_emb array<double>"))


def test_fused_heads_beat_either_half(spark):
    rows, text, image = two_halves(spark)
    res, pred = jobs.run_fusion_classifier(rows, text, image, "id", hidden=16, common=24, max_iter=25)
    got = {(r["form"], r["split"]): r for r in res.collect()}
    for form in ("concat", "add"):
        for alone in ("text", "image"):
            assert got[form, "test"]["f1"] > got[alone, "test"]["f1"] + 0.2, got
        assert got[form, "test"]["accuracy"] > 0.85
    # the metric rows, by SQL from the predictions
    p = pred.drop("probs").toPandas()
    assert len(p) == 4 * 900 and p.groupby("form")["id"].nunique().tolist() == [900] * 4
    con = duckdb.connect()
    con.register("p", p)
    sql = con.execute("""
        WITH c AS (SELECT DISTINCT form, split, label AS c FROM p UNION SELECT DISTINCT form, split, prediction FROM p),
        k AS (SELECT c.form, c.split, c.c, count(*) FILTER (label = c.c) AS n, count(*) FILTER (label = c.c AND prediction = c.c) AS tp,
                     count(*) FILTER (prediction = c.c) AS m
              FROM c JOIN p ON p.form = c.form AND p.split = c.split GROUP BY ALL)
        SELECT form, split, sum(tp) / sum(n), sum(n * CASE WHEN n + m = 0 THEN 0 ELSE 2.0 * tp / (n + m) END) / sum(n) FROM k GROUP BY ALL""").fetchall()
    for form, split, acc, f1 in sql:
        assert got[form, split]["accuracy"] == pytest.approx(acc) and got[form, split]["f1"] == pytest.approx(f1)


def test_fusion_query_trains_every_form(spark, monkeypatch):
    whole = jobs.run_fusion_classifier

    def small(*args, **kw):
        return whole(*args, hidden=4, common=6, max_iter=2, **kw)
    monkeypatch.setattr(jobs, "run_fusion_classifier", small)
    got = catalog.QUERIES["run_fusion_classifier"](spark, SF).collect()
    assert {(r["form"], r["split"]) for r in got} == {
        (f, s) for f in ("concat", "add", "text", "image") for s in ("train", "val", "test")} and len(got) == 12


def rare(spark, n=2000):
    r = np.random.default_rng(5)
    rows = [(k, int(k % 20 == 0), "test" if k % 3 == 0 else "val" if k % 3 == 1 else "train") for k in range(n)]
    vec = [(k, [float(x) for x in r.normal(0.9 * y, 1.0, 3)]) for k, y, _ in rows]
    return spark.createDataFrame(rows, "id long, label int, split string"), spark.createDataFrame(vec, "id long, v array<double>")


def test_class_weights_raise_minority_recall(spark):
    rows, vec = rare(spark)
    found = {}
    for weighted in (False, True):
        rep = jobs.run_classifier(rows, vec, "id", "v", hidden=4, max_iter=25, class_weights=weighted).collect()
        found[weighted] = next(r["recall"] for r in rep if r["class"] == "1")
    assert found[True] > found[False] + 0.3, found


def test_replicated_rows_have_the_weighted_class_mass(spark):
    d = spark.range(40_000).select(F.col("id"), (F.col("id") % 20 == 0).cast("int").alias("label"))
    w = models.with_class_weights(d, labels.class_weights(d, 2))
    for growth in (4.0, 1.5, 1.0):  # no row is lost at 4, the majority is thinned below 1.9
        got = dict(models.replicate_by_weight(w, "id", max_growth=growth).groupBy("label").count().collect())
        each = 20_000 * min(growth, 1.9)
        assert got == {0: pytest.approx(each, rel=0.02), 1: pytest.approx(each, rel=0.02)}, growth
    a, b = (sorted(r["id"] for r in models.replicate_by_weight(x, "id").collect()) for x in (w, w.repartition(7)))
    assert a == b
    odd = spark.createDataFrame([(1, 0.0), (2, None), (3, 2.5)], "id long, weight double")
    assert {r["id"] for r in models.replicate_by_weight(odd, "id").collect()} == {3}
    assert models.replicate_by_weight(odd.limit(0), "id").count() == 0


def test_weighted_baselines(spark):
    r = np.random.default_rng(1)
    words = [["red", "blue", "green"], ["green", "black", "red"]]
    rows = []
    for k in range(600):
        y = int(k % 12 == 0)
        rows.append((k, " ".join(r.choice(words[y], 5)), y, ["train", "train", "val", "test"][int(r.integers(0, 4))]))
    d = spark.createDataFrame(rows, "doc_id long, text string, label int, split string")
    plain, weighted = (jobs.run_baselines(d, names=["logistic_regression", "naive_bayes"], max_iter=30, class_weights=w).collect()
                       for w in (False, True))
    assert [x["model"] for x in plain] == [x["model"] for x in weighted] and plain != weighted


@pytest.mark.parametrize("panel", [7 * 3, 1 << 20])
def test_projection_equals_numpy(spark, panel):
    r = np.random.default_rng(2)
    w = r.standard_normal((7, 10))
    vec = [[float(x) for x in r.standard_normal(n)] for n in (7, 7, 5, 9, 0)] + [None, [1.0, None, 2.0, None, 0.0, 0.0, 1.0]]
    d = spark.createDataFrame([(i % 6, v) for i, v in enumerate(vec)], "id long, v array<double>").repartition(3)
    cells = [(i, j, float(w[i, j])) for i in range(7) for j in range(10)]
    m = spark.createDataFrame([(i, j, x / 2) for i, j, x in cells] * 2, "i long, j long, w double")  # listed twice: added

    def brute(v):
        x = np.zeros(7)
        for i, a in enumerate(v[:7]):
            x[i] = a or 0.0
        return x @ w
    for matrix in (m, w):
        got = sorted(((r["id"], r["o"]) for r in fusion.project(d, "id", "v", matrix, "o", panel).collect()), key=str)
        want = sorted(((i % 6, None if v is None else list(brute(v))) for i, v in enumerate(vec)), key=str)
        for (a, x), (b, y) in zip(sorted(got, key=lambda t: (t[0], str(t[1])[:8])), sorted(want, key=lambda t: (t[0], str(t[1])[:8]))):
            assert a == b and (x is y is None or np.allclose(x, y))
    none = fusion.project(d, "id", "v", m.limit(0), "o").collect()
    assert all(r["o"] in (None, []) for r in none)


def test_fitted_projection_keeps_distances(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    d = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    w = fusion.fit_projection(d, "v", 12)
    assert w.shape == (5, 12) and np.allclose(np.linalg.norm(x @ w, axis=1), np.linalg.norm(x, axis=1))
    small = x @ fusion.fit_projection(d, "v", 2)
    _, _, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.linalg.norm(small, axis=1), np.linalg.norm(x @ vt[:2].T, axis=1))


def test_store_finds_the_best_version_and_ignores_half_saves(spark, tmpdir_path):
    rows, vec = rare(spark, 300)
    d = models.array_features(rows.join(vec, "id"), "v")
    store = ModelStore(spark, tmpdir_path + "/models")
    assert store.best("nb") is None and store.versions().count() == 0
    with pytest.raises(LookupError):
        store.load("nb")
    fits = [models.estimator("logistic_regression", n).fit(d) for n in (1, 300)]
    data = fingerprint(rows)
    v = [store.save(m, "lr", f1, data, {"n": i}) for i, (m, f1) in enumerate(zip(fits, (0.4, 0.7)))]
    store.save(fits[0], "lr", float("nan"), data)
    store.save(fits[0], "lr", 0.9, "other data")
    assert store.best("lr", data)["version"] == v[1] and store.best("lr")["metric"] == 0.9
    again = models.score(store.load("lr", data), d, "id").orderBy("id").collect()
    assert again == models.score(fits[1], d, "id").orderBy("id").collect()
    assert store.load("lr", version=v[0]).stages[0].coefficientMatrix == fits[0].coefficientMatrix
    from prodlens.sources.io import save_model
    from pyspark.ml import PipelineModel
    save_model(PipelineModel([fits[0]]), tmpdir_path + "/models/lr/half")  # the list line never came
    assert store.versions("lr").count() == 4


def test_fingerprint_is_of_rows(spark):
    d = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    assert fingerprint(d) == fingerprint(d.repartition(5).select("x", "id"))
    assert fingerprint(d) != fingerprint(d.limit(99)) and fingerprint(d.limit(0)) == "0-0-0"
