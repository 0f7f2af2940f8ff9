"""Operators on literal rows and brute-force checks: labels, splits,
weights, selection, metrics, AUC, early stopping, TF-IDF, naive Bayes,
fusion, coverage."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodlens.operators import (active, coverage, features, fusion, labels, metrics, ranking,
                                series)


def test_encode_labels_nulls_and_unseen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, category string")
    cmap = labels.category_map(df)
    assert [tuple(r) for r in cmap.orderBy("label").collect()] == [("a", 0), ("b", 1)]
    other = spark.createDataFrame([(9, "zzz")], "id int, category string")
    got = dict(labels.encode_labels(df.unionByName(other), cmap=cmap)
               .select("id", "label").collect())
    assert got == {1: 1, 2: 0, 3: -1, 4: 1, 9: -1}


def test_drop_rare_classes(spark):
    rows = [(i, c) for i, c in enumerate(["x"] + ["y"] * 2 + ["z"] * 3 + [None])]
    df = spark.createDataFrame(rows, "id int, category string")
    kept = Counter(r[0] for r in labels.drop_rare_classes(df, min_count=2).select("category").collect())
    assert kept == {"y": 2, "z": 3}
    rare = [tuple(r) for r in labels.rare_classes(df, min_count=2).collect()]
    assert rare == [("x", 1)]


def test_stratified_split_properties(spark):
    rows = [(i, i % 7 if i % 11 else 0) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    a = {r[0]: r[1] for r in labels.stratified_split(df).select("doc_id", "split").collect()}
    b = {r[0]: r[1] for r in labels.stratified_split(df.repartition(8)).select("doc_id", "split").collect()}
    assert a == b                                  # independent of partitioning
    assert set(a) == {r[0] for r in rows}          # covers, disjoint
    c = Counter(a.values())
    assert c["test"] == math.ceil(0.2 * 1000)
    assert c["val"] == math.ceil(0.125 * (1000 - c["test"]))
    per = Counter((lab, a[i]) for i, lab in rows)
    for lab in set(lab for _, lab in rows):        # each class near its share
        n_c = sum(1 for _, x in rows if x == lab)
        assert abs(per[(lab, "test")] - 0.2 * n_c) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(3,)] * 4, "label int")
    w = dict(labels.class_weights(df, num_classes=5).collect())
    n = Counter([0] * 6 + [1] * 2 + [3] * 4)
    assert abs(sum(n[c] * w[c] for c in n) - 12) < 1e-9
    assert w[2] == 1.0 and w[4] == 1.0


def test_sample_and_selection_bounds(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "k long, u double")
    assert ranking.sample_n(df, 5, "k").count() == 5
    assert ranking.sample_n(df, 50, "k").count() == 20
    assert ranking.sample_n(df, 0, "k").count() == 0
    sel = sorted(r["k"] for r in active.select_uncertain(df, 4, "k", "u").collect())
    assert sel == [2, 5, 8, 11]                    # equal scores: smallest keys first
    assert active.select_uncertain(df, 0, "k", "u").count() == 0
    assert active.select_uncertain(df, 100, "k", "u").count() == 20
    some, more = (ranking.sample_n(df, n, "k").collect() for n in (7, 15))
    assert len(some) == 7 and set(some) < set(more) and len(more) == 15


def test_exact_median(spark):
    for vals in ([3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [5.0] * 10 + [1.0]):
        df = spark.createDataFrame([(v,) for v in vals], "u double")
        assert ranking.exact_median(df, "u").first()[0] == float(np.median(vals))


def _demo_predictions(spark):
    """1000 labels of 5 classes; 200 positions redrawn (seed 42)."""
    rng = np.random.default_rng(42)
    y = rng.integers(0, 5, 1000)
    p = y.copy()
    idx = rng.choice(1000, 200, replace=False)
    p[idx] = rng.integers(0, 5, 200)
    rows = [(int(i), int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "key long, label int, prediction int"), y, p


def test_metrics_against_numpy(spark):
    df, y, p = _demo_predictions(spark)
    m = metrics.metrics(df, "weighted").first()
    assert abs(m["accuracy"] - (y == p).mean()) < 1e-12
    assert abs(m["recall"] - m["accuracy"]) < 1e-12          # weighted recall = accuracy
    f1s, sup = [], []
    for c in range(5):
        tp = ((y == c) & (p == c)).sum()
        prec = tp / max((p == c).sum(), 1)
        rec = tp / max((y == c).sum(), 1)
        f1s.append(0 if prec + rec == 0 else 2 * prec * rec / (prec + rec))
        sup.append((y == c).sum())
    assert abs(m["f1"] - np.average(f1s, weights=sup)) < 1e-12
    cm = metrics.confusion_matrix(df)
    assert cm.agg(F.sum("n")).first()[0] == 1000 and cm.count() == 25


def test_string_classes_and_nulls(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), (None, "a"), ("b", None)],
                               "label string, prediction string")
    got = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(got) == 9 and got["a", "a"] == got["a", "b"] == got["c", "c"] == 1 and sum(got.values()) == 3
    pc = {r["class"]: r for r in metrics.per_class_metrics(df).collect()}
    assert set(pc) == {"a", "b", "c"}
    assert (pc["a"]["precision"], pc["a"]["recall"], pc["a"]["support"]) == (0.5, 0.5, 2)
    assert (pc["b"]["precision"], pc["b"]["recall"], pc["b"]["support"]) == (0.0, 0.0, 1)


def test_report_shuffles(spark):
    df, _, _ = _demo_predictions(spark)
    rep = metrics.classification_report(df)
    assert [r["class"] for r in rep.collect()] == ["0", "1", "2", "3", "4", "accuracy", "macro avg", "weighted avg"]
    plan = rep._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") <= 3
    assert metrics.classification_report(df.limit(0)).count() == 0


def test_top_classes_by_f1(spark):
    pc = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.5), (3, 0.1)], "class int, f1 double")
    assert [r[0] for r in metrics.top_classes(pc, "f1", 3).collect()] == [1, 0, 2]


def test_auc_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 5) / 5            # many ties
    rows = [(i, int(a), [float(1 - b), float(b)]) for i, (a, b) in enumerate(zip(y, s))]
    df = spark.createDataFrame(rows, "key long, label int, probs array<double>")
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(metrics.auc(df).first()[0] - brute) < 1e-12
    one = spark.createDataFrame([(1, 1, [0.2, 0.8])], "key long, label int, probs array<double>")
    assert metrics.auc(one).first()[0] is None


def test_early_stop_demo_history(spark):
    rows = [("r", e, f) for e, f in enumerate([0.5, 0.6, 0.6, 0.55, 0.58, 0.7], start=1)]
    h = spark.createDataFrame(rows, "run_id string, epoch int, val_f1 double")
    e = series.early_stop(h, patience=3).orderBy("epoch").collect()
    assert [r["epoch"] for r in e] == [1, 2, 3, 4, 5]        # stops after 3 without gain
    assert e[-1]["stopped"] and e[1]["improved"] and not e[2]["improved"]
    b = series.best_epoch(h, patience=3).first()
    assert (b["best_epoch"], b["best_score"], b["stop_epoch"]) == (2, 0.6, 5)
    z = spark.createDataFrame([("z", 1, 0.0), ("z", 2, 0.0)], "run_id string, epoch int, val_f1 double")
    assert series.best_epoch(z).first()["best_epoch"] is None


def test_tfidf_and_naive_bayes_brute_force(spark):
    docs = ["red apple red", "green apple", "red green blue", "blue sky", "apple sky blue", "zz"]
    lab = [0, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(docs, lab))],
                               "doc_id long, text string, label int")
    m = features.fit_tfidf(df, "doc_id", n_max=1, min_df=2, max_df=0.95, max_features=None)
    vocab = {r["term"]: (r["idx"], r["idf"]) for r in m.vocab.collect()}
    n = len(docs)
    dfc = Counter(t for d in docs for t in set(d.split()) if len(t) >= 2)
    expect = sorted(t for t, c in dfc.items() if 2 <= c <= 0.95 * n)
    assert sorted(vocab) == expect
    assert [vocab[t][0] for t in expect] == list(range(len(expect)))
    for t in expect:
        assert abs(vocab[t][1] - (math.log((1 + n) / (1 + dfc[t])) + 1)) < 1e-12
    w = features.tfidf(df, m, "doc_id")
    X = np.zeros((n, len(expect)))
    for i, d in enumerate(docs):
        for t, c in Counter(d.split()).items():
            if t in vocab:
                X[i, vocab[t][0]] = c * vocab[t][1]
        if X[i].any():
            X[i] /= np.linalg.norm(X[i])
    for r in w.collect():
        assert abs(r["weight"] - X[r["doc_id"], r["idx"]]) < 1e-12
    nb = features.naive_bayes_fit(w, df, m, "doc_id")
    pred = {r["doc_id"]: r["prediction"] for r in
            features.naive_bayes_predict(w, nb, "doc_id", all_keys=df).collect()}
    y = np.array(lab)
    fc = np.array([X[y == c].sum(0) for c in (0, 1)])
    flp = np.log(fc + 1) - np.log(fc.sum(1, keepdims=True) + len(expect))
    prior = np.log(np.bincount(y) / n)
    jll = X @ flp.T + prior
    assert pred == {i: int(np.argmax(jll[i])) for i in range(n)}


def test_encode_fixed(spark):
    df = spark.createDataFrame([(1, "aa bb cc aa"), (2, ""), (3, "dd " * 10)], "doc_id long, text string")
    v = features.build_vocab(df, size=2)
    e = {r["doc_id"]: (r["input_ids"], r["attention_mask"])
         for r in features.encode_fixed(df, v, "doc_id", max_len=6).collect()}
    ids = dict(v.select("term", "id").collect())
    assert e[1][0] == [2, ids["aa"], ids.get("bb", 1), ids.get("cc", 1), ids["aa"], 3]
    assert e[2] == ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])
    assert len(e[3][0]) == 6 and e[3][0][-1] == 3 and e[3][1] == [1] * 6


def test_move_selected_conserves(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "k long, label int")
    lab, pool = active.split_pool(df, "k", frac=10)
    assert lab.count() == 10 and pool.count() == 90
    sel = active.select_random(pool, 25, "k", seed=3)
    lab2, pool2 = active.move_selected(lab, pool, sel, "k")
    ks = [r[0] for r in lab2.select("k").collect()] + [r[0] for r in pool2.select("k").collect()]
    assert sorted(ks) == list(range(100)) and lab2.count() == 35


def test_fusion_missing_image(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k long, text_emb array<double>")
    i = spark.createDataFrame([(1, [5.0])], "k long, image_emb array<double>")
    got = dict(fusion.fuse_concat(t, i, "k", image_dim=1).select("k", "fused").collect())
    assert got == {1: [1.0, 2.0, 5.0], 2: [3.0, 4.0, 0.0]}
    wt = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "i int, j int, w double")
    wi = spark.createDataFrame([(0, 0, 2.0)], "i int, j int, w double")
    got = dict(fusion.fuse_add(t, i, "k", wt, wi, dim=1).collect())
    assert got == {1: [13.0], 2: [7.0]}


def test_project_literal_and_join(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(20, 6)), rng.normal(size=(6, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(20, None)], "k long, v array<double>")
    m = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(6) for j in range(4)], "i int, j int, w double")
    for cells in (1000, 3):
        got = dict(fusion.project(df, "k", "v", m, "out", max_cells=cells).collect())
        assert got.pop(20) is None
        assert np.allclose([got[i] for i in range(20)], x @ w)


def test_coverage_report(spark):
    df = spark.createDataFrame([(1, None), (2, "data/images/2.jpg"), (3, "data\\images\\3.jpg")],
                               "id int, image_path string")
    files = spark.createDataFrame([("file:///x/ignored.jpg",), ("file:data/images/3.jpg",)], "path string")
    st = coverage.with_file_status(df, files)
    got = dict(st.select("id", "status").collect())
    assert got == {1: "missing_path", 2: "missing_file", 3: "valid"}
    r = coverage.coverage_report(st).first()
    assert (r["total"], r["missing_path"], r["missing_file"], r["valid"], r["verdict"]) == \
        (3, 1, 1, 1, "partial")


def test_top_n_with_hot_tie(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, 0.5 if i % 3 == 0 else (None if i % 17 == 0 else rnd.random())) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, u double")
    expect = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    for n in (1, 150, 250, 590, 599, 700):
        got = ranking.top_n(df, n, "u", "k").collect()
        assert sorted(r["k"] for r in got) == sorted(r[0] for r in expect[:n])
    s = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, u double")
    assert sorted(r["k"] for r in ranking.top_n(s, 2, "u", "k").collect()) == ["a", "c"]
    assert ranking.top_n(s.limit(0), 2, "u", "k").count() == 0


def test_top_n_compares_in_the_own_type(spark):
    longs = spark.createDataFrame([(1, 2 ** 53), (2, 2 ** 53 + 1), (3, -5)], "k long, u long")
    assert [r["k"] for r in ranking.top_n(longs, 1, "u", "k").collect()] == [2]
    x = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, -1.0), (5, float("-inf"))],
                              "k long, u double")
    for n, want in enumerate([[1], [1, 2], [1, 2, 4], [1, 2, 4, 5], [1, 2, 3, 4, 5]], 1):
        assert sorted(r["k"] for r in ranking.top_n(x, n, "u", "k").collect()) == want
    words = spark.createDataFrame([(i, "B0%05d" % (i * 7919 % 3000)) for i in range(3000)], "k long, u string")
    got = ranking.top_n(words, 1234, "u", "k").collect()
    assert sorted(r["u"] for r in got) == ["B0%05d" % i for i in range(3000 - 1234, 3000)]


def test_key_bucket_spreads_shared_prefixes(spark):
    df = spark.createDataFrame([("B0%06d" % i,) for i in range(5000)] + [("A",), (None,)], "k string")
    rows = df.select("k", ranking.key_bucket(df, "k").alias("b")).where("k is not null").orderBy("k").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert len({r["b"] for r in rows}) > 200


def _text_exchanges(df) -> int:
    """Shuffles of the executed plan whose rows hold the column ``text``."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if kind == "ShuffleExchangeExec":
            out = node.output()
            found += any(out.apply(i).name() == "text" for i in range(out.size()))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_prepare_and_sample_shuffle_no_text(spark):
    from prodlens.plans import jobs
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("lang", "category")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        assert _text_exchanges(docs.repartition(3, "doc_id")) == 1      # the probe sees one
        assert _text_exchanges(jobs.prepare(docs)) == 0
        assert _text_exchanges(ranking.sample_n(docs, 50, "doc_id")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_encode_labels_join_fallback(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_BROADCAST_ROWS", 1)
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, category string")
    got = dict(labels.encode_labels(df).select("id", "label").collect())
    assert got == {1: 1, 2: 0, 3: -1}


def test_encode_labels_rejects_repeated_categories(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b")], "id int, category string")
    cmap = spark.createDataFrame([("b", 0), ("b", 1)], "category string, label int")
    for rows in (labels.MAX_BROADCAST_ROWS, 1):
        monkeypatch.setattr(labels, "MAX_BROADCAST_ROWS", rows)
        with pytest.raises(ValueError):
            labels.encode_labels(df, cmap=cmap)
