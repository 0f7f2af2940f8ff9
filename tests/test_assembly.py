"""Dataset builders and evaluation edge cases on literal rows."""

import math

from pyspark.sql import functions as F

from prodlens.operators import assemble, labels, metrics, series

REVIEWS = "review_id long, parent_asin string, title string, text string, rating double, " \
          "timestamp long, verified_purchase boolean, helpful_vote int"
IMG_A = "array<struct<hi_res:string,large:string,thumb:string>>"


def _reviews(spark):
    rows = [(1, "p1", "Great", "works well", 5.0, 300, True, 1),
            (2, "p1", None, "ok", 3.0, 200, False, 0),
            (3, "p1", "Meh", None, 2.0, 200, True, 2),       # same time as 2: tie by key
            (4, "p2", "Bad", "broke", 1.0, 100, False, 0),
            (5, None, "Orphan", "no product", 4.0, 50, True, 0)]
    return spark.createDataFrame(rows, REVIEWS)


def test_latest_per_key_ties_and_null_key(spark):
    got = [r[0] for r in assemble.latest_per_key(_reviews(spark), "parent_asin", "timestamp", 2,
                                                  tiebreak=["review_id"]).orderBy("review_id").collect()]
    assert got == [1, 2, 4]


def test_join_products_duplicates_and_null_keys(spark):
    prods = spark.createDataFrame([("p1", "A"), ("p1", "A2"), (None, "N")], "parent_asin string, title string")
    r = _reviews(spark).select("review_id", "parent_asin", "title")
    j = assemble.join_products(r, prods)
    assert j.count() == 6 and set(j.columns) >= {"title_review", "title_product"}
    ns = assemble.join_products(r, prods, null_safe=True)
    assert ns.where(F.col("review_id") == 5).count() == 1


def test_build_dataset_literal(spark):
    prods = spark.createDataFrame(
        [("p1", "Lamp", ["bright", None, "warm"], None, [(None, "ftp://x", "http://t")]),
         ("p2", None, None, "Tools", [])],
        "parent_asin string, title string, description array<string>, main_category string, images %s" % IMG_A)
    d = {r["review_id"]: r for r in assemble.build_dataset(_reviews(spark), prods).collect()}
    assert d[1]["text"] == "Lamp bright warm Great works well"
    assert d[1]["category"] == "Unknown" and d[1]["image_url"] == "http://t"
    assert d[2]["text"] == "Lamp bright warm ok"
    assert 4 not in d                                 # "broke" review text too short with no title
    assert 5 not in d                                 # null key does not join
    assert assemble.build_dataset(_reviews(spark), prods, sample_size=2).count() == 2


def test_build_training_table_literal(spark):
    prods = spark.createDataFrame(
        [("p1", "Lamp", ["bright"], None, (["None", "http://l1"], None)),
         ("p2", "Saw", None, "Tools", ([""], [None]))],
        "parent_asin string, title string, description array<string>, main_category string, "
        "images struct<large:array<string>,hi_res:array<string>>")
    d = {r["review_id"]: r for r in assemble.build_training_table(_reviews(spark), prods, "img", k=2).collect()}
    assert sorted(d) == [1, 2]                        # p2 has no usable link -> dropped
    assert d[1]["image_path"] == "img/p1.jpg" and d[1]["category"] is None
    assert d[1]["text"] == "Lamp bright Great works well"


def test_metrics_class_only_in_predictions_and_report(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 2), (3, 1, 1), (4, 1, 0)],
                               "key long, label int, prediction int")
    pc = {r["class"]: r for r in metrics.per_class_metrics(df).collect()}
    assert set(pc) == {0, 1, 2} and pc[2]["support"] == 0 and pc[2]["precision"] == 0.0
    rep = metrics.classification_report(df).collect()
    assert [r["class"] for r in rep] == ["0", "1", "2", "accuracy", "macro avg", "weighted avg"]
    assert rep[3]["f1"] == 0.5 and rep[3]["support"] == 4
    cm = metrics.confusion_matrix(df, normalize=True)
    shares = {(r[0], r[1]): r[2] for r in cm.collect()}
    assert shares[(0, 2)] == 0.5 and shares[(2, 2)] is None   # empty row -> null
    assert [r["band"] for r in metrics.f1_bands(metrics.per_class_metrics(df)).orderBy("class").collect()] \
        == ["medium", "medium", "low"]


def test_log_loss_weighted(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.25, 0.75]), (1, [0.5, 0.5])],
                               "label int, probs array<double>")
    w = labels.class_weights(df, num_classes=2)
    got = metrics.log_loss(df, w).first()[0]
    w0, w1 = 3 / (2 * 1), 3 / (2 * 2)
    expect = (w0 * -math.log(0.5) + w1 * -math.log(0.75) + w1 * -math.log(0.5)) / (w0 + 2 * w1)
    assert abs(got - expect) < 1e-12


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "key long, label int, prediction int")
    assert metrics.metrics(e).first()["n"] is None or metrics.metrics(e).first()["accuracy"] == 0.0
    c = spark.createDataFrame([], "category string")
    assert labels.class_distribution(c).count() == 0
    assert labels.class_count(c).first()[0] == 0


def test_histogram_constant_scores_and_threshold(spark):
    df = spark.createDataFrame([(i, 0.3) for i in range(5)], "key long, uncertainty double")
    h = series.uncertainty_histogram(df, bins=4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [5, 0, 0, 0]
    assert series.selection_threshold(df, 2, "key").first()[0] == 0.3
    assert series.selection_threshold(df, 0, "key").first()[0] is None
    v = spark.createDataFrame([(i, float(i)) for i in range(10)], "key long, uncertainty double")
    h = series.uncertainty_histogram(v, bins=3).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 3, 4]           # last bin closed on the right
    assert series.selection_threshold(v, 3, "key").first()[0] == 7.0
    assert series.selection_threshold(v, 50, "key").first()[0] == 0.0


def test_history_series_long_form(spark):
    h = spark.createDataFrame([("a", 1, 0.5, 0.9), ("a", 2, 0.4, 0.8)],
                              "run_id string, epoch int, train_loss double, val_f1 double")
    s = series.history_series(h).collect()
    assert len(s) == 4 and set(r["metric"] for r in s) == {"train_loss", "val_f1"}
    assert {(r["step"], r["metric"]): r["value"] for r in s}[(2, "val_f1")] == 0.8
