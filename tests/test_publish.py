"""Published datasets and the resumable active-learning loop."""

import json

import pytest
from pyspark.sql import functions as F

from prodlens.operators import active, models
from prodlens.plans import jobs
from prodlens.sources import publish as pub
from prodlens.sources.io import write_dataset
from test_models import _pool

ROWS = "review_id long, text string, category string, image_url string"


def rows(spark, links=True):
    return spark.createDataFrame([(1, "a, \"b\"\nc", "Toys", "http://x/1.jpg" if links else None), (2, "d", "Books", None),
                                  (3, "e", 'Ödd "name"', None), (4, "f", "Toys", None)], ROWS)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_publish_and_read_back(spark, tmpdir_path, fmt):
    d = rows(spark)
    v = pub.publish(d, tmpdir_path, fmt=fmt)
    data, cmap = pub.read_published(spark, tmpdir_path)
    assert sorted((int(r["review_id"]), r["text"]) for r in data.collect()) == sorted((r["review_id"], r["text"]) for r in d.collect())
    assert dict(map(tuple, cmap.collect())) == {"Books": 0, "Toys": 1, 'Ödd "name"': 2}
    r = pub.versions(spark, tmpdir_path).first()
    assert (r["version"], r["rows"], r["images"], r["categories"]) == (v, 4, 1, 3)
    # the map is one JSON object
    assert json.loads(spark.read.text(r["map"], wholetext=True).first()["value"]) == {"Books": 0, "Toys": 1, 'Ödd "name"': 2}


def test_killed_and_refused_attempts_are_no_versions(spark, tmpdir_path, monkeypatch):
    with pytest.raises(LookupError):
        pub.read_published(spark, tmpdir_path)
    pub.publish(rows(spark), tmpdir_path)

    def killed(*a, **k):
        raise KeyboardInterrupt
    monkeypatch.setattr(pub, "map_object", killed)  # after the data, before the manifest
    with pytest.raises(KeyboardInterrupt):
        pub.publish(rows(spark).where("review_id > 1"), tmpdir_path, image=None)
    monkeypatch.undo()
    with pytest.raises(RuntimeError):
        pub.publish(rows(spark, links=False), tmpdir_path)
    assert pub.versions(spark, tmpdir_path).count() == 1 and pub.read_published(spark, tmpdir_path)[0].count() == 4
    v = pub.publish(rows(spark).where("review_id < 3"), tmpdir_path)
    assert pub.read_published(spark, tmpdir_path)[0].count() == 2
    assert pub.read_published(spark, tmpdir_path, v)[1].count() == 2


def test_publish_job(spark, tmpdir_path):
    reviews = spark.createDataFrame([(1, "p1", "Nice", "works very well", 5.0), (2, "p2", "Bad", "broke at once!", 1.0)],
                                    "review_id long, parent_asin string, title string, text string, rating double")
    image = "array<struct<hi_res:string,large:string,thumb:string>>"
    products = spark.createDataFrame([("p1", "Thing", ["good"], "Toys", [("http://x/1.jpg", None, None)]), ("p2", "Other", [], None, [])],
                                     "parent_asin string, title string, description array<string>, main_category string, images " + image)
    got = {r["review_id"]: (r["category"], r["label"], r["image_url"]) for r in jobs.publish_dataset(reviews, products, tmpdir_path).collect()}
    assert got == {1: ("Toys", 0, "http://x/1.jpg"), 2: ("Unknown", 1, None)}


def run(df, n, journal=None, stop_after=None):
    lab, pool = active.split_pool(df, "k", frac=10)
    fits = []

    def fit(d):
        if stop_after is not None and len(fits) > stop_after:
            raise KeyboardInterrupt  # the driver dies in the round after
        fits.append(1)
        return models.estimator("naive_bayes", 60).fit(d)

    def score(m, d):
        return models.score(m, d, "k").select("k", "probs")
    hist, lab, pool = active.al_loop(lab, pool, df, "k", fit, score, lambda m, d: models._acc_f1(models.score(m, d, "k"))[1],
                                     iterations=n, n=5, journal=journal)
    return [tuple(r) for r in hist.drop("seconds").orderBy("iteration").collect()], sorted(r["k"] for r in lab.collect()), len(fits)


def test_a_loop_that_broke_off_goes_on(spark, tmpdir_path):
    df = _pool(spark)
    whole, keys, _ = run(df, 4)
    j = tmpdir_path + "/journal"
    with pytest.raises(KeyboardInterrupt):
        run(df, 4, j, stop_after=2)  # the first fit and those of two rounds
    assert [r["iteration"] for r in active.Journal(spark, j).rounds()] == [1, 2]
    again, keys2, fits = run(df, 4, j)
    assert (again, keys2, fits) == (whole, keys, 2)
    assert run(df, 4, j) == (whole, keys, 0)  # nothing is left to do
    assert run(df, 3, j)[0] == whole[:3]
