"""Column functions on literal rows: text cleaning against Python's re
rules, strip, n-grams, image links, paths, probability scores."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from prodlens.functions import paths, scores, text

HARD_TEXTS = [
    None, "", "   ", "Hello, World!", "<p>Tag</p> text", "see http://x.com/a?b=1 now",
    "www.example.org and wwwfoo", "a b\u001cc　d", "Ünïcödé çà", "UPPER lower 123",
    "tabs\tand\nnewlines", "<a href='x'>link</a>http://y", "x" * 5,
]


def py_clean(t):
    """The reference's rules with Python's Unicode-aware regexes."""
    if t is None:
        return ""
    t = str(t).lower()
    t = re.sub(r"<[^>]+>", "", t)
    t = re.sub(r"(http|www)\S+", "", t)
    t = re.sub(r"[^a-z0-9\s]", " ", t)
    t = re.sub(r"\s+", " ", t)
    return t.strip()


def test_clean_text_matches_python_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD_TEXTS)], "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", text.clean_text("t").alias("c")).collect()}
    for i, t in enumerate(HARD_TEXTS):
        assert got[i] == py_clean(t), (t, got[i])


def test_strip_unicode_whitespace(spark):
    rows = [("  a b 　",), ("\t\n x ",), (None,), ("   ",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(text.strip("t")).collect()]
    assert got == ["a b", "x", None, ""]


def test_review_text_nulls(spark):
    df = spark.createDataFrame([(None, "body "), ("Title", None), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(text.review_text("a", "b")).collect()]
    assert got == ["body", "Title", ""]


def test_ngrams_short_inputs(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "t array<string>")
    got = [r[0] for r in df.select(text.ngrams("t", 1, 2)).collect()]
    assert got == [[], ["a"], ["a", "b", "a b"], ["a", "b", "c", "a b", "b c"]]
    tri = [r[0] for r in df.select(text.ngrams("t", 3, 3)).collect()]
    assert tri == [[], [], [], ["a b c"]]


def test_first_image_url_shape_a(spark):
    schema = "images array<struct<hi_res:string,large:string,thumb:string>>"
    rows = [([("ftp://a", None, "http://t1"), ("http://h2", "http://l2", None)],),
            ([(None, None, None)],), (None,), ([],), ([(None, "https://l", "http://t")],)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(paths.first_image_url("images")).collect()]
    assert got == ["http://t1", None, None, None, "https://l"]


def test_first_image_url_shape_b(spark):
    schema = "images struct<large:array<string>,hi_res:array<string>>"
    rows = [((["None", "", None, "http://l"], ["http://h"]),), ((None, ["http://h"]),),
            ((["None"], [""]),), (None,)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(paths.first_image_url_by_size("images")).collect()]
    assert got == ["http://l", "http://h", None, None]


def test_normalize_and_image_path(spark):
    df = spark.createDataFrame([(None,), ("data\\images\\a.jpg",), ("data/images/data/images/b.jpg",)],
                               "p string")
    got = [r[0] for r in df.select(paths.normalize_path("p")).collect()]
    assert got == [None, "data/images/a.jpg", "data/images/b.jpg"]
    ids = spark.createDataFrame([("x",), (None,)], "id string")
    got = [r[0] for r in ids.select(paths.image_path("dir/", "id", ".png")).collect()]
    assert got == ["dir/x.png", None]


def test_scores_against_numpy(spark):
    rows = [[0.7, 0.2, 0.1], [0.5, 0.5, 0.0], [1.0], [0.2, 0.2, 0.2, 0.2, 0.2], [0.0, 0.0]]
    df = spark.createDataFrame([(r,) for r in rows], "p array<double>")
    out = df.select(scores.entropy("p").alias("e"), scores.margin("p").alias("m"),
                    scores.least_confidence("p").alias("lc"), scores.argmax("p").alias("a")).collect()
    for r, o in zip(rows, out):
        p = np.array(r)
        if p.sum() > 0:
            q = p / p.sum()
            e = -sum(x * math.log(x) for x in q if x > 0)
            assert abs(o["e"] - e) < 1e-12
            assert 0 <= o["e"] <= math.log(len(p)) + 1e-12
        else:
            assert o["e"] is None
        if len(p) >= 2:
            s = np.sort(p)[::-1]
            assert abs(o["m"] + (s[0] - s[1])) < 1e-12
        else:
            assert o["m"] is None
        assert abs(o["lc"] - (1 - p.max())) < 1e-12
        assert o["a"] == int(np.argmax(p))


def test_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, math.log(3.0)],)], "z array<double>")
    got = [r[0] for r in df.select(scores.softmax("z")).collect()]
    assert np.allclose(got[0], [0.5, 0.5]) and np.allclose(got[1], [0.25, 0.75])


def test_has_clean_text_says_what_cleaning_leaves(spark):
    from prodlens.functions import text
    texts = [None, "", " ", "a", "É", "Kelvin \u212a", "\u212a", "<b>", "<b>x</b>", "< b", "http", "http://x", "see http://x", "www.a.b", "WWW.A",
             "ht<b>tp://x", "www", "!?", "<a><b>", "7", "ï", "<>", "http 1", "Http\u00a0z"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(text.has_clean_text("t").alias("has"), F.length(text.clean_text("t")).alias("n")).collect()
    assert [r["has"] for r in got] == [r["n"] > 0 for r in got]
