"""Readers, writers and model persistence on files written by the test."""

import os
import struct

from pyspark.sql import functions as F

from prodlens.operators import coverage, features, models
from prodlens.sources import io


def test_read_jsonl_bad_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "reviews.jsonl")
    with open(p, "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n{not json\n{"a": "oops", "b": "y"}\n{"a": 3}\n')
    df = io.read_jsonl(spark, p, "a int, b string")
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, [(1, "x"), (None, "y"), (3, None)]))
    assert io.read_jsonl(spark, p, "a int, b string", first_lines=2).count() == 1


def test_read_table_na_markers_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a,b", "NA"), (2, 'say "hi"\nok', "None"), (3, "n/a", "x")],
                               "id int, text string, cat string")
    out = os.path.join(tmpdir_path, "csv")
    io.write_dataset(df, out, fmt="csv")
    back = {r["id"]: (r["text"], r["cat"]) for r in io.read_table(spark, out).collect()}
    assert back == {1: ("a,b", None), 2: ('say "hi"\nok', None), 3: (None, "x")}


def test_category_map_and_partitioned_read(spark, tmpdir_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "category string, v int")
    root = os.path.join(tmpdir_path, "by_cat")
    io.write_dataset(df, root, partition_by=["category"])
    one = io.read_by_category(spark, root, "b")
    assert sorted(r["v"] for r in one.collect()) == [1, 3]
    from prodlens.operators.labels import category_map
    mp = os.path.join(tmpdir_path, "map")
    io.write_category_map(category_map(df), mp)
    assert [tuple(r) for r in spark.read.json(mp).select("category", "label").collect()] == \
        [("a", 0), ("b", 1)]


def test_pipeline_save_load_same_predictions(spark, tmpdir_path):
    rows = [(i, t, l) for i, (t, l) in enumerate(
        [("red apple", 0), ("green apple", 0), ("apple pie", 0), ("blue sky", 1), ("sky high", 1),
         ("blue sea", 1)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    tm = features.fit_tfidf(df, "doc_id", min_df=1)
    pm = models.fit_baseline_pipeline(df, tm, "naive_bayes")
    path = os.path.join(tmpdir_path, "model")
    io.save_model(pm, path)
    back = io.load_model(path)
    a = sorted(tuple(r) for r in pm.transform(df).select("doc_id", "prediction").collect())
    b = sorted(tuple(r) for r in back.transform(df).select("doc_id", "prediction").collect())
    assert a == b
    assert sum(1 for (i, p), r in zip(a, sorted(rows)) if p == r[2]) >= len(rows) - 2


def _bmp(path, w=2, h=2):
    row = bytes([10, 20, 30] * w) + b"\x00" * ((4 - (3 * w) % 4) % 4)
    data = row * h
    header = b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0)
    with open(path, "wb") as f:
        f.write(header + info + data)


def test_images_and_file_list(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "images")
    os.makedirs(d)
    _bmp(os.path.join(d, "good.bmp"))
    with open(os.path.join(d, "bad.bmp"), "wb") as f:
        f.write(b"BMnot really an image")
    files = coverage.list_files(spark, d)
    assert sorted(os.path.basename(r["path"]) for r in files.collect()) == ["bad.bmp", "good.bmp"]
    imgs = io.read_images(spark, d).select("image.origin", "image.height", "image.width")
    got = {os.path.basename(r["origin"]): (r["height"], r["width"]) for r in imgs.collect()}
    assert got["good.bmp"] == (2, 2) and got["bad.bmp"][0] == -1
    assert io.read_images(spark, d, drop_invalid=True).count() == 1
    rows = spark.createDataFrame([(1, os.path.join(d, "good.bmp")), (2, os.path.join(d, "gone.bmp")),
                                  (3, None)], "id int, image_path string")
    st = dict(coverage.with_file_status(rows, files).select("id", "status").collect())
    assert st == {1: "valid", 2: "missing_file", 3: "missing_path"}


def test_file_status_schemes_and_root(spark):
    files = spark.createDataFrame([("hdfs://nn:9000/shop/data/images/1.jpg",), ("s3a://b/shop/2.jpg",), ("file:/x/3.jpg",)], "path string")
    rows = spark.createDataFrame([(1, "data/images/1.jpg"), (2, "2.jpg"), (3, "/x/3.jpg"), (4, "3.jpg"), (5, None), (6, None),
                                  (7, "file:///x/3.jpg")], "id int, image_path string")
    st = dict(coverage.with_file_status(rows, files, root="hdfs://nn:9000/shop").select("id", "status").collect())
    assert st == {1: "valid", 2: "valid", 3: "valid", 4: "missing_file", 5: "missing_path", 6: "missing_path", 7: "valid"}
    st = dict(coverage.with_file_status(rows, files).select("id", "status").collect())
    assert (st[1], st[3]) == ("missing_file", "valid")


def test_verify_images_and_features(spark, tmpdir_path):
    import numpy as np
    from prodlens.operators import images
    d = os.path.join(tmpdir_path, "imgs")
    os.makedirs(d)
    _bmp(os.path.join(d, "p1.jpg"), w=4, h=3)
    with open(os.path.join(d, "p2.jpg"), "wb") as f:
        f.write(b"corrupt")
    os.makedirs(os.path.join(d, "sub"))
    _bmp(os.path.join(d, "sub", "p3.jpg"))  # not the file that p3 asks for
    rows = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "parent_asin string")
    kept = [r[0] for r in images.verify_images(rows, d, "parent_asin", ".jpg").collect()]
    assert kept == ["p1"]
    feats = {os.path.basename(r["path"]): r["pixels"] for r in
             images.image_features(io.read_images(spark, d), size=8).collect()}
    assert feats["p2.jpg"] is None
    px = np.array(feats["p1.jpg"]).reshape(3, 8, 8)
    # BGR (10, 20, 30) everywhere -> RGB (30, 20, 10) / 255, normalised
    expect = (np.array([30, 20, 10]) / 255.0 - np.array(images.IMAGENET_MEAN)) / np.array(images.IMAGENET_STD)
    assert np.allclose(px[:, 3, 3], expect, atol=1e-5)


def test_check_images_present(spark):
    import pytest
    from prodlens.operators import assemble
    df = spark.createDataFrame([(None,), ("http://a",)], "image_url string")
    assert assemble.check_images_present(df) == 1
    with pytest.raises(RuntimeError):
        assemble.check_images_present(df.where("image_url is null"))
