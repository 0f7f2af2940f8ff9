"""Edges that no test table reaches, on literal rows."""

import math

from pyspark.sql import functions as F

from prodlens.functions.text import join_description
from prodlens.operators import metrics
from prodlens.operators.assemble import build_dataset
from prodlens.sources.io import read_table


def test_log_loss_zero_probability_and_unknown_labels(spark):
    d = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "label int, probs array<double>")
    assert metrics.log_loss(d).first()[0] == math.inf
    d = spark.createDataFrame([(-1, [0.5, 0.5]), (None, [0.5, 0.5]), (7, [0.5, 0.5]), (1, [0.75, 0.25])], "label int, probs array<double>")
    assert math.isclose(metrics.log_loss(d).first()[0], -math.log(0.25))


def test_auc_of_nan_probability_is_null(spark):
    d = spark.createDataFrame([(0, [0.5, float("nan")]), (1, [0.2, 0.8])], "label int, probs array<double>")
    assert metrics.auc(d).first()[0] is None


def test_descriptions_that_are_no_list(spark):
    d = spark.createDataFrame([("plain",), (None,)], "description string")
    assert [r[0] for r in d.select(join_description("description", False)).collect()] == ["plain", ""]
    reviews = spark.createDataFrame([(1, "p", 5.0, "good", "a long enough text")], "review_id long, parent_asin string, rating double, title string, text string")
    products = spark.createDataFrame([("p", "T", "plain words", None)], "parent_asin string, title string, description string, main_category string")
    products = products.withColumn("images", F.lit(None).cast("array<struct<large:string,hi_res:string,thumb:string,variant:string>>"))
    assert "plain words" in build_dataset(reviews, products).first()["text"]


def test_number_columns_with_markers(spark, tmpdir_path):
    path = tmpdir_path + "/t.csv"
    with open(path, "w") as f:
        f.write("a,b,c\n1,x,1.5\nNA,NA,NA\n3,y,2\n")
    d = read_table(spark, path)
    assert dict(d.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert [tuple(r) for r in d.collect()] == [(1, "x", 1.5), (None, None, None), (3, "y", 2.0)]
