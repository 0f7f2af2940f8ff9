"""Top-n selections computed once, against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prodlens.operators import active, ranking


def order(row):
    v, k = row
    nan = v is not None and isinstance(v, float) and math.isnan(v)
    up = (0, -math.inf) if nan else (1, -v) if v is not None else (2, 0)
    return up, (k is not None, k)


CASES = {
    "double": ("double", lambda r: r.choice([r.random(), 0.5, -r.random() * 1e-9, r.random() * 1e300, 0.0, math.nan, math.inf, -math.inf, None])),
    "ties": ("double", lambda r: 0.25 if r.random() < 0.9 else r.random()),
    "near": ("double", lambda r: 1.0 + r.randrange(40) * 2.0 ** -52),
    "long": ("long", lambda r: r.choice([2 ** 53, 2 ** 53 + 1, 2 ** 62 + r.randrange(9), -r.randrange(50), None])),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_top_n_equals_sorting(spark, monkeypatch, case):
    monkeypatch.setattr(ranking, "FETCH_ROWS", 7)
    monkeypatch.setattr(ranking, "BINS", 4)
    kind, draw = CASES[case]
    r = random.Random(case)
    rows = [(draw(r), k if k else None) for k in range(400)]
    df = spark.createDataFrame(rows, "v %s, k long" % kind).repartition(5)
    want = sorted(rows, key=order)
    for n in (1, 3, 57, 200, 399, 400, 500):
        got = sorted(map(tuple, ranking.top_n(df, n, "v", "k").collect()), key=order)
        assert str(got) == str(want[:n]), n


def test_the_model_behind_a_selection_runs_once_a_row(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(k):
        seen.add(1)
        p = (k * 37 % 101) / 101
        return [p, 1 - p]
    df = spark.range(500).select(F.col("id").alias("k"), model("id").alias("probs"))
    assert active.select_samples(df, 40, "k").count() == 40
    assert seen.value == 500
