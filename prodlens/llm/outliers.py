"""Quality rules: base rules on counts, then robust multivariate outliers.

Per language and source, location and scatter of a vector of transformed
statistics are estimated by minimum covariance determinant, and a text is
rejected by its squared Mahalanobis distance.

The estimate is the deterministic variant, for all groups at once: start from
medians and median deviations, then concentration steps: distances, the
``h`` share of rows with the smallest distances, mean and covariance of
these. A step is one aggregation by (group, distance bin) of counts, sums and
sums of products; a group's bins (a fixed number) then choose the subset and
give the next estimate. So a group of any size is pre-aggregated in every
task, and nothing is sorted or collected. Estimates use texts that pass the
base rules, each distinct vector once (copies have no extra weight).

A group with fewer than ``min_group`` vectors uses its language's estimate,
and that of all texts if the language has fewer, too. ``FLOOR`` is added to
the scatter, so that a statistic which is constant in a group doesn't make
every other value an outlier.

Edge cases: a null or empty text has no words and fails the base rules; null
language and null source are groups of their own; repeated rows are judged
alike; if no text passes the base rules none is kept; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import BROADCAST_BYTES, materialise, pick
from prodlens.llm.textstats import text_stats


def base_failed() -> Column:
    """Fewer than 10 words, or over 20% of words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics. Ratios are shrunk by a few words' worth, as
    they vary more in short texts."""
    n = F.col("n_words")
    per = lambda c, w: F.col(c) / (n + w)
    return [F.log1p(n.cast("double")),
            (F.col("word_chars") + 100) / (n + 20),
            F.log1p(10 * per("n_symbols", 5)),
            F.log1p(F.col("n_dup_lines").cast("double")),
            F.sqrt(per("n_repeat_words", 20)),
            F.log1p(F.col("n_distinct_words").cast("double")),
            F.log1p(10 * per("n_loud", 5))]


#: Standard deviations added to each statistic's scatter, in its own unit.
FLOOR = [0.3, 0.2, 0.15, 0.4, 0.1, 0.1, 0.15]
D = len(FLOOR)
X = ["x%d" % i for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
MEAN, PREC = ["m%d" % i for i in range(D)], ["p%d_%d" % p for p in PAIRS]
PARAMS = ", ".join(["lv int", "g1 string", "g2 string", "n long", "scale double"]
                   + ["%s double" % c for c in MEAN + PREC])
BINS_PER_DOUBLING = 8


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * math.sqrt(a)) ** 3


def _distance() -> Column:
    out = F.lit(0.0)
    for i, j in PAIRS:
        t = (F.col(X[i]) - F.col(MEAN[i])) * (F.col(X[j]) - F.col(MEAN[j])) * F.col("p%d_%d" % (i, j))
        out = out + (t if i == j else 2 * t)
    return out


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BINS_PER_DOUBLING).cast("int")


def _params(key: tuple, n: int, mean: np.ndarray, cov: np.ndarray, scale: float) -> pd.DataFrame:
    prec = np.linalg.inv(cov + np.diag(np.square(FLOOR)))
    vals = [float("%.9g" % v) for v in [*mean, *(prec[i, j] for i, j in PAIRS)]]
    return pd.DataFrame([[key[0], key[1], key[2], n, scale, *vals]],
                        columns=["lv", "g1", "g2", "n", "scale", *MEAN, *PREC])


def _start(key: tuple[Any, ...], f: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations from histograms of one group."""
    mean, dev = np.zeros(D), np.zeros(D)
    for i in range(D):
        h = f[f["dim"] == i]
        v, c = h["v"].to_numpy() / 100.0, h["c"].to_numpy()
        mean[i] = _median(v, c)
        dev[i] = 1.4826 * _median(np.abs(v - mean[i]), c)
    n = int(f.loc[f["dim"] == 0, "c"].sum())
    return _params(key, n, mean, np.diag(np.square(dev)), 1.0)


def _median(v: np.ndarray, c: np.ndarray) -> float:
    o = np.argsort(v, kind="stable")
    return float(v[o][np.searchsorted(np.cumsum(c[o]), c.sum() / 2)])


def _step(h: float):
    """Next estimate from a group's distance bins."""
    def run(key: tuple[Any, ...], f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("b")
        c = f["c"].to_numpy()
        n = int(c.sum())
        last = int(np.searchsorted(np.cumsum(c), math.ceil(h * n)))
        part = f.iloc[:last + 1]
        k = part["c"].sum()
        mean = np.array([part["s%d" % i].sum() for i in range(D)]) / k
        cov = np.zeros((D, D))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = part["s%d_%d" % (i, j)].sum() / k - mean[i] * mean[j]
        # distances at the subset's edge against those of a normal vector
        edge = 2.0 ** ((part["b"].iloc[-1] + 1) / BINS_PER_DOUBLING)
        scale = max(1.0, edge / chi2_quantile(k / n if k < n else 0.999, D))
        return _params(key, n, mean, np.maximum(cov, cov.T), scale)
    return run


def _join(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    p = params.select(F.col("lv").alias("_lv"), F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "n",
                      "scale", *MEAN, *PREC)
    p = F.broadcast(p) if groups * 400 <= BROADCAST_BYTES else p
    return rows.join(p, (F.col("lv") == F.col("_lv")) & F.col("g1").eqNullSafe(F.col("_g1"))
                     & F.col("g2").eqNullSafe(F.col("_g2")))


LEVELS = ((0, True, True), (1, True, False), (2, False, False))


def estimate(rows: DataFrame, steps: int = 5, h: float = 0.75) -> tuple[DataFrame, int]:
    """Estimates by (lv, g1, g2) from ``rows`` (g1, g2, x0..). Level 0 is
    language and source, 1 language, 2 all. Also the number of estimates."""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("lv"), (F.col("g1") if a else F.lit(None)).cast("string").alias("g1"),
                                         (F.col("g2") if b else F.lit(None)).cast("string").alias("g2"))
                                for i, a, b in LEVELS]))
    d = rows.select(level.alias("g"), *X).select("g.lv", "g.g1", "g.g2", *X)
    by = ["lv", "g1", "g2"]
    dims = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * 100 + 0.5).cast("int").alias("v"))
                               for i, x in enumerate(X)]))
    hist = (d.select(*by, dims.alias("q")).groupBy(*by, "q.dim", "q.v").agg(F.count(F.lit(1)).alias("c"))
            .select(*by, "dim", "v", "c"))
    params = materialise(hist.groupBy(*by).applyInPandas(_start, PARAMS))
    groups = params.count()
    for _ in range(steps):
        j = _join(d, params, groups).withColumn("b", _bin(_distance()))
        sums = [F.sum(x).alias("s%d" % i) for i, x in enumerate(X)]
        sums += [F.sum(F.col(X[i]) * F.col(X[k])).alias("s%d_%d" % (i, k)) for i, k in PAIRS]
        agg = j.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("c"), *sums)
        params = materialise(agg.groupBy(*by).applyInPandas(_step(h), PARAMS))
    return params, groups


def judge(stats: DataFrame, group1: str = "lang", group2: str = "source", steps: int = 5, h: float = 0.75,
          min_group: int = 100, alpha: float = 1e-9) -> DataFrame:
    """``stats`` (rows with the statistics) plus ``base_failed``, ``distance2``
    (in units of the group's scatter) and ``kept``. Reject beyond the
    ``1 - alpha`` quantile of chi-square, with the scatter floor above."""
    d = stats.withColumn("base_failed", base_failed())
    keyed = d.select("*", pick(d, group1, "string").alias("g1"), pick(d, group2, "string").alias("g2"),
                     *[v.alias(x) for x, v in zip(X, vector(), strict=True)])
    clean = materialise(keyed.where("not base_failed").select("g1", "g2", *X).distinct())
    params, groups = estimate(clean, steps, h)
    # each (language, source) takes the first level with enough vectors
    own = clean.select("g1", "g2").distinct()
    pairs = None
    for i, a, b in LEVELS:
        p = params.where("lv = %d" % i).select(
            *([F.col("g1").alias("_a")] if a else []), *([F.col("g2").alias("_b")] if b else []),
            F.struct("n", "scale", *MEAN, *PREC).alias("e%d" % i))
        cond = F.lit(True)
        if a:
            cond = cond & F.col("g1").eqNullSafe(F.col("_a"))
        if b:
            cond = cond & F.col("g2").eqNullSafe(F.col("_b"))
        # level 2 is one row; the others have a row per group
        pairs = (own if pairs is None else pairs).join(F.broadcast(p) if i == 2 or groups * 400 <= BROADCAST_BYTES else p,
                                                       cond, "left").drop("_a", "_b")
    best = (F.when(F.col("e0.n") >= min_group, F.col("e0")).when(F.col("e1.n") >= min_group, F.col("e1"))
            .otherwise(F.col("e2")))
    chosen = materialise(pairs.select(F.lit(0).alias("lv"), "g1", "g2", best.alias("e")).select("lv", "g1", "g2", "e.*"))
    cut = chi2_quantile(1 - alpha, D)
    ok = keyed.where("not base_failed").withColumn("lv", F.lit(0))
    ok = _join(ok, chosen, groups).withColumn("distance2", _distance() / F.col("scale"))
    cols = [F.col("`%s`" % c) for c in d.columns]
    passed = ok.select(*cols, "distance2", (F.col("distance2") <= cut).alias("kept"))
    failed = keyed.where("base_failed").select(*cols, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)


def rules_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per document: key, the base counts, base_failed, kept and distance2."""
    d = docs.select(pick(docs, key, "long").alias(key), pick(docs, "lang", "string").alias("lang"),
                    pick(docs, "source", "string").alias("source"), pick(docs, text, "string").alias(text))
    stats = materialise(text_stats(d, text, [key, "lang", "source"]))
    return judge(stats, **kw).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept", "distance2")
