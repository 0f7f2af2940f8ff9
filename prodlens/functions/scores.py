"""Probability-vector expressions: softmax, argmax and the uncertainty
scores used by active learning. Inputs are ``array<double>`` columns;
all work is done with Spark higher-order functions (no Python workers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prodlens.functions.core import let

STRATEGIES = ("entropy", "margin", "least_confidence")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _with_scalar(arr: Column, scalar: Column, fn) -> Column:
    """``transform(arr, x -> fn(x, scalar))`` without referring to
    ``scalar`` inside the lambda (Spark would evaluate it once per
    element): the scalar is repeated into an array and zipped."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def softmax(logits) -> Column:
    """exp(x - max) / sum(exp(x - max)); the max shift keeps it finite."""
    def body(z):
        e = _with_scalar(z, F.array_max(z), lambda x, m: F.exp(x - m))
        return let(e, lambda ee: _with_scalar(ee, _sum(ee), lambda x, s: x / s))
    return let(_col(logits).cast("array<double>"), body)


def argmax(probs) -> Column:
    """0-based index of the largest entry; the first one wins on ties."""
    return let(_col(probs), lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def entropy(probs) -> Column:
    """Shannon entropy in nats of the renormalised vector, 0*ln(0) = 0.
    Null when the vector sums to 0."""
    def body(p):
        def with_sum(s):
            terms = _with_scalar(p, s, lambda x, t: F.when(x / t > 0, -(x / t) * F.ln(x / t))
                                 .otherwise(F.lit(0.0)))
            return F.when(s > 0, _sum(terms))
        return let(_sum(p), with_sum)
    return let(_col(probs).cast("array<double>"), body)


def margin(probs) -> Column:
    """-(top1 - top2): higher is more uncertain. Null with fewer than 2
    classes."""
    srt = F.sort_array(_col(probs).cast("array<double>"), asc=False)
    return let(srt, lambda s: F.when(F.size(s) >= 2, -(F.element_at(s, 1) - F.element_at(s, 2))))


def least_confidence(probs) -> Column:
    """1 - max probability."""
    return F.lit(1.0) - F.array_max(_col(probs).cast("array<double>"))


def uncertainty(probs, strategy: str) -> Column:
    """Uncertainty score of the named strategy; unknown names raise."""
    if strategy == "entropy":
        return entropy(probs)
    if strategy == "margin":
        return margin(probs)
    if strategy == "least_confidence":
        return least_confidence(probs)
    raise ValueError("Unknown strategy: %s" % strategy)
