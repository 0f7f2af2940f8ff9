"""Ranks and running sums that never put a whole group into one task.

A plain ``row_number().over(partitionBy(g).orderBy(o))`` sorts every row of
group ``g`` in a single task; with one class holding a third of the data that
task is a third of the job. Here the order is cut into buckets by a column
that is monotone in the order (e.g. the leading hex digits of a hash, or the
exponent/mantissa of a probability). Per ``(group, bucket)`` totals are
small (groups x buckets), their running offsets are computed on that small
frame, and the within-bucket running sums run in tasks of bucket size.
Results are exact: buckets only decide where work runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.session import write_table

DEFAULT_HASH_HEX = 4  # 65,536 buckets


def hash_order(key, seed: int) -> Column:
    """Repeatable pseudo-random order key: md5 of '<seed>:<key>'. The same
    for any partitioning and any engine that has md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))


def hex_bucket(h, hex_digits: int = DEFAULT_HASH_HEX) -> Column:
    """Bucket of a hex string by its leading digits (monotone in ``h``)."""
    c = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(c, 1, hex_digits), 16, 10).cast("long")


def unit_bucket(x, mantissa_bits: int = 12) -> Column:
    """Monotone bucket of a non-negative double (a probability): binary
    exponent first, then the leading mantissa bits. Spreads values that
    crowd near 0 over many buckets. Nulls go to bucket -1."""
    c = F.col(x) if isinstance(x, str) else x
    e = F.floor(F.log2(c))
    frac = c / F.pow(F.lit(2.0), e) - 1.0  # in [0, 1)
    b = (e + 1100) * (1 << mantissa_bits) + F.floor(frac * (1 << mantissa_bits))
    return (F.when(c.isNull(), F.lit(-1))
            .when(c <= 0, F.lit(0))
            .otherwise(b).cast("long"))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence, bucket: Column,
                values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Add, for every ``name -> expr`` of ``values``, a column ``name`` with
    the sum of ``expr`` over the rows before this one (``inclusive`` adds the
    row itself) within its ``by`` group, ordered by ``order``.

    ``bucket`` must be non-decreasing along ``order`` inside each group and
    ``order`` should be a total order for exact row numbers.
    """
    by = list(by)
    d = df.withColumn("_bkt", bucket)
    for name, expr in values.items():
        d = d.withColumn("_v_" + name, expr)
    aggs = [F.sum("_v_" + n).alias("_t_" + n) for n in values]
    totals = d.groupBy(*by, "_bkt").agg(*aggs)
    w_off = (Window.partitionBy(*by).orderBy("_bkt")
             .rowsBetween(Window.unboundedPreceding, -1))
    offs = totals.select(*by, "_bkt", *[
        F.coalesce(F.sum("_t_" + n).over(w_off), F.lit(0)).alias("_o_" + n)
        for n in values])
    hi = 0 if inclusive else -1
    w_loc = (Window.partitionBy(*by, "_bkt").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, hi))
    for name in values:
        d = d.withColumn("_l_" + name, F.coalesce(F.sum("_v_" + name).over(w_loc), F.lit(0)))
    offs = offs.withColumnRenamed("_bkt", "_bkt_o")
    for c in by:
        offs = offs.withColumnRenamed(c, "_by_" + c)
    cond = d["_bkt"] == offs["_bkt_o"]
    for c in by:
        cond = cond & d[c].eqNullSafe(offs["_by_" + c])
    j = d.join(offs, cond, "inner")
    out = j.select(*df.columns, *[(F.col("_o_" + n) + F.col("_l_" + n)).alias(n) for n in values])
    return out


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence, bucket: Column,
                name: str = "rn") -> DataFrame:
    """1-based row number within ``by`` along ``order`` (see
    :func:`prefix_sums`)."""
    out = prefix_sums(df, by, order, bucket, {name: F.lit(1).cast("long")}, inclusive=True)
    return out


def nth_row(d: DataFrame, n: int, order: Sequence[Column], bucket: Column, keep: Column) -> DataFrame:
    """``keep`` of the ``n``-th row of ``d`` along ``order`` (one row; none
    when ``d`` has fewer rows).

    Rows are counted per ``bucket`` (non-decreasing along ``order``), the
    bucket where the running count passes ``n`` is found on that small
    frame, and only the rows of that bucket are ordered.
    """
    d = d.withColumn("_b", bucket)
    tot = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = (tot.withColumn("_hi", F.sum("_c").over(w))
           .where((F.col("_hi") >= n) & (F.col("_hi") - F.col("_c") < n)))
    at = F.lit(n) - hit.select(F.col("_hi") - F.col("_c")).scalar()
    return (d.where(F.col("_b").eqNullSafe(hit.select("_b").scalar()) & at.isNotNull())
            .withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
            .where(F.col("_rn") == at).select(keep.alias("_cut")))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, count)`` rows, the first by the hash order of ``key``.

    The hash and key of the ``n``-th row are found from key-only scans
    (:func:`nth_row`) and the rows up to it are a filter in the scan: no
    row is shuffled, whatever ``n`` is. ``key`` identifies a row; rows that
    repeat the last row's key are kept with it. Null keys come first.
    """
    if n <= 0:
        return df.limit(0)
    at = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    cut = nth_row(df.select(at.alias("_at")), n, [F.col("_at")], hex_bucket(F.col("_at.h")),
                  F.col("_at")).scalar()
    return df.where(cut.isNull() | (at <= cut))


def double_bucket(x, mantissa_bits: int = 12) -> Column:
    """Monotone bucket of any double: negatives below 0 below positives,
    each side by binary exponent and leading mantissa bits."""
    c = F.col(x) if isinstance(x, str) else x
    a = F.abs(c)
    e = F.floor(F.log2(a))
    frac = a / F.pow(F.lit(2.0), e) - 1.0
    f = (e + 1100) * (1 << mantissa_bits) + F.floor(frac * (1 << mantissa_bits))
    return (F.when(c.isNull(), F.lit(None))
            .when(F.isnan(c) | (a == float("inf")), F.signum(F.nanvl(c, F.lit(1.0))) * 2 ** 40)
            .when(c > 0, f + 1)
            .when(c < 0, -f - 1)
            .otherwise(F.lit(0)).cast("long"))


def exact_median(df: DataFrame, col: str, alias: str = "median") -> DataFrame:
    """One row: the exact median of non-null ``col`` (mean of the two middle
    values when the count is even).

    Selection instead of a global sort: values are first counted per
    distinct value (a hot value becomes one row), bucketed by
    :func:`double_bucket`, the buckets holding the middle ranks are found
    from per-bucket totals, and only the distinct values of those buckets
    are ordered.
    """
    vc = (df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
          .groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
          .withColumn("_b", double_bucket("_v")))
    tot = vc.groupBy("_b").agg(F.sum("_c").alias("_bc"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("_off", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
              .withColumn("_n", F.sum("_bc").over(Window.partitionBy())))
    tot = tot.withColumn("_r1", F.expr("(_n + 1) div 2")).withColumn("_r2", F.expr("(_n + 2) div 2"))
    hit = tot.where(((F.col("_r1") > F.col("_off")) & (F.col("_r1") <= F.col("_off") + F.col("_bc")))
                    | ((F.col("_r2") > F.col("_off")) & (F.col("_r2") <= F.col("_off") + F.col("_bc"))))
    hit = hit.select(F.col("_b").alias("_hb"), "_off", "_r1", "_r2")
    cand = vc.join(hit, vc["_b"] == hit["_hb"], "inner")
    wl = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_hi", F.col("_off") + F.sum("_c").over(wl)) \
               .withColumn("_lo", F.col("_hi") - F.col("_c"))
    m1 = F.max(F.when((F.col("_r1") > F.col("_lo")) & (F.col("_r1") <= F.col("_hi")), F.col("_v")))
    m2 = F.max(F.when((F.col("_r2") > F.col("_lo")) & (F.col("_r2") <= F.col("_hi")), F.col("_v")))
    return cand.agg(((m1 + m2) / 2.0).alias(alias))


# String ranges are cut at this many sampled values (a power of two, less one).
RANGE_CUTS = 255


def range_bucket(c: Column, cuts: Sequence) -> Column:
    """Number of the sorted ``cuts`` that are <= ``c``, by binary search."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(cuts)).cast("long")


def key_bucket(df: DataFrame, key: str) -> Column:
    """A bucket that does not decrease along ``key`` (null first): exponent
    and leading mantissa bits for numbers, and for other types ranges
    between ``RANGE_CUTS`` values of the column, those with the smallest
    hashes, so a prefix shared by all keys does not put them in one bucket."""
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[key].dataType, NumericType):
        return double_bucket(F.col(key).cast("double"))
    h = F.xxhash64(key)
    rows = (df.select(key).where(F.col(key).isNotNull()).groupBy(h.alias("_h"))
            .agg(F.min(key).alias("_k")).orderBy("_h").limit(RANGE_CUTS).collect())
    return F.when(F.col(key).isNotNull(), range_bucket(F.col(key), sorted(r["_k"] for r in rows)))


#: Rows up to this number are fetched to find the last row of a top-n.
FETCH_ROWS = 10_000
#: Bins of a narrowing pass.
BINS = 4096


def _last_of_top(t: DataFrame, n: int, value: str, key: str):
    """``(value, key)`` of the ``n``-th row of ``t`` by value (largest first)
    and key; None if there are fewer rows.

    Rows are counted by exponent and leading mantissa bits of the value, then
    by equal bins of the bucket that holds the ``n``-th row, until few rows or
    a single value are left. Each pass reads two columns and returns a count
    per bin."""
    from pyspark.sql.types import NumericType
    v, k = F.col(value), F.col(key)
    x = v.cast("double") if isinstance(t.schema[value].dataType, NumericType) else None
    bucket = key_bucket(t.select(v), value) if x is None else double_bucket(x, 6)
    spans = t.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    rows = sorted(spans.collect(), key=lambda r: (r["b"] is None, 0 if r["b"] is None else -r["b"]))
    inside, left = None, n
    while True:
        for r in rows:
            if left <= r["c"]:
                break
            left -= r["c"]
        else:
            return None
        inside = bucket.eqNullSafe(F.lit(r["b"])) if inside is None else inside & (bucket == r["b"])
        single = r["lo"] == r["hi"] or r["b"] is None
        if r["c"] <= FETCH_ROWS or single or x is None:
            break
        lo, hi = float(r["lo"]), float(r["hi"])
        if not hi - lo > 0 or hi - lo == float("inf") or hi != hi:
            break
        bucket = F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("long")
        rows = sorted(t.where(inside).groupBy(bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect(), key=lambda r: -r["b"])
    rest = t.where(inside).select(v.alias("v"), k.alias("k"))
    if r["c"] <= FETCH_ROWS:
        return rest.orderBy(F.col("v").desc_nulls_last(), F.col("k").asc()).limit(left).collect()[-1]
    at = F.struct("v", "k")
    if single:  # many rows of one value: the last key among them
        return nth_row(rest, left, [F.col("k")], key_bucket(rest, "k"), at).first()["_cut"]
    # values that the bins can't part: in the order of their own type
    down = F.col("v").desc_nulls_last()
    vc = rest.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    vc = prefix_sums(vc, [], [down], F.coalesce(-key_bucket(vc, "v"), F.lit(2 ** 62)), {"off": F.col("c")})
    last = vc.where((F.col("off") < left) & (F.col("off") + F.col("c") >= left)).first()
    ties = rest.where(F.col("v").eqNullSafe(F.lit(last["v"])))
    return nth_row(ties, left - last["off"], [F.col("k")], key_bucket(ties, "k"), at).first()["_cut"]


def top_n(df: DataFrame, n: int, value: str, key: str) -> DataFrame:
    """The ``n`` rows with the largest ``value`` (NaN is the largest number,
    nulls last; ties by ``key`` ascending, null first).

    ``df`` is computed once, into a table under ``spark.checkpoint.dir``, so a
    model behind ``value`` runs once per row. The last row is found there from
    counts (:func:`_last_of_top`; values are compared in their own type), and
    the result is a comparison with it: no row is shuffled, whatever ``n`` is.
    ``key`` identifies a row; rows that repeat the last row's value and key
    are kept with it.
    """
    if n <= 0:
        return df.limit(0)
    t = write_table(df)
    last = _last_of_top(t, n, value, key)
    if last is None:
        return t
    types = {c: t.schema[c].dataType for c in (value, key)}
    cv, ck = F.lit(last["v"]).cast(types[value]), F.lit(last["k"]).cast(types[key])
    v, k = F.col(value), F.col(key)
    before = v.isNotNull() if last["v"] is None else F.coalesce(v > cv, F.lit(False))
    return t.where(before | (v.eqNullSafe(cv) & (F.struct(k.alias("k")) <= F.struct(ck.alias("k")))))
