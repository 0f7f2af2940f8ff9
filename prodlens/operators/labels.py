"""Category maps, label codes, class statistics, rare-class filtering,
stratified splits and class weights.

Everything that is data-sized is a shuffle on a key or a map-side
expression; only class-sized frames (one row per category) are ever
ordered without a partition key or collected.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.operators.ranking import hash_order, hex_bucket, key_bucket, row_numbers

# A class-sized frame up to this size is broadcast; a larger one is joined
# as it is and Spark picks the join.
MAX_BROADCAST_BYTES = 32 << 20
MAX_BROADCAST_ROWS = 1_000_000


def class_table(small: DataFrame) -> DataFrame:
    """``small`` (one or two rows per class) computed once and marked for
    broadcast if it has at most ``MAX_BROADCAST_BYTES``, else unchanged.
    Its rows are the same either way."""
    t = small.limit(MAX_BROADCAST_ROWS + 1).toArrow()
    if t.num_rows > MAX_BROADCAST_ROWS or t.nbytes > MAX_BROADCAST_BYTES:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(t, small.schema))


def category_map(df: DataFrame, col: str = "category") -> DataFrame:
    """``(category, label)``: distinct non-null values sorted ascending,
    numbered from 0. Numbered with bucketed row numbers over the distinct
    values, so even millions of classes are not ordered in one task."""
    d = df.select(F.col(col).alias("category")).where(F.col("category").isNotNull()).distinct()
    r = row_numbers(d, [], ["category"], key_bucket(d, "category"), "_rn")
    return r.select("category", (F.col("_rn") - 1).cast("int").alias("label"))


def encode_labels(df: DataFrame, col: str = "category", out: str = "label",
                  cmap: DataFrame | None = None) -> DataFrame:
    """Add the integer code of ``col`` in the sorted category map; null (or
    a value missing from ``cmap``) gives -1.

    A left join with the map as a :func:`class_table`. A category that
    ``cmap`` holds twice is an error.
    """
    if cmap is None:
        cmap = category_map(df, col)
    else:
        twice = (cmap.where(F.col("category").isNotNull()).groupBy("category")
                 .agg(F.count(F.lit(1)).alias("n")).where("n > 1").first())
        if twice:
            raise ValueError("the category map holds %r twice" % twice["category"])
    m = class_table(cmap.select(F.col("category").alias("_cat"), F.col("label").alias("_lab")))
    j = df.drop(out).join(m, F.col(col) == m["_cat"], "left")
    return j.withColumn(out, F.coalesce(F.col("_lab"), F.lit(-1)).cast("int")).drop("_cat", "_lab")


def class_distribution(df: DataFrame, col: str = "category", top_k: int | None = None) -> DataFrame:
    """``(category, n)`` over non-null values, largest first, ties by
    category. ``top_k`` keeps the first k (a top-k report)."""
    d = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category"))
         .agg(F.count(F.lit(1)).alias("n")))
    d = d.orderBy(F.desc("n"), F.asc("category"))
    return d.limit(top_k) if top_k is not None else d


def class_count(df: DataFrame, col: str = "category") -> DataFrame:
    """One row: number of distinct non-null classes."""
    return df.agg(F.countDistinct(col).alias("n_classes"))


def rare_classes(df: DataFrame, col: str = "category", min_count: int = 2) -> DataFrame:
    """``(category, n)`` of the non-null classes with fewer than
    ``min_count`` rows (the ones the split drops)."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_count))


def drop_rare_classes(df: DataFrame, col: str = "category", min_count: int = 2,
                      keys: DataFrame | None = None) -> DataFrame:
    """Keep rows whose class has at least ``min_count`` rows. Null classes
    go. A semi-join against the set of kept classes as a
    :func:`class_table`. ``keys`` may hold the same rows with fewer columns,
    for a ``df`` that is costly to scan; the counts come from it."""
    ok = ((df if keys is None else keys).where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k"))
          .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select("_k"))
    ok = class_table(ok)
    return df.join(ok, df[col] == ok["_k"], "left_semi")


def _ceil_frac(n: str, frac: Fraction) -> Column:
    """ceil(n * p / q) in exact integer arithmetic (``n`` a column name)."""
    p, q = frac.numerator, frac.denominator
    return F.expr("(cast(`%s` as decimal(38,0)) * %d + %d) div %d" % (n, p, q - 1, q)).cast("long")


def _largest_remainder(counts: DataFrame, size_col: str, total_col: str, seats_col: str,
                       label: str, out: str) -> DataFrame:
    """Share ``seats`` over classes proportionally to ``size``: floor of
    the share plus one seat for the largest remainders, ties by label.
    ``counts`` is class-sized (one row per class)."""
    num = "cast(`%s` as decimal(38,0)) * cast(`%s` as decimal(38,0))" % (size_col, seats_col)
    den = "cast(`%s` as decimal(38,0))" % total_col
    d = counts.withColumn("_base", F.expr("if(%s > 0, (%s) div %s, 0)" % (den, num, den)).cast("long"))
    d = d.withColumn("_rem", F.expr("if(%s > 0, (%s) %% %s, 0)" % (den, num, den)))
    w_all = Window.partitionBy()
    d = d.withColumn("_extra", F.col(seats_col) - F.sum("_base").over(w_all))
    d = d.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(label))))
    d = d.withColumn(out, F.col("_base") + F.when(F.col("_r") <= F.col("_extra"), 1).otherwise(0))
    return d.drop("_base", "_rem", "_extra", "_r")


def split_quotas(df: DataFrame, label: str = "label", test: float | str = "0.2",
                 val: float | str = "0.1") -> DataFrame:
    """Class-sized frame ``(label, n_c, test_c, val_c)``.

    Test total ``ceil(test * n)``; validation total
    ``ceil(val / (1 - test) * (n - test_total))``; each shared over the
    classes by largest remainder. Fractions are exact decimals.
    """
    return _quotas(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c")), label, test, val)


def _quotas(c: DataFrame, label: str, test: float | str, val: float | str) -> DataFrame:
    ft = Fraction(str(test))
    fv = Fraction(str(val)) / (1 - ft)
    c = c.withColumn("_n", F.sum("n_c").over(Window.partitionBy()))
    c = c.withColumn("_T", _ceil_frac("_n", ft))
    c = _largest_remainder(c, "n_c", "_n", "_T", label, "test_c")
    c = c.withColumn("_m_c", F.col("n_c") - F.col("test_c"))
    c = c.withColumn("_M", F.col("_n") - F.col("_T"))
    c = c.withColumn("_V", _ceil_frac("_M", fv))
    c = _largest_remainder(c, "_m_c", "_M", "_V", label, "val_c")
    return c.select(label, "n_c", "test_c", "val_c")


def stratified_split(df: DataFrame, label: str = "label", key: str = "doc_id",
                     test: float | str = "0.2", val: float | str = "0.1", seed: int = 42,
                     out: str = "split", keys: DataFrame | None = None) -> DataFrame:
    """Add ``split`` in {'train', 'val', 'test'}.

    Rows of a class are ordered by ``md5('<seed>:<key>')`` then ``key``;
    the first ``test_c`` go to test, the next ``val_c`` to val, the rest to
    train. The quotas and, per class, the hash bucket in which each one ends
    come from counts by class and bucket; only the rows of those buckets
    are ranked. That gives two cuts per class, and the split is a
    comparison with them: no row of ``df`` is shuffled while the cuts are
    a broadcast :func:`class_table`. ``key`` identifies a row; rows that
    repeat a key go to the same split. ``keys`` may hold the same rows with
    ``key`` and ``label`` only, for a ``df`` that is costly to scan; the
    cuts come from it.
    """
    at = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    d = (df if keys is None else keys).select(F.col(label).alias("_l"), at.alias("_at"))
    d = d.withColumn("_b", F.coalesce(hex_bucket(F.col("_at.h")), F.lit(-1)))
    counts = d.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_c"))
    q = _quotas(counts.groupBy("_l").agg(F.sum("_c").alias("n_c")), "_l", test, val).select(
        F.col("_l").alias("_q"), F.col("test_c").alias("_t"),
        (F.col("test_c") + F.col("val_c")).alias("_tv"))
    w = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    ends = ends.join(q, ends["_l"].eqNullSafe(q["_q"]), "inner")
    ends = ends.where(F.col("_t").between(F.col("_lo") + 1, F.col("_hi"))
                      | F.col("_tv").between(F.col("_lo") + 1, F.col("_hi")))
    ends = class_table(ends.select("_q", F.col("_b").alias("_qb"), "_lo", "_t", "_tv"))
    c = d.join(ends, d["_l"].eqNullSafe(ends["_q"]) & (d["_b"] == ends["_qb"]), "inner")
    rn = F.row_number().over(Window.partitionBy("_q", "_qb").orderBy("_at"))
    c = c.withColumn("_rn", rn + F.col("_lo"))
    cuts = class_table(c.groupBy("_q").agg(
        F.max(F.when(F.col("_rn") == F.col("_t"), F.col("_at"))).alias("_cut_t"),
        F.max(F.when(F.col("_rn") == F.col("_tv"), F.col("_at"))).alias("_cut_tv")))
    j = df.drop(out).join(cuts, df[label].eqNullSafe(cuts["_q"]), "left")
    split = (F.when(at <= F.col("_cut_t"), F.lit("test"))
             .when(at <= F.col("_cut_tv"), F.lit("val")).otherwise(F.lit("train")))
    return j.withColumn(out, split).drop("_q", "_cut_t", "_cut_tv")


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """``(split, n)``."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """``(label, weight)`` for labels ``0..num_classes-1``: balanced weight
    ``n / (k * n_c)`` over the k classes present, 1.0 for absent ones."""
    spark = df.sparkSession
    c = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_nc"))
    c = c.withColumn("_n", F.sum("_nc").over(Window.partitionBy())) \
         .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))
    c = c.select("_l", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("_w"))
    allc = spark.range(num_classes).select(F.col("id").cast("int").alias(label))
    j = allc.join(c, allc[label] == c["_l"], "left")
    return j.select(F.col(label), F.coalesce(F.col("_w"), F.lit(1.0)).alias("weight"))
