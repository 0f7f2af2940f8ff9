"""Training-history queries and the tables behind the charts: early
stopping over many runs, best epoch, metric series, uncertainty summary
and histogram, 2-D PCA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodlens.operators.ranking import exact_median, top_n

HISTORY_METRICS = ("train_loss", "train_acc", "val_loss", "val_acc", "val_f1")


def early_stop(history: DataFrame, patience: int = 3, by: Sequence[str] = ("run_id",),
               epoch: str = "epoch", score: str = "val_f1") -> DataFrame:
    """The epochs each run actually trains, with ``improved`` (score above
    the best so far, which starts at 0.0), ``best_so_far``,
    ``since_best`` (epochs since the last improvement) and ``stopped``
    (true on the epoch where ``since_best`` first reaches ``patience``;
    later epochs are cut).

    Windows are partitioned by run: one run's history is epoch-sized.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(epoch)
    prev = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = history.withColumn("_best_before", F.greatest(F.coalesce(prev, F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("improved", F.col(score) > F.col("_best_before"))
    d = d.withColumn("best_so_far", F.greatest("_best_before", F.col(score)))
    d = d.withColumn("_pos", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_pos"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("since_best", (F.col("_pos") - F.coalesce(last, F.lit(0))).cast("int"))
    stop = F.min(F.when(F.col("since_best") >= patience, F.col("_pos"))).over(Window.partitionBy(*by))
    d = d.withColumn("_stop", stop)
    d = d.where(F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop")))
    d = d.withColumn("stopped", F.coalesce(F.col("_pos") == F.col("_stop"), F.lit(False)))
    return d.drop("_best_before", "_pos", "_stop")


def best_epoch(history: DataFrame, patience: int = 3, by: Sequence[str] = ("run_id",),
               epoch: str = "epoch", score: str = "val_f1") -> DataFrame:
    """One row per run: ``best_epoch`` / ``best_score`` (the first epoch
    reaching the maximum among the epochs trained; null when no score is
    above 0), ``stop_epoch`` (null when the run never stops early) and
    ``n_epochs`` trained."""
    by = list(by)
    e = early_stop(history, patience, by, epoch, score)
    return e.groupBy(*by).agg(
        # improvements raise the best score, so the last improved epoch is
        # the first one that reached the maximum
        F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col(score))).alias("best_score"),
        F.max(F.when(F.col("stopped"), F.col(epoch))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("n_epochs"))


def history_series(history: DataFrame, by: Sequence[str] = ("run_id",), step: str = "epoch",
                   metrics: Sequence[str] = HISTORY_METRICS) -> DataFrame:
    """Long ``(*by, step, metric, value)`` series of a table of many runs
    (one line per metric per run in a chart)."""
    ids = list(by) + [step]
    present = [m for m in metrics if m in history.columns]
    d = history.select(*ids, *[F.col(m).cast("double").alias(m) for m in present])
    out = d.unpivot(ids, present, "metric", "value")
    return out.withColumnRenamed(step, "step") if step != "step" else out


def uncertainty_summary(scored: DataFrame, col: str = "uncertainty") -> DataFrame:
    """One row: ``mean, std (population), median (exact), min, max``.
    The median is a distributed selection, not a global sort."""
    a = scored.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                   F.min(col).alias("min"), F.max(col).alias("max"))
    m = exact_median(scored, col, "median")
    return a.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one") \
        .select("mean", "std", "median", "min", "max")


def uncertainty_histogram(scored: DataFrame, col: str = "uncertainty", bins: int = 50) -> DataFrame:
    """``(bin, lo, hi, n)`` for bins 1..``bins`` of equal width between the
    min and max (last bin closed on the right; all values in bin 1 when
    min = max). Empty bins are kept with ``n = 0``."""
    spark = scored.sparkSession
    rng = scored.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = scored.select(F.col(col).alias("_u")).where(F.col("_u").isNotNull())
    x = x.withColumn("_one", F.lit(1)).join(F.broadcast(rng.withColumn("_one", F.lit(1))), "_one")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col("_u") - F.col("_lo")) / width * bins) + 1, F.lit(bins))) \
        .otherwise(F.lit(1))
    counts = x.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    grid = grid.withColumn("_one", F.lit(1)).join(F.broadcast(rng.withColumn("_one", F.lit(1))), "_one")
    step = (F.col("_hi") - F.col("_lo")) / bins
    g = grid.select("bin", (F.col("_lo") + (F.col("bin") - 1) * step).alias("lo"),
                    (F.col("_lo") + F.col("bin") * step).alias("hi"))
    return g.join(counts, "bin", "left").select("bin", "lo", "hi",
                                                F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def selection_threshold(scored: DataFrame, n: int, key: str, col: str = "uncertainty") -> DataFrame:
    """One row ``(threshold)``: the n-th largest score (the cut line of a
    top-n selection); null for ``n <= 0``; the minimum when ``n`` is above
    the row count."""
    top = top_n(scored.where(F.col(col).isNotNull()), n, col, key)
    return top.agg(F.min(col).alias("threshold"))


def pca_2d(df: DataFrame, features_col: str = "features", key: str | None = None) -> tuple[DataFrame, list]:
    """Project on the first two principal components (centred, unscaled)
    with ``spark.ml``; returns ``(frame with pc1, pc2, explained variance
    ratios)``. Signs are fixed so each component's largest loading is
    positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    sc = StandardScaler(inputCol=features_col, outputCol="_centred", withMean=True, withStd=False).fit(df)
    c = sc.transform(df)
    pca = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(c)
    pcs = pca.pc.toArray()
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = pca.transform(c).withColumn("_a", vector_to_array("_pc"))
    out = out.withColumn("pc1", F.col("_a")[0] * signs[0]).withColumn("pc2", F.col("_a")[1] * signs[1])
    return out.drop("_centred", "_pc", "_a"), list(pca.explainedVariance.toArray())
