"""Classification metrics as tables.

Input: a predictions frame with integer ``label`` and ``prediction``
(and ``probs array<double>`` for AUC / log loss). The data-sized work is
one ``groupBy(label, prediction).count()`` (map-side combined); everything
after it runs on class-sized frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodlens.operators.ranking import prefix_sums, unit_bucket

MAX_CLASSES = 100_000
# The dense confusion matrix has classes^2 cells; above this many classes
# use the sparse ``confusion_counts`` instead.
MAX_DENSE_CLASSES = 2_000

# F1 bands of the per-class chart (below 0.5, below 0.7, rest).
F1_BANDS = ((0.5, "low"), (0.7, "medium"))
F1_TOP_BAND = "high"


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (``zero_division=0``)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Sparse ``(label, prediction, n)``."""
    return (df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def _class_stats(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(class, tp, support, predicted)`` over the union of true and
    predicted classes: every row counts once for its label and once for its
    prediction, in one aggregation by class with partial counts per task.
    A null label or prediction counts for no class."""
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    hit = F.when(F.col(label) == F.col(prediction), one).otherwise(no)
    x = df.select(F.inline(F.array(
        F.struct(F.col(label).alias("class"), hit.alias("tp"), one.alias("support"), no.alias("predicted")),
        F.struct(F.col(prediction).alias("class"), no.alias("tp"), no.alias("support"), one.alias("predicted")))))
    return (x.where(F.col("class").isNotNull()).groupBy("class")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))


def per_class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, precision, recall, f1, support)`` for every class seen as a
    label or a prediction; undefined ratios are 0."""
    s = _class_stats(df, label, prediction)
    return s.select(
        "class",
        _div0(F.col("tp"), F.col("predicted")).alias("precision"),
        _div0(F.col("tp"), F.col("support")).alias("recall"),
        _div0(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support").cast("long").alias("support"))


def metrics(df: DataFrame, average: str = "weighted", label: str = "label",
            prediction: str = "prediction") -> DataFrame:
    """One row ``(accuracy, precision, recall, f1, n)``; ``average`` is
    'weighted' (by support), 'macro' or 'micro'."""
    s = _class_stats(df, label, prediction)
    p = _div0(F.col("tp"), F.col("predicted"))
    r = _div0(F.col("tp"), F.col("support"))
    f = _div0(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    n = F.sum("support")
    acc = _div0(F.sum("tp"), n)
    if average == "weighted":
        agg = [_div0(F.sum(m * F.col("support")), n).alias(a)
               for m, a in ((p, "precision"), (r, "recall"), (f, "f1"))]
    elif average == "macro":
        agg = [F.avg(m).alias(a) for m, a in ((p, "precision"), (r, "recall"), (f, "f1"))]
    elif average == "micro":
        agg = [acc.alias("precision"), acc.alias("recall"), acc.alias("f1")]
    else:
        raise ValueError("Unknown average: %s" % average)
    return s.agg(acc.alias("accuracy"), *agg, n.cast("long").alias("n"))


def _class_list(df: DataFrame, cols: list[str]) -> list:
    vals = None
    for c in cols:
        v = df.select(F.col(c).alias("_c"))
        vals = v if vals is None else vals.union(v)
    rows = vals.where(F.col("_c").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("more than %d classes" % MAX_CLASSES)
    return sorted(r["_c"] for r in rows)


def confusion_matrix(df: DataFrame, normalize: bool = False, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Dense long matrix ``(label, prediction, n)`` over every pair of
    classes seen as label or prediction. With ``normalize`` the value is
    the row share ``n / sum(n) over label`` (null for an empty row).
    Classes are numbers or strings."""
    cc = confusion_counts(df, label, prediction)
    classes = _class_list(cc, ["label", "prediction"])
    if len(classes) > MAX_DENSE_CLASSES:
        raise ValueError("%d classes: a dense matrix has %d cells; use confusion_counts"
                         % (len(classes), len(classes) ** 2))
    kind = T.StructType([T.StructField("label", cc.schema["label"].dataType)])
    grid = cc.sparkSession.createDataFrame([(c,) for c in classes], kind) \
        .withColumn("prediction", F.explode(F.array(*[F.lit(c) for c in classes]).cast(T.ArrayType(kind[0].dataType))))
    m = grid.join(cc, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if normalize:
        m = m.select("label", "prediction", F.try_divide(
            F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("label"))).alias("share"))
    return m


def classification_report(df: DataFrame, names: DataFrame | None = None, label: str = "label",
                          prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """Per-class rows then 'accuracy', 'macro avg', 'weighted avg';
    columns ``(class, precision, recall, f1, support)`` rounded to
    ``digits``. ``names`` (``label int, category string``) names the
    classes; otherwise the class code is used. Without rows the report is
    empty."""
    pc = per_class_metrics(df, label, prediction)
    if names is not None:
        nm = names.select(F.col("label").alias("_cl"), F.col("category").alias("_name"))
        pc = pc.join(nm, pc["class"] == nm["_cl"], "left").withColumn(
            "_cname", F.coalesce(F.col("_name"), F.col("class").cast("string")))
    else:
        pc = pc.withColumn("_cname", F.col("class").cast("string"))
    # one grouping set per class and one over all classes
    tot = F.sum("support")
    ms = ("precision", "recall", "f1")
    t = pc.rollup("class").agg(
        F.grouping("class").alias("_all"), F.max("_cname").alias("_cname"), tot.cast("long").alias("support"),
        *[F.avg(m).alias(m) for m in ms],
        *[_div0(F.sum(F.col(m) * F.col("support")), tot).alias("_w_" + m) for m in ms])

    def row(name: Column, cols: list[Column], order: int) -> Column:
        return F.struct(name.alias("class"), *[F.round(c, digits).alias(m) for m, c in zip(ms, cols)],
                        F.col("support").alias("support"), F.lit(order).alias("_ord"), F.col("class").alias("_cl"))

    none = F.lit(None).cast("double")
    plain, weighted = [F.col(m) for m in ms], [F.col("_w_" + m) for m in ms]
    rep = t.select(F.inline(F.when(F.col("_all") == 0, F.array(row(F.col("_cname"), plain, 0))).otherwise(F.array(
        row(F.lit("accuracy"), [none, none, F.col("_w_recall")], 1), row(F.lit("macro avg"), plain, 2),
        row(F.lit("weighted avg"), weighted, 3)))))
    return rep.orderBy("_ord", "_cl").drop("_ord", "_cl")


def auc(df: DataFrame, label: str = "label", probs: str = "probs", average: str = "weighted") -> DataFrame:
    """One row ``(auc)``: ROC AUC with tied scores counted half.

    Two columns of probabilities: binary AUC on ``probs[1]`` with the
    larger label positive. More: one-vs-rest per class (column j belongs to
    the j-th smallest label), averaged by prevalence ('weighted') or
    plainly ('macro'). Null when undefined (one class, a class count that
    differs from the probability width, or a NaN probability).

    Scores are counted per (class, score) first; negatives below each
    score come from :func:`prefix_sums`, so no class is sorted in one task.
    """
    spark = df.sparkSession
    classes = _class_list(df, [label])
    width_row = df.agg(F.min(F.size(probs)).alias("lo"), F.max(F.size(probs)).alias("hi"),
                       F.max(F.exists(probs, F.isnan)).alias("nan")).first()
    k = len(classes)
    if k < 2 or width_row["lo"] != width_row["hi"] or width_row["hi"] != k or width_row["nan"]:
        return spark.createDataFrame([(None,)], "auc double")
    cls_arr = F.array(*[F.lit(c) for c in classes])
    x = df.select(F.col(label).alias("_y"), F.posexplode(probs).alias("_j", "_s"))
    if k == 2:
        x = x.where(F.col("_j") == 1)
    x = x.withColumn("_pos", (F.col("_y") == F.element_at(cls_arr, F.col("_j") + 1)).cast("long"))
    g = x.groupBy("_j", "_s").agg(F.sum("_pos").alias("_p"), F.sum(1 - F.col("_pos")).alias("_q"))
    g = prefix_sums(g, ["_j"], ["_s"], unit_bucket("_s"), {"_below": F.col("_q")})
    per = g.groupBy("_j").agg(
        F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_q"))).alias("_u"),
        F.sum("_p").alias("_P"), F.sum("_q").alias("_N"))
    per = per.withColumn("_a", F.try_divide(F.col("_u"), F.col("_P") * F.col("_N")))
    if k == 2:
        return per.select(F.col("_a").alias("auc"))
    if average == "weighted":
        return per.agg((F.sum(F.col("_a") * F.col("_P")) / F.sum("_P")).alias("auc"))
    return per.agg(F.avg("_a").alias("auc"))


def log_loss(df: DataFrame, weights: DataFrame | None = None, label: str = "label",
             probs: str = "probs") -> DataFrame:
    """One row ``(loss)``: class-weighted mean of ``-ln p[label]``, i.e.
    ``sum(w_y * -ln p_y) / sum(w_y)`` over all rows. ``weights`` is
    ``(label, weight)`` (class-sized); without it every weight is 1.
    A probability of 0 for the row's class makes the loss infinite. Rows
    whose label is null, negative (an unknown class) or beyond the
    probabilities are left out of both sums."""
    known = F.col(label).isNotNull() & (F.col(label) >= 0) & (F.col(label) < F.size(probs))
    p = F.get(F.col(probs), F.col(label).cast("int"))
    d = df.where(known).select(F.col(label).alias("_y"), F.when(p > 0, -F.ln(p)).otherwise(
        F.when(p.isNotNull(), F.lit(float("inf")))).alias("_nll"))
    # one row per class before the weights come in: no join sees a hot label
    d = d.groupBy("_y").agg(F.sum("_nll").alias("_nll"), F.count(F.lit(1)).alias("_n"))
    if weights is not None:
        w = weights.select(F.col("label").alias("_wl"), F.col("weight").alias("_w"))
        d = d.join(w, d["_y"] == w["_wl"], "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    else:
        d = d.withColumn("_w", F.lit(1.0))
    return d.agg((F.sum(F.col("_w") * F.col("_nll")) / F.sum(F.col("_w") * F.col("_n"))).alias("loss"))


def compare_models(results: DataFrame, metric: str = "f1", by: list[str] | None = None,
                   model: str = "model", order: str | None = None) -> DataFrame:
    """Add ``rank`` (1 = best ``metric``) and ``is_best`` per ``by`` group.
    Ties go to the earlier model by ``order`` (else by name)."""
    by = by or []
    tie = F.col(order).asc() if order else F.col(model).asc()
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), tie)
    return (results.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.col(metric).desc())))
            .withColumn("is_best", F.row_number().over(w) == 1))


def best_model(results: DataFrame, metric: str = "val_f1", by: list[str] | None = None,
               model: str = "model", order: str | None = None) -> DataFrame:
    """The best row per ``by`` group by ``metric`` (first on ties)."""
    by = by or []
    tie = F.col(order).asc() if order else F.col(model).asc()
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), tie)
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def f1_bands(per_class: DataFrame, col: str = "f1") -> DataFrame:
    """Add ``band``: 'low' below 0.5, 'medium' below 0.7, else 'high'."""
    e = None
    for limit, name in F1_BANDS:
        e = (F.when(F.col(col) < limit, F.lit(name)) if e is None
             else e.when(F.col(col) < limit, F.lit(name)))
    return per_class.withColumn("band", e.otherwise(F.lit(F1_TOP_BAND)))


def top_classes(df: DataFrame, metric: str = "f1", k: int = 20, key: str = "class") -> DataFrame:
    """The ``k`` rows with the largest ``metric`` (ties by ``key``): a
    top-k report over a class-sized frame."""
    return df.orderBy(F.col(metric).desc(), F.col(key).asc()).limit(k)
