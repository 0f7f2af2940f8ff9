"""Stand-in inputs built from the driver's test tables.

Each function only reshapes a test table into the schema a job expects
(reviews, products, documents with a category, predictions, training
histories, ...). None of them does any of the job's work: the jobs take
these frames like any other input of that schema.

Mapping (see FIXTURES.md section 3):

* reviews      <- lineitem (part key = product, ship date = review time)
* products     <- part (name = title, brand/type = description, type = category)
* documents    <- documents (lang = category)
* predictions  <- embeddings (class centroids -> logits -> softmax)
* histories    <- events (event type = run, day = epoch, mean value = score)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.functions.scores import argmax, softmax

# Host names and size folders of the invented image links.
IMG_HOST = "img.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet("%s/%s.parquet" % (sf_dir.rstrip("/"), name))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(review_id, parent_asin, title, text, rating, timestamp,
    verified_purchase, helpful_vote)`` from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"),
        F.col("l_partkey").cast("string").alias("parent_asin"),
        F.col("l_returnflag").alias("title"),
        F.concat(F.lit("status "), F.col("l_linestatus"), F.lit(" qty "),
                 F.col("l_quantity").cast("int").cast("string")).alias("text"),
        (F.col("l_quantity") / 10.0).alias("rating"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
               "cast(l_shipdate AS TIMESTAMP_NTZ))").alias("timestamp"),
        (F.col("l_linestatus") == "F").alias("verified_purchase"),
        F.col("l_linenumber").alias("helpful_vote"))


def _url(kind: str) -> F.Column:
    return F.concat(F.lit("http://%s/%s/" % (IMG_HOST, kind)),
                    F.col("p_partkey").cast("string"), F.lit(".jpg"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(parent_asin, title, description, main_category, images)`` from
    part; ``images`` in shape A (array of hi_res/large/thumb structs).
    Small parts have no hi_res link, the smallest a non-http large link,
    cheap parts no thumb."""
    p = table(spark, sf_dir, "part")
    large = F.when(F.col("p_size") > 10, _url("large")).otherwise(
        F.concat(F.lit("ftp://%s/large/" % IMG_HOST), F.col("p_partkey").cast("string")))
    img = F.struct(
        F.when(F.col("p_size") > 40, _url("hi_res")).alias("hi_res"),
        large.alias("large"),
        F.when(F.col("p_retailprice") > 950, _url("thumb")).alias("thumb"))
    return p.select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array("p_brand", "p_type").alias("description"),
        F.col("p_type").alias("main_category"),
        F.array(img).alias("images"))


def products_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`products` but ``images`` in shape B (lists keyed by
    size), with '' and 'None' entries where a part has no such link."""
    p = table(spark, sf_dir, "part")
    large = F.array(F.when(F.col("p_size") > 25, _url("large")).otherwise(F.lit("None")))
    hi_res = F.array(F.when(F.col("p_size") > 5, _url("hi_res")).otherwise(F.lit("")))
    return p.select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array("p_brand", "p_type").alias("description"),
        F.col("p_type").alias("main_category"),
        F.struct(large.alias("large"), hi_res.alias("hi_res")).alias("images"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, category, source, n_chars)``: ``lang`` is the class."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("lang").alias("category"), "source", "n_chars")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, images)`` shape A with the page url as the large link."""
    p = table(spark, sf_dir, "pages")
    img = F.struct(F.lit(None).cast("string").alias("hi_res"), F.col("url").alias("large"),
                   F.lit(None).cast("string").alias("thumb"))
    return p.select("page_id", F.array(img).alias("images"))


def centroid_matrix(emb: DataFrame, max_cells: int = 1_000_000) -> list[list[float]]:
    """Class centroids of the embeddings (class-sized: k x d), labels
    ascending. Computed by a distributed aggregate; only k x d numbers come
    back, and that size is checked."""
    x = emb.select("label", F.posexplode("embedding").alias("pos", "v"))
    c = x.groupBy("label", "pos").agg(F.avg("v").alias("c"))
    rows = c.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError("centroid matrix above %d cells" % max_cells)
    labels = sorted({r["label"] for r in rows})
    dim = max(r["pos"] for r in rows) + 1
    m = {lab: [0.0] * dim for lab in labels}
    for r in rows:
        m[r["label"]][r["pos"]] = float(r["c"])
    return [m[lab] for lab in labels]


def predictions(spark: SparkSession, sf_dir: str, digits: int = 9) -> DataFrame:
    """``(key, label, prediction, probs)`` from the embeddings: the logit of
    class j is the dot product with the j-th centroid, ``probs`` its
    softmax (rounded to ``digits`` so that equal scores are equal in every
    engine), ``prediction`` the argmax."""
    emb = table(spark, sf_dir, "embeddings")
    cent = centroid_matrix(emb)
    e = F.col("embedding").cast("array<double>")
    logits = F.array(*[
        F.aggregate(F.zip_with(e, F.array(*[F.lit(v) for v in row]), lambda a, b: a * b),
                    F.lit(0.0), lambda acc, v: acc + v)
        for row in cent])
    # One stage per projection: a later stage refers to the earlier column
    # several times, and Catalyst keeps such non-cheap columns computed once.
    x = emb.select(F.col("vec_id").alias("key"), "label", logits.alias("_z"))
    x = x.select("key", "label", softmax("_z").alias("_p"))
    x = x.select("key", "label", F.transform("_p", lambda p: F.round(p, digits)).alias("probs"))
    return x.select("key", "label", argmax("probs").alias("prediction"), "probs")


def binary_scores(spark: SparkSession, sf_dir: str, target: str = "toxic") -> DataFrame:
    """``(key, label, probs)`` for a binary task: ``labels.<target>``
    against a length score ``k / (k + 20)`` with ``k = n_chars div 2000``
    (many ties)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    k = F.floor(F.col("n_chars") / 2000)
    s = (k / (k + 20.0)).cast("double")
    j = lab.join(doc, "doc_id", "inner")
    return j.select(F.col("doc_id").alias("key"), F.col(target).cast("int").alias("label"),
                    F.array(F.lit(1.0) - s, s).alias("probs"))


def _share_above(limit: float) -> F.Column:
    """Share of the group's events whose value is above ``limit`` (an exact
    ratio of counts, so every engine computes the same double)."""
    return F.avg((F.col("value") > limit).cast("int"))


def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, epoch, train_loss, train_acc, val_loss, val_acc,
    val_f1)``: one run per event type, one epoch per day, each score the
    day's share of events above a value threshold."""
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy(F.col("event_type").alias("run_id"),
                   (F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) + 1)
                   .cast("int").alias("epoch"))
    return g.agg(
        (1 - _share_above(50.0)).alias("train_loss"),
        _share_above(20.0).alias("train_acc"),
        (1 - _share_above(80.0)).alias("val_loss"),
        _share_above(150.0).alias("val_acc"),
        _share_above(100.0).alias("val_f1"))


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, model, val_f1, test_f1)``: one row per (event type,
    user), scores the user's share of events above a value threshold."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("run_id"),
                      F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model")) \
        .agg(_share_above(100.0).alias("val_f1"), _share_above(150.0).alias("test_f1"))
