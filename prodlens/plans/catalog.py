"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy
DataFrame that runs one library operator (or job) over the whole stand-in
tables of :mod:`prodlens.plans.standins`.

Floats are rounded to 6 decimals and integer widths are fixed so the
results compare exactly with the SQL in :mod:`prodlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.functions import paths, scores, text
from prodlens.operators import (active, assemble, coverage, features, fusion, labels, metrics,
                                ranking, series)
from prodlens.plans import jobs
from prodlens.sources import io
from prodlens.plans import standins as si

R = 6  # decimals of every float in a registered result


def _r(c, name: str | None = None):
    col = F.round(F.col(c) if isinstance(c, str) else c, R)
    return col.alias(name or c) if isinstance(c, str) or name else col


def length_band(df: DataFrame) -> DataFrame:
    """Documents classed by length in thousands of characters (gives
    classes with 1, 2, 3 ... rows)."""
    return df.withColumn("category", F.concat(F.lit("k"), (F.col("n_chars") / 1000).cast("long")
                                              .cast("string")))


# ---------------------------------------------------------------- text
def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return d.select("doc_id", text.clean_text("text").alias("text"))


def q_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    p = si.table(spark, sf, "pages")
    return p.select("page_id", text.clean_text("html").alias("text"))


def q_clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = si.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.clean_text("text").alias("text"))


def q_review_text(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return d.select("doc_id", text.review_text("source", "text").alias("review_text"))


def q_strip(spark: SparkSession, sf: str) -> DataFrame:
    c = si.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.strip("text").alias("text"))


def q_clean_pair(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return d.select("doc_id", text.clean_pair("text", "source").alias("text"))


def q_join_description(spark: SparkSession, sf: str) -> DataFrame:
    p = si.products(spark, sf)
    return p.select("parent_asin", text.join_description("description").alias("description"))


def q_min_length(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "conversations")
    return assemble.min_length(d, "text", 10).select("conv_id", "turn")


def q_drop_empty_text(spark: SparkSession, sf: str) -> DataFrame:
    c = si.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_text("text").alias("text"))
    return assemble.drop_empty_text(c, "text").select("conv_id", "turn")


# ---------------------------------------------------------------- images / paths
def q_first_image_url(spark: SparkSession, sf: str) -> DataFrame:
    p = si.products(spark, sf)
    return p.select("parent_asin", paths.first_image_url("images").alias("image_url"))


def q_first_image_url_by_size(spark: SparkSession, sf: str) -> DataFrame:
    p = si.products_by_size(spark, sf)
    return p.select("parent_asin", paths.first_image_url_by_size("images").alias("image_url"))


def q_image_path(spark: SparkSession, sf: str) -> DataFrame:
    p = si.products(spark, sf)
    return p.select("parent_asin", paths.image_path("data/images", "parent_asin", ".jpg")
                    .alias("image_path"))


def q_normalize_path(spark: SparkSession, sf: str) -> DataFrame:
    p = si.table(spark, sf, "part")
    raw = F.when(F.col("p_size") > 25, F.concat(F.lit("data\\images\\"), F.col("p_partkey").cast("string"),
                                                F.lit(".jpg"))) \
        .otherwise(F.concat(F.lit("data/images/data/images/"), F.col("p_partkey").cast("string"),
                            F.lit(".jpg")))
    return p.select("p_partkey", paths.normalize_path(raw).alias("path"))


# ---------------------------------------------------------------- joins / assembly
def q_join_products(spark: SparkSession, sf: str) -> DataFrame:
    r = si.reviews(spark, sf).select("review_id", "parent_asin", "title", "rating")
    p = si.products(spark, sf).select("parent_asin", "title", "main_category")
    j = assemble.join_products(r, p, "parent_asin")
    return j.select("review_id", "parent_asin", "title_review", "title_product", "main_category",
                    _r("rating"))


def q_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    r = si.reviews(spark, sf)
    return assemble.latest_per_key(r, "parent_asin", "timestamp", 5, tiebreak=["review_id"]) \
        .select("review_id", "parent_asin", "timestamp")


def q_build_dataset(spark: SparkSession, sf: str) -> DataFrame:
    d = assemble.build_dataset(si.reviews(spark, sf), si.products(spark, sf),
                               sample_size=10_000, key="review_id", seed=42)
    return d.select("review_id", "text", "category", "parent_asin", _r("rating"), "image_url")


def q_publish_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The full build, published and read back with its label codes."""
    import uuid

    from prodlens.session import ensure_checkpoint_dir
    path = "%s/prodlens-published/%s" % (ensure_checkpoint_dir(spark).rstrip("/"), uuid.uuid4().hex)
    d = jobs.publish_dataset(si.reviews(spark, sf), si.products(spark, sf), path)
    return d.select("review_id", "text", "category", "parent_asin", _r("rating"), "image_url", "label")


def q_build_dataset_full(spark: SparkSession, sf: str) -> DataFrame:
    d = assemble.build_dataset(si.reviews(spark, sf), si.products(spark, sf), key="review_id")
    return d.select("review_id", "text", "category", "parent_asin", _r("rating"), "image_url")


def q_build_training_table(spark: SparkSession, sf: str) -> DataFrame:
    d = assemble.build_training_table(si.reviews(spark, sf), si.products_by_size(spark, sf),
                                      image_dir="data/images", k=5, key="review_id")
    return d.select("review_id", "text", "category", "parent_asin", "image_path", _r("rating"),
                    "verified_purchase", "helpful_vote")


# ---------------------------------------------------------------- labels / classes
def q_category_map(spark: SparkSession, sf: str) -> DataFrame:
    return labels.category_map(si.documents(spark, sf), "category")


def q_encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = labels.encode_labels(si.documents(spark, sf), "category")
    return d.select("doc_id", "label")


def q_class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return labels.class_distribution(si.documents(spark, sf), "category")


def q_top_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return labels.class_distribution(d, "source", top_k=5)


def q_class_count(spark: SparkSession, sf: str) -> DataFrame:
    return labels.class_count(si.documents(spark, sf), "category")


def q_rare_classes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.rare_classes(length_band(si.documents(spark, sf)), "category", 2)


def q_drop_rare_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = labels.drop_rare_classes(length_band(si.documents(spark, sf)), "category", 2)
    return d.select("doc_id", "category")


def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = labels.encode_labels(si.documents(spark, sf), "category")
    w = labels.class_weights(d, num_classes=6)
    return w.select("label", _r("weight"))


def _split_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = labels.encode_labels(si.documents(spark, sf), "category")
    return labels.stratified_split(d, "label", "doc_id", test="0.2", val="0.1", seed=42)


def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split_docs(spark, sf).select("doc_id", "label", "split")


def q_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_sizes(_split_docs(spark, sf))


def q_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sample_n(si.table(spark, sf, "documents"), 100, "doc_id", 42).select("doc_id")


# ---------------------------------------------------------------- scores
def q_softmax(spark: SparkSession, sf: str) -> DataFrame:
    p = si.predictions(spark, sf)
    return p.select("key", "prediction", _r(F.array_max("probs"), "p_max"),
                    _r(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), "p_sum"))


def q_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    p = si.predictions(spark, sf)
    return p.select("key", _r(scores.entropy("probs"), "entropy"),
                    _r(scores.margin("probs"), "margin"),
                    _r(scores.least_confidence("probs"), "least_confidence"))


# ---------------------------------------------------------------- evaluation
def q_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.metrics(si.predictions(spark, sf), "weighted")
    return m.select(*[_r(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


def q_metrics_macro(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.metrics(si.predictions(spark, sf), "macro")
    return m.select(*[_r(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


def q_per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.per_class_metrics(si.predictions(spark, sf))
    return m.select("class", *[_r(c) for c in ("precision", "recall", "f1")], "support")


def q_f1_bands(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.f1_bands(metrics.per_class_metrics(si.predictions(spark, sf)))
    return m.select("class", _r("f1"), "band")


def q_top_classes_by_f1(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.top_classes(metrics.per_class_metrics(si.predictions(spark, sf)), "f1", k=5)
    return m.select("class", _r("f1"), "support")


def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(si.predictions(spark, sf))


def q_confusion_matrix_normalized(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.confusion_matrix(si.predictions(spark, sf), normalize=True)
    return m.select("label", "prediction", _r("share"))


def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification_report(si.predictions(spark, sf))


def q_auc_binary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(si.binary_scores(spark, sf, "toxic")).select(_r("auc"))


def q_auc_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(si.predictions(spark, sf), average="weighted").select(_r("auc"))


def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    p = si.predictions(spark, sf)
    w = labels.class_weights(p, num_classes=10)
    return metrics.log_loss(p, w).select(_r("loss"))


def q_compare_models(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.compare_models(si.model_results(spark, sf), "val_f1", by=["run_id"])
    return c.select("run_id", "model", _r("val_f1"), F.col("rank").cast("int").alias("rank"), "is_best")


def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    b = metrics.best_model(si.model_results(spark, sf), "val_f1", by=["run_id"])
    return b.select("run_id", "model", _r("val_f1"))


# ---------------------------------------------------------------- jobs
def q_prepare(spark: SparkSession, sf: str) -> DataFrame:
    d = jobs.prepare(si.documents(spark, sf), key="doc_id", route="processed")
    return d.select("doc_id", "text", "label", "split")


def q_prepare_raw(spark: SparkSession, sf: str) -> DataFrame:
    d = si.documents(spark, sf).select("doc_id", "text", "source", "category")
    d = jobs.prepare(d, key="doc_id", description_col="source", route="raw")
    return d.select("doc_id", "text", "label", "split")


def _prepared(spark: SparkSession, sf: str, materialize: bool = False) -> DataFrame:
    """The prepared documents; written once as a table for jobs that read
    the text several times."""
    return jobs.prepare(si.documents(spark, sf).select("doc_id", "text", "category"), key="doc_id",
                        route="processed", materialize=materialize)


def _tfidf_model(spark: SparkSession, sf: str):
    prep = _prepared(spark, sf, materialize=True)
    model = features.fit_tfidf(prep.where(F.col("split") == "train"), "doc_id", "text")
    return prep, model


# ---------------------------------------------------------------- features
def _clean_docs(spark: SparkSession, sf: str) -> DataFrame:
    return si.table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("text"))


def q_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = _clean_docs(spark, sf).select("doc_id", text.tokens("text").alias("tok"))
    d = d.select("doc_id", "tok", text.text_ngrams("tok", 1, 2).alias("trm"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"), F.size("trm").alias("n_terms"),
                    F.md5(F.array_join("trm", "|")).alias("terms_md5"))


def q_build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_vocab(_clean_docs(spark, sf), "text")


def q_encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents").select("doc_id", "text")
    v = features.build_vocab(d, "text", clean=True)
    e = features.encode_fixed(d, v, "doc_id", "text", max_len=128, clean=True)
    return e.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


def q_fit_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    _, m = _tfidf_model(spark, sf)
    return m.vocab.select("term", "idx", "df", _r("idf"))


def q_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    prep, m = _tfidf_model(spark, sf)
    return features.tfidf(prep, m, "doc_id").select("doc_id", "term", "idx", _r("weight"))


def q_feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    prep, m = _tfidf_model(spark, sf)
    return features.feature_summary(features.tfidf(prep, m, "doc_id"), m, "doc_id")


def q_naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    prep, m = _tfidf_model(spark, sf)
    w = features.tfidf(prep, m, "doc_id")
    train = prep.where(F.col("split") == "train")
    nb = features.naive_bayes_fit(w.join(train.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"),
                                  train, m, "doc_id")
    p = features.naive_bayes_predict(w, nb, "doc_id", all_keys=prep)
    return p.select("doc_id", "prediction", _r("log_prob"))


# ---------------------------------------------------------------- active learning
def _scored(spark: SparkSession, sf: str, strategy: str = "entropy") -> DataFrame:
    return active.score_uncertainty(si.predictions(spark, sf), strategy)


def _selection(strategy: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        s = active.select_samples(si.predictions(spark, sf), 50, "key", strategy)
        return s.select("key", _r("uncertainty"))
    q.__name__ = "q_select_" + strategy
    return q


def q_select_uncertain_large(spark: SparkSession, sf: str) -> DataFrame:
    r = si.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_discount").alias("uncertainty"))
    return active.select_uncertain(r, 30_000, "key").select("key", _r("uncertainty"))


def q_select_random(spark: SparkSession, sf: str) -> DataFrame:
    return active.select_random(si.predictions(spark, sf), 50, "key", seed=42).select("key")


def _train_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).where(F.col("split") == "train").select("doc_id", "label")


def q_split_pool(spark: SparkSession, sf: str) -> DataFrame:
    lab, pool = active.split_pool(_train_docs(spark, sf), "doc_id", frac=10, seed=42)
    return lab.select("doc_id", F.lit("labelled").alias("part")).unionByName(
        pool.select("doc_id", F.lit("pool").alias("part")))


def q_move_selected(spark: SparkSession, sf: str) -> DataFrame:
    lab, pool = active.split_pool(_train_docs(spark, sf), "doc_id", frac=10, seed=42)
    sel = active.select_random(pool, 50, "doc_id", seed=1)
    lab2, pool2 = active.move_selected(lab, pool, sel, "doc_id")
    return lab2.select("doc_id", F.lit("labelled").alias("part")).unionByName(
        pool2.select("doc_id", F.lit("pool").alias("part")))


def q_sample_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return active.sample_classes(d, "source", 5, seed=42).select("doc_id", "source")


# ---------------------------------------------------------------- series
def q_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    e = series.early_stop(si.training_history(spark, sf), patience=3)
    return e.select("run_id", "epoch", "improved", "since_best", "stopped", _r("best_so_far"))


def q_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    b = series.best_epoch(si.training_history(spark, sf), patience=3)
    return b.select("run_id", "best_epoch", _r("best_score"), "stop_epoch", "n_epochs")


def q_history_series(spark: SparkSession, sf: str) -> DataFrame:
    h = series.history_series(si.training_history(spark, sf))
    return h.select("run_id", "step", "metric", _r("value"))


def q_uncertainty_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = series.uncertainty_summary(_scored(spark, sf))
    return u.select(*[_r(c) for c in ("mean", "std", "median", "min", "max")])


def q_uncertainty_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = series.uncertainty_histogram(_scored(spark, sf), bins=50)
    return h.select("bin", _r("lo"), _r("hi"), "n")


def q_selection_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return series.selection_threshold(_scored(spark, sf), 50, "key").select(_r("threshold"))


# ---------------------------------------------------------------- fusion
def _emb_pair(spark: SparkSession, sf: str):
    """Text vectors of 64 and image vectors of 32 numbers; items of label 3
    have no image."""
    e = si.table(spark, sf, "embeddings")
    text_emb = e.select("vec_id", F.col("embedding").alias("text_emb"))
    image_emb = e.where("label <> 3").select("vec_id", F.transform(
        F.slice("embedding", 1, 32), lambda x: x.cast("double") * x.cast("double")).alias("image_emb"))
    return text_emb, image_emb


def _elements(f: DataFrame) -> DataFrame:
    return f.select("vec_id", F.posexplode("fused").alias("j", "value")).select("vec_id", "j", _r("value"))


def _matrix(spark: SparkSession, d_in: int, d_out: int, a: int, b: int, fn) -> DataFrame:
    """A fixed projection matrix ``w[i][j] = fn(i * a + j * b) / 8``."""
    r = spark.range(d_in * d_out)
    i, j = (F.col("id") / d_out).cast("long"), F.col("id") % d_out
    return r.select(i.alias("i"), j.alias("j"), (fn(i * a + j * b) / 8.0).alias("w"))


def q_fuse_concat(spark: SparkSession, sf: str) -> DataFrame:
    t, i = _emb_pair(spark, sf)
    return _elements(fusion.fuse_concat(t, i, "vec_id", image_dim=32))


def q_fuse_add(spark: SparkSession, sf: str) -> DataFrame:
    t, i = _emb_pair(spark, sf)
    wt = _matrix(spark, 64, 8, 7, 3, F.sin)
    wi = _matrix(spark, 32, 8, 5, 11, F.cos)
    return _elements(fusion.fuse_add(t, i, "vec_id", wt, wi, dim=8))


def q_fuse_add_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The usual sizes: text vectors of 768, image vectors of 2048, 512 out."""
    e = si.table(spark, sf, "embeddings")

    def wide(n: int, fn):  # the vector repeated up to ``n`` numbers, each by its place
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(
            "embedding", F.pmod(i, F.size("embedding")) + 1).cast("double") * fn(i))
    t = e.select("vec_id", wide(768, lambda i: F.cos(i * 0.5)).alias("text_emb"))
    i = e.where("label <> 3").select("vec_id", wide(2048, lambda i: F.sin(i * 0.25)).alias("image_emb"))
    wt, wi = _matrix(spark, 768, 512, 7, 3, F.sin), _matrix(spark, 2048, 512, 5, 11, F.cos)
    return _elements(fusion.fuse_add(t, i, "vec_id", wt, wi, dim=512))


# ---------------------------------------------------------------- coverage
def _doc_status(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") >= 100, paths.image_path("data/images", "doc_id", ".jpg"))
        .alias("image_path"))
    files = si.table(spark, sf, "labels").select(
        paths.image_path("data/images", "doc_id", ".jpg").alias("path"))
    return coverage.with_file_status(d, files, "image_path", "path")


def q_with_file_status(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_status(spark, sf).select("doc_id", "status")


def q_coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_report(_doc_status(spark, sf))


# ---------------------------------------------------------------- sources
def q_parse_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    e = si.table(spark, sf, "events")
    return io.parse_json_lines(e, "props", "k int", keep=["event_id"])


# ---------------------------------------------------------------- models (rows-only checks)
def q_run_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_baselines(_prepared(spark, sf, materialize=True), "doc_id", "text")


def q_active_learning(spark: SparkSession, sf: str) -> DataFrame:
    h = jobs.run_active_learning(_prepared(spark, sf, materialize=True), "doc_id", "text")
    return h.drop("seconds")


def q_embed(spark: SparkSession, sf: str) -> DataFrame:
    from prodlens.operators import models
    d = models.embed(_clean_docs(spark, sf), "text", dim=64)
    return d.select("doc_id", F.posexplode("embedding").alias("j", "value")).select("doc_id", "j", _r("value"))


def q_run_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from prodlens.operators import models
    prep = _prepared(spark, sf, materialize=True)
    vec = models.embed(prep.select("doc_id", "text"), "text", dim=64).select("doc_id", "embedding")
    return jobs.run_classifier(prep, vec, "doc_id", "embedding")


def q_run_fusion_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Heads over both halves of the embeddings, joined, added and each half
    alone; every tenth item has no image."""
    from prodlens.operators.labels import stratified_split
    e = stratified_split(si.table(spark, sf, "embeddings"), "label", "vec_id")
    half = F.floor(F.size("embedding") / 2).cast("int")
    text = e.select("vec_id", F.slice("embedding", F.lit(1), half).alias("text_emb"))
    image = e.where("vec_id % 10 <> 0").select("vec_id", F.slice("embedding", half + 1, F.size("embedding")).alias("image_emb"))
    results, _ = jobs.run_fusion_classifier(e, text, image, "vec_id")
    return results


def q_run_classifier_weighted(spark: SparkSession, sf: str) -> DataFrame:
    from prodlens.operators import models
    prep = _prepared(spark, sf, materialize=True)
    vec = models.embed(prep.select("doc_id", "text"), "text", dim=64).select("doc_id", "embedding")
    return jobs.run_classifier(prep, vec, "doc_id", "embedding", class_weights=True)


def q_pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    from prodlens.operators import models
    e = models.array_features(si.table(spark, sf, "embeddings"), "embedding")
    out, _ = series.pca_2d(e, "features")
    return out.select("vec_id", _r("pc1"), _r("pc2"))


FLAGSHIP = "prepare"

QUERIES = {
    "prepare": q_prepare,
    "run_baselines": q_run_baselines,
    "active_learning": q_active_learning,
    "embed": q_embed,
    "run_classifier": q_run_classifier,
    "run_classifier_weighted": q_run_classifier_weighted,
    "run_fusion_classifier": q_run_fusion_classifier,
    "pca_2d": q_pca_2d,
    "parse_jsonl": q_parse_jsonl,
    "select_entropy": _selection("entropy"),
    "select_margin": _selection("margin"),
    "select_least_confidence": _selection("least_confidence"),
    "select_random": q_select_random,
    "split_pool": q_split_pool,
    "move_selected": q_move_selected,
    "sample_classes": q_sample_classes,
    "early_stop": q_early_stop,
    "best_epoch": q_best_epoch,
    "history_series": q_history_series,
    "uncertainty_summary": q_uncertainty_summary,
    "uncertainty_histogram": q_uncertainty_histogram,
    "selection_threshold": q_selection_threshold,
    "fuse_concat": q_fuse_concat,
    "fuse_add": q_fuse_add,
    "fuse_add_wide": q_fuse_add_wide,
    "with_file_status": q_with_file_status,
    "coverage_report": q_coverage_report,
    "tokens": q_tokens,
    "build_vocab": q_build_vocab,
    "encode_fixed": q_encode_fixed,
    "fit_tfidf": q_fit_tfidf,
    "tfidf": q_tfidf,
    "feature_summary": q_feature_summary,
    "naive_bayes": q_naive_bayes,
    "clean_text": q_clean_text,
    "clean_html": q_clean_html,
    "clean_conversations": q_clean_conversations,
    "review_text": q_review_text,
    "strip": q_strip,
    "clean_pair": q_clean_pair,
    "join_description": q_join_description,
    "min_length": q_min_length,
    "drop_empty_text": q_drop_empty_text,
    "first_image_url": q_first_image_url,
    "first_image_url_by_size": q_first_image_url_by_size,
    "image_path": q_image_path,
    "normalize_path": q_normalize_path,
    "join_products": q_join_products,
    "latest_per_key": q_latest_per_key,
    "build_dataset": q_build_dataset,
    "build_dataset_full": q_build_dataset_full,
    "publish_dataset": q_publish_dataset,
    "build_training_table": q_build_training_table,
    "prepare_raw": q_prepare_raw,
    "top_classes_by_f1": q_top_classes_by_f1,
    "select_uncertain_large": q_select_uncertain_large,
    "category_map": q_category_map,
    "encode_labels": q_encode_labels,
    "class_distribution": q_class_distribution,
    "top_classes": q_top_classes,
    "class_count": q_class_count,
    "rare_classes": q_rare_classes,
    "drop_rare_classes": q_drop_rare_classes,
    "class_weights": q_class_weights,
    "stratified_split": q_stratified_split,
    "split_sizes": q_split_sizes,
    "sample_n": q_sample_n,
    "softmax": q_softmax,
    "uncertainty": q_uncertainty,
    "metrics": q_metrics,
    "metrics_macro": q_metrics_macro,
    "per_class_metrics": q_per_class_metrics,
    "f1_bands": q_f1_bands,
    "confusion_matrix": q_confusion_matrix,
    "confusion_matrix_normalized": q_confusion_matrix_normalized,
    "classification_report": q_classification_report,
    "auc_binary": q_auc_binary,
    "auc_multiclass": q_auc_multiclass,
    "log_loss": q_log_loss,
    "compare_models": q_compare_models,
    "best_model": q_best_model,
}
