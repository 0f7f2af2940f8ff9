"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.functions.text import clean_text, has_clean_text
from prodlens.operators.assemble import drop_empty_text
from prodlens.operators.forest import VECTOR_ROWS
from prodlens.operators.labels import drop_rare_classes, encode_labels, stratified_split
from prodlens.session import arrow_rows, write_table
from prodlens.sources.store import ModelStore, fingerprint


def prepare(df: DataFrame, text_col: str = "text", category_col: str = "category",
            key: str = "doc_id", description_col: str | None = None, route: str | None = None,
            min_count: int = 2, test: str = "0.2", val: str = "0.1", seed: int = 42,
            materialize: bool = False) -> DataFrame:
    """Clean, encode, filter and split; adds ``text`` (cleaned), ``label``
    and ``split``.

    ``route`` follows the two entry paths of the reference: 'processed'
    (the input already has ``text`` and ``category``) codes the labels
    before empty texts are dropped; 'raw' cleans ``text_col`` (plus the
    cleaned ``description_col``), drops empty texts, then codes. ``None``
    picks 'processed' when both columns are present. Classes with fewer
    than ``min_count`` rows (and null classes) are dropped, then the rows
    are split 70/10/20 per label.

    The cut values of the split come from a table of keys, classes and
    labels of the kept rows, written once under ``spark.checkpoint.dir``, so
    the text is read for that table, cleaned for the result and never
    shuffled. ``materialize`` writes the cleaned rows there instead and
    reads everything from them (lineage cut, survives executor loss,
    columnar reads): use it when several passes follow (TF-IDF fit and
    transform, model fits), the text is then cleaned once. Rows are spread
    by key before that, so the table's files are of even size.
    """
    if route is None:
        route = "processed" if {"text", "category"} <= set(df.columns) else "raw"
    if materialize:
        df = df.repartition(F.col(key))
    if route == "processed":
        # empty texts are told from the raw text: the cleaned one is made once
        d = encode_labels(df, category_col).where(has_clean_text("text"))
        d = d.withColumn("text", clean_text("text"))
    elif route == "raw":
        if description_col and description_col in df.columns:
            t = F.concat(clean_text(text_col), F.lit(" "), clean_text(description_col))
            d = drop_empty_text(df.withColumn("text", t), "text")
        else:
            d = df.where(has_clean_text(text_col)).withColumn("text", clean_text(text_col))
        d = encode_labels(d, category_col)
    else:
        raise ValueError("Unknown route: %s" % route)
    if materialize:
        d = keys = write_table(d)
    else:
        keys = write_table(d.select(*{key: 0, category_col: 0, "label": 0}))
    d, keys = (drop_rare_classes(x, category_col, min_count, keys) for x in (d, keys))
    return stratified_split(d, "label", key, test=test, val=val, seed=seed, keys=keys)


def publish_dataset(reviews: DataFrame, products: DataFrame, path: str, fmt: str = "parquet", **kw) -> DataFrame:
    """B1 with its guard and sinks: build the dataset, refuse it if no row has
    an image link, publish it with its category map under ``path``, and return
    the published rows with their label codes. Safe to rerun: see
    :mod:`prodlens.sources.publish`."""
    from prodlens.operators.assemble import build_dataset
    from prodlens.sources.publish import publish, read_published
    built = build_dataset(reviews, products, **kw)
    version = publish(built, path, fmt=fmt)
    data, cmap = read_published(reviews.sparkSession, path, version, built.schema if fmt != "csv" else None)
    return encode_labels(data, "category", cmap=cmap)


def split_frames(prepared: DataFrame, split: str = "split"):
    """The train / val / test rows of a prepared table."""
    return tuple(prepared.where(F.col(split) == s) for s in ("train", "val", "test"))


def run_baselines(prepared: DataFrame, key: str = "doc_id", text_col: str = "text",
                  names=None, max_iter: int | None = None, class_weights: bool = False) -> DataFrame:
    """B4: fit TF-IDF on train, vectorise all splits, train the baselines,
    score train/val/test; the results table rounded to 4 decimals.
    ``max_iter`` caps the linear solvers (default: the reference's 1000);
    ``class_weights`` gives every class of the training rows equal weight."""
    from prodlens.operators import features, models
    from prodlens.operators.labels import class_weights as balanced
    train, val, test = split_frames(prepared)
    tm = features.fit_tfidf(train, key, text_col)
    pm = models.tfidf_pipeline(tm, text_col, "features")
    if class_weights:
        k = train.agg(F.max("label")).first()[0]
        train = models.with_class_weights(train, balanced(train, (k if k is not None else -1) + 1))
    parts = [models.vectorize(pm, d).persist() for d in (train, val, test)]
    with arrow_rows(prepared.sparkSession, VECTOR_ROWS):
        res, fitted = models.train_all(*parts[:2], key, names or models.BASELINES,
                                       weight_col="weight" if class_weights else None,
                                       max_iter=max_iter or models.MAX_ITER)
        out = models.evaluate_all(res, fitted, parts[2], key)
    for d in parts:
        d.unpersist()
    return out


def run_classifier(prepared: DataFrame, vectors: DataFrame, key: str, vec_col: str,
                   hidden: int = 512, max_iter: int = 100, class_weights: bool = False,
                   store: ModelStore | None = None) -> DataFrame:
    """B5: an MLP head over per-row vectors (``vectors (key, vec_col)``);
    the hidden sizes ``[hidden, hidden // 2]`` are trained on train and saved
    in ``store`` (default: a new one in the shared checkpoint folder) with
    their validation F1; the best version of this data is loaded from there
    and scored on test: per-class report rows."""
    from prodlens.operators import metrics
    d = prepared.join(vectors, key, "inner")
    best = fit_heads(d, vec_col, {"mlp_%d" % h: [h] for h in (hidden, max(hidden // 2, 2))}, key, max_iter,
                     class_weights, store)
    return metrics.classification_report(best.where("split = 'test'").select(key, "label", "prediction", "probs"))


def fit_heads(d: DataFrame, vec_col: str, heads: dict[str, list[int]], key: str, max_iter: int = 100,
              class_weights: bool = False, store: ModelStore | None = None, name: str = "classifier") -> DataFrame:
    """Train MLP heads (name -> widths of the hidden layers) over an array
    column on the rows of split 'train', save each with its F1 on 'val', load
    the best version of this data back and score all rows with it:
    ``(key, split, label, prediction, probs)``."""
    from prodlens.operators import models
    from prodlens.operators.labels import class_weights as balanced
    store = store or ModelStore.temporary(d.sparkSession)
    # iterative solvers read the input once per iteration: write it once
    d = write_table(models.array_features(d.select(key, "label", "split", vec_col), vec_col).drop(vec_col))
    size = d.agg(F.max("label").alias("k"), F.first("features").alias("v")).first()
    train, val, _ = split_frames(d)
    weight = "weight" if class_weights else None
    if weight:
        train = models.with_class_weights(train, balanced(train, size["k"] + 1))
    train = train.persist()
    data = fingerprint(d.select(key, "label", "split"))
    candidates = {n: models.estimator("mlp", 1, layers=[len(size["v"]), *widths, size["k"] + 1], maxIter=max_iter)
                  for n, widths in heads.items()}
    models.select_on_validation(candidates, train, val, key, weight_col=weight, keep=lambda n, m, f1: store.save(
        m, name, f1, data, {"head": n, "layers": list(m.getOrDefault("layers")), "max_iter": max_iter}))
    train.unpersist()
    model = store.load(name, data)
    return models.score(model, d, key, keep=["split"])


def run_fusion_classifier(prepared: DataFrame, text_emb: DataFrame, image_emb: DataFrame, key: str,
                          text_col: str = "text_emb", image_col: str = "image_emb", hidden: int = 1024, common: int = 512,
                          max_iter: int = 100, class_weights: bool = True, store: ModelStore | None = None,
                          forms: tuple[str, ...] = ("concat", "add", "text", "image")) -> tuple[DataFrame, DataFrame]:
    """M9: heads over the vectors of both modalities. 'concat' joins them
    (hidden layers ``hidden`` and ``hidden // 2``); 'add' projects both to
    ``common`` numbers (fitted on train), adds them (one hidden layer of 512);
    'text' and 'image' are the same as 'concat' over one of them. Missing
    images are zeros. ``prepared`` has ``key, label, split``.

    Returns ``(results, predictions)``: form, split, accuracy, precision, recall
    and f1; form, key, split, label, prediction, probs (written once)."""
    from prodlens.operators import fusion, metrics
    rows = prepared.select(key, "label", "split")
    text = text_emb.select(key, F.col(text_col).alias("t")).join(rows, key, "left_semi")
    image = image_emb.select(key, F.col(image_col).alias("i")).join(rows, key, "left_semi")
    dims = [f.select(F.max(F.size(c))).first()[0] or 0 for f, c in ((text, "t"), (image, "i"))]
    train = rows.where("split = 'train'").select(key)

    def vectors(form: str) -> DataFrame:
        if form == "add":
            wt, wi = (fusion.fit_projection(f.join(train, key, "left_semi"), c, common, seed)
                      for f, c, seed in ((text, "t", 1), (image, "i", 2)))
            return fusion.fuse_add(text, image, key, wt, wi, common, "t", "i", "v")
        both = fusion.fuse_concat(text, image, key, dims[1], "t", "i", "v")
        return both.select(key, {"concat": F.col("v"), "text": F.slice("v", 1, dims[0]),
                                 "image": F.slice("v", dims[0] + 1, dims[1])}[form].alias("v"))
    found = None
    for form in forms:
        heads = {"fused_%s" % form: [512] if form == "add" else [hidden, hidden // 2]}
        p = fit_heads(rows.join(vectors(form), key), "v", heads, key, max_iter, class_weights, store, "fusion_" + form)
        p = p.select(F.lit(form).alias("form"), key, "split", "label", "prediction", "probs")
        found = p if found is None else found.unionByName(p)
    found = write_table(found)
    results = None
    for form in forms:
        for split in ("train", "val", "test"):
            m = metrics.metrics(found.where((F.col("form") == form) & (F.col("split") == split)), "weighted")
            m = m.select(F.lit(form).alias("form"), F.lit(split).alias("split"), *m.columns)
            results = m if results is None else results.unionByName(m)
    return results, found


def run_active_learning(prepared: DataFrame, key: str = "doc_id", text_col: str = "text",
                        iterations: int = 5, n: int = 500, strategy: str = "entropy",
                        frac: int = 10, journal: str | None = None) -> DataFrame:
    """B6: TF-IDF vectors, a labelled set of ``train // frac`` rows, then
    ``iterations`` rounds of naive-Bayes fit, uncertainty selection from
    the pool, move, refit and validation F1. Returns the history. A call with
    the ``journal`` of an earlier one that broke off goes on from there."""
    from prodlens.operators import active, features, models
    train, val, _ = split_frames(prepared)
    tm = features.fit_tfidf(train, key, text_col)
    pm = models.tfidf_pipeline(tm, text_col, "features")
    tr = models.vectorize(pm, train).select(key, "label", "features")
    va = models.vectorize(pm, val).select(key, "label", "features")
    labelled, pool = active.split_pool(tr, key, frac)
    n_train = tr.count()

    def fit(lab):
        return models.estimator("naive_bayes", n_train).fit(lab)

    def score(m, df):
        return models.score(m, df, key).select(key, "probs")

    def evaluate(m, df):
        return models._acc_f1(models.score(m, df, key))[1]

    hist, _, _ = active.al_loop(labelled, pool, va, key, fit, score, evaluate, iterations, n,
                                strategy, **({"journal": journal} if journal else {}))
    return hist
