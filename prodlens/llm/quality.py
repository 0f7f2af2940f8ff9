"""Quality classifier: a sparse rule ensemble.

1. Statistics of whole texts (:mod:`textstats`) become a few ratios.
2. Boosted shallow trees are fitted to labelled rows; every path from a root
   to an inner node or leaf is a rule, a conjunction of ``ratio <= t`` and
   ``ratio > t``.
3. A lasso logistic regression over the 0/1 rules keeps a few with weights.
4. The kept rules compile into one Spark column expression of the ratios, so
   scoring is a projection.

Only the fit is bounded: it reads at most ``max_train`` labelled rows, those
with the smallest hash of their key (a documented parameter). Everything else
covers all rows. The sample is fitted in one sorted partition, so a rerun
gives the same model.

Edge cases: null and empty texts have zero statistics and get a score; labels
other than 0 and 1, null keys and null labels are not learnt from; a key with
several labels counts as 0 if any is 0; with no labelled rows the score is 0.5,
with labels of one class it is their smoothed rate; repeated documents are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import materialise, pick
from prodlens.llm.textstats import text_stats


def _ratio(a: str, b: str, plus: int = 0) -> Column:
    return F.col(a) / F.greatest(F.col(b) + plus, F.lit(1))


def ratios() -> dict[str, Column]:
    """What the rules speak of: name -> column over the statistics."""
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_lines": _ratio("n_dup_lines", "n_lines", 1),
        "repeat_words": _ratio("n_repeat_words", "n_words"),
        "upper": _ratio("n_upper", "n_letters"),
        "digits": _ratio("n_digits", "n_chars"),
        "loud": _ratio("n_loud", "n_words"),
        "punct": _ratio("n_punct", "n_words"),
        "distinct_words": _ratio("n_distinct_words", "n_words"),
        "symbol_words": _ratio("n_symbol_words", "n_words"),
        "stutter": _ratio("n_stutter_words", "n_words"),
        "lines_per_word": _ratio("n_lines", "n_words"),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (ratio, above, threshold), sorted


def tree_rules(debug: str) -> set[Rule]:
    """All root-to-node paths of a tree, from its printed form."""
    out: set[Rule] = set()
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (int(m[2]), m[3] == ">", float(m[4])))]
        tight: dict[tuple[int, bool], float] = {}
        for _, (f, above, t) in path:
            pick_ = max if above else min
            tight[f, above] = pick_(t, tight.get((f, above), t))
        out.add(tuple(sorted((f, a, t) for (f, a), t in tight.items())))
    return out


@dataclass
class RuleEnsemble:
    """Weighted rules; ``score`` is a column expression of the statistics."""
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def holds(self, rule: Rule, over: dict[str, Column]) -> Column:
        c = F.lit(True)
        for f, above, t in rule:
            x = over[self.names[f]]
            c = c & (x > F.lit(t) if above else x <= F.lit(t))
        return c

    def score(self, over: dict[str, Column] | None = None) -> Column:
        over = over or ratios()
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(self.holds(r, over), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        show = sorted(zip(self.weights, self.rules, strict=True), key=lambda x: -abs(x[0]))
        return ["%+.3f if %s" % (w, " and ".join("%s %s %.6g" % (self.names[f], ">" if a else "<=", t)
                                                for f, a, t in r)) for w, r in show]


def fit(labelled: DataFrame, key: str, label: str, max_train: int = 20_000, trees: int = 16,
        depth: int = 3, lasso: float = 0.0003) -> RuleEnsemble:
    """Fit to rows with statistics, a ``key`` and a 0/1 ``label``."""
    names = list(ratios())
    d = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    d = d.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(8), F.col(key).cast("string")), 1))
    n = d.count()
    if n > max_train:  # the hash cut leaves about 95% of the bound, the limit is hard
        d = d.where(F.col("_h") < F.lit(int((1 << 63) * 0.95 * max_train / n))).limit(max_train)
    d = d.select("_h", F.col(label).cast("double").alias("label"), F.array(*ratios().values()).alias("x"))
    d = materialise(d.repartition(1).sortWithinPartitions("_h", "label", "x"))
    ones, n = d.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not n or ones in (0, n):
        p = ((ones or 0) + 1) / (n + 2)
        return RuleEnsemble(names, [], [], _logit(p))
    train = d.withColumn("features", array_to_vector("x")).coalesce(1).cache()
    try:
        gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=8)
        rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in gbt.fit(train).trees)))
        if not rules:
            return RuleEnsemble(names, [], [], _logit((ones + 1) / (n + 2)))
        model = RuleEnsemble(names, rules, [0.0] * len(rules), 0.0)
        over = {nm: F.col("x")[i] for i, nm in enumerate(names)}
        fired = F.array(*[model.holds(r, over).cast("double") for r in rules])
        lr = LogisticRegression(featuresCol="fired", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                                maxIter=200, standardization=False)
        fitted = lr.fit(train.withColumn("fired", array_to_vector(fired)).select("fired", "label"))
    finally:
        train.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(names, [r for r, _ in kept], [w for _, w in kept], float(fitted.intercept))


def _logit(p: float) -> float:
    import math
    return math.log(p / (1 - p))


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per key: 0 if any of its labels is 0."""
    return (labels.select(pick(labels, key, "long").alias("_lk"), pick(labels, label, "int").alias("_label"))
            .where("_lk is not null and _label in (0, 1)").groupBy("_lk").agg(F.min("_label").alias("_label")))


def held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def fit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality", **kw) -> tuple[RuleEnsemble, DataFrame]:
    """(model, statistics of all documents by ``key``), in one pass over the
    texts. Rows that are held out are not learnt from."""
    d = docs.select(pick(docs, key, "long").alias(key), pick(docs, text, "string").alias(text))
    stats = materialise(text_stats(d, text, [key]))
    joined = (stats.where(~held_out(F.col(key))).join(one_label(labels, key, label), F.col(key) == F.col("_lk")))
    return fit(joined, key, "_label", **kw), stats


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "quality", threshold: float = 0.3, **kw) -> DataFrame:
    """``docs`` plus ``quality_score`` and ``quality_ok``. The texts are read
    twice (fit and score) and never shuffled."""
    model, _ = fit_documents(docs, labels, key, text, label, **kw)
    row = F.struct(*["`%s`" % c for c in docs.columns]).alias("_row")
    d = docs.select(row, pick(docs, text, "string").alias("_text"))
    s = model.score()
    out = text_stats(d, "_text", ["_row"]).withColumn("_score", s)
    cols = [F.col("_row.`%s`" % c).alias(c) for c in docs.columns
            if c.lower() not in ("quality_score", "quality_ok")]
    return out.select(*cols, F.col("_score").alias("quality_score"),
                      (F.col("_score") >= threshold).alias("quality_ok"))


def score_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.3,
                 **kw) -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    model, stats = fit_documents(docs, labels, key, **kw)
    d = stats.withColumn("score", model.score())
    return d.select(key, held_out(F.col(key)).alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
