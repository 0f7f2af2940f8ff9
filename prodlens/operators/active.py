"""Active learning: uncertainty selection, random selection, the initial
labelled/pool split, moving selected rows, and the loop.

Row identity is always a key column (never a position), so selections
are repeatable under any partitioning.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prodlens.functions.scores import uncertainty
from prodlens.operators.ranking import sample_n, top_n
from prodlens.session import write_table
from prodlens.sources.store import ModelStore


def score_uncertainty(scored: DataFrame, strategy: str = "entropy", probs: str = "probs",
                      out: str = "uncertainty") -> DataFrame:
    """Add the uncertainty of ``probs`` by ``strategy`` ('entropy',
    'margin', 'least_confidence'); unknown names raise."""
    return scored.withColumn(out, uncertainty(probs, strategy))


def select_uncertain(scored: DataFrame, n: int, key: str, col: str = "uncertainty") -> DataFrame:
    """The ``n`` most uncertain rows (ties by key; ``n <= 0`` gives none,
    ``n`` above the pool gives all of it)."""
    return top_n(scored, n, col, key)


def select_samples(scored: DataFrame, n: int, key: str, strategy: str = "entropy",
                   probs: str = "probs") -> DataFrame:
    """Score by ``strategy`` and keep the ``n`` most uncertain rows."""
    return select_uncertain(score_uncertainty(scored, strategy, probs), n, key)


def select_random(pool: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, pool)`` rows chosen uniformly without replacement, by a
    repeatable hash order of the key."""
    return sample_n(pool, n, key, seed)


def split_pool(train: DataFrame, key: str, frac: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Initial labelled set: a random ``n // frac`` rows of ``train``; the
    rest is the unlabelled pool (anti-join by key)."""
    n = train.count()
    labelled = sample_n(train, n // frac, key, seed)
    pool = train.join(labelled.select(key), key, "left_anti")
    return labelled, pool


def move_selected(labelled: DataFrame, pool: DataFrame, selected: DataFrame,
                  key: str) -> tuple[DataFrame, DataFrame]:
    """Add the pool rows whose key is selected to the labelled set (bag
    union) and remove them from the pool (anti-join)."""
    keys = selected.select(key).distinct()
    moved = pool.join(keys, key, "left_semi")
    return (labelled.unionByName(moved.select(*labelled.columns)),
            pool.join(keys, key, "left_anti"))


def sample_classes(df: DataFrame, label: str, m: int, seed: int = 42) -> DataFrame:
    """Rows of ``m`` randomly chosen classes (a hash-ordered sample of the
    distinct labels, then a semi-join)."""
    classes = sample_n(df.select(label).distinct().where(F.col(label).isNotNull()), m, label, seed)
    return df.join(F.broadcast(classes), label, "left_semi")


class Journal:
    """Rounds of an active-learning loop in a folder: tables and models are
    written first, the line of the start or of a round last, so a round that
    broke off is no round."""

    LINES = ("iteration int, n_samples_added int, train_size long, unlabeled_size long, strategy string, val_f1 double, "
             "seconds double, keys string, model string")

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = ModelStore(spark, self._path("models"))

    def _path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def start(self, labelled: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
        schema = "labelled string, pool string"
        r = self._table("start", schema).orderBy("labelled").first()
        if r is None:
            r = {n: self._path("tables", uuid.uuid4().hex) for n in ("labelled", "pool")}
            labelled.write.parquet(r["labelled"])
            pool.write.parquet(r["pool"])
            self.spark.createDataFrame([(r["labelled"], r["pool"])], schema).coalesce(1).write.parquet(self._path("start"))
        return self.spark.read.parquet(r["labelled"]), self.spark.read.parquet(r["pool"])

    def rounds(self) -> list:
        """The completed rounds in order."""
        return self._table("rounds", self.LINES).orderBy("iteration").collect()

    def keys(self, selected: DataFrame) -> tuple[DataFrame, str]:
        path = self._path("tables", uuid.uuid4().hex)
        selected.write.parquet(path)
        return self.spark.read.parquet(path), path

    def commit(self, row: tuple, keys: str, model) -> None:
        version = self.store.save(model, "round", row[5]) if hasattr(model, "write") else None
        line = self.spark.createDataFrame([(*row, keys, version)], self.LINES)
        line.coalesce(1).write.mode("append").parquet(self._path("rounds"))

    def model(self):
        """The model of the last round; None where there is none (it is fitted again)."""
        done = self.rounds()
        return self.store.load("round", version=done[-1]["model"]) if done and done[-1]["model"] else None


def al_loop(labelled: DataFrame, pool: DataFrame, val: DataFrame, key: str,
            fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame],
            evaluate: Callable[[object, DataFrame], float], iterations: int, n: int,
            strategy: str = "entropy", journal: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run ``iterations`` rounds: fit on ``labelled``, score the pool
    (``score`` returns ``(key, probs)``), select the ``n`` most uncertain
    (or ``n`` random rows for strategy 'random'), move them, refit and
    record ``val_f1``. Stops early when the pool is empty.

    Returns ``(history, labelled, pool)``; history has ``iteration,
    n_samples_added, train_size, unlabeled_size, strategy, val_f1,
    seconds``. The two start tables are written once under
    ``spark.checkpoint.dir``; a round scores the pool once, into a table of
    keys and scores, and writes its ``n`` selected keys. Labelled set and pool are the start
    tables joined with the keys selected so far (``n`` keys a round), so
    lineage does not grow and a lost executor does not replay earlier rounds.

    With ``journal`` (a folder) the start tables, each round's keys, metrics and
    model are kept there, and a new call with the same folder goes on after the
    last round that was completed; the given start tables are then not read.
    """
    spark = labelled.sparkSession
    log = Journal(spark, journal) if journal else None
    if log:
        start, start_pool = log.start(labelled, pool)
    else:
        start, start_pool = write_table(labelled), write_table(pool)
    labelled, pool = start, start_pool
    train_size, pool_size = start.count(), start_pool.count()
    rows = log.rounds() if log else []
    picked: DataFrame | None = None
    for r in rows[:iterations]:
        sel = spark.read.parquet(r["keys"])
        picked = sel if picked is None else picked.unionByName(sel)
        train_size, pool_size = r["train_size"], r["unlabeled_size"]
    rows = [tuple(r)[:7] for r in rows[:iterations]]
    if picked is not None:
        labelled, pool = move_selected(start, start_pool, picked, key)
    model = (log.model() if log else None) or (fit(labelled) if len(rows) < iterations else None)
    for it in range(len(rows) + 1, iterations + 1):
        t0 = time.time()
        if pool_size == 0:
            break
        if strategy == "random":
            sel = select_random(pool, n, key, seed=it)
        else:
            scores = score_uncertainty(score(model, pool), strategy).select(key, "uncertainty")
            sel = select_uncertain(scores, n, key)
        sel = sel.select(key)
        sel, keys = log.keys(sel) if log else (write_table(sel), None)
        added = sel.count()
        picked = sel if picked is None else picked.unionByName(sel)
        labelled, pool = move_selected(start, start_pool, picked, key)
        train_size, pool_size = train_size + added, pool_size - added
        model = fit(labelled)
        f1 = float(evaluate(model, val))
        rows.append((it, added, train_size, pool_size, strategy, f1, time.time() - t0))
        if log:
            log.commit(rows[-1], keys, model)
    hist = spark.createDataFrame(rows, "iteration int, n_samples_added int, train_size long, "
                                       "unlabeled_size long, strategy string, val_f1 double, "
                                       "seconds double")
    return hist, labelled, pool
