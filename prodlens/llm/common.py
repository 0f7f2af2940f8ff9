"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodlens.session import ensure_checkpoint_dir

#: A word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Frames up to this many bytes may be broadcast; larger ones are joined by
#: a shuffle. Callers multiply a counted number of rows by the row width.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet("%s/%s.parquet" % (sf_dir, name))


def scratch(spark: SparkSession, kind: str = "tables") -> str:
    """A fresh folder name under the shared folder of ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    return posixpath.join(base.rstrip("/"), "prodlens-llm", kind, uuid.uuid4().hex)


#: Has Spark remove the shuffle files of an execution when it ends, not when the
#: driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read
    it back: later passes read columns, and no lost executor makes them differ.
    ``lean``, for large tables that are made of shuffles: packed harder, and the
    shuffle files go as soon as the table is written."""
    conf, path = df.sparkSession.conf, scratch(df.sparkSession)
    if lean:
        was = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, was) if was is not None else conf.unset(CLEANUP)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`materialise` wrote, after its last use."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {posixpath.dirname(f) for f in df.inputFiles()}:
        if "/prodlens-llm/" not in path:
            raise ValueError("not a table of ours: %s" % path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def observed(df: DataFrame, *values: Column) -> tuple[DataFrame, dict]:
    """:func:`materialise` and aggregates of the written rows, by name: taken
    while they are written, so no further job reads them again."""
    seen = Observation()
    out = materialise(df.observe(seen, *values))
    return out, seen.get


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`materialise` and the number of rows."""
    out, seen = observed(df, F.count(F.lit(1)).alias("n"))
    return out, seen["n"]


def pick(df: DataFrame, name: str, dtype: str) -> Column:
    """Column ``name`` cast to ``dtype``, or a null where the frame lacks it."""
    if name.lower() in [c.lower() for c in df.columns]:
        return F.col("`%s`" % name).cast(dtype)
    return F.lit(None).cast(dtype)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names (any letter case): an operator's
    own output columns replace columns of the same name."""
    low = {n.lower() for n in names}
    return df.select(*["`%s`" % c for c in df.columns if c.lower() not in low])


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hint_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size is within the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of a bounded list built on the driver (few partitions)."""
    struct = T._parse_datatype_string(schema)
    return spark.createDataFrame(rows, struct).coalesce(1)
