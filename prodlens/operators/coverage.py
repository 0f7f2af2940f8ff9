"""File status of image paths and the coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.functions.paths import normalize_path

# Statuses and verdicts of the image coverage report.
MISSING_PATH, MISSING_FILE, VALID = "missing_path", "missing_file", "valid"
VERDICT_NONE, VERDICT_PARTIAL, VERDICT_ALL = "none", "partial", "all"


def list_files(spark: SparkSession, directory: str, glob: str = "*",
               recursive: bool = True) -> DataFrame:
    """``(path, length, modificationTime)`` of the files under a folder.
    The ``binaryFile`` source is used with ``content`` pruned, so file
    bodies are never read."""
    r = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", str(recursive).lower()).load(directory))
    return r.select("path", "length", "modificationTime")


# scheme and authority of a path: file:, file://, hdfs://host:port, s3a://bucket
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?"


def with_file_status(df: DataFrame, files: DataFrame, path_col: str = "image_path",
                     file_col: str = "path", out: str = "status",
                     strip_scheme: bool = True, root: str | None = None) -> DataFrame:
    """Add ``status``: 'missing_path' (null path), 'missing_file' (no such
    file) or 'valid'. Paths are normalised on both sides and, unless
    ``strip_scheme`` is off, compared without scheme and authority; paths of
    ``df`` that do not start with '/' are taken from ``root`` if that is
    given. One left join on the path (one row per distinct listed file)."""
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, SCHEME, "") if strip_scheme else c

    path = plain(normalize_path(path_col))
    if root is not None:
        base = plain(F.lit(root.rstrip("/") + "/"))
        path = F.when(path.startswith("/"), path).otherwise(F.concat(base, path))
    fl = files.select(plain(normalize_path(file_col)).alias("_fp")).distinct().withColumn("_exists", F.lit(True))
    # rows without a path match no file; a hash of the row spreads them (null
    # keys would all go to one shuffle partition)
    whole = [F.col("`%s`" % f.name) for f in df.schema
             if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    d = df.withColumn("_none", F.col(path_col).isNull())
    d = d.withColumn("_np", F.coalesce(path, F.concat(F.lit("\0"), F.xxhash64(*whole).cast("string"))))
    j = d.join(fl, F.col("_np") == fl["_fp"], "left")
    return j.withColumn(out, F.when(F.col("_none"), F.lit(MISSING_PATH))
                        .when(F.col("_exists").isNull(), F.lit(MISSING_FILE))
                        .otherwise(F.lit(VALID))).drop("_fp", "_exists", "_np", "_none")


def coverage_report(df: DataFrame, status: str = "status") -> DataFrame:
    """One row ``(total, missing_path, missing_file, valid, verdict)``;
    verdict 'none' without valid rows, 'all' when every row is valid,
    else 'partial'. One pass of conditional counts."""
    r = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(F.col(status) == MISSING_PATH).alias("missing_path"),
               F.count_if(F.col(status) == MISSING_FILE).alias("missing_file"),
               F.count_if(F.col(status) == VALID).alias("valid"))
    v = (F.when(F.col("valid") == 0, F.lit(VERDICT_NONE))
         .when(F.col("valid") < F.col("total"), F.lit(VERDICT_PARTIAL))
         .otherwise(F.lit(VERDICT_ALL)))
    return r.withColumn("verdict", v)
