"""Publishing a dataset: staged, guarded, with a manifest as the commit.

A version is written to folders of its own; the line in the manifest comes
last. Readers see the versions of the manifest only, so an attempt that was
killed, or that the guard refused, changes nothing, and a rerun needs no clean-up.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prodlens.operators.assemble import check_images_present
from prodlens.operators.labels import category_map
from prodlens.sources.io import write_dataset
from prodlens.sources.store import fingerprint

MANIFEST = "version string, data string, map string, rows long, images long, categories long, format string, digest string, saved timestamp"


def map_object(cmap: DataFrame) -> DataFrame:
    """One row with the whole category map as one JSON object
    ``{name: index}``, names in order (the map is class-sized)."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "category")))
    return cmap.agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["category"], x["label"])))).alias("value"))


def publish(df: DataFrame, path: str, category: str = "category", image: str | None = "image_url", fmt: str = "parquet") -> str:
    """Write ``df`` and its category map as a new version under ``path``;
    returns the version. With ``image``, a dataset without any image link is
    refused (before anything is committed)."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    data, cmap = (posixpath.join(path.rstrip("/"), part, version) for part in ("data", "map"))
    write_dataset(df, data, fmt, mode="error")
    back = _read(spark, data, fmt, df)
    images = check_images_present(back, image) if image else 0
    codes = category_map(back, category)
    map_object(codes).coalesce(1).write.text(cmap)
    row = [(version, data, cmap, back.count(), images, codes.count(), fmt, fingerprint(back))]
    line = spark.createDataFrame(row, MANIFEST.rsplit(",", 1)[0]).withColumn("saved", F.current_timestamp())
    line.coalesce(1).write.mode("append").parquet(posixpath.join(path.rstrip("/"), "_manifest"))
    return version


def _read(spark: SparkSession, data: str, fmt: str, like: DataFrame | None = None) -> DataFrame:
    r = spark.read.format(fmt)
    if like is not None:
        r = r.schema(like.schema)
    if fmt == "csv":
        r = r.option("header", True).option("escape", '"').option("multiLine", True)
    return r.load(data)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The committed versions, a row each."""
    try:
        return spark.read.schema(MANIFEST).parquet(posixpath.join(path.rstrip("/"), "_manifest"))
    except AnalysisException:  # nothing committed yet
        return spark.createDataFrame([], MANIFEST)


def read_published(spark: SparkSession, path: str, version: str | None = None, schema=None) -> tuple[DataFrame, DataFrame]:
    """The dataset and the category map ``(category, label)`` of the last
    committed version, or of the one that is asked for."""
    v = versions(spark, path)
    v = v.where(F.col("version") == version) if version else v
    r = v.orderBy(F.col("saved").desc(), "version").first()
    if r is None:
        raise LookupError("no version is published in %s" % path)
    text = spark.read.text(r["map"], wholetext=True).first()
    codes = sorted(json.loads(text["value"]).items(), key=lambda x: x[1]) if text else []
    return (spark.read.format(r["format"]).schema(schema).load(r["data"]) if schema else _read(spark, r["data"], r["format"]),
            spark.createDataFrame(codes, "category string, label int"))
