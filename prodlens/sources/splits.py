"""Line files read by byte ranges: the exact first lines, and CSV files whose
quoted fields hold line feeds.

Spark's text reader cuts files into ranges and gives each line the range it
starts in (``_metadata.file_block_start``); within a range, lines come in order.
So what has to be known about everything before a line is a sum over ranges:
the number of lines for the first ``n``, the number of quotes for CSV, where a
line feed ends a record if the quotes before it are even.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A row per byte range is broadcast; this many (some 64 MB) are some 350 TB.
MAX_RANGES = 2_800_000


def lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """(value, file, start, nth): lines with their file, the start of their
    byte range and an order within the range."""
    r = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                               F.monotonically_increasing_id().alias("nth"))


def first_lines(spark: SparkSession, path, n: int) -> DataFrame:
    """(value): the first ``n`` lines of the files in the order of their paths,
    the same under any split size. Lines are counted per byte range; only the
    range in which the ``n``-th line lies is numbered."""
    d = lines(spark, path)
    order = Window.orderBy("file", "start")  # a row per range
    c = d.groupBy("file", "start").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(order))
    last = c.where(F.col("upto") >= n).orderBy("file", "start").first() if n > 0 else None
    if n <= 0:
        return d.limit(0).select("value")
    if last is None:
        return d.select("value")
    here = (F.col("file") == last["file"]) & (F.col("start") == last["start"])
    before = (F.col("file") < last["file"]) | ((F.col("file") == last["file"]) & (F.col("start") < last["start"]))
    rest = d.where(here).withColumn("r", F.row_number().over(Window.partitionBy("file", "start").orderBy("nth")))
    return d.where(before).select("value").unionByName(
        rest.where(F.col("r") <= n - (last["upto"] - last["c"])).select("value"))


_PIECES = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one range, and the parts of those that don't."""
    at, seq, held, open_, opens = None, 0, [], False, True
    out: list[dict] = []

    def piece(closes: bool) -> dict:
        return {"file": at[0], "start": at[1], "seq": seq, "opens": opens, "closes": closes, "text": "\n".join(held)}
    for b in batches:
        for value, file, start, odd in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (file, start):
                if held:
                    out.append(piece(False))
                at, seq, held, open_, opens = (file, start), 0, [], odd, not odd
            held.append(value)
            open_ ^= value.count('"') & 1 == 1
            if not open_:
                out.append(piece(True))
                seq, held, opens = seq + 1, [], True
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
        out = []
    if held:
        yield pa.RecordBatch.from_pylist([piece(False)], schema=_PIECES)


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(file, start, seq, text): the records of CSV files, those with line
    feeds in quoted fields as one text. The range where a record starts reads
    it; only records that cross ranges are grouped."""
    d = lines(spark, path, "\n").select("value", F.xxhash64("file").alias("file"), "start")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = d.groupBy("file", "start").agg(F.sum(quotes).alias("q"))
    before = F.sum("q").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("odd"))
    t = per.limit(MAX_RANGES + 1).toArrow()
    if t.num_rows > MAX_RANGES:
        raise ValueError("more than %d byte ranges: raise spark.sql.files.maxPartitionBytes" % MAX_RANGES)
    odd = F.broadcast(spark.createDataFrame(t, per.schema))
    p = d.join(odd, ["file", "start"]).select("value", "file", "start", "odd").mapInArrow(
        _pieces, "file long, start long, seq long, opens boolean, closes boolean, text string")
    whole = p.where("opens and closes").select("file", "start", "seq", "text")
    part = p.where("not (opens and closes)")
    w = Window.partitionBy("file").orderBy("start", "seq")  # at most two parts a range
    part = part.withColumn("record", F.sum(F.col("opens").cast("int")).over(w))
    joined = part.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("x"))
    joined = joined.select("file", F.col("x")[0]["start"].alias("start"), F.col("x")[0]["seq"].alias("seq"),
                           F.concat_ws("\n", F.transform("x", lambda y: y["text"])).alias("text"))
    out = whole.unionByName(joined)
    return out.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")


def read_csv(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    """CSV files with a header each, read by many tasks whatever their quoted
    fields hold. Without a schema all columns are text, named by the header of
    the first file."""
    r = csv_records(spark, path)
    if schema is None:
        head = r.where("start = 0 and seq = 0").orderBy("file").first()
        if head is None:
            return spark.createDataFrame([], StructType())
        names = next(csv.reader([head["text"].lstrip("﻿")]))
        schema = StructType([StructField(n, StringType()) for n in names])
    ddl = schema if isinstance(schema, str) else ", ".join("`%s` %s" % (f.name, f.dataType.simpleString()) for f in schema)
    body = r.where("not (start = 0 and seq = 0)")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return body.select(F.from_csv("text", ddl, options).alias("row")).select("row.*")
