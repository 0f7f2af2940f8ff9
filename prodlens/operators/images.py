"""Image rows as Spark jobs: keep rows whose image exists and decodes, and
turn decoded images into fixed-size normalised pixel arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.sources.io import read_images

# ImageNet channel means and standard deviations (RGB order).
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)


def verify_images(df: DataFrame, directory: str, id_col: str = "parent_asin",
                  ext: str = ".jpg") -> DataFrame:
    """Rows of ``df`` whose file ``<directory>/<id><ext>`` exists and
    decodes: a semi-join on the path below ``directory`` against the
    decodable images there (Spark's image source with ``dropInvalid``; only
    the origin column is kept)."""
    spark = df.sparkSession
    below = r"^.*?\Q%s\E/+(.*)$" % re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(//)?", "", directory).rstrip("/")
    ok = read_images(spark, directory, drop_invalid=True).select(
        F.regexp_extract(F.col("image.origin"), below, 1).alias("_file")).distinct()
    d = df.withColumn("_file", F.concat(F.col(id_col).cast("string"), F.lit(ext)))
    return d.join(ok, "_file", "left_semi").drop("_file")


def _resize_bilinear(img: np.ndarray, size: int) -> np.ndarray:
    """``(h, w, c)`` -> ``(size, size, c)`` by bilinear interpolation with
    half-pixel centres."""
    h, w = img.shape[:2]
    ys = np.clip((np.arange(size) + 0.5) * h / size - 0.5, 0, h - 1)
    xs = np.clip((np.arange(size) + 0.5) * w / size - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    wy, wx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = img[y0][:, x0] * (1 - wx) + img[y0][:, x1] * wx
    bot = img[y1][:, x0] * (1 - wx) + img[y1][:, x1] * wx
    return top * (1 - wy) + bot * wy


def _to_features(height: int, width: int, channels: int, data: bytes, size: int) -> np.ndarray | None:
    if height is None or height <= 0 or data is None:
        return None
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float32)
    if channels == 1:
        a = np.repeat(a, 3, axis=2)
    rgb = a[:, :, 2::-1] if channels >= 3 else a          # BGR(A) -> RGB
    x = _resize_bilinear(rgb, size) / 255.0
    x = (x - np.array(IMAGENET_MEAN)) / np.array(IMAGENET_STD)
    return x.transpose(2, 0, 1).astype(np.float32).ravel()  # channel-first


def image_features(images: DataFrame, size: int = 224) -> DataFrame:
    """``(path, pixels)`` from Spark's image source: RGB, resized to
    ``size`` x ``size``, scaled to [0, 1], ImageNet-normalised, channel
    first, flattened (``3 * size * size`` floats). Undecodable images give
    null. Arrow batches through ``mapInPandas``; each task handles its own
    images."""
    src = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"),
                        F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"),
                        F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = [_to_features(h, w, c, d, size) for h, w, c, d in
                  zip(b["h"], b["w"], b["c"], b["data"])]
            yield pd.DataFrame({"path": b["path"], "pixels": px})

    return src.mapInPandas(run, "path string, pixels array<float>")
