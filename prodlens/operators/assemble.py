"""Assembly of the training table from reviews and product metadata:
per-product latest reviews, the reviews x products join, text assembly,
image choice and the row filters of both dataset builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.functions.paths import first_image_url, first_image_url_by_size, image_path
from prodlens.functions.text import combined_text, join_description, review_text
from prodlens.operators.ranking import sample_n

# Fixed value: category given to products without one in the raw builder.
UNKNOWN_CATEGORY = "Unknown"


def latest_per_key(df: DataFrame, key: str, order: str, k: int = 5,
                   tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep the ``k`` rows with the largest ``order`` per ``key`` (ties by
    ``tiebreak`` ascending). Rows with a null key go.

    ``row_number() <= k`` is planned as a partial ``WindowGroupLimit``
    before the shuffle, so a hot key ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), *[F.col(t).asc() for t in tiebreak])
    return (df.where(F.col(key).isNotNull())
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= k).drop("_rn"))


def join_products(reviews: DataFrame, products: DataFrame, on: str = "parent_asin",
                  null_safe: bool = False,
                  suffixes: tuple[str, str] = ("_review", "_product")) -> DataFrame:
    """Inner equi-join; a product key that repeats multiplies its reviews.
    Columns present on both sides (besides ``on``) get ``suffixes``.
    ``null_safe`` matches a null key with a null key (pandas merge does);
    by default SQL equality drops null keys.

    No broadcast is forced: product metadata can be large, AQE picks
    broadcast or sort-merge from runtime sizes and splits skewed keys.
    """
    common = (set(reviews.columns) & set(products.columns)) - {on}
    r = reviews.select(*[F.col(c).alias(c + suffixes[0]) if c in common else F.col(c)
                         for c in reviews.columns])
    p = products.select(*[F.col(c).alias(c + suffixes[1]) if c in common
                          else (F.col(c).alias("_p_key") if c == on else F.col(c))
                          for c in products.columns])
    cond = r[on].eqNullSafe(p["_p_key"]) if null_safe else r[on] == p["_p_key"]
    return r.join(p, cond, "inner").drop("_p_key")


def min_length(df: DataFrame, col: str = "text", n: int = 10) -> DataFrame:
    """Keep rows whose text has more than ``n`` characters."""
    return df.where(F.length(col) > n)


def drop_empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Keep rows whose text is not empty."""
    return df.where(F.length(col) > 0)


def require_image(df: DataFrame, col: str = "image_path") -> DataFrame:
    """Keep rows that have an image path."""
    return df.where(F.col(col).isNotNull())


def default_category(c, default: str = UNKNOWN_CATEGORY) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def check_images_present(df: DataFrame, col: str = "image_url") -> int:
    """Number of non-null image links; raises when there are none."""
    n = df.agg(F.count(col).alias("n")).first()["n"]
    if n == 0:
        raise RuntimeError("no row has an image link")
    return n


def _is_list(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def build_dataset(reviews: DataFrame, products: DataFrame, sample_size: int | None = None,
                  key: str = "review_id", seed: int = 42, min_chars: int = 10,
                  null_safe: bool = False) -> DataFrame:
    """Raw builder: ``(review_id, text, category, parent_asin, rating,
    image_url)``.

    review text = strip(title + ' ' + text); product text, description
    list joined by spaces, category defaulting to 'Unknown', first usable
    image link (shape A); inner join on ``parent_asin``; combined text;
    keep texts longer than ``min_chars``; then an exact repeatable sample
    of ``sample_size`` rows by ``key`` when there are more.
    """
    r = reviews.select(key, "parent_asin", "rating",
                       review_text("title", "text").alias("review_text"))
    p = products.select(
        "parent_asin",
        F.coalesce(F.col("title"), F.lit("")).alias("product_title"),
        join_description("description", _is_list(products, "description")).alias("product_description"),
        default_category("main_category").alias("category"),
        first_image_url("images").alias("image_url"))
    j = join_products(r, p, "parent_asin", null_safe=null_safe)
    d = j.select(key, combined_text("product_title", "product_description", "review_text").alias("text"),
                 "category", "parent_asin", "rating", "image_url")
    d = min_length(d, "text", min_chars)
    if sample_size:
        d = sample_n(d, sample_size, key, seed)
    return d


def product_image_paths(products: DataFrame, image_dir: str, key: str = "parent_asin",
                        ext: str = ".jpg") -> DataFrame:
    """Products with ``image_path``: where a usable link exists (shape B,
    ``large`` before ``hi_res``) the file a downloader stores it under,
    ``image_dir/<key><ext>``; else null."""
    url = first_image_url_by_size("images")
    return products.withColumn("image_path", F.when(url.isNotNull(), image_path(image_dir, key, ext)))


def build_training_table(reviews: DataFrame, products: DataFrame, image_dir: str = "data/images",
                         k: int = 5, sample_size: int | None = None, key: str = "review_id",
                         seed: int = 42, with_images: bool = True) -> DataFrame:
    """Hub builder: ``(review_id, text, category, parent_asin, image_path,
    rating, verified_purchase, helpful_vote)``.

    Optional exact sample of the reviews first; the ``k`` latest reviews
    per product (ties by ``key``); review text; inner join with suffixes
    ``_review`` / ``_product``; combined text = product title +
    description + review; ``main_category`` becomes ``category`` (null
    stays null); with ``with_images`` rows without an image path go.
    """
    r = reviews
    if sample_size:
        r = sample_n(r, sample_size, key, seed)
    r = latest_per_key(r, "parent_asin", "timestamp", k, tiebreak=[key])
    r = r.withColumn("review_text", review_text("title", "text"))
    p = product_image_paths(products, image_dir).select(
        "parent_asin", "title", "description", "main_category", "image_path")
    j = join_products(r, p, "parent_asin")
    d = j.select(key,
                 combined_text("title_product", join_description("description", _is_list(products, "description")), "review_text").alias("text"),
                 F.col("main_category").alias("category"), "parent_asin", "image_path",
                 "rating", "verified_purchase", "helpful_vote")
    if with_images:
        d = require_image(d)
    return d
