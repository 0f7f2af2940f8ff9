"""Image-link and file-path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preference order of image sizes inside one image entry
# (shape A), and the order of the size lists (shape B).
SHAPE_A_ORDER = ("hi_res", "large", "thumb")
SHAPE_B_ORDER = ("large", "hi_res")
# Fixed value: a list entry that stands for "no link" in shape B.
NONE_MARKER = "None"
# Fixed value: the doubled prefix that path normalisation collapses.
DOUBLED_PREFIX = "data/images/data/images"
SINGLE_PREFIX = "data/images"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_image_url(images) -> Column:
    """Shape A (array<struct<hi_res, large, thumb>>): walk the images in
    order and, inside each, hi_res > large > thumb; the first link that
    starts with ``http`` wins. Null when there is none."""
    flat = F.flatten(F.transform(
        _col(images), lambda x: F.array(*[x[k] for k in SHAPE_A_ORDER])))
    usable = F.filter(flat, lambda u: u.startswith("http"))
    return F.try_element_at(usable, F.lit(1))


def first_image_url_by_size(images) -> Column:
    """Shape B (struct<large: array, hi_res: array>): every ``large`` link
    before any ``hi_res`` one; skip null, '' and the string 'None'."""
    img = _col(images)
    links = F.concat(*[F.coalesce(img[k], F.array().cast("array<string>"))
                       for k in SHAPE_B_ORDER])
    usable = F.filter(links, lambda u: u.isNotNull() & (u != "") & (u != NONE_MARKER))
    return F.try_element_at(usable, F.lit(1))


def image_path(directory: str, id_col, ext: str = ".jpg") -> Column:
    """``directory/<id><ext>``; a null id gives null."""
    base = directory.rstrip("/")
    return F.concat(F.lit(base + "/"), _col(id_col).cast("string"), F.lit(ext))


def normalize_path(c) -> Column:
    """Null stays null; backslashes become '/'; the doubled image prefix
    is collapsed (every non-overlapping occurrence, one pass)."""
    p = F.replace(_col(c).cast("string"), F.lit("\\"), F.lit("/"))
    return F.replace(p, F.lit(DOUBLED_PREFIX), F.lit(SINGLE_PREFIX))
