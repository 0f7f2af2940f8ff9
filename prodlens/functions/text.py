"""Text column expressions (all JVM-side, no Python workers).

Every function takes and returns a ``Column`` so it can be used in
``select`` / ``withColumn`` on batch or streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prodlens.functions.core import let

# The Unicode whitespace set of Python's ``str.isspace`` /
# ``re`` ``\s`` (Java's ``\s`` is ASCII-only, so the class is spelled out).
# Written in the ``\x{..}`` form that both Java regex and RE2 accept.
WS = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# The cleaning rules (lower-case first, then in this order).
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = r"(http|www)[^" + WS + r"]+"
NON_ALNUM_PATTERN = r"[^a-z0-9]+"
# Fixed value: a token is a run of two or more non-space characters.
TOKEN_PATTERN = r"[^ ]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove Unicode whitespace at both ends (Spark ``trim`` only
    removes U+0020)."""
    return F.regexp_replace(_col(c), r"^[" + WS + r"]+|[" + WS + r"]+$", "")


def clean_text(c) -> Column:
    """null -> ''; lower; drop tags; drop http/www runs; every other
    non-[a-z0-9] run -> one space; trim."""
    s = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    s = F.regexp_replace(s, TAG_PATTERN, "")
    s = F.regexp_replace(s, URL_PATTERN, "")
    s = F.regexp_replace(s, NON_ALNUM_PATTERN, " ")
    return F.trim(s)


def has_clean_text(c) -> Column:
    """Whether :func:`clean_text` leaves anything. A text without a tag or
    link start keeps its first letter or digit, so only the others are
    cleaned for the answer."""
    s = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    odd = s.contains("<") | s.contains("http") | s.contains("www")
    return F.when(odd, F.length(clean_text(c)) > 0).otherwise(s.rlike("[a-z0-9]"))


def clean_pair(text, description) -> Column:
    """Cleaned text followed by one space and the cleaned description."""
    return F.concat(clean_text(text), F.lit(" "), clean_text(description))


def review_text(title="title", text="text") -> Column:
    """strip(title + ' ' + text) with nulls read as ''."""
    return strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "),
                          F.coalesce(_col(text), F.lit(""))))


def join_description(c, is_list: bool = True) -> Column:
    """Description list joined by single spaces; a null list gives ''.
    Null elements are skipped. With ``is_list`` false the column is no
    list and is turned into text."""
    if not is_list:
        return F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.coalesce(F.array_join(_col(c), " "), F.lit(""))


def combined_text(product_title, description, review) -> Column:
    """strip(product_title + ' ' + description + ' ' + review), nulls as ''."""
    return strip(F.concat(
        F.coalesce(_col(product_title), F.lit("")), F.lit(" "),
        F.coalesce(_col(description), F.lit("")), F.lit(" "),
        F.coalesce(_col(review), F.lit(""))))


def tokens(cleaned) -> Column:
    """Word tokens of an already cleaned text: the space-separated runs of
    two or more characters (cleaned text only holds [a-z0-9] and spaces).
    A code-generated regex extraction (no higher-order function)."""
    return F.regexp_extract_all(F.coalesce(_col(cleaned), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def text_ngrams(tok, n_min: int = 1, n_max: int = 2) -> Column:
    """Same result as :func:`ngrams` for tokens without spaces (as
    :func:`tokens` gives), with code-generated regex functions: the tokens
    are joined by single spaces and every n-gram is a zero-width lookahead
    match at a token start, so overlapping n-grams come out in order."""
    t = _col(tok)
    joined = F.array_join(t, " ")
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(t)
        else:
            pattern = r"(?<![^ ])(?=([^ ]+(?: [^ ]+){%d}))" % (n - 1)
            parts.append(F.regexp_extract_all(joined, F.lit(pattern), 1))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ngrams(tok, n_min: int = 1, n_max: int = 2) -> Column:
    """Word n-grams (joined by a space) of a token array, for
    ``n_min <= n <= n_max``; unigrams first, then bigrams, ...

    Built from shifted slices combined with ``zip_with``; the token array
    is bound once with :func:`let`, and no lambda refers to an outer
    expression (Spark would evaluate it once per element).
    """
    def body(t):
        parts = []
        for n in range(n_min, n_max + 1):
            if n == 1:
                parts.append(t)
                continue
            cnt = F.greatest(F.size(t) - n + 1, F.lit(0))
            grams = F.slice(t, 1, cnt)
            for k in range(1, n):
                grams = F.zip_with(grams, F.slice(t, k + 1, cnt), _join_pair)
            parts.append(F.when(cnt >= 1, grams).otherwise(F.array().cast("array<string>")))
        return parts[0] if len(parts) == 1 else F.concat(*parts)
    return let(_col(tok), body)


def _join_pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def min_length(c, n: int) -> Column:
    """Predicate: text longer than ``n`` characters (code points)."""
    return F.length(_col(c)) > n
