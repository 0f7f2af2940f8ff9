"""Statistics of whole texts, one pass in numpy per Arrow batch.

``text_stats`` appends the columns of ``STATS`` to a frame (bigint counts).
Nulls and empty texts have zeros. The frame's other columns pass through;
columns named like a statistic are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm import kernels as K
from prodlens.llm.common import without


def _bytes(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars]] = True
    return m


SYMBOLS = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
DIGIT = _bytes("0123456789")
LOUD = _bytes("!?")
PUNCT = _bytes(".,;:")
LEAD = np.arange(256) & 0xC0 != 0x80  # first bytes of code points

#: Name -> what is counted in a text.
STATS = {
    "n_words": "words", "word_chars": "code points in words", "n_symbols": "characters of #*$%&|<>",
    "n_dup_lines": "lines with a word, equal to an earlier line",
    "n_repeat_words": "words in 5-word windows found twice or more",
    "n_chars": "code points", "n_lines": "line feeds", "n_upper": "A-Z", "n_letters": "ASCII letters",
    "n_digits": "0-9", "n_loud": "! and ?", "n_punct": ". , ; :", "n_distinct_words": "different words",
    "n_symbol_words": "words that end in one of #*$%&|<>!",
    "n_stutter_words": "words equal to the word before",
}
_ENDS = SYMBOLS | _bytes("!")


def slice_stats(s: K.Slice) -> list[np.ndarray]:
    h, owner = s.word_hashes(), s.owner()
    lead = LEAD[s.buf]
    in_word = lead & ~K.SPACE[s.buf]
    odd = _ENDS[s.buf[s.ends - 1]] if len(s.ends) else np.zeros(0, bool)
    who, _, _ = K.runs(owner, h)
    by = s.count_bytes
    return [s.n_words, by(in_word), by(SYMBOLS[s.buf]), K.repeated_lines(s),
            K.repeated_span_words(s, h, owner), by(lead), by(s.buf == K.NEWLINE), by(UPPER[s.buf]),
            by(LETTER[s.buf]), by(DIGIT[s.buf]), by(LOUD[s.buf]), by(PUNCT[s.buf]),
            np.bincount(who, minlength=s.n), np.bincount(owner[odd], minlength=s.n),
            np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=s.n)]


def text_stats(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) without the text, plus ``STATS``."""
    keep = [c for c in (keep or without(df, text, *STATS).columns)]
    d = df.select(F.col("`%s`" % text).cast("string").alias("_text"), *["`%s`" % c for c in keep])
    schema = without(d, "_text").schema
    fields = ", ".join("`%s` %s" % (f.name, f.dataType.simpleString()) for f in schema)
    out = ", ".join(filter(None, [fields, *("%s long" % n for n in STATS)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [slice_stats(s) for s in K.slices(b.column(0))]
            if not parts:
                continue
            cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*keep, *STATS])
    return d.mapInArrow(run, out)
