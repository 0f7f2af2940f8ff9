"""Vectorised text passes over Arrow string columns (numpy, inside tasks).

Texts are taken in slices of about ``SLICE`` bytes (a longer text is a slice
of its own), so a pass needs a bounded multiple of the slice or of the longest
text. Words are runs of bytes other than space and 0x09..0x0D, which is the
same as the rule on code points, because these bytes never occur inside
a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)  # odd
_BYTE = np.random.default_rng(20_240_101).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLICE + 1)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inverse):
            p = np.full(m, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


class Slice:
    """Some texts of a column: bytes, their offsets, and their words."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.buf, self.off = lo, hi, buf, off
        self.n = hi - lo
        sp = SPACE[buf]
        word = ~sp
        before = np.empty(len(buf), dtype=bool)
        after = np.empty(len(buf), dtype=bool)
        if len(buf):
            before[0], before[1:] = True, sp[:-1]
            after[-1], after[:-1] = True, sp[1:]
            inner = off[1:-1]
            inner = inner[inner < len(buf)]
            before[inner] = True
            after[inner[inner > 0] - 1] = True
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        #: words of text d: [first[d], first[d + 1])
        self.first = np.searchsorted(self.starts, off)
        self.n_words = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans (equal bytes, equal hash); ``fold``
        reads A-Z as a-z."""
        n = len(self.buf)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[self.buf] * up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MUL)

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends, fold)

    def count_bytes(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes that ``mask`` (by byte) marks."""
        c = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def slices(col: pa.Array) -> Iterator[Slice]:
    """A text column in slices; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32,
                         count=col.offset + len(col) + 1)[col.offset:].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + SLICE, side="right")) - 1
        hi = min(len(col), max(hi, lo + 1))
        yield Slice(lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def windows(h: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside a text, and the index
    of each window's first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, width):
        acc = acc * _MUL + h[j:j + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1:])
    return mix(acc[at]), at


def shingles(s: Slice, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every ``width``-word shingle; a text of fewer words has
    one shingle of them all, a text without words has none."""
    h, owner = s.word_hashes(), s.owner()
    w, at = windows(h, owner, width)
    short = np.flatnonzero((s.n_words > 0) & (s.n_words < width))
    if not len(short):
        return w, owner[at]
    acc = np.zeros(len(short), dtype=np.uint64)
    for j in range(width - 1):
        has = s.n_words[short] > j
        acc[has] = acc[has] * _MUL + h[s.first[short[has]] + j]
    extra = mix(acc ^ (s.n_words[short].astype(np.uint64) << U(56)))
    who = np.concatenate([owner[at], short])
    order = np.argsort(who, kind="stable")
    return np.concatenate([w, extra])[order], who[order]


def runs(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (group, value) pairs with counts; ``group`` ascends."""
    if not len(value):
        return group, value, np.zeros(0, np.int64)
    out = value.copy()
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b].sort()
    new = np.r_[True, (out[1:] != out[:-1]) | (group[1:] != group[:-1])]
    at = np.flatnonzero(new)
    return group[at], out[at], np.diff(np.r_[at, len(out)])


def repeated_span_words(s: Slice, h: np.ndarray, owner: np.ndarray, width: int = 5) -> np.ndarray:
    """Per text, the number of words that lie in a ``width``-word window which
    the text has twice or more (its first occurrence included)."""
    w, at = windows(h, owner, width)
    if not len(w):
        return np.zeros(s.n, dtype=np.int64)
    who = owner[at]
    # equal windows of one text become neighbours
    order = np.lexsort((w, who))
    ws, gs = w[order], who[order]
    same = (ws[1:] == ws[:-1]) & (gs[1:] == gs[:-1])
    twice = np.zeros(len(ws), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + width, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=s.n)


NEWLINE = 0x0A


def repeated_lines(s: Slice) -> np.ndarray:
    """Per text, the lines (split at line feeds) that hold a word and equal an
    earlier line of the text."""
    nl = np.flatnonzero(s.buf == NEWLINE)
    starts = np.sort(np.concatenate([s.off[:-1], nl + 1]))
    starts = starts[starts < len(s.buf)]
    starts = np.unique(starts)
    ends = np.empty_like(starts)
    if not len(starts):
        return np.zeros(s.n, dtype=np.int64)
    ends[:-1], ends[-1] = starts[1:], len(s.buf)
    ends = ends - ((s.buf[ends - 1] == NEWLINE) & (ends > starts))
    has = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends = starts[has], ends[has]
    who = np.searchsorted(s.off, starts, side="right") - 1
    h = s.hash_spans(starts, ends)
    total = np.bincount(who, minlength=s.n)
    g, _, _ = runs(who, h)
    return total - np.bincount(g, minlength=s.n)
