"""Secret scans: rules, and a character network over everything that might be one.

Three rules (assigned values, access keys, long hexadecimal runs) give the base
findings. Candidates are all runs of ``MIN_RUN`` or more characters of keys and
tokens that hold a digit, a step from lower to upper case, or stand behind an
assignment sign. A convolutional network reads each candidate and its
surroundings: 24 characters before, the candidate in tiles of 40, 8 after;
learnt character vectors, one convolution of width 5, maxima over the three
regions and the mean over the tile, a hidden layer, one logit. It is written in
numpy, forward and backward, and trained on labelled findings: candidates that
a rule found (label 1), other candidates (label 0), and re-drawn variants of
both in forms that the rules don't know (other key names, alphabets, lengths;
numbers, addresses, paths, identifiers). A candidate's score is its best tile's.

A fifth of the findings, by hash, isn't trained on: it calibrates the scores
(a logistic curve of the logit) and sets a threshold for each shape of
candidates (assigned, hexadecimal, other): the highest that keeps ``recall`` of
the labelled secrets of that shape. Candidates at or above it that touch no
base finding are added as kind ``net``.

Scale: two passes over the texts, without any shuffle of texts. The first
writes the different findings of all texts (a finding that repeats counts
once); they are dealt by hash to blocks of about ``BLOCK`` findings. The network
is trained on all blocks at once: each goes through its findings for an epoch,
then the networks of the blocks are averaged, as many epochs at any size. The
calibration sums over all held-out findings, and a threshold is an exact order
statistic of theirs, found by counts per bin. The second pass scores every
candidate of every text. The driver holds networks (some 10,000 numbers) and
counts, never findings; the result doesn't depend on the partitioning.

Edge cases: a null text is empty; an empty text has no findings; repeated rows,
and rows with null or equal ids, are each reported; candidates of any
length are read whole, tile by tile; without labelled findings of both labels
there is no network and base findings only; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.llm.common import local_rows, materialise, pick

KINDS = ("assign", "access", "hex", "net")


def _any_case(word: str) -> str:
    return "".join("[%s%s]" % (c, c.upper()) if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile("(?:%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
    [*map(_any_case, NAMES[:4]), _any_case("api") + "_?" + _any_case("key")]))
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")

MIN_RUN = 8
RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?" % MIN_RUN)
MIXED = re.compile("[0-9]|[a-z][A-Z]")
SIGN = re.compile("[:=]\\x20{0,4}[\"']?$")
#: With a letter: mere numbers are another shape.
HEXADECIMAL = re.compile("(?=[0-9]*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)")
SHAPES = ("assigned", "hexadecimal", "other")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the rules' findings, and (start, end) of the
    secrets inside them."""
    spans, values = [], []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end() - m.start(1) >= 8:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(1))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                spans.append((m.start(), 1, m.end()))
                values.append(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append(m.span())
    return sorted(spans), values


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, shape) of every candidate."""
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-/":
            b -= 1
        while a < b and text[a] in ".-/":
            a += 1
        if b - a < MIN_RUN:
            continue
        assigned = a > 0 and text[a - 1] in "\"' :=" and SIGN.search(text, max(0, a - 6), a)
        if assigned or MIXED.search(text, a, b):
            yield a, b, 0 if assigned else 1 if HEXADECIMAL.fullmatch(text, a, b) else 2


def touches(a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    return any(x < b and a < y for x, y in spans)


# ------------------------------------------------------------------ network
LEFT, TILE, RIGHT, WIDTH = 24, 40, 8, 5
LENGTH = LEFT + TILE + RIGHT
#: Rows of a training step; steps of a block and epochs at least; findings of a block.
BATCH, STEPS, EPOCHS, BLOCK = 256, 500, 14, 4096
REGIONS = ((0, LEFT), (LEFT, LEFT + TILE), (LEFT + TILE, LENGTH))
_CHARS = string.ascii_letters + string.digits + "+/_.=-\"' :;,@#()[]{}<>&$%!?*|\\~^`\n\t"
#: Symbols: 0 padding, 1 other ASCII, 2 beyond ASCII, then ``_CHARS``.
N_SYMBOLS = 3 + len(_CHARS)
SYMBOL = np.full(128, 1, dtype=np.uint8)
SYMBOL[[ord(c) for c in _CHARS]] = np.arange(3, N_SYMBOLS)


def _symbols(s: str) -> np.ndarray:
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(code < 128, SYMBOL[np.minimum(code, 127)], np.uint8(2))


def windows(left: str, value: str, right: str) -> np.ndarray:
    """Symbol rows (tiles, LENGTH) of a candidate; the last tile ends with it."""
    n = len(value)
    at = [*range(0, max(1, n - TILE + 1), TILE)]
    if n > TILE and at[-1] + TILE < n:
        at.append(n - TILE)
    whole = _symbols(left[-LEFT:] + value + right[:RIGHT])
    lead = min(len(left), LEFT)
    out = np.zeros((len(at), LENGTH), dtype=np.uint8)
    for row, a in zip(out, at, strict=True):
        before = whole[max(0, lead + a - LEFT):lead + a]
        tile = whole[lead + a:lead + min(n, a + TILE)]
        after = whole[lead + min(n, a + TILE):lead + min(n, a + TILE) + RIGHT]
        row[LEFT - len(before):LEFT] = before
        row[LEFT:LEFT + len(tile)] = tile
        row[LEFT + TILE:LEFT + TILE + len(after)] = after
    return out


_REGION = np.zeros((LENGTH, 3), dtype=np.float32)
for _i, (_a, _b) in enumerate(REGIONS):
    _REGION[_a:_b, _i] = 1


@dataclass
class Network:
    """Parameters, and the calibrated thresholds of the shapes."""
    w: dict
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple = (0.5, 0.5, 0.5)
    report: dict = field(default_factory=dict)
    moments: list = field(default_factory=list)  # of Adam, while it is trained
    steps: float = 0

    @staticmethod
    def fresh(seed: int, dim: int = 8, filters: int = 32, hidden: int = 32) -> Network:
        r = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)
        width = WIDTH * (dim + 3)
        return Network({"e": draw(N_SYMBOLS, dim, scale=0.3), "k": draw(width, filters, scale=(2 / width) ** 0.5),
                        "kb": np.zeros(filters, np.float32), "h": draw(4 * filters, hidden, scale=(0.5 / filters) ** 0.5),
                        "hb": np.zeros(hidden, np.float32), "o": draw(hidden, scale=hidden ** -0.5), "ob": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of symbol rows, and what :meth:`backward` needs."""
        w, n = self.w, len(x)
        v = np.concatenate([w["e"][x], np.broadcast_to(_REGION, (n, *_REGION.shape))], axis=2)
        pad = np.zeros((n, LENGTH + WIDTH - 1, v.shape[2]), np.float32)
        pad[:, WIDTH // 2:WIDTH // 2 + LENGTH] = v
        cols = np.concatenate([pad[:, i:i + LENGTH] for i in range(WIDTH)], axis=2)
        conv = np.maximum(cols.reshape(n * LENGTH, -1) @ w["k"] + w["kb"], 0).reshape(n, LENGTH, -1)
        tops = [a + conv[:, a:b].argmax(1) for a, b in REGIONS]
        pooled = [np.take_along_axis(conv, t[:, None, :], 1)[:, 0] for t in tops]
        pooled.append(conv[:, LEFT:LEFT + TILE].mean(1))
        f = np.concatenate(pooled, axis=1)
        h = np.maximum(f @ w["h"] + w["hb"], 0)
        return h @ w["o"] + w["ob"][0], (x, cols, conv, tops, f, h)

    def backward(self, d: np.ndarray, kept: tuple) -> dict:
        """Gradients for the loss whose derivative by the logits is ``d``."""
        x, cols, conv, tops, f, h = kept
        w, n, nf = self.w, len(x), self.w["k"].shape[1]
        dim = w["e"].shape[1]
        dh = np.outer(d, w["o"]) * (h > 0)
        df = dh @ w["h"].T
        dc = np.zeros_like(conv)
        rows, filt = np.arange(n)[:, None], np.arange(nf)[None, :]
        for i, t in enumerate(tops):
            dc[rows, t, filt] += df[:, i * nf:(i + 1) * nf]
        dc[:, LEFT:LEFT + TILE] += df[:, None, 3 * nf:] / TILE
        dc = (dc * (conv > 0)).reshape(n * LENGTH, nf)
        dcols = (dc @ w["k"].T).reshape(n, LENGTH, WIDTH, -1)
        dpad = np.zeros((n, LENGTH + WIDTH - 1, dim), np.float32)
        for i in range(WIDTH):
            dpad[:, i:i + LENGTH] += dcols[:, :, i, :dim]
        de = np.zeros_like(w["e"])
        np.add.at(de, x.ravel(), dpad[:, WIDTH // 2:WIDTH // 2 + LENGTH].reshape(-1, dim))
        return {"e": de, "k": cols.reshape(n * LENGTH, -1).T @ dc, "kb": dc.sum(0), "h": f.T @ dh, "hb": dh.sum(0),
                "o": h.T @ d, "ob": np.array([d.sum()], np.float32)}

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: list[int], span: range, epochs: int,
            batch: int = BATCH, rate: float = 3e-3) -> Network:
        """Adam on the weighted mean logistic loss: the epochs ``span`` of ``epochs``."""
        if not self.moments:
            self.moments = [{k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)]
        m, s = self.moments
        for epoch in span:
            order = np.random.default_rng([*seed, epoch]).permutation(len(y))
            step = rate * (1 - epoch / epochs)
            for a in range(0, len(y), batch):
                i = order[a:a + batch]
                z, kept = self.forward(x[i])
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)).astype(np.float32)
                self.steps += 1
                for k, g in self.backward(d, kept).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - step * (m[k] / (1 - 0.9 ** self.steps)) / (np.sqrt(s[k] / (1 - 0.999 ** self.steps)) + 1e-8)
        return self

    def flat(self) -> np.ndarray:
        """Parameters, moments and steps as one vector."""
        return np.concatenate([d[k].ravel() for d in (self.w, *self.moments) for k in sorted(d)] + [[self.steps]], dtype=np.float64)

    def load(self, v: np.ndarray) -> Network:
        """The network of a :meth:`flat` vector, of the shape of this one."""
        at, parts = 0, []
        for _ in range(3):
            parts.append({})
            for k in sorted(self.w):
                parts[-1][k] = v[at:at + self.w[k].size].reshape(self.w[k].shape).astype(np.float32)
                at += self.w[k].size
        return Network(parts[0], moments=parts[1:], steps=float(v[at]))

    def logits(self, x: np.ndarray, batch: int = 1024) -> np.ndarray:
        return np.concatenate([self.forward(x[a:a + batch])[0] for a in range(0, len(x), batch)] or [np.zeros(0, np.float32)])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z.astype(np.float64) + self.offset, -50, 50)))

    def scores(self, found: Iterable[tuple[str, str, str]], batch: int = 1024) -> np.ndarray:
        """Calibrated probability of each candidate (left, value, right)."""
        best: list[float] = []
        rows, owner = [], []

        def flush():
            if rows:
                for i, z in zip(owner, self.logits(np.concatenate(rows), batch), strict=True):
                    best[i] = max(best[i], float(z))
            rows.clear()
            owner.clear()
        for left, value, right in found:
            best.append(-np.inf)
            x = windows(left, value, right)
            for a in range(0, len(x), batch):  # a long candidate is scored in parts
                rows.append(x[a:a + batch])
                owner += [len(best) - 1] * len(rows[-1])
                if len(owner) >= batch:
                    flush()
        flush()
        return self.probability(np.array(best))


def calibrate(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton, lightly damped so that
    separable labels have finite values); ``sums`` gives the gradient and the
    Hessian of its loss over all logits (see :func:`curve_sums`)."""
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        g, hess = sums(c)
        move = np.linalg.solve(hess + 1e-2 * np.eye(2), g + 1e-2 * (c - [1.0, 0.0]))
        c = c - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return float(max(c[0], 1e-3)), float(c[1])


def curve_sums(c: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss of the curve ``c`` of ``z``."""
    a = np.stack([z.astype(np.float64), np.ones(len(z))], axis=1)
    p = 1 / (1 + np.exp(-np.clip(a @ c, -50, 50)))
    return a.T @ (p - y), (a * (p * (1 - p))[:, None]).T @ a


# --------------------------------------------------------- labelled findings
KEY_NAMES = ("password passwd secret token api_key auth access_key private_key client_secret bearer credential pwd passphrase "
             "signing_key session db_pass").split()
SIGNS = ("=", ": ", " = ", ' = "', '="', ": '", ":")
BASE62, BASE64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"


def _draw(r: np.random.Generator, chars: str, lo: int, hi: int) -> str:
    return "".join(chars[i] for i in r.integers(0, len(chars), r.integers(lo, hi + 1)))


def secret_variant(r: np.random.Generator, left: str, right: str) -> tuple[str, str, str]:
    """A re-drawn secret in the surroundings of a finding."""
    form = r.integers(0, 6)
    value = (_draw(r, "0123456789abcdef", 16, 64) if form == 0 else _draw(r, "0123456789ABCDEF", 16, 64) if form == 1 else
             _draw(r, BASE62, 16, 48) if form == 2 else _draw(r, BASE64, 22, 64) + "=" * int(r.integers(0, 3)) if form == 3 else
             _draw(r, string.ascii_lowercase, 2, 4) + "_" + _draw(r, BASE62, 20, 40) if form == 4 else
             _draw(r, string.ascii_uppercase, 4, 4) + _draw(r, string.ascii_uppercase + string.digits, 14, 20))
    words = left.split(" ")
    kept = " ".join(words[:-1]) + " " if len(words) > 1 else ""
    if r.random() < 0.6:
        sign = SIGNS[r.integers(0, len(SIGNS))]
        kept += KEY_NAMES[r.integers(0, len(KEY_NAMES))] + sign
        if sign[-1] in "\"'":
            right = sign[-1] + right.lstrip("\"'")
    return kept[-LEFT:], value, right


def plain_variant(r: np.random.Generator, left: str, right: str, words: list[str]) -> tuple[str, str, str]:
    """Something harmless of key-like characters in the surroundings of a finding."""
    digits = string.digits

    def word():
        return words[r.integers(0, len(words))] if words else "word"
    form = r.integers(0, 9)
    value = (_draw(r, digits, 8, 20) if form == 0 else ".".join(_draw(r, digits, 1, 3) for _ in range(4)) if form == 1 else
             "%04d-%02d-%02d" % tuple(r.integers((1900, 1, 1), (2100, 13, 29))) if form == 2 else
             "-".join(_draw(r, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)) if form == 3 else
             "_".join([word(), word(), _draw(r, digits, 1, 3)]) if form == 4 else word() + word().title() + _draw(r, digits, 0, 2) if form == 5 else
             "/".join([word(), word(), word() + _draw(r, digits, 1, 4) + ".txt"]) if form == 6 else
             word() + _draw(r, digits, 1, 2) + "." + word() + ".com" if form == 7 else word() + "-" + word() + _draw(r, digits, 1, 4))
    if len(value) < MIN_RUN:
        value = value + _draw(r, digits, MIN_RUN, MIN_RUN)
    cut = re.search(r"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?$", left)
    return (left[:cut.start()] if cut else left)[-LEFT:], value, right


def shape_of(left: str, value: str) -> int:
    return 0 if SIGN.search(left) else 1 if HEXADECIMAL.fullmatch(value) else 2


FINDING = "h long, label int, l string, v string, r string"
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def block_of(number: int, found: list[tuple], each: dict[int, int], by_position: bool, seed: int) -> Block:
    """(number, symbol rows, the finding or variant that each belongs to; label,
    held out, shape of these) of a block of findings (hash, label, left,
    value, right) in order, each with ``each`` variants of its label."""
    words = sorted({w for _, y, left, _, _ in found if not y for w in left.split() if w.isalpha() and len(w) > 2})
    rows = []  # label, held out, left, value, right
    for h, label, left, value, right in found:
        rows.append((label, h % 5 == 0, left, value, right))
        r = np.random.default_rng([seed, h & 0xFFFFFFFF, label])
        for i in range(each[label]):  # a variant stays on the side of its finding
            other = found[int(r.integers(0, len(found)))]
            near = (left, right) if i % 2 == 0 or (other[0] % 5 == 0) != (h % 5 == 0) else other[2:5:2]
            rows.append((label, h % 5 == 0, *(secret_variant(r, *near) if label else plain_variant(r, *near, words))))
    x = [windows(left, value, right) for _, _, left, value, right in rows]
    held = [i % 5 == 0 for i in range(len(rows))] if by_position else [r[1] for r in rows]
    return (number, np.concatenate(x), np.repeat(np.arange(len(rows)), [len(a) for a in x]), np.array([r[0] for r in rows]),
            np.array(held), np.array([shape_of(r[2], r[3]) for r in rows]))


def mean_of(parts: RDD, n: int) -> np.ndarray:
    """Mean of (number, weight, vector) by weight. The sums follow the
    numbers, so that reruns agree to the last digit."""
    def total(group):
        group = sorted(group, key=lambda x: x[0])
        return group[0][0], sum(w for _, w, _ in group), sum(w * v for _, w, v in group)
    sums = parts.map(lambda x: (x[0] // 64, x)).groupByKey(-(-n // 64)).map(lambda g: total(g[1])).collect()
    _, weight, v = total((i, 1, np.append(v, w)) for i, w, v in sums)
    return v[:-1] / v[-1]


def fit_blocks(blocks: RDD, n: int, seed: int) -> Network:
    """A network trained on the rows of ``n`` blocks that aren't held out, both
    labels with equal weight; as many epochs as ``STEPS`` steps of a block need,
    ``EPOCHS`` at least. After each epoch the blocks' networks are averaged."""
    def rows(block):
        _, _, own, y, held, _ = block
        return np.bincount(y[own][~held[own]], minlength=2)
    count = blocks.map(rows).reduce(np.add)
    total = int(count.sum())
    epochs = max(EPOCHS, -(-STEPS * BATCH * n // total))
    share = np.where(count > 0, 0.5 / np.maximum(count, 1), 0) * total
    net = Network.fresh(seed)
    each = epochs if n == 1 else 1  # a single block needs no averages
    for a in range(0, epochs, each):
        def step(block, net=net, span=range(a, a + each)):
            number, x, own, y, held, _ = block
            keep = ~held[own]
            label = y[own][keep]
            if not len(label):
                return []
            got = net.fit(x[keep], label.astype(np.float32), share[label], [seed, number], span, epochs)
            return [(number, len(label), got.flat())]
        net = net.load(mean_of(blocks.flatMap(step), n))
    net.moments = []
    return net


def order_key(z: np.ndarray) -> np.ndarray:
    """Integers in the order of 32-bit floats (its own inverse on their bits)."""
    i = z.astype(np.float32).view(np.int32)
    return np.where(i < 0, i ^ 0x7FFFFFFF, i)


def lowest_kept(scored: RDD, recall: float) -> tuple[list[int], list[float]]:
    """(counts, logits): of the held-out secrets of each shape, and of all, the
    number and the highest logit that keeps ``recall`` of them. Counts per bin
    of the upper, then of the lower 16 bits find it; the driver holds counts."""
    def counts(part: Callable) -> dict[tuple[int, int], int]:
        def run(block):
            _, z, y, held, shape = block
            for i in range(len(SHAPES) + 1):
                at = held & (y == 1) & ((shape == i) | (i == len(SHAPES)))
                for b, c in zip(*np.unique(part(order_key(z[at]), i), return_counts=True), strict=True):
                    yield (i, int(b)), int(c)
        return dict(scored.flatMap(run).reduceByKey(lambda a, b: a + b).collect())

    def nth(c: dict, i: int, rank: int) -> tuple[int, int]:
        for b in sorted(b for j, b in c if j == i):
            if rank < c[i, b]:
                return b, rank
            rank -= c[i, b]
        return 0, 0
    upper = counts(lambda k, i: k >> 16)
    sizes = [sum(c for (j, _), c in upper.items() if j == i) for i in range(len(SHAPES) + 1)]
    bins = [nth(upper, i, int(np.floor((1 - recall) * n))) for i, n in enumerate(sizes)]
    lower = counts(lambda k, i: k[k >> 16 == bins[i][0]] & 0xFFFF)
    keys = [b << 16 | nth(lower, i, rank)[0] for i, (b, rank) in enumerate(bins)]
    return sizes, [float(np.array([k if k >= 0 else k ^ 0x7FFFFFFF], np.int32).view(np.float32)[0]) for k in keys]


def train(found: DataFrame | list[tuple], variants: int = 2000, recall: float = 0.98, seed: int = 42) -> Network | None:
    """A calibrated network from labelled findings (hash, label, left, value,
    right; see :func:`labelled_findings`), or None without findings of both labels."""
    if isinstance(found, list):
        found = local_rows(SparkSession.active(), found, FINDING)
    sides = {(r[0], r[1]): r[2] for r in found.groupBy("label", (F.col("h") % 5 == 0).alias("held")).count().collect()}
    size = {y: sides.get((y, True), 0) + sides.get((y, False), 0) for y in (0, 1)}
    if not all(size.values()):
        return None
    n = -(-sum(size.values()) // BLOCK)
    each = {y: -(-variants // size[y]) for y in size}
    by_position = len(sides) < 4  # too few findings to hold some out by hash

    def build(number, rows):
        rows = [tuple(r) for r in rows]
        return [block_of(number, rows, each, by_position, seed)] if rows else []

    dealt = found.select("h", "label", "l", "v", "r").repartition(n, "h").sortWithinPartitions("h", "label", "l", "v", "r")
    blocks = dealt.rdd.mapPartitionsWithIndex(build).persist(StorageLevel.MEMORY_AND_DISK)
    scored = None
    try:
        net = fit_blocks(blocks, n, seed)

        def logits(block):
            number, x, own, y, held, shape = block
            z = np.full(len(y), -np.inf, np.float32)
            np.maximum.at(z, own, net.logits(x))
            return number, z, y, held, shape
        scored = blocks.map(logits).persist(StorageLevel.MEMORY_AND_DISK)

        def sums(c):
            parts = sorted(scored.map(lambda b: (b[0], *curve_sums(c, b[1][b[3]], b[2][b[3]]))).collect(), key=lambda x: x[0])
            return sum(g for _, g, _ in parts), sum(h for _, _, h in parts)
        slope, offset = calibrate(sums)
        net = Network(net.w, slope, offset)
        sizes, kept = lowest_kept(scored, recall)
        *own, pooled = map(float, net.probability(np.array(kept)))
        # a shape with few held-out secrets isn't set above the pooled threshold
        net.thresholds = tuple(p if c >= 50 else min(pooled, p) if c else pooled for p, c in zip(own, sizes))

        def flagged(block):
            _, z, y, held, shape = block
            hit = net.probability(z) >= np.array(net.thresholds)[shape]
            return np.array([(~held).sum(), (held & (y == 0)).sum(), (held & (y == 1)).sum(),
                             (hit & held & (y == 0)).sum(), (hit & held & (y == 1)).sum()])
        fitted, plain, secret, false, true = map(int, scored.map(flagged).reduce(np.add))
        net.report = {"train": fitted, "held_out": plain + secret, "recall": true / secret, "false_rate": false / plain,
                      "thresholds": net.thresholds}
    finally:
        blocks.unpersist()
        if scored is not None:
            scored.unpersist()
    return net


def labelled_findings(docs: DataFrame, text: str = "text", max_train: int | None = None) -> DataFrame | list[tuple]:
    """All different findings (h, label, l, v, r: hash, label, left, value,
    right), written once. For looking at some: a list of the ``max_train``
    of each label with the smallest hashes."""
    schema = pa.schema([("h", pa.int64()), ("label", pa.int32()), ("l", pa.string()), ("v", pa.string()), ("r", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist():
                t = t or ""
                _, values = base_spans(t)
                for a, e, _ in candidates(t):
                    label = int(touches(a, e, values))
                    x = (t[max(0, a - LEFT):a], t[a:e][:4 * TILE], t[e:e + RIGHT])
                    h = xxhash.xxh64_intdigest("\0".join(x).encode("utf-8", "surrogatepass"), label) >> 1
                    found.add((h, label, *x))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema=schema)
    d = docs.select(pick(docs, text, "string").alias("t"))
    found = materialise(d.mapInArrow(run, FINDING).distinct())
    if max_train is None:
        return found
    return [tuple(r) for label in (0, 1) for r in found.where(F.col("label") == label).orderBy("h").limit(max_train).collect()]


def scan(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array of (kind, start, end)) of every row; code points,
    ``end`` exclusive, by start and then by kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("k", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, more = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                spans, _ = base_spans(t)
                found.append(spans)
                if net is not None:
                    taken = [(a, e) for a, _, e in spans]
                    more += [(i, a, e, s, t[max(0, a - LEFT):a], t[a:e], t[e:e + RIGHT])
                             for a, e, s in candidates(t) if not touches(a, e, taken)]
            if more:
                for (i, a, e, s, *_), p in zip(more, net.scores(x[4:] for x in more), strict=True):
                    if p >= net.thresholds[s]:
                        found[i].append((a, 3, e))
            rows = [{"k": k, "spans": [{"kind": KINDS[j], "start": a, "end": e} for a, j, e in sorted(f)]}
                    for k, f in zip(b.column(0).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    d = docs.select(pick(docs, key, "long").alias("k"), pick(docs, text, "string").alias("t"))
    out = d.mapInArrow(run, "k long, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("k", key)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = 0.98, seed: int = 42) -> DataFrame:
    """:func:`scan` with a network trained on all findings of ``docs``."""
    return scan(docs, train(labelled_findings(docs, text), recall=recall, seed=seed), key, text)


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per row: base findings by kind, their digest, and all spans."""
    d = find_secrets(docs, key, text, **kw)

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def n_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return d.select(key, *map(n_of, KINDS[:3]),
                    F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
