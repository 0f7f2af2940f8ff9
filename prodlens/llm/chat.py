"""Chat formatting with a compiled template language.

The language (a sandbox: no calls, no attribute access beyond the names
below, no recursion):

* text; ``{{ expr }}`` prints; ``{# note #}`` is dropped
* ``{% for m in messages %} .. {% endfor %}``
* ``{% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}``
* ``{% generation %} .. {% endgeneration %}`` marks what a model learns from
* expressions: ``'text'``, numbers, ``true false none``, ``m.role``,
  ``m.text``, ``loop.index loop.first loop.last loop.previous_role``,
  ``+ == != and or not ( )`` and filters ``| escape | trim | lower | upper``

A template is parsed into a syntax tree, constants are folded (also whole
branches of ``if``), adjacent texts are joined, and the tree becomes Python
generator closures. They pull one message at a time, so a conversation of any
length streams through a task; its output is cut into pieces at turn
boundaries (``piece_chars``), and a piece carries its generation spans.

``escape`` makes control strings inside texts harmless and is reversible:
``\\`` becomes ``\\\\``, ``<|`` becomes ``<\\|`` and, in roles, a line feed
becomes ``\\n``.

Edge cases: null text or role is empty; rows of a conversation run by
(turn, role, text), nulls first, and repeated rows are turns of their own;
a null conversation id is one conversation; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import pick

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

CHATML = (
    "{% for m in messages %}"
    "{{ '<|im_' + 'start|>' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "lower": str.lower, "upper": str.upper}
FIELDS = {"m": {"role", "text"}, "loop": {"index", "first", "last", "previous_role"}}

# ---------------------------------------------------------------- syntax tree
# expressions: ("const", v) ("field", base, name) ("op", name, a, b) ("not", a) ("filter", name, a)
# statements:  ("text", s) ("print", e) ("for", var, body) ("if", [(e, body)..], body) ("gen", body)

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*')|(?P<num>\d+)|(?P<op>==|!=|[+|().])|(?P<name>[A-Za-z_]\w*))")


def _lex(src: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while src[at:].strip():
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError("cannot read %r" % src[at:])
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, src: str, loop_var: str | None):
        self.toks, self.i, self.var = _lex(src), 0, loop_var

    def parse(self):
        e = self.either()
        if self.i < len(self.toks):
            raise TemplateError("unexpected %r" % self.toks[self.i][1])
        return e

    def peek(self, *texts: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] != "str" and self.toks[self.i][1] in texts

    def take(self):
        if self.i >= len(self.toks):
            raise TemplateError("expression ends too early")
        self.i += 1
        return self.toks[self.i - 1]

    def _left(self, below, *ops: str):
        e = below()
        while self.peek(*ops):
            e = ("op", self.take()[1], e, below())
        return e

    def either(self):
        return self._left(self.both, "or")

    def both(self):
        return self._left(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self._left(self.total, "==", "!=")

    def total(self):
        return self._left(self.filtered, "+")

    def filtered(self):
        e = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError("no filter %r" % name)
            e = ("filter", name, e)
        return e

    def atom(self):
        kind, s = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1]))
        if kind == "num":
            return ("const", int(s))
        if s == "(":
            e = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
            return e
        if s in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[s])
        base = "m" if s == self.var else "loop" if s == "loop" and self.var else None
        if kind == "name" and base and self.peek("."):
            self.take()
            name = self.take()[1]
            if name in FIELDS[base]:
                return ("field", base, name)
        raise TemplateError("%r is not allowed here" % s)


_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


def parse(src: str) -> list:
    """The template as a list of statements."""
    parts, at = _PART.split(src), 0

    def block(ends: tuple[str, ...], var: str | None):
        nonlocal at
        out: list = []
        while at < len(parts):
            p = parts[at]
            at += 1
            if p.startswith("{#") or not p:
                continue
            if p.startswith("{{"):
                out.append(("print", _Expr(p[2:-2], var).parse()))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, rest
                out.append(statement(word, rest, var))
            else:
                out.append(("text", p))
        if ends:
            raise TemplateError("missing %s" % ends[-1])
        return out, "", ""

    def statement(word: str, rest: str, var: str | None):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not m or var:
                raise TemplateError("for runs over messages, once")
            return ("for", m[1], block(("endfor",), m[1])[0])
        if word == "generation":
            return ("gen", block(("endgeneration",), var)[0])
        if word == "if":
            cases, other = [], []
            end = "elif"
            while end == "elif":
                cond = _Expr(rest, var).parse()
                body, end, rest = block(("elif", "else", "endif"), var)
                cases.append((cond, body))
            if end == "else":
                other = block(("endif",), var)[0]
            return ("if", cases, other)
        raise TemplateError("no statement %r" % word)

    return block((), None)[0]


def _text(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _apply(op: str, a, b):
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return a == b if op == "==" else a != b


def fold_expr(e):
    """Evaluate what is constant."""
    if e[0] == "op":
        a, b = fold_expr(e[2]), fold_expr(e[3])
        if e[1] in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (e[1] == "and") else a
        if a[0] == b[0] == "const" and e[1] not in ("and", "or"):
            return ("const", _apply(e[1], a[1], b[1]))
        return ("op", e[1], a, b)
    if e[0] in ("not", "filter"):
        a = fold_expr(e[-1])
        if a[0] == "const":
            return ("const", not a[1] if e[0] == "not" else FILTERS[e[1]](_text(a[1])))
        return (*e[:-1], a)
    return e


def fold(body: list) -> list:
    """Constants printed become text, decided branches are inlined, adjacent
    texts are joined."""
    out: list = []
    for s in body:
        new: list = []
        if s[0] == "print":
            e = fold_expr(s[1])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("print", e)]
        elif s[0] == "if":
            cases, other = [], fold(s[2])
            for cond, b in s[1]:
                c = fold_expr(cond)
                if c[0] != "const":
                    cases.append((c, fold(b)))
                elif c[1]:
                    other = fold(b)
                    break
            new = [("if", cases, other)] if cases else other
        elif s[0] in ("for", "gen"):
            new = [(*s[:-1], fold(s[-1]))]
        else:
            new = [s]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


def _expr(e) -> Callable[[dict], object]:
    if e[0] == "const":
        return lambda env, v=e[1]: v
    if e[0] == "field":
        return lambda env, b=e[1], n=e[2]: env[b][n]
    if e[0] == "not":
        a = _expr(e[1])
        return lambda env: not a(env)
    if e[0] == "filter":
        f, a = FILTERS[e[1]], _expr(e[2])
        return lambda env: f(_text(a(env)))
    op, a, b = e[1], _expr(e[2]), _expr(e[3])
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _apply(op, a(env), b(env))


# Closures yield (kind, text): "out" text, "on" / "off" a generation mark, "turn" a turn's end.
def _closure(body: list) -> Callable[[dict, Iterator], Iterator[tuple[str, str]]]:
    def step(s):
        if s[0] == "text":
            return lambda env, ms, t=s[1]: iter((("out", t),))
        if s[0] == "print":
            e = _expr(s[1])
            return lambda env, ms: iter((("out", _text(e(env))),))
        if s[0] == "gen":
            inner = _closure(s[1])

            def gen(env, ms):
                yield ("on", "")
                yield from inner(env, ms)
                yield ("off", "")
            return gen
        if s[0] == "if":
            cases, other = [(_expr(c), _closure(b)) for c, b in s[1]], _closure(s[2])
            return lambda env, ms: next((b for c, b in cases if c(env)), other)(env, ms)
        inner = _closure(s[2])

        def loop(env, ms):
            prev, index, cur = None, 0, next(ms, None)
            while cur is not None:
                nxt, index = next(ms, None), index + 1
                yield from inner(env | {"m": cur, "loop": {
                    "index": index, "first": index == 1, "last": nxt is None, "previous_role": prev}}, ms)
                yield ("turn", "")
                prev, cur = cur["role"], nxt
        return loop

    steps = [step(s) for s in body]

    def run(env, ms):
        for f in steps:
            yield from f(env, ms)
    return run


class Template:
    """A compiled template; pickled by its source."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _closure(self.tree)

    def __reduce__(self):
        return (Template, (self.source,))

    def events(self, messages: Iterator[dict]) -> Iterator[tuple[str, str]]:
        return self._run({}, iter(messages))

    def pieces(self, messages: Iterator[dict], piece_chars: int) -> Iterator[tuple[str, list]]:
        """(text, generation spans) of at least ``piece_chars`` characters
        each, but for the last; cut only where a turn ends."""
        buf, size, spans, start = [], 0, [], None
        for kind, t in self.events(messages):
            if kind == "out":
                buf.append(t)
                size += len(t)
            elif kind == "on":
                start = size if start is None else start
            elif kind == "off":
                spans.append((start, size))
                start = None
            elif size >= piece_chars and start is None:
                yield "".join(buf), spans
                buf, size, spans = [], 0, []
        if buf or spans:
            yield "".join(buf), spans

    def render(self, messages) -> tuple[str, list]:
        """Whole text and spans, for a short list of messages."""
        return next(self.pieces(iter(messages), 1 << 62), ("", []))


PIECES = ("conv_id long, piece int, formatted string, "
          "spans array<struct<start:int,end:int>>")


def format_conversations(convs: DataFrame, template: str = CHATML, piece_chars: int = 1 << 20,
                         key: str = "conv_id") -> DataFrame:
    """One row per piece of a conversation (one piece, unless it is longer
    than ``piece_chars``): (conv_id, piece, formatted, spans). The rows of a
    conversation are adjacent and in order within their partition."""
    compiled = Template(template)  # errors show here, not in tasks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        nxt = next(rows, None)
        out: list = []
        chars = 0
        while nxt is not None:
            conv = nxt[0]

            def turns(conv=conv):
                nonlocal nxt
                while nxt is not None and nxt[0] == conv:
                    cur, nxt = nxt, next(rows, None)
                    yield {"role": cur[1], "text": cur[2]}
            it = turns()
            for i, (text, spans) in enumerate(compiled.pieces(it, piece_chars)):
                out.append((None if conv == "" else int(conv), i, text, spans))
                chars += len(text)
                if chars > 4 << 20:
                    yield _frame(out)
                    out, chars = [], 0
            for _ in it:  # a template without a loop leaves the turns unread
                pass
        if out:
            yield _frame(out)

    d = convs.select(F.coalesce(pick(convs, key, "string"), F.lit("")).alias("c"),
                     F.coalesce(pick(convs, "role", "string"), F.lit("")).alias("role"),
                     F.coalesce(pick(convs, "text", "string"), F.lit("")).alias("text"),
                     pick(convs, "turn", "long").alias("turn"))
    d = d.repartition("c").sortWithinPartitions("c", "turn", "role", "text").select("c", "role", "text")
    return d.mapInPandas(run, PIECES)


def _frame(rows: list) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=["conv_id", "piece", "formatted", "spans"])
    d["conv_id"] = d["conv_id"].astype("Int64")
    d["spans"] = [[{"start": a, "end": b} for a, b in s] for s in d["spans"]]
    return d


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a text in the default template, unescaped."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN_START, at):
            raise ValueError("no turn starts at %d" % at)
        nl = formatted.index("\n", at)
        end = formatted.index(TURN_END, nl + 1)
        yield unescape(formatted[at + len(TURN_START):nl]), unescape(formatted[nl + 1:end])
        at = end + len(TURN_END) + 1


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces (adjacent
    and in order, as :func:`format_conversations` leaves them)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, out = None, []
        for f in frames:
            for conv, piece, text, spans in f[["conv_id", "piece", "formatted", "spans"]].itertuples(index=False, name=None):
                if piece == 0:
                    if cur:
                        out.append(_digest(cur))
                    cur = [None if pd.isna(conv) else int(conv), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    cur[1] += 1
                    cur[2].update(("%s\n%s\n" % (role, said)).encode())
                for s in spans:
                    learnt = unescape(text[s["start"]:s["end"]])
                    cur[3] += len(learnt)
                    cur[4].update(learnt.encode())
                cur[5] += len(text)
            if len(out) > 2000:
                yield _digests(out)
                out = []
        if cur:
            out.append(_digest(cur))
        if out:
            yield _digests(out)
    return pieces.mapInPandas(run, DIGEST)


def _digest(c: list) -> tuple:
    return (c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5])


def _digests(rows: list) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
    d["conv_id"] = d["conv_id"].astype("Int64")
    return d
