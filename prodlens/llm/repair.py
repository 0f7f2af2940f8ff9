"""Repair of conversation structure by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Edits
bring it there: Keep a row, Rerole it to user or assistant, Delete it, Insert
an empty turn. The repair grammar is in Chomsky normal form: its nonterminal
``X[p, q]`` derives the rows (with edits) that lead the pattern from state p to
state q, its binary rules are ``X[p, q] -> X[p, r] X[r, q]``, its terminal
rules are the edits of one row, and the empty word derives insertions only. The
start symbols are ``X[0, 0]`` and ``X[0, a]``.

A cell holds, per nonterminal, the minimum of (cost, audit) over the
derivations of its span; audit is the string of the edits' initials. Row cells
are closed under insertion on both sides (insertion closure), so longer spans
need binary rules only. Cells are combined bottom-up by span length: 1, 2, 4,
... rows. As the nonterminals carry the states at both ends of a span, every
cut of a span gives the same cell, so one cut is enough and a conversation of n
rows takes about n combinations. Minima of parts give the minimum of the whole
also in the audit: two derivations of a span with equal cost delete, keep and
rerole equally many rows, so neither audit is a proper prefix of the other.

Scale: rows of a conversation are cut into blocks by their turns; each block's
cell is made in its own task, then the cells of a conversation are folded in
order, and its audit goes back to the blocks, which write their part of the
repaired text. Equal rows of a turn are one row with a count. Duplicates are
found by a minimum per (conversation, role and text), combined before the
shuffle, and a join that AQE may split. A conversation's audit is held whole by
the task that folds it (a byte a row, as it is the result); texts are streamed.

Edge cases: nulls in any column read as one space (a null conversation id is
one conversation of its own, reported with a null id); null turns come first; rows that tie in turn
are ordered by the MD5 of role and text; a role without characters has no
initial and can't be kept; conversations whose rows are all gone
have zeros and the empty string's digest; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import materialise, pick

#: Costs of the edits, and of an undeleted truncated row (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns per block.
BLOCK = 1024

#: States of the pattern: start, after the system turn, after a user turn,
#: after an assistant turn; moves by role initial.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
#: Nonterminals, and the middle states of each one's binary rules.
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {x: i for i, x in enumerate(PAIRS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in PAIRS]

#: A derivation: cost, audit, whether its first turn is a kept system turn.
#: A cell: a derivation or None per nonterminal.
Cell = list


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is None or b is None:
                continue
            c = a[0] + b[0]
            if best is None or c <= best[0]:
                x = (c, a[1] + b[1], a[2] or b[2])
                if best is None or x < best:
                    best = x
        out.append(best)
    return out


def _cell(found: dict) -> Cell:
    return [found.get(x) for x in PAIRS]


def closure() -> Cell:
    """Cheapest insertions between states (nothing from a state to itself)."""
    found = {(p, p): (0, "", False) for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit, lead) in list(found.items()):
            for (s, role), q in MOVES.items():
                x = (cost + INSERT, audit + "I", lead)
                if s == r and role != "s" and x < found.get((p, q), (1 << 60,)):
                    found[p, q] = x
    return _cell(found)


EMPTY = closure()


def row_cell(initial: str, truncated: bool, alive: bool) -> Cell:
    """The closed cell of one row; a row that isn't ``alive`` (blank or
    duplicate) has to be deleted."""
    found = {(p, p): (DELETE, "D", False) for p in range(4)}
    more = TRUNCATED if truncated else 0
    for (p, role), q in MOVES.items() if alive else ():
        if role == initial:
            found[p, q] = (KEEP + more, "K", p == 0 and role == "s")
        elif role != "s":
            found[p, q] = (REROLE + more, "R", False)
    return combine(combine(EMPTY, _cell(found)), EMPTY)


def power(cell: Cell, n: int) -> Cell:
    """The cell of ``n`` equal rows."""
    out = None
    while n:
        if n & 1:
            out = cell if out is None else combine(cell, out)
        n >>= 1
        if n:
            cell = combine(cell, cell)
    return out if out is not None else EMPTY


def parse(rows: Iterable[tuple[str, bool, bool, int]]) -> tuple[Cell, int]:
    """The cell of a row sequence (initial, truncated, first, count), and its
    number of rows. Of ``count`` equal rows the first is alive if ``first``.

    Cells of equal span length are combined as they become neighbours, as in a
    binary counter, so only about log(n) cells are held.
    """
    stack: list[tuple[int, Cell]] = []
    total, made = 0, {}
    for initial, truncated, first, count in rows:
        total += count
        kind = (initial if initial in "sua" else "", truncated, first)
        if kind not in made:
            made[kind] = row_cell(*kind)
        cell = made[kind]
        if count > 1:
            cell = combine(cell, power(row_cell("", False, False), count - 1))
        size = 1
        while stack and stack[-1][0] == size:
            cell, size = combine(stack.pop()[1], cell), size * 2
        stack.append((size, cell))
    out = None
    for _, cell in reversed(stack):
        out = cell if out is None else combine(cell, out)
    return out or EMPTY, total


def best(cell: Cell) -> tuple[int, str, bool]:
    return min(cell[_AT[0, q]] for q in FINAL if cell[_AT[0, q]])


def cut_audit(audit: str, sizes: list[int]) -> Iterator[str]:
    """The audit in parts of ``sizes`` rows; insertions go with the row after
    them, those at the end with the last part."""
    at = 0
    for i, n in enumerate(sizes):
        end = at
        while n:
            n -= audit[end] != "I"
            end += 1
        yield audit[at:] if i == len(sizes) - 1 else audit[at:end]
        at = end


def turn_role(index: int, lead: bool) -> str:
    """Role of the ``index``-th turn of the repaired conversation after the
    system turn."""
    return "user" if (index - lead) % 2 == 0 else "assistant"


# --------------------------------------------------------------------- jobs
def damage(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(c, turn, role, text, n): the damaged rows by crc32 of ``conv_id:turn``
    modulo 20; ``n`` is 2 for a repeated row."""
    def text_of(name, dtype="string"):
        return F.coalesce(pick(convs, name, dtype).cast("string"), F.lit(" "))
    turn = pick(convs, "turn", "long")
    code = F.crc32(F.concat(text_of(key, "long"), F.lit(":"), text_of("turn", "long")).cast("binary")) % 20
    d = convs.select(F.coalesce(pick(convs, key, "long").cast("string"), F.lit("")).alias("c"), turn.alias("turn"),
                     text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code")).where("code != 0")
    return d.select(
        "c", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``id`` (MD5 of role and text) and ``block``; blocks do not fall along (turn, id)."""
    d = rows.withColumn("id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    first = F.conv(F.substring("id", 1, 3), 16, 10).cast("long") - (1 << 60)
    return d.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), first))


def entries(rows: DataFrame) -> DataFrame:
    """(c, block, turn, id, n, initial, blank, truncated, first): equal rows
    of a turn in one row; ``first``: not blank and not seen earlier."""
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    last = F.substring(end, -1, 1)
    d = _keyed(rows).select("c", "block", "turn", "id", "n", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"),
                            (~last.isin(".", "!", "?")).alias("truncated"))
    d = materialise(d.groupBy("c", "block", "turn", "id").agg(F.sum("n").alias("n"), *[
        F.min(x).alias(x) for x in ("initial", "blank", "truncated")]))
    seen = d.groupBy("c", "id").agg(F.min(F.struct("turn")).alias("s"))  # null turns are smallest
    return d.join(seen, ["c", "id"]).select(*d.columns, (~F.col("blank") & F.col("turn").eqNullSafe(F.col("s.turn"))).alias("first"))


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of runs of equal first ``width`` columns in a sorted
    partition; rows are streamed."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    nxt = next(rows, None)
    while nxt is not None:
        key = nxt[:width]

        def run(key=key):
            nonlocal nxt
            while nxt is not None and nxt[:width] == key:
                yield nxt[width:]
                nxt = next(rows, None)
        it = run()
        yield key, it
        for _ in it:
            pass


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1 << 22, width=lambda r: 64) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += width(r)
        if held >= size:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_DERIVATION = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("lead", pa.bool_())])
_BLOCKS = pa.schema([("c", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("cell", pa.list_(_DERIVATION)),
                     ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
_PIECES = pa.schema([("c", pa.string()), ("block", pa.int64()), ("piece", pa.string()), ("before", pa.int64()),
                     ("lead", pa.bool_()), ("alone", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
_PARTS = pa.schema([("c", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("said", pa.string()), ("sha", pa.string())])


def block_cells(found: DataFrame) -> DataFrame:
    """(c, block, n, cell, illegal, head, tail) of every block."""
    def run(batches):
        def rows():
            for (c, block), it in _groups(batches, 2):
                seen = {"illegal": 0, "head": None, "tail": None}

                def watched(it=it, seen=seen):
                    for initial, truncated, first, n in it:
                        if seen["head"] is None:
                            seen["head"] = initial
                        else:
                            seen["illegal"] += seen["tail"] + initial not in ("su", "ua", "au")
                        seen["illegal"] += n - 1
                        seen["tail"] = initial
                        yield initial, truncated, first, n
                cell, n = parse(watched())
                yield {"c": c, "block": block, "n": n, **seen,
                       "cell": [d and {"cost": d[0], "audit": d[1], "lead": d[2]} for d in cell]}
        yield from _batched(rows(), _BLOCKS, width=lambda r: 200 + 12 * r["n"])
    d = found.repartition("c", "block").sortWithinPartitions("c", "block", F.col("turn").asc_nulls_first(), "id")
    return d.select("c", "block", "initial", "truncated", "first", "n").mapInArrow(
        run, "c string, block long, n long, cell array<struct<cost:long,audit:string,lead:boolean>>, "
             "illegal long, head string, tail string")


def fold_blocks(cells: DataFrame) -> DataFrame:
    """(c, block, piece, before, lead, alone, cost, audit, illegal): the part
    of the audit that edits a block, and the turns that stand before it; the
    first block of a conversation carries the last three."""
    def run(batches):
        def rows():
            for (c,), it in _groups(batches, 1):
                cell, blocks, sizes, illegal, tail = None, [], [], 0, None
                for block, n, found, inner, head, last in it:
                    x = [d and (d["cost"], d["audit"], d["lead"]) for d in found]
                    if cell is not None:  # only what starts the conversation is needed
                        cell = [d if p == 0 else None for (p, _), d in zip(PAIRS, cell, strict=True)]
                        illegal += tail + head not in ("su", "ua", "au")
                    cell = x if cell is None else combine(cell, x)
                    illegal, tail = illegal + inner, last
                    blocks.append(block)
                    sizes.append(n)
                cost, audit, lead = best(cell)
                before, alone = 0, len(blocks) == 1
                for i, (block, piece) in enumerate(zip(blocks, cut_audit(audit, sizes), strict=True)):
                    yield {"c": c, "block": block, "piece": piece, "before": before, "lead": lead, "alone": alone} | (
                        {"cost": cost, "audit": audit, "illegal": illegal} if i == 0 else {})
                    before += len(piece) - piece.count("D")
        yield from _batched(rows(), _PIECES, width=lambda r: 100 + 2 * len(r["piece"]))
    d = cells.repartition("c").sortWithinPartitions("c", "block").select("c", "block", "n", "cell", "illegal", "head", "tail")
    return d.mapInArrow(run, "c string, block long, piece string, before long, lead boolean, alone boolean, "
                             "cost long, audit string, illegal long")


def repaired_turns(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(c, block, part, said, sha): the repaired ``role:text`` lines of each
    block, in parts of about a megabyte; a conversation of one block has its
    digest in ``sha`` in place of them."""
    none = F.lit(None)
    head = plan.select("c", "block", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("id"),
                       none.cast("string").alias("role"), F.col("piece").alias("text"), F.col("before").alias("n"), "lead", "alone")
    body = _keyed(rows).select("c", "block", F.lit(1).alias("kind"), "turn", "id", "role", "text", "n",
                               none.cast("boolean").alias("lead"), none.cast("boolean").alias("alone"))

    def lines(piece: str, at: int, lead: bool, it) -> Iterator[str]:
        role = text = None
        left = 0
        for edit in piece:
            if edit != "I":
                if not left:
                    role, text, left = next(it)[1:4]
                left -= 1
                if edit == "D":
                    continue
            yield ("\n" if at else "") + (role if edit == "K" else turn_role(at, lead)) + ":" + ("" if edit == "I" else text)
            at += 1

    def run(batches):
        def out():
            for (c, block), it in _groups(batches, 2):
                _, _, piece, before, lead, alone = next(it)
                sha, held, size, part = hashlib.sha256(), [], 0, 0
                for line in lines(piece, before, lead, it):
                    if alone:
                        sha.update(line.encode())
                        continue
                    held.append(line)
                    size += len(line)
                    if size >= 1 << 20:
                        yield {"c": c, "block": block, "part": part, "said": "".join(held)}
                        held, size, part = [], 0, part + 1
                if alone or held:
                    yield {"c": c, "block": block, "part": part, "said": "".join(held), "sha": sha.hexdigest() if alone else None}
        yield from _batched(out(), _PARTS, width=lambda r: 100 + len(r["said"]))
    both = head.unionByName(body).repartition("c", "block").sortWithinPartitions(
        "c", "block", "kind", F.col("turn").asc_nulls_first(), "id")
    return both.select("c", "block", "kind", "role", "text", "n", "lead", "alone").mapInArrow(
        run, "c string, block long, part long, said string, sha string")


def digests(parts: DataFrame) -> DataFrame:
    """(c, sha): the digest of the repaired text of each conversation."""
    schema = pa.schema([("c", pa.string()), ("sha", pa.string())])

    def run(batches):
        def out():
            for (c,), it in _groups(batches, 1):
                sha = hashlib.sha256()
                for (said,) in it:
                    sha.update(said.encode())
                yield {"c": c, "sha": sha.hexdigest()}
        yield from _batched(out(), schema)
    long = (parts.where("sha is null").repartition("c").sortWithinPartitions("c", "block", "part")
            .select("c", "said").mapInArrow(run, "c string, sha string"))
    return parts.where("sha is not null").select("c", "sha").unionByName(long)


def repair_report(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per original conversation: faults of its damaged rows, cost and audit
    of the cheapest repair, and the digest of the repaired conversation."""
    rows = damage(convs, key)
    found = materialise(entries(rows))
    plan = materialise(fold_blocks(block_cells(found)))
    live = ~F.col("blank") & F.col("first")
    faults = found.groupBy("c").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((live & F.col("truncated")).cast("long")).alias("truncated"))
    fixed = plan.where("cost is not null").select("c", "illegal", "cost", "audit")
    shas = digests(materialise(repaired_turns(rows, plan)))
    all_ = convs.select(F.coalesce(pick(convs, key, "long").cast("string"), F.lit("")).alias("c")).distinct()
    out = all_.join(faults, "c", "left").join(fixed, "c", "left").join(shas, "c", "left")
    return out.select(F.expr("try_cast(c as bigint)").alias(key), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
