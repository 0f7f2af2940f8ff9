"""DuckDB SQL of the queries of this package that SQL can express."""

from __future__ import annotations


def _nibbles() -> list[int]:
    """CRC-32 (reversed polynomial 0xEDB88320) of the sixteen nibbles."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, a nibble at a time."""
    data = ("flatten(list_transform(range(1, length(%s) + 1), lambda i: [ascii(substr(%s, i::INT, 1))::BIGINT, 0::BIGINT]))" % (text, text))
    step = "xor(xor(s, b) >> 4, (%s::BIGINT[])[((xor(s, b)) & 15) + 1])" % _nibbles()
    return "xor(list_reduce(%s, lambda s, b: %s, 4294967295::BIGINT), 4294967295::BIGINT)" % (data, step)


WORDS = r"length(regexp_extract_all(%s, '[^\x20\x09-\x0D]+'))"

TRIE = """
WITH t AS (
  SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) s FROM t GROUP BY c),
h AS (SELECT c, s, (%(crc)s) %% 4 h FROM (SELECT *, c::VARCHAR d FROM l)),
e AS (
  SELECT h.c, list_concat(CASE WHEN b.s IS NULL THEN h.s[1:0] ELSE b.s[1:h.h] END, h.s[h.h + 1:]) s
  FROM h LEFT JOIN l b ON b.c = h.c - h.c %% 20),
p AS (SELECT c, len(s) n, u.d, s[1:u.d] k FROM e, unnest(range(0, len(s) + 1)) u(d)),
n AS (
  SELECT k, d, min(c) conv_id, count(*) n_convs,
         coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '') ends
  FROM p GROUP BY k, d),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * %(words)s END own FROM n),
kids AS (SELECT k[1:d - 1] k, d - 1 d, count(*) n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT w.*, coalesce(n_children, 0) n_children FROM w LEFT JOIN kids USING (k, d)),
sub AS (
  SELECT f.k[1:u.a] k, u.a d, sum(own) saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) leaves
  FROM f, unnest(range(0, f.d + 1)) u(a) GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens,
       sha256(f.ends) AS ends_sha256
FROM f JOIN sub USING (k, d) LEFT JOIN n up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]
""" % {"crc": crc32("d"), "words": WORDS % "k[d].x"}

#: The repair as a pass along the rows: the cheapest (cost, audit, output) that
#: ends in each state of the pattern, closed under insertion after every row.
_INF = 1_000_000_000


def _ins(state: str, edits: str, said: str) -> str:
    return "{'c': %s.c + %d, 'e': %s.e || '%s', 'o': %s.o || '%s'}" % (state, 5 * len(edits), state, edits, state, said)


def _row(state: str, cost: str, edit: str, said: str) -> str:
    return "{'c': %s.c + %s, 'e': %s.e || %s, 'o': %s.o || %s}" % (state, cost, state, edit, state, said)


def _turn(state: str, initial: str, role: str) -> str:
    same = "r.i = '%s'" % initial
    return _row(state, "CASE WHEN r.live THEN CASE WHEN %s THEN 0 ELSE 1 END + CASE WHEN r.t THEN 5 ELSE 0 END ELSE %d END" % (same, _INF),
                "CASE WHEN %s THEN 'K' ELSE 'R' END" % same, "CASE WHEN %s THEN r.r ELSE '%s' END || ':' || r.x || chr(10)" % (same, role))


_DEL = {q: _row("s." + q, "2", "'D'", "''") for q in "zsua"}
_LEAD = _row("s.z", "CASE WHEN r.live AND r.i = 's' THEN CASE WHEN r.t THEN 5 ELSE 0 END ELSE %d END" % _INF, "'K'", "r.r || ':' || r.x || chr(10)")
_STEP = "{'z': %s, 's': least(%s, %s), 'u': least(%s, %s), 'a': least(%s, %s)}" % (
    _DEL["z"], _DEL["s"], _LEAD, _DEL["u"], ", ".join(_turn("s." + q, "u", "user") for q in "zsa"), _DEL["a"], _turn("s.u", "a", "assistant"))
_U, _A = "user:' || chr(10) || '", "assistant:' || chr(10) || '"
_CLOSE = "{'z': s.z, 's': s.s, 'u': least(s.u, %s), 'a': least(s.a, %s, %s)}" % (
    ", ".join(_ins("s." + q, "I", _U) for q in "zsa"), _ins("s.u", "I", _A), ", ".join(_ins("s." + q, "II", _U + _A) for q in "zs"))
_START = ("{'z': {'c': 0::BIGINT, 'e': '', 'o': ''}, 's': {'c': %d::BIGINT, 'e': '', 'o': ''}, "
          "'u': {'c': 5::BIGINT, 'e': 'I', 'o': 'user:' || chr(10)}, "
          "'a': {'c': 10::BIGINT, 'e': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}}") % _INF

REPAIR = r"""
WITH o AS (
  SELECT conv_id c, turn, coalesce(role, ' ') r, coalesce(text, ' ') x,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k FROM conversations),
h AS (SELECT *, (%(crc)s) %% 20 code FROM o),
d AS (
  SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE r END r,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END x, u.n
  FROM h, unnest(range(0, CASE WHEN code = 3 THEN 2 ELSE 1 END)) u(n) WHERE code <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x), n) pos FROM d),
f AS (
  SELECT *, NOT regexp_matches(x, '[^ 	-]') blank, row_number() OVER (PARTITION BY c, r, x ORDER BY pos) > 1 dup,
         regexp_extract(x, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') cut, substr(r, 1, 1) i,
         lag(substr(r, 1, 1)) OVER (PARTITION BY c ORDER BY pos) before
  FROM p),
g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (blank) blank,
         count(*) FILTER (NOT blank AND dup) duplicate, count(*) FILTER (NOT blank AND NOT dup AND cut) truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) illegal,
         list({'r': r, 'x': x, 'i': i, 'live': NOT blank AND NOT dup, 't': cut} ORDER BY pos) rows
  FROM f GROUP BY c),
q AS (
  SELECT *, list_reduce(flatten(list_transform(rows, lambda r: [{'r': r, 'close': false}, {'r': r, 'close': true}])),
                        lambda s, w: CASE WHEN w.close THEN %(close)s ELSE %(step)s END, %(start)s) s FROM g),
b AS (SELECT *, least(s.z, s.a) w FROM q)
SELECT a.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit,
       sha256(CASE WHEN coalesce(w.o, '') = '' THEN '' ELSE w.o[:-2] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id c FROM conversations) a LEFT JOIN b ON b.c IS NOT DISTINCT FROM a.c
""" % {"crc": crc32("k"), "close": _CLOSE, "step": _STEP.replace("r.", "w.r."), "start": _START}

SQL = {"op11_repair_conversations": REPAIR, "op12_conversation_trie": TRIE}
