"""Conversation repair, conversation tries and secret scans against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodlens.llm import oracle, queries, repair, secretscan, trie
from prodlens.llm.common import local_rows
from tests_oracle_support import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"


def md5(role, text):
    return hashlib.md5(("%d:%s%s" % (len(role), role, text)).encode()).hexdigest()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def edge_convs(seed=0, n=60):
    """Nulls in every column, ties, repeated rows, shared heads, a long conversation."""
    r = random.Random(seed)
    texts = ["Hi.", "Hi there", "", None, "What?", "  \n", "Yes!", "no", "Ünï ok."]
    rows = []
    for c in [*range(0, n), -7, -40, 1 << 40]:
        for t in range(r.randrange(0, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    rows += [(5, None, "user", "before"), (5, None, "user", None), (5, 3, "user", "tie"), (5, 3, "assistant", "tie"), (6, 1, "user", "twice"),
             (6, 1, "user", "twice"), (None, 0, "user", "nobody's."), (None, None, None, None)]
    rows += [(20, t, "user" if t % 2 else "assistant", r.choice(["a.", "b.", "c"]) if t % 7 else "t%d." % t) for t in range(300)]
    r.shuffle(rows)
    return rows


def clash(d):
    for c in ("c", "block", "id", "n", "node", "rep", "k1", "words", "Text_", "h", "pos", "turns"):
        d = d.withColumn(c, F.lit("mine"))
    return d


# --------------------------------------------------------------------- trie
def brute_trie(rows, group=20, heads=4):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, md5(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, group))
        seq = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, d == len(seq)))
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        saved = (len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        leaves = 0 if k in kids else 1
        for x in kids.get(k, []):
            a, b = below(x)
            saved, leaves = saved + a, leaves + b
        return saved, leaves
    import sys
    sys.setrecursionlimit(10_000)
    out = []
    for k, who in nodes.items():
        saved, leaves = below(k)
        up = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in who), len(k), up, len(who), len(kids.get(k, [])), leaves, saved,
                    sha(",".join(map(str, sorted(c for c, e in who if e))))))
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", 2 if block == 2 else 4096)
    rows = edge_convs() + [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    got = trie.conversation_trie(clash(local_rows(spark, rows, CONV))).collect()
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_an_empty_table(spark):
    assert trie.conversation_trie(local_rows(spark, [], CONV)).collect() == []


def test_trie_with_other_groups_and_heads(spark):
    rows = edge_convs(3, 25)
    got = trie.conversation_trie(local_rows(spark, rows, CONV), group=5, heads=2).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(rows, 5, 2)))


# ------------------------------------------------------------------- repair
def every_repair(rows):
    """Least (cost, audit) over all derivations with at most three insertions
    between rows; nothing is pruned."""
    def close(st):
        out = {q: set(v) for q, v in st.items()}
        edge = [(q, x) for q, v in st.items() for x in v]
        for _ in range(3):
            edge = [(repair.MOVES[q, ro], (c + 5, a + "I")) for q, (c, a) in edge for ro in "ua" if (q, ro) in repair.MOVES]
            for q, x in edge:
                out.setdefault(q, set()).add(x)
        return out
    cur = close({0: {(0, "")}})
    for initial, cut, alive in rows:
        nxt = {}
        for q, v in cur.items():
            for c, a in v:
                nxt.setdefault(q, set()).add((c + 2, a + "D"))
                for ro in "sua" if alive else "":
                    if (q, ro) in repair.MOVES and (ro == initial or ro != "s"):
                        same = ro == initial
                        nxt.setdefault(repair.MOVES[q, ro], set()).add((c + (not same) + 5 * cut, a + "RK"[same]))
        cur = close(nxt)
    return min(x for q in (0, 3) for x in cur.get(q, ()))


def test_parse_is_the_least_of_all_derivations():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(40 if n < 4 else 20):
            rows = [(r.choice("suax"), r.random() < 0.3, r.random() < 0.8) for _ in range(n)]
            cell, total = repair.parse([(*x, 1) for x in rows])
            assert repair.best(cell)[:2] == every_repair(rows) and total == n


def forward(rows):
    """The same minimum by a pass along the rows, for long inputs."""
    def close(st):
        for _ in range(3):
            for (q, ro), p in repair.MOVES.items():
                if ro != "s" and q in st:
                    x = (st[q][0] + 5, st[q][1] + "I")
                    st[p] = min(st.get(p, x), x)
        return st
    cur = close({0: (0, "")})
    for initial, cut, alive in rows:
        nxt = {q: (c + 2, a + "D") for q, (c, a) in cur.items()}
        for (q, ro), p in repair.MOVES.items():
            if alive and q in cur and (ro == initial or ro != "s"):
                x = (cur[q][0] + (ro != initial) + 5 * cut, cur[q][1] + ("K" if ro == initial else "R"))
                nxt[p] = min(nxt.get(p, x), x)
        cur = close(nxt)
    return min(cur[q] for q in (0, 3) if q in cur)


def test_spans_of_any_cut_give_the_same_cell():
    r = random.Random(4)
    rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.9, 1) for _ in range(700)]
    whole, _ = repair.parse(rows)
    assert repair.best(whole)[:2] == forward([x[:3] for x in rows])
    for cut in (1, 13, 350, 699):
        assert repair.combine(repair.parse(rows[:cut])[0], repair.parse(rows[cut:])[0]) == whole


def brute_repair(rows):
    convs = {}
    for c, t, role, text in rows:
        kept = convs.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(("%s:%s" % (" " if c is None else c, " " if t is None else t)).encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept += [(t is not None, t or 0, md5(role, text), role, text)] * (2 if code == 3 else 1)
    out = []
    for c, kept in convs.items():
        kept.sort()
        turns = [x[1] for x in kept if x[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, line = set(), [0, 0, 0], []
        for *_, role, text in kept:
            w = WORD.findall(text)
            blank, dup = not w, (role, text) in seen
            cut = not blank and w[-1][-1] not in ".!?"
            seen.add((role, text))
            if blank or dup or cut:
                faults[0 if blank else 1 if dup else 2] += 1
            line.append((role[:1], cut, not blank and not dup))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(line, line[1:]))
        cost, audit = forward(line)
        said, at = [], 0
        for e in audit:
            role, text = (None, "") if e == "I" else kept[at][3:]
            at += e != "I"
            if e != "D":
                said.append((role if e == "K" else None, text))
        lead = bool(said) and said[0][0] is not None and said[0][0][:1] == "s"
        said = [(r if r is not None else "user" if (i - lead) % 2 == 0 else "assistant") + ":" + x for i, (r, x) in enumerate(said)]
        out.append((c, gaps, *faults, illegal, cost, audit, sha("\n".join(said))))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = edge_convs(1, 150)
    got = repair.repair_report(clash(local_rows(spark, rows, CONV))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_repair(rows)))


def test_repair_of_an_empty_table_and_of_dropped_rows(spark):
    assert repair.repair_report(local_rows(spark, [], CONV)).collect() == []
    gone = next(c for c in range(100) if zlib.crc32(b"%d:0" % c) % 20 == 0)
    [r] = repair.repair_report(local_rows(spark, [(gone, 0, "user", "x")], CONV)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", sha(""))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql_of_the_package(spark, name):
    r = compare(spark, duck(SF), name, queries.QUERIES[name], oracle.SQL[name], SF)
    assert r["ok"], r


# ------------------------------------------------------------------ secrets
def brute_base(text):
    """The rules, character by character."""
    safe = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out = []

    def run(at, chars):
        e = at
        while e < len(text) and text[e] in chars:
            e += 1
        return e
    at = 0
    while at < len(text):
        hit = None
        for n in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            part = text[at:at + len(n)]
            if all(a in (b, b.upper()) for a, b in zip(part, n)) and len(part) == len(n):
                for quote in (1, 0):
                    e = at + len(n)
                    if quote and e < len(text) and text[e] in "\"'":
                        e += 1
                    elif quote:
                        continue
                    e = run(e, " ")
                    if e < len(text) and text[e] in ":=":
                        e = run(e + 1, " ")
                        e += e < len(text) and text[e] in "\"'"
                        if run(e, safe) > e:
                            hit = (at, e, run(e, safe))
                            break
                if hit:
                    break
        if hit:
            if hit[2] - hit[1] >= 8:
                out.append((at, "assign", hit[2]))
            at = hit[2]
        else:
            at += 1
    at = 0
    while at < len(text):
        e = run(at + 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") if text.startswith("AKIA", at) else at
        if e > at + 4:
            if e - at >= 16:
                out.append((at, "access", e))
            at = e
        else:
            at += 1
    at = 0
    while at < len(text):
        e = run(at, "0123456789abcdef")
        if e - at >= 32:
            out.append((at, "hex", e))
        at = max(e, at + 1)
    return sorted(out, key=lambda s: (s[0], secretscan.KINDS.index(s[1])))


def test_base_findings_equal_brute_force(spark):
    r = random.Random(3)
    bits = ["password", "PassWd", "SECRET", "token", "api_key", "APIKey", "apikey", "=", ":", " ", "  ", "\"", "'", "AKIA", "AKIA" + "Z9" * 8,
            "a1" * 16, "deadbeef" * 5, "abc", "x.y", "é", "ſecret", "toKen", "\n", "A" * 20, "12345678", "pass"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(600)),
             "token: secret:abcdefghij", "password='%s' é " % ("a0" * 30) * 3]
    d = local_rows(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name in ("k", "spans", "kind"):
        d = d.withColumn(name, F.lit("mine"))
    got = {x["doc_id"]: x for x in secretscan.secret_report(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        joined = ",".join("%s:%d:%d" % (k, a, b) for a, k, b in want)
        g = got[i]
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in secretscan.KINDS[:3]), t
        assert g["base_sha256"] == sha(joined), t
        assert ",".join(s for s in g["spans"].split(",") if s and not s.startswith("net:")) == joined


def test_gradients_equal_differences():
    net = secretscan.Network.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x = r.integers(0, secretscan.N_SYMBOLS, (5, secretscan.LENGTH))
    d = r.standard_normal(5)
    z, kept = net.forward(x)
    grads = net.backward(d, kept)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in net.w[k].shape) if k != "e" else (int(x.ravel()[r.integers(0, x.size)]), int(r.integers(0, 8)))
            old = net.w[k][at]
            net.w[k][at] = old + 1e-5
            up = net.forward(x)[0] @ d
            net.w[k][at] = old - 1e-5
            down = net.forward(x)[0] @ d
            net.w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at])), k


def planted(n, seed):
    """Texts with findings that the rules know, and harmless key-like runs."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(30)]
        odd = [" password=" + secretscan._draw(r, "0123456789abcdef", 18, 18), ' token = "%s"' % secretscan._draw(r, "0123456789abcdef", 40, 40),
               " AKIA" + secretscan._draw(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 16), " " + secretscan._draw(r, "0123456789", 12, 16),
               " %d.%d.%d.%d" % tuple(r.integers(10, 256, 4)), " a.b%d@mail.example.com" % i, " report%d.final.txt" % i][i % 7]
        out.append((i, " ".join(words[:15]) + odd + " " + " ".join(words[15:]) + "."))
    return out


def test_network_finds_unknown_forms_and_leaves_plain_text(spark):
    rows = planted(700, 1)
    unknown = ["our signing_key = '9hQx2LmZr8TbV3kWc7Ns5Pd1' and more", "bearer: qk_Zt81LmQ0xR4vTn29sWbYc73hJ",
               "the credential: wJalrXUtnFEMIK7MDENGbPxRfiCYzzEXAMPLEKEY here"]
    # labels are the rules': a network is trained on text without the unknown secrets, as they'd be label 0
    net = secretscan.train(secretscan.labelled_findings(local_rows(spark, rows, "doc_id long, text string")), variants=1500)
    rows += [(10_000 + i, t) for i, t in enumerate(unknown)] + [(None, unknown[0]), (None, unknown[0])]
    d = local_rows(spark, rows, "doc_id long, text string").repartition(3)
    assert net.report["recall"] >= 0.97 and net.report["false_rate"] <= 0.02, net.report
    got = secretscan.scan(d, net).collect()
    net_hits = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "net"] for r in got}
    assert sum(bool(net_hits[10_000 + i]) for i in range(3)) >= 2
    assert sum(bool(net_hits[i]) for i in range(700)) <= 7
    assert sum(r["doc_id"] is None for r in got) == 2


def test_sample_does_not_depend_on_partitions(spark):
    d = local_rows(spark, planted(300, 2) * 2, "doc_id long, text string")
    a = secretscan.labelled_findings(d.repartition(1), max_train=40)
    b = secretscan.labelled_findings(d.repartition(7), max_train=40)
    assert a == b and sum(y for _, y, *_ in a) == 40


def test_tiles_cover_long_candidates_and_scores_batch_alike():
    value = "".join(chr(97 + i % 26) for i in range(333)) + "0"
    x = secretscan.windows("left text ", value, "right")
    assert len(x) == -(-334 // secretscan.TILE)
    assert (x[-1][secretscan.LEFT:secretscan.LEFT + secretscan.TILE] == secretscan._symbols(value[-secretscan.TILE:])).all()
    net = secretscan.Network.fresh(3)
    found = [("a ", value, " b"), ("", "12345678", ""), ("x=", "abcdefgh", ".")] * 3
    assert np.allclose(net.scores(found), net.scores(found, batch=2), atol=1e-5)


def test_scan_edges(spark):
    empty = local_rows(spark, [], "doc_id long, text string")
    assert secretscan.secret_report(empty).collect() == []
    d = local_rows(spark, [(1, "password=" + "a" * 300_000), (2, None), (3, ""), (1, "x" * 100_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["spans"]) for r in secretscan.secret_report(d).collect())  # one label only: rules alone
    assert got == [(1, ""), (1, "assign:0:300009,hex:9:300009"), (2, ""), (3, "")]


def test_network_learns_from_all_findings(spark):
    r = np.random.default_rng(5)
    texts = ["the page %d of %s-%s" % (10_000_000 + i, "".join(chr(97 + c) for c in r.integers(0, 26, 5)), i) for i in range(4000)]
    texts += ["set password=" + secretscan._draw(r, "0123456789abcdef", 20, 20) for _ in range(500)]
    d = local_rows(spark, list(enumerate(texts)) + [(5000, texts[0])], "doc_id long, text string")
    nets = []
    for parts in (1, 5):
        found = secretscan.labelled_findings(d.repartition(parts))
        nets.append(secretscan.train(found))
    n = [found.where("label = %d" % y).count() for y in (0, 1)]
    assert n[0] >= 4000 and n[1] == 500
    report = nets[0].report
    assert report["train"] + report["held_out"] == 2 * n[0] + 5 * n[1]  # each with its variants, none left out
    assert report["recall"] >= 0.97 and report["false_rate"] <= 0.02, report
    assert report == nets[1].report and all((nets[0].w[k] == nets[1].w[k]).all() for k in nets[0].w)


def test_thresholds_are_exact_order_statistics(spark):
    r = np.random.default_rng(6)
    blocks = [(i, np.round(r.standard_normal(300), 2).astype(np.float32), r.integers(0, 2, 300), r.random(300) < 0.5, r.integers(0, 2, 300))
              for i in range(7)]
    sizes, kept = secretscan.lowest_kept(spark.sparkContext.parallelize(blocks, 3), 0.9)
    _, z, y, held, shape = (np.concatenate(x) if np.ndim(x[0]) else x for x in zip(*blocks))
    for i in (0, 1, 3):
        v = np.sort(z[held & (y == 1) & ((shape == i) | (i == 3))])
        assert sizes[i] == len(v) and kept[i] == v[int(np.floor((1 - 0.9) * len(v)))]
    assert sizes[2] == 0
