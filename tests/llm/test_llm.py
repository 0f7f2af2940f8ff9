"""Operators of prodlens.llm against brute force on small literal frames:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prodlens.llm import chat, decontam, kernels as K, lm, mixing, neardup, outliers, quality, queries, sharding, textstats, urls, warc
from prodlens.llm.common import local_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"
RNG = np.random.default_rng(5)


def prose(n, seed=0):
    r = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in r.integers(0, 4000, n))


def edge_docs(spark, extra=()):
    """Nulls in every column, empty, very long and repeated texts, clashing names."""
    rows = [(1, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (2, prose(60, 1), "en", "a"), (None, prose(40, 2), None, "b"),
            (3, None, "en", None), (4, "", "en", "b"), (5, " \n\t ", None, None), (6, prose(30_000, 3), "de", "b"), (7, "x", "de", "")]
    d = local_rows(spark, rows, DOC)
    for c in extra:
        d = d.withColumn(c, F.lit("mine"))
    return d


# ------------------------------------------------------------------ kernels
def brute_stats(x):
    x = x or ""
    w = WORD.findall(x)
    n, seen, dup = len(w), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, cover = Counter(tuple(w[j:j + 5]) for j in range(n - 4)), set()
    for j in range(n - 4):
        if c[tuple(w[j:j + 5])] > 1:
            cover.update(range(j, j + 5))
    return [n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, len(cover)]


def test_statistics_equal_brute_force_for_any_slicing(monkeypatch):
    texts = ["", None, " a ", "a", "\n\n", "x\nx\n x\nx", "x x x x x x", "é ü 漢字 a\x0bb", "a\n", "a b c d e a b c d e", "#|", prose(300),
             "l1 a b\n" * 9, prose(50) + "\n" + prose(50)]
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(K, "SLICE", size)
        out = [np.concatenate(c) for c in zip(*(textstats.slice_stats(s) for s in K.slices(pa.array(texts))))]
        assert [[int(out[j][i]) for j in range(5)] for i in range(len(texts))] == [brute_stats(t) for t in texts]


# ------------------------------------------------------------------- mixing
def test_targets_share_and_cap():
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 2, "c": 3})
    assert t["a"] == 30 and math.isclose(t["b"], 792) and math.isclose(t["c"], 1188)
    assert mixing.targets({}, {}) == {} and mixing.targets({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert mixing.default_weights(["b", None, "a"]) == {"a": 1, "b": 2, None: 3}


def test_splitting_tree_keeps_quotas_and_sizes():
    draws = np.array([1000, 3, 0, 77])
    q = mixing.splitting_tree(draws, 7, np.random.default_rng(1))
    assert (q.sum(axis=0) == draws).all() and np.ptp(q.sum(axis=1)) <= 1
    mean = np.mean([mixing.splitting_tree(draws, 4, np.random.default_rng(i))[0] for i in range(400)], axis=0)
    assert np.allclose(mean, draws / 4, rtol=0.2, atol=0.3)


def test_mix_words_near_targets_and_rerun_agrees(spark):
    r = queries.op1_mix_sources(spark, SF).toPandas()
    again = queries.op1_mix_sources(spark, SF).toPandas()
    key = ["doc_id", "taken"]
    assert r[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (r["taken"] <= 3 * r["size"]).all() and math.isclose(r.groupby("source")["target"].first().sum(), r["size"].sum())
    by = r.groupby("source")  # whole documents: off by half the largest one at most
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 0.5 * by["size"].max() + 1).all()
    r = queries.op1_mix_sources(spark, "/root/testdata/sf0.01").toPandas().groupby("source")
    assert ((r["taken"].sum() - r["target"].first()).abs() <= 0.03 * r["target"].first()).all()


def test_mix_rows_agree_with_report(spark):
    d = edge_docs(spark, ("mix_shard", "size", "k"))
    m = mixing.mix(d, n_shards=3)
    assert m.columns[:6] == ["doc_id", "text", "lang", "source", "size", "k"]
    rep = {(r["doc_id"], r["size"], r["source"]): r["copies"] for r in mixing.mix_report(d, n_shards=3).collect()}
    got = Counter((r["doc_id"], r["source"]) for r in m.collect())
    want = Counter()
    for r in mixing.mix_report(d, n_shards=3).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert got == +want and rep
    assert mixing.mix(d.limit(0)).count() == 0


def brute_mix(rows, plan_blocks, seed=42):
    """Words taken by source from (source, size, k) rows: blocks in their
    permuted order, the last one place by place, then the best fit."""
    size = Counter()
    for s, n, _ in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets(dict(size), mixing.default_weights(names))
    total, taken, copies = sum(size.values()), {}, Counter()
    for i, s in enumerate(names):
        p = max(1, round(plan_blocks * size[s] / total))
        mine = sorted((k, n) for src, n, k in rows if src == s)
        blocks = defaultdict(list)
        for k, n in mine:
            blocks[((k >> 32) * p) >> 31].append((k, n))
        rng = np.random.default_rng([seed, i])
        full = int(want[s] / size[s] + 1e-9) if size[s] else 0
        rest = max(0, round(want[s] - full * size[s]))
        for _ in range(full):
            rng.permutation(np.array(sorted(blocks)))
        words, got, done = full * size[s], Counter(), set()
        if rest:
            for b in rng.permutation(np.array(sorted(blocks))):
                if sum(n for _, n in blocks[b]) <= rest:
                    got.update(blocks[b])
                    done.add(b)
                    rest -= sum(n for _, n in blocks[b])
                    continue
                for k, n in blocks[b]:
                    if n <= rest:
                        got[k, n] += 1
                        rest -= n
                    elif n:
                        break
                break
            last = max((k for b, v in blocks.items() for k, n in v if b not in done and got[k, n]), default=-1)
            end = b if b not in done else None
            open_ = [(abs(n - rest), k, n) for x, v in blocks.items() if x not in done for k, n in v
                     if n and abs(n - rest) < rest and (x != end or k >= last) and got[k, n] < v.count((k, n))]
            if rest and open_:
                _, k, n = min(open_)
                got[k, n] += 1
        words += sum(n * c for (k, n), c in got.items())
        taken[s] = words
        copies.update({(s, k): c for (k, n), c in got.items() if n})
        for k, n in mine:
            copies[s, k] += full if n else 0
    return taken, copies


@pytest.mark.parametrize("blocks", [20, 16_384])
def test_taken_equals_brute_force(spark, blocks):
    rows = [(None, "t t t t t t t t t t", "a")] * 900 + [(i, " ".join(["w%d" % i] * 10), "a") for i in range(100)]
    r = np.random.default_rng(3)
    rows += [(1000 + i, " ".join(["v%d" % i] * int(r.integers(0, 40))), ["b", "c", None][i % 3]) for i in range(500)] + [(7, None, "b")]
    d = local_rows(spark, rows, "doc_id long, text string, source string").repartition(5)
    thin = [tuple(x) for x in mixing._thin(d, "doc_id", "text", "source", 42).select("source", "size", "k").collect()]
    words, copies = brute_mix(thin, blocks)
    rep = mixing.mix_report(d, n_blocks=blocks).collect()
    got, target = Counter(), {}
    for x in rep:
        got[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
        assert x["taken"] <= 3 * x["size"] and sum(y["copies"] for y in x["shards"]) == x["copies"]
    assert dict(got) == words
    assert all(abs(words[s] - target[s]) <= (10 if s == "a" else 20) for s in words)
    assert sum(x["copies"] for x in rep if x["size"]) == sum(copies.values())


def test_shards_draw_what_the_tree_deals(spark, monkeypatch):
    d = local_rows(spark, [(i, " ".join(["w"] * (i % 9)), "ab"[i % 2]) for i in range(600)], "doc_id long, text string, source string")

    def by_shard():
        out = Counter()
        for x in mixing.mix_report(d, n_shards=6, n_blocks=300).collect():
            out.update({y["shard"]: y["copies"] for y in x["shards"]})
        return [out[i] for i in range(6)]
    rows = by_shard()
    assert min(rows) > 0.5 * max(rows) and sum(rows) > 400
    mixed = mixing.mix(d, n_shards=6, n_blocks=300)
    assert rows == [c for _, c in sorted(Counter(x["mix_shard"] for x in mixed.collect()).items())]
    where = mixing.in_shard_order(mixed).select(F.spark_partition_id().alias("p"), "mix_shard", "mix_order").collect()
    assert all(a["mix_order"] <= b["mix_order"] for a, b in zip(where, where[1:]) if a["p"] == b["p"] and a["mix_shard"] == b["mix_shard"])
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda n, k, rng: np.vstack([real(n, 1, rng), np.zeros((k - 1, len(n)), np.int64)]))
    assert by_shard() != rows  # without the tree the report is another


def test_written_shards_hold_the_mix(spark, tmpdir_path):
    d = local_rows(spark, [(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    mixed = mixing.mix(d, n_shards=3, n_blocks=100)
    mixing.write_mix(mixed, tmpdir_path + "/mix")
    back = spark.read.parquet(tmpdir_path + "/mix")
    key = ("mix_shard", "mix_order", "doc_id", "text")
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, mixed.select(*key).collect()))


def test_stages_with_clashing_names_nulls_and_repeats(spark):
    import corpus_pipeline as P
    names = ("_did", "_node", "_dnode", "_id", "_tk", "_bad", "_draw", "_row", "row", "k", "draws", "i", "n", "text_key", "h", "class", "size", "mix_k")
    d = edge_docs(spark, names)
    for name, stage in P.STAGES:
        out = stage(spark, d, SF)
        if name != "shard":
            assert out.columns == d.columns, name
        rows = out.collect()
        assert all(r["_draw"] == r["row"] == r["class"] == "mine" for r in rows), name


# --------------------------------------------------------------------- chat
def test_template_folds_constants_and_rejects_unsafe():
    t = chat.Template("{{ 'a' + 'b' }}{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}{# note #}!")
    assert t.tree == [("text", "aby!")] and t.render([]) == ("aby!", [])
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for m in messages %}", "{{ 'a' | eval }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


@pytest.mark.parametrize("s", ["", "\\", "<|", "\\<|", "<\\|", "<<|im_end|>>", "a\\nb\n", "\\\\|<", "<", "<|im_start|>assistant"])
def test_escape_is_reversible_and_hides_controls(s):
    for f in (chat.escape, chat.escape_line):
        assert chat.unescape(f(s)) == s and "<|" not in f(s)
    text, spans = chat.Template(chat.CHATML).render([{"role": "assistant", "text": s}, {"role": s, "text": s}])
    assert list(chat.turns_of(text)) == [("assistant", s), (s, s)] and [chat.unescape(text[a:b]) for a, b in spans] == [s]


def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "assistant", "é\n"),
            (None, 4, "assistant", "\\<|"), (3, None, "assistant", "x" * 50_000)]
    c = local_rows(spark, rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    for chars in (1, 1 << 20):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(c, piece_chars=chars)).collect()}
        by = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
            by[r[0]].append((r[2] or "", r[3] or ""))
        for k, turns in by.items():
            learnt = "".join(t for r, t in turns if r == "assistant")
            want = (len(turns), hashlib.sha256("".join("%s\n%s\n" % x for x in turns).encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest())
            assert tuple(got[k])[1:5] == want
        assert len(got) == len(by)
    assert chat.read_back(chat.format_conversations(c.limit(0))).count() == 0


# ------------------------------------------------------------ near duplicates
def shingle_set(t):
    w = WORD.findall(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_classes(texts, threshold=0.8):
    n = len(texts)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    s = [None if t is None else shingle_set(t) for t in texts]
    for i in range(n):
        for j in range(i):
            if s[i] is None or s[j] is None:
                continue
            same = texts[i] == texts[j] or (s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]))
            if same:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_dart_signatures_estimate_weighted_similarity():
    est, true = [], []
    for _ in range(30):
        e = RNG.integers(0, 1 << 63, 200).astype(np.uint64)
        a = RNG.choice([0.3, 1, 2, 3, 7.5, 20], 200)
        b = np.where(RNG.random(200) < 0.7, a, RNG.choice([0.3, 1, 2, 3, 7.5, 20], 200))
        s = neardup.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 252)
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.02


def family():
    base = prose(120, 9).split()
    texts = [" ".join(base)] * 3
    r = np.random.default_rng(3)
    for i in range(40):  # copies of copies, some beyond the threshold
        w = texts[int(r.integers(0, len(texts)))].split()
        for j in r.integers(0, len(w), int(r.integers(1, 4))):
            w[j] = "z%d" % r.integers(0, 99999)
        texts.append(" ".join(w))
    return texts + [prose(80, 50 + i) for i in range(10)] + ["", "", None, None, "one two", "one two", "one  two", " "]


def test_classes_equal_brute_force(spark):
    texts = family()
    d = local_rows(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in neardup.class_report(d).collect()}
    want = brute_classes(texts)
    low = {}
    for i, c in enumerate(want):
        low.setdefault(c, i)
    assert [got[i] for i in range(len(texts))] == [low[c] for c in want]
    kept = sorted(r["doc_id"] for r in neardup.keep_one(d).collect())
    assert kept == sorted(set(low.values()))


def test_keep_one_of_repeated_and_keyless_rows(spark):
    d = edge_docs(spark, ("class", "bands")).unionByName(edge_docs(spark, ("class", "bands")))
    k = neardup.keep_one(d)
    assert k.columns == d.columns
    assert Counter(r["text"] for r in k.collect()) == Counter({t: (2 if t is None else 1) for t in {r["text"] for r in d.collect()}})
    assert neardup.keep_one(d.limit(0)).count() == 0 and neardup.class_report(d.limit(0)).count() == 0


# ---------------------------------------------------------- decontamination
QUESTION = "Alice has 3 apples and gives 2 apples to Bob after 5 km of walking home. Alice is happy."


def test_reparameterised_questions_are_caught(spark):
    rows = [(1, prose(50) + " " + QUESTION + " " + prose(50)), (2, "Carol has 7 apples and gives 4 apples to Dan after 9 miles of walking home. Carol is happy."),
            (3, "Carol has 7 apples and gives 4 apples to Dan after 9 miles of walking home. Erin is happy."), (4, None), (5, ""),
            (6, prose(3000)), (2, "Carol has 7 apples and gives 4 apples to Dan after 9 miles of walking home. Carol is happy."), (None, QUESTION.upper())]
    d = local_rows(spark, rows, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("h", F.lit(0))
    b = local_rows(spark, [(9, QUESTION), (8, None), (7, "too short")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.contaminated(d, b).collect())
    assert got == [(1, 9, True), (2, 9, False), (2, 9, False)]
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "6", "None"]
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), b).count() == 0


def test_one_changed_occurrence_does_not_hide_a_copy(spark):
    shared = "Tom buys 2 apples and then he also picks 2 pears from the old garden near his house today."
    rows = [(1, QUESTION.replace("Alice is", "Erin is")),  # all but one token word for word
            (2, shared.replace("2 apples", "3 apples").replace("2 pears", "4 pears")),  # two roles shared a value
            (3, QUESTION.replace("Alice has", "Carol has").replace("Alice is", "Erin is"))]  # a run of 15 is left
    d = local_rows(spark, rows, "doc_id long, text string")
    b = local_rows(spark, [(9, QUESTION), (8, shared)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.contaminated(d, b).collect())
    assert got == [(1, 9, False), (2, 8, False), (3, 9, False)]


def test_exact_copies_are_found_whatever_they_are_made_of(spark):
    items = [(1, QUESTION), (2, "12 + 7 = 19"), (3, "Oslo, Rome, Paris, Bern, Wien, Riga"), (4, "東京はどこですか"), (5, "8 km 9 km 10 km 11 km 12 km")]
    b = local_rows(spark, items, "item_id long, text string")
    docs = [(k, "%s %s. %s" % (prose(30, k), t, prose(30, k + 50))) for k, t in items]
    docs += [(11, QUESTION.upper()), (12, QUESTION.lower()), (13, "答えて東京はどこですかと"), (14, prose(200, 9)), (15, "12 + 8 = 19")]
    d = local_rows(spark, docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b, fold_case=True).collect()}
    assert got == {(k, k) for k, _ in items} | {(11, 1), (12, 1), (13, 4)}
    short = b.where("item_id = 2")  # no template window at all
    assert [r["doc_id"] for r in decontam.contaminated(d, short).collect()] == [2]


def test_variants_without_case_digits_or_short_names_are_caught(spark):
    swapped = "Carol has 7 apples and gives 4 apples to Dan after 9 miles of walking home. Carol is happy."
    docs = [(1, swapped.lower()), (2, swapped.upper()), (3, "Carol has seven apples and gives four apples to Dan after nine miles of walking home. Carol is happy."),
            (4, swapped.replace("Carol", "Maria de Souza")), (5, swapped.replace("miles", "verstes")),
            (6, swapped.replace("apples", "pears").lower()), (7, "carol has seven apples and gives twenty one apples to dan after 9 km of walking home. carol is happy"),
            (11, swapped.lower().replace("carol is", "erin is")), (12, "carol is walking home and gives apples to dan"), (13, prose(400, 4)),
            (14, "after five days of walking home they had seven apples and a happy dog, and gives is a word")]
    docs = [(k, "%s %s %s" % (prose(25, k), t, prose(25, k + 50))) for k, t in docs]
    b = local_rows(spark, [(9, QUESTION), (8, None), (7, "Anna Bob")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(local_rows(spark, docs, "doc_id long, text string"), b, fold_case=True).collect()}
    assert got == {(k, 9) for k in range(1, 8)}


def brute_template_hits(texts, items, width=8):
    """Texts that share a template or plain window with an item, window by window."""
    name, number = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*(?![^\W\d_])"), r"[0-9]+(?:[.,:/][0-9]+)*"

    def template(t):
        out = []
        for m in re.finditer("%s|%s|%s" % (name.pattern, number, r"[^\W\d_]+"), t):
            x = m[0]
            out.append("P" if name.fullmatch(x) else "N" if x[0].isdigit() else "U" if x.lower() in decontam.UNITS else x.lower())
        return out

    def plain(t):
        return re.findall("%s|%s" % (number, r"[^\W\d_]+"), t.lower())

    def windows(tokens, w):
        return {tuple(tokens[i:i + w]) for i in range(len(tokens) - w + 1)}
    want = set()
    for item in items:
        t, p = template(item), plain(item)
        if len(t) >= 5:
            want |= {("t", x) for x in windows(t, min(width, len(t))) if sum(len(y) > 1 or y.islower() for y in x) >= 4}
        want |= {("p", x) for x in windows(p, min(width, len(p)))}
    sizes = {(k, len(x)) for k, x in want}
    return {i for i, t in enumerate(texts) if any((k, x) in want for k, w in sizes for x in windows(template(t) if k == "t" else plain(t), w))}


def test_first_search_keeps_every_text_with_a_window(spark):
    docs = [r["text"] for r in spark.read.parquet(SF + "/documents.parquet").where("text is not null").collect()]
    items = [r["text"] for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    docs += [" ".join(d.split()[:20]) + " " + " ".join(i.split()[k:k + 9]) + " end" for k, (d, i) in enumerate(zip(docs, items))]
    b = local_rows(spark, list(enumerate(items)), "item_id long, text string")
    d = local_rows(spark, list(enumerate(docs)), "i long, text string").withColumn("text_key", F.xxhash64("text"))
    bw, pw = decontam.benchmark_windows(b, 8, "item_id", "text"), decontam.plain_windows(b, 8, "item_id", "text", True)
    # with one token as enough no window may be passed over
    grams = decontam.first_grams(bw, pw, 1, 0.0)
    kept = {r["i"] for r in decontam.texts_with_grams(d, grams).collect()}
    hits = brute_template_hits(docs, items)
    assert len(hits) > 20 and hits <= kept
    assert len(kept) < 0.7 * len(docs) + len(items)


def test_first_search_changes_no_result(spark, monkeypatch):
    docs, b = (spark.read.parquet("%s/%s.parquet" % (SF, n)) for n in ("documents", "benchmark"))
    b = b.unionByName(local_rows(spark, [(900, QUESTION), (901, "12 + 7 = 19"), (902, "東京 はどこ")], "item_id long, text string"))
    more = [(9000, QUESTION.replace("Alice", "Zoë").replace("3", "8")), (9001, "so 12 + 7 = 19."), (9002, "x東京はどこy"), (9003, QUESTION[8:70])]
    docs = docs.select("doc_id", "text").unionByName(local_rows(spark, more, "doc_id long, text string"))
    got = sorted(map(tuple, decontam.contaminated(docs, b, fold_case=True).collect()))
    monkeypatch.setattr(decontam, "texts_with_grams", lambda d, grams: d)
    assert got == sorted(map(tuple, decontam.contaminated(docs, b, fold_case=True).collect())) and len(got) == 7


# --------------------------------------------------------------------- urls
def test_url_rules(spark):
    rules = local_rows(spark, queries.URL_RULES, "host string, path string, verdict string")
    cases = [("https://a.example.com/en/1?x#y", "block", "example.com/en/"), ("https://WWW.Example.COM/en/", "allow", "www.example.com/en/"),
             ("http://x.www.example.com/en/z", "allow", "www.example.com/en/"), ("http://example.com/fr", "allow", "com/"),
             ("http://net/es/", "block", "net/es/"), ("http://a.net/de/", "allow", None), ("http://anet/es/", "allow", None),
             ("http://a.com", "allow", None), ("http://a.com?b://c.net/es/", "allow", None), ("no url", "allow", None), (None, "allow", None), ("", "allow", None)]
    p = local_rows(spark, [(i, c[0]) for i, c in enumerate(cases)] + [(None, cases[0][0])], "page_id long, url string").withColumn("rule", F.lit("x"))
    got = {r["page_id"]: r for r in urls.judge(p, rules).collect()}
    assert [(got[i]["verdict"], got[i]["rule"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/1") and (got[7]["host"], got[7]["path"]) == ("a.com", "")
    assert got[None]["verdict"] == "block" and urls.judge(p.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(p, rules.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negative(spark):
    keys = ["k%d" % i for i in range(3000)]
    b = urls.BlockedBloom.build(local_rows(spark, [(k,) for k in keys], "k string"), "k")
    assert b.test(keys).all() and b.test(["n%d" % i for i in range(5000)]).mean() < 0.02


# ----------------------------------------------------------------- sharding
def test_shards_move_only_into_the_new_one(spark):
    d = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    r = sharding.shard_report(d).toPandas()
    moved = r[r["shard"] != r["grown_shard"]]
    assert (moved["grown_shard"] == 40).all() and 40 < len(moved) < 180
    for _, g in r.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    w = sharding.add_shard(d, [1.0, 3.0, 0.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert 2 not in w.index and 2.5 < w[1] / w[0] < 3.6


def test_shard_edges(spark):
    d = edge_docs(spark, ("shard", "slot"))
    r = sharding.shard_report(d).collect()
    want = Counter((x["doc_id"], len((x["text"] or "").encode()) + 16, zlib.crc32((x["text"] or "").encode())) for x in d.collect())
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in r) == want
    assert sharding.add_shard(d, [1.0]).columns == ["doc_id", "text", "lang", "source", "slot", "shard"]
    assert sharding.shard_report(d.limit(0)).count() == 0


# --------------------------------------------------------------------- warc
@pytest.mark.parametrize("step", [1000, 4097, 1 << 24])
def test_warc_round_trip_over_byte_ranges(spark, step):
    rows = [(1, "http://a", "same é"), (5, None, "same é"), (3, "u\r\nv", "same é"), (7, "x", None), (None, "y", ""), (8, "z", "q" * 70_000),
            (9, "z", "noise %s" % base64.b64encode(RNG.bytes(60_000)).decode())]
    p = local_rows(spark, rows, "page_id long, url string, html string").withColumn("sha1", F.lit(0)).repartition(2)
    man = warc.write_warc(p)
    got = {r["k"]: r for r in warc.read_warc(man, range_bytes=step).withColumn("k", warc.page_key("record_id")).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, _, html in rows:
        body = (html or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {k for k in got if got[k]["record_type"] == "revisit"} == {1, 3, None}
    assert got[1]["refers_to"] == "<urn:x-page:5>" and bytes(got[5]["payload"]) == "same é".encode()
    assert warc.page_report(p.limit(0)).count() == 0


def test_reader_skips_false_magic():
    rec = warc.record(1, "u", b"p", hashlib.sha1(b"p").hexdigest(), None)
    raw = b"\x1f\x8b\x08junk" + rec + b"\x00\x1f\x8b" + rec
    for cut in range(0, len(raw)):
        n = sum(len(list(warc.records_in(io.BytesIO(raw), a, b))) for a, b in ((0, cut), (cut, len(raw))))
        assert n == 2


# ------------------------------------------------------------------ quality
def test_rules_from_tree_text():
    text = "  If (feature 1 <= 0.5)\n   If (feature 0 > 2.0)\n    Predict: 1\n   Else (feature 0 <= 2.0)\n    Predict: 0\n  Else (feature 1 > 0.5)\n   Predict: 0\n"
    assert quality.tree_rules(text) == {((1, False, 0.5),), ((1, True, 0.5),), ((0, True, 2.0), (1, False, 0.5)), ((0, False, 2.0), (1, False, 0.5))}


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r["predicted"] == r["quality"]).mean() > 0.9 and r["score"].between(0, 1).all()


def test_classifier_edges(spark):
    d = edge_docs(spark, ("quality_ok", "n_words"))
    for rows in ([], [(1, 1), (2, None), (6, 1), (None, 0), (7, 5)]):
        lab = local_rows(spark, rows, "doc_id long, quality int")
        out = quality.classify(d, lab)
        assert out.count() == 9 and "n_words" in out.columns and out.where("quality_ok").count() == 9
        assert quality.score_report(d, lab).where("score is null").count() == 0
    assert quality.classify(d.limit(0), lab).count() == 0


# ----------------------------------------------------------- language model
def test_base_scores_are_exact(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, t) for i, t in enumerate(family())] + [(1, "A a B"), (None, "w1 W2"), (70, "É é")]
    d = local_rows(spark, rows, "doc_id long, text string").withColumn("h", F.lit(1))

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = [WORD.findall((t or "").translate(low)) + [None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, toks) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
                   for (i, _), ws in zip(rows, toks))
    for head in (1 << 20, 5):
        r = lm.score_texts(d, head=head).collect()
        assert Counter((x["doc_id"], x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in r) == want
        assert all(x["train_tokens"] == n and x["score"] <= 0 for x in r)
    assert lm.score_texts(d.limit(0)).count() == 0


def test_filter_never_underestimates(spark):
    h = RNG.integers(0, 1 << 63, 5000).astype(np.uint64)
    c = RNG.integers(1, 300, 5000)
    g = local_rows(spark, [(int(x), int(y)) for x, y in zip(h.view(np.int64), c)], "h long, c long")
    lff = lm.LogFrequencyFilter(lm.build_filter(g))
    q = 1 + np.floor(np.log2(c) + 1e-9)
    got = lff.levels(h)
    assert (got >= q).all() and (got == q).mean() > 0.98
    assert (lff.levels(RNG.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.02


def language(n, seed):
    """Texts of a small language: frequent words, and pairs that keep company."""
    r = np.random.default_rng(seed)
    follow = r.integers(0, 300, 300)
    out = []
    for _ in range(n):
        w = [int(x) for x in np.minimum(299, r.zipf(1.3, 40))]
        for j in range(1, len(w)):
            if r.random() < 0.4:
                w[j] = int(follow[w[j - 1]])
        out.append(" ".join("t%d" % x for x in w))
    return out


def test_probabilities_add_up_and_follow_exact_counts(spark):
    texts = language(700, 4)
    d = local_rows(spark, list(enumerate(texts)), "doc_id long, text string")
    grams = lm.materialise(lm.count_ngrams(d.where(~lm.held_out(F.col("doc_id")))))
    learnt = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    c1, c2 = Counter(), Counter()
    for t in learnt:
        w = ["^", *WORD.findall(t), "$"]
        c1.update(w)
        c2.update(zip(w, w[1:]))
    kinds = sorted(set(c1) - {"^", "$"})
    total, v = sum(c1.values()) - c1["^"], len(kinds) + 1
    est = lm.level_values(grams)
    lff = lm.LogFrequencyFilter(lm.build_filter(grams))

    def p_of(text):  # the probability of each token, the end included
        [s] = K.slices(pa.array([text]))
        return lm.token_probabilities(*lm.tokens(s), lff.levels, est, total, v, 0.3)
    mass, gap = [], []
    for ctx in kinds[:12] + kinds[-60:]:
        p = [p_of("%s %s" % (ctx, w))[1] for w in kinds] + [p_of(ctx)[1]]
        mass.append(sum(p) + (1 - 0.3 * c1[ctx] / (c1[ctx] + lm.PRIOR)) * 0.1 / (total + 0.1 * (v + 1)))  # and any unseen word
        for w, x in zip([*kinds, "$"], p, strict=True):
            k = 0.3 * c1[ctx] / (c1[ctx] + lm.PRIOR)
            exact = k * c2[ctx, w] / c1[ctx] + (1 - k) * (c1[w] + 0.1) / (total + 0.1 * (v + 1))
            gap.append(math.log10(x / exact))
    [one] = K.slices(pa.array([" ".join(kinds)]))
    uni = (est.token[lff.levels(lm.tokens(one)[0])] + 0.1) / (total + 0.1 * (v + 1))
    assert abs(uni.sum() + 0.1 / (total + 0.1 * (v + 1)) - 1) < 0.01  # words, the end, any unseen word
    assert abs(np.mean(mass) - 1) < 0.02 and max(abs(m - 1) for m in mass) < 0.3 * 0.5, mass
    assert abs(np.mean(gap)) < 0.03 and np.mean(np.abs(gap)) < 0.12


def test_filter_beyond_the_broadcast_bound_gives_the_same_scores(spark):
    rows = [(i, t) for i, t in enumerate(family())] + [(i, prose(2000, i)) for i in range(100, 190)] + [(None, "w1 W2")]
    d = local_rows(spark, rows, "doc_id long, text string").repartition(3)

    def scores(**kw):
        return sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 9)) for r in lm.score_texts(d, **kw).collect())
    want = scores()
    # 0 bits may be broadcast: the filter keeps its size and is looked up by a shuffle
    assert scores(max_bits=0) == want and scores(max_bits=0, head=5) == want
    assert lm.score_texts(d.limit(0), max_bits=0).count() == 0


def test_filter_beyond_the_broadcast_bound_takes_little_disk(spark):
    from prodlens.session import ensure_checkpoint_dir
    sc, texts = spark.sparkContext, [(i, prose(3000, i)) for i in range(400)]
    d = local_rows(spark, texts, "doc_id long, text string").repartition(4).persist()
    d.count()
    places = [*sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(),
              ensure_checkpoint_dir(spark).removeprefix("file:")]

    def on_disk():
        return sum(os.lstat(os.path.join(f, n)).st_size for p in places for f, _, names in os.walk(p) for n in names if not n.endswith(".crc"))
    before = on_disk()
    scored = lm.score_texts(d, max_bits=0, head=100)
    took = (on_disk() - before) / sum(len(t) for _, t in texts)
    assert took < 2, took
    assert scored.count() == len(texts)
    d.unpersist()


def test_bigrams_seen_once_are_known(spark):
    train = [(1, "red green"), (2, "blue white")]  # neither key is held out
    assert not any(zlib.crc32(str(i).encode()) % 10 == 0 for i in (1, 2, 3, 4))
    rows = train + [(k, t) for k, t in ((3, "red green"), (4, "red white"))]
    d = local_rows(spark, rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(d).collect()}
    skip = {r["doc_id"]: r["score"] for r in lm.score_texts(d, min_bigram=2).collect()}
    # "red white" and "white <end>": the former occurs once
    assert got[4] > skip[4] + 1e-6 and abs(got[1] - got[3]) < 1e-12


def test_levels_end_at_the_largest_entered():
    full = np.full((1, lm.SEGMENT_BITS // 8), 255, dtype=np.uint8)
    assert lm.LogFrequencyFilter(full, 3).levels(np.arange(5, dtype=np.uint64)).tolist() == [3] * 5


# ----------------------------------------------------------------- outliers
def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rows = [(i, prose(100 + i % 50, i), "en", "a" if i % 3 else "b") for i in range(400)]
    junk = [(1000 + i, " | ".join(prose(60, 900 + i).split()), "en", "a") for i in range(10)]
    d = local_rows(spark, rows + junk, DOC).withColumn("x0", F.lit("mine")).withColumn("kept", F.lit(1))
    r = outliers.rules_report(d).collect()
    assert {x["doc_id"] for x in r if not x["kept"]} == {x[0] for x in junk} and len(r) == 410


def test_outlier_edges(spark):
    d = edge_docs(spark)
    r = outliers.rules_report(d).collect()
    want = Counter((x["doc_id"], *brute_stats(x["text"])) for x in d.collect())
    assert Counter(tuple(x)[:6] for x in r) == want
    assert all(x["kept"] is False for x in r if x["base_failed"]) and all(x["kept"] is not None for x in r)
    assert outliers.rules_report(d.limit(0)).count() == 0
    assert abs(outliers.chi2_quantile(0.5, 7) - 6.346) < 0.02 and abs(outliers.chi2_quantile(0.99, 7) - 18.475) < 0.1


# ----------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from prodlens.llm.common import materialise
    docs = spark.read.parquet(SF + "/documents.parquet")
    sizes = [docs.count()]
    for i, (_, f) in enumerate(P.STAGES):
        out = materialise(f(spark, docs, SF))
        assert out.columns == (docs.columns if i < 4 else [*docs.columns, "shard"])
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    texts = {r["text"] for r in docs.collect()}
    assert not any(b["text"] in t for b in spark.read.parquet(SF + "/benchmark.parquet").collect() for t in texts)
    empty = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, f in P.STAGES:
        empty = materialise(f(spark, empty, SF))
    assert empty.count() == 0
