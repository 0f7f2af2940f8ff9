"""Files read by byte ranges against one-task readers."""

import csv
import gzip
import random

import pytest

from prodlens.sources import io, splits


@pytest.fixture(params=[64, 1000, 1 << 27])
def split_size(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def wild(n, seed=1):
    r = random.Random(seed)
    bits = ["a", "b c", ",", "\n", "\r\n", '"', '""', "é", "", " ", "x" * 90, "\n\n", "'"]
    return [[str(i), "".join(r.choice(bits) for _ in range(r.randrange(0, 7))), r.choice(["1.5", "-2", "", "NaN", "7"]),
             "".join(r.choice(bits) for _ in range(r.randrange(0, 3)))] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_by_ranges_equals_python(spark, tmpdir_path, split_size, end):
    rows = wild(160)
    path = tmpdir_path + "/t.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL if end == "\n" else csv.QUOTE_MINIMAL)
        w.writerow(["id", "text", "num", "more"])
        w.writerows(rows)
    got = splits.read_csv(spark, path, "id string, text string, num string, more string")
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(map(tuple, rows))
    named = io.read_large_table(spark, path)
    assert named.dtypes == [("id", "bigint"), ("text", "string"), ("num", "double"), ("more", "string")]
    schema = "id long, text string, num double, more string"
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    key = lambda r: r["id"]
    # in a file of CRLF lines the one-task reader makes LF of those inside quotes
    one, many = (str(sorted(d.collect(), key=key)).replace("\\r\\n", "\\n") for d in (io.null_markers(one), io.read_table(spark, path, schema)))
    assert one == many
    if split_size == 64:
        assert splits.lines(spark, path).rdd.getNumPartitions() > 20


def test_csv_of_several_files_and_a_record_over_many_ranges(spark, tmpdir_path, split_size):
    for name, text in (("a", "x" * 700 + "\n" * 50), ("b", 'say ""hi""\r\nthere')):
        with open("%s/%s.csv" % (tmpdir_path, name), "w", newline="") as f:
            f.write('k,v\n1,"%s"\n2,plain\n\n3,"last"' % text)
    got = sorted((r["k"], r["v"]) for r in splits.read_csv(spark, tmpdir_path, "k int, v string").collect())
    assert got == sorted([(1, "x" * 700 + "\n" * 50), (1, 'say "hi"\r\nthere'), (2, "plain"), (2, "plain"), (3, "last"), (3, "last")])


def test_first_lines_are_exact(spark, tmpdir_path, split_size):
    rows = ['{"a": %d, "b": "%s"}' % (i, "y" * (i % 40)) for i in range(200)]
    rows[3] = "bad line"
    with open(tmpdir_path + "/p.jsonl", "w") as f:
        f.write("\n".join(rows) + "\n")
    with gzip.open(tmpdir_path + "/q.jsonl.gz", "wt") as f:
        f.write("\n".join(rows))
    for path in ("/p.jsonl", "/q.jsonl.gz"):
        for n in (0, 1, 4, 77, 199, 200, 500):
            got = sorted(r["a"] for r in io.read_jsonl(spark, tmpdir_path + path, "a int", first_lines=n).collect())
            assert got == [i for i in range(min(n, 200)) if i != 3], (path, n)
    both = io.read_jsonl(spark, [tmpdir_path + "/q.jsonl.gz", tmpdir_path + "/p.jsonl"], "a int", first_lines=250)
    assert sorted(r["a"] for r in both.collect()) == sorted([i for i in range(200) if i != 3] + [i for i in range(50) if i != 3])
