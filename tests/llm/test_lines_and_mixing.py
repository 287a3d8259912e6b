"""Operators 3 and 7 against brute force and SQL."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from framesql.llm import lines, mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE_SQL[name])


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    seen = {(i, None if i is not None else t or "", key(x)) for i, t in rows for x in (t or "").split("\n")}
    count = Counter(k for _, _, k in seen)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or count[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
    r = random.Random(3)
    words = ["Foo", " foo\t", "bar", "", " ", "É", "é", "x\r", "\x0bZ", "long line " * 50]
    rows = [(i, "\n".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(40)] + [(50, None), (51, ""), (None, "Foo\nq"), (3, "bar"), (3, "bar"), (99, "foo\n" * 3000 + "own\n" * 3000)]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, drop int, lines string")
    done = lines.deduplicate(docs, min_docs=10)
    assert set(docs.columns) < set(done.columns)
    got = sorted([tuple(x) for x in done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()], key=str)
    assert got == brute_lines(rows, 10)
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_lines_count_documents_not_rows(spark):
    rows = [(1, "same\nown")] * 10 + [(2, "x\ny")] * 2 + [(i, "x") for i in range(3, 11)] + [(None, f"z\n{i // 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(x) for x in lines.deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()], key=str)
    assert got == brute_lines(rows, 10)
    dropped = Counter(i for i, _, n, _ in got if n)
    assert not dropped[1] and not dropped[2] and dropped[None] == 20


def test_a_line_of_blanks_takes_linear_time(spark):
    long = "a" + " " * 10_000_000 + "b" + "\t" * 1_000_000
    docs = spark.createDataFrame([(i, long) for i in range(2)], "doc_id long, text string")
    began = time.perf_counter()
    assert [x.n_dropped for x in lines.deduplicate(docs, min_docs=2).select("n_dropped").collect()] == [1, 1]
    assert time.perf_counter() - began < 30


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice("aaaaaabcd") if i % 11 else None) for i in range(3000)] + [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "q", "b"), (9000, "", "empty"), (9001, "w " * 5000, "z")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    target |= share
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]) and x.taken <= 2 * x.size
        assert all(0 <= p < 1 for p in x.positions) and x.taken == x.size * len(x.positions)
        taken[x.source] += x.taken
    for s in order:
        if s != "z":
            assert abs(taken[s] - target[s]) <= 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(x.positions) for x in got)
    assert mixing.plan(docs.limit(0)).count() == 0


def test_equal_rows_keep_their_own_copies(spark, tmp_path):
    rows = [(1, "x y z", s, i) for s in "aab" for i in range(3)] + [(i, "w " * (i % 9), "abc"[i % 3], i) for i in range(2, 200)] + [(None, "q r", None, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_row int").coalesce(1)
    planned, mixed = mixing.plan(docs).collect(), mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for x in planned:
        want[x.doc_id, x.source] += x.copies
    assert Counter((x.doc_id, x.source) for x in mixed.collect()) == +want
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    again = mixing.mix(spark.read.parquet(str(tmp_path / "docs")))
    assert again.columns == docs.columns and Counter((x.doc_id, x.source) for x in again.collect()) == +want
    mixed.write.parquet(str(tmp_path / "mix"))
    placed = mixing.training_order(spark.read.parquet(str(tmp_path / "mix")), "at").collect()
    assert sorted(x["at"] for x in placed) == list(range(sum(want.values())))
    # A document of one copy stands before another one where its position is smaller.
    first = {x.doc_id: x.positions[0] for x in planned if x.copies == 1 and x.doc_id not in (1, None)}
    order = [x.doc_id for x in sorted(placed, key=lambda x: x["at"]) if x.doc_id in first]
    assert len(order) > 20 and order == sorted(order, key=first.get)


def test_positions_follow_the_schedule():
    from math import sqrt

    for slope in (-0.5, 0.0, 0.5):
        for t in (0.0, 0.2, 0.7, 1.0):
            y = t + slope * (t * t - t)
            assert 2 * y / ((1 - slope) + sqrt((1 - slope) ** 2 + 4 * slope * y)) == pytest.approx(t)
