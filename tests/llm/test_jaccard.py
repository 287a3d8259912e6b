"""Operator 8 against brute force, and components."""

import random
from collections import defaultdict

import numpy as np
import pytest

from framesql.llm import graph, jaccard


def word_sets(rows, width):
    out = []
    for i, t in rows:
        w = (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, width, share):
    """Size and component of each row, from all pairs with a common shingle."""
    sets = word_sets(rows, width)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    distinct = {}
    for i, s in sets:
        if i is not None and s:
            distinct.setdefault(s, []).append(i)
    done = []
    for s, ids in distinct.items():
        shared = defaultdict(int)
        for g in s:
            for j in index[g]:
                shared[j] += 1
            index[g].append(len(done))
        near = [done[j][1][0] for j, k in shared.items() if 100 * k >= share * (len(s) + len(done[j][0]) - k)]
        done.append((s, ids))
        for other in ids + near:
            a, b = find(ids[0]), find(other)
            parent[max(a, b)] = min(a, b)
    return sorted([(i, len(s), None if i is None else find(i) if s else i) for i, s in sets], key=str)


def run(docs, width, share):
    return sorted([tuple(r) for r in jaccard.classes(docs, width, share).collect()], key=str)


@pytest.mark.parametrize(("width", "share"), [(4, 85), (5, 80)])
def test_given_documents(spark, width, share):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs, width, share) == brute(rows, width, share)


def planted(seed):
    """Near copies at various distances, chains, a group larger than a cold token may have, common passages, and odd rows."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(120):
        rows.append(text(r.randrange(3, 150)) + passage * (r.random() < 0.5) + text(r.randrange(0, 40)))
    for size, edits in ((3, 1), (8, 2), (40, 2), (60, 4)):
        base = text(r.randrange(60, 160)) + passage * (size == 40)
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(edits + 1)):
                own[r.randrange(len(own))] = word()
            rows.append(own)
    chain = text(100)
    for _ in range(12):
        chain = list(chain)
        chain[r.randrange(100)] = word()
        chain[r.randrange(100)] = word()
        rows.append(chain)
    rows += [r.choice(rows) for _ in range(50)]
    r.shuffle(rows)
    made = [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(rows)]
    made += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three"), (2006, "É a b c d"), (2007, "é a b c d"), (None, made[0][1]), made[5], made[5]]
    made += [(2010, " ".join(text(20_000))), (2011, " ".join(passage * 40))]
    return made


@pytest.mark.parametrize(("seed", "width", "share", "limit"), [(1, 4, 85, 10**6), (3, 5, 80, 0), (5, 2, 60, 10**6)])
def test_planted_groups(spark, monkeypatch, seed, width, share, limit):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)
    monkeypatch.setattr(jaccard, "COLD", 8)
    rows = planted(seed)
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, n int, rid string").repartition(6)
    assert run(docs, width, share) == brute(rows, width, share)


def test_boilerplate_makes_few_candidates(spark):
    r = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(30)] + passage + [f"w{r.randrange(10**6)}" for _ in range(30)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, tied = jaccard.candidates(jaccard._Sets(docs, 4, 85))
    assert pairs.count() <= len(rows) // 10 and tied.count() == 0


def test_matches_to_demand():
    # Ten partners by each of the first tokens: a longer prefix leaves fewer to compare.
    assert jaccard.matches_to_demand(np.full(30, 10), 10, 500) > 1
    # The next token costs more than it saves.
    assert jaccard.matches_to_demand(np.append(np.full(10, 1), np.full(20, 10_000)), 10, 500) == 1
    assert jaccard.matches_to_demand(np.full(10, 3), 10, 500) == 1
    assert all(jaccard.prefix(n, s) == n - -(-s * n // 100) + 1 for n in range(1, 300) for s in (50, 80, 85, 100))


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, "x y z q r s t"), (9, "x y z q r s t"), (11, None), (12, None), (None, "a b c d e f g")]
    # Different texts under one doc_id: a copy of another document, and one of its own.
    rows += [(20, "h i j k l m n o"), (21, "h i j k l m n o"), (21, "something else that stays here by itself"), (22, "so does this which has no copy at all"), (22, "and this with the same number as that")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, n long")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [11, 12, 2, 20, 21, 22, 22, 9, None]
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(130)] + [(5, 5), (1, 2), (2, 1)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in ends}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_is_exact():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, size=r.integers(1, 60))) for _ in range(60)] + [np.arange(9000), np.arange(50, 9000)]
    got = jaccard.linked(sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            k = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * k >= 50 * (len(a) + len(b) - k))
