"""Operators 2 and 9."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesql.llm import langid, topk

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    ok = [(i, np.floor(256 * np.array(v, dtype="f8"))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    pad = lambda v: np.pad(v, (0, dim - len(v)))
    out = []
    for q in queries:
        own = [pad(v) for i, v in ok if i == q]
        if own:
            best = sorted(((-int(pad(v) @ own[0]), i) for i, v in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("cell", "block", "queries"), [(8192, 256, 512), (64, 16, 4), (20, 5, 2)])
def test_search(spark, monkeypatch, cell, block, queries):
    for name, value in (("CELL_DOCS", cell), ("BLOCK_DOCS", block), ("CELL_QUERIES", queries)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * (3 if 40 < i < 60 else 1) for _ in range(6)]) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(300, 330)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [9.0, 1.0]), (None, [1.0] * 6), (300, [0.5] * 6)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = sorted(tuple(x) for x in topk.search(df, df.where("vec_id % 50 = 0"), 5).collect())
    f4 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    once = list({str(x): x for x in f4}.values())
    assert got == brute(once, [0, 50, 100, 150, 300, 400], 5)
    assert topk.search(df.limit(0), df, 5).count() == 0 and topk.search(df, df.limit(0), 5).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.search(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 3, 256 * 512)]


def test_few_blocks_are_shipped_for_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_DOCS", 20)
    r = np.random.default_rng(2)
    centres = r.normal(size=(50, 8)) * 4
    rows = [(i, (centres[i // 60] + r.normal(size=8) * 0.2).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = topk.Search(df, df.where("vec_id % 50 = 0"), 5)
    got = sorted(tuple(x) for x in search.run().collect())
    assert got == brute(rows, range(0, 3000, 50), 5)
    assert search.chosen < 0.2 * 60 * search.forward.count()


def test_nothing_is_written_per_pair_of_query_and_block(spark, monkeypatch):
    """On vectors without structure every query meets every block; what is written stays in proportion to the input."""
    monkeypatch.setattr(topk, "BLOCK_DOCS", 4)
    total, real = [], topk.common.written

    def written(df, name):
        out = real(df, name)
        total.extend(out.agg(*(F.sum(F.length(c)) for c, kind in out.dtypes if kind == "binary")).first() if "binary" in dict(out.dtypes).values() else ())
        return out

    monkeypatch.setattr(topk.common, "written", written)
    vectors = np.random.default_rng(4).normal(size=(3000, 64)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    search = topk.Search(df, df.where("vec_id % 50 = 0"), 5)
    assert sorted(tuple(x) for x in search.run().collect()) == brute(rows, range(0, 3000, 50), 5)
    assert search.chosen > 0.9 * 60 * search.forward.count() and sum(x or 0 for x in total) < 4 * vectors.nbytes


def test_many_batches_small_cells_and_large_values(spark, monkeypatch):
    for name, value in (("BATCH_BYTES", 200), ("CELL_BYTES", 400), ("BLOCK_BYTES", 100), ("CELL_QUERIES", 3), ("STEP", 2)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(5)
    rows = [(i, [r.choice([-1, 1]) * r.uniform(0, 2.0 ** r.choice([0, 8, 16, 21])) for _ in range(r.choice([1, 5, 9]))]) for i in range(0, 1500, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.search(df, df.where("vec_id % 50 = 0"), 3).collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 1500, 50):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    empty = spark.createDataFrame([(i, []) for i in (0, 7, 9)], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.search(empty, empty.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 7, 0), (0, 2, 9, 0)]


def test_large_numbers_are_exact():
    r = np.random.default_rng(3)
    q, d = np.floor(r.normal(size=(5, 4)) * 2.0**40), np.floor(r.normal(size=(30, 4)) * 2.0**40)
    want = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in d] for a in q]
    assert topk._dot(q, d).tolist() == want
    one = d.reshape(30, 1, 4)
    high = low = one[:, 0]
    kth = [sorted(w)[-5] for w in want]
    chosen = topk.choose(q, kth, high, low, 0, None)
    assert chosen.sum(axis=1).tolist() == [5] * 5 and topk.choose(q, [None] * 5, high, low, 0, 2).sum() == 10



def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9_compression_langid(spark, "/root/testdata/sf0.01")
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() == docs.count()
    n, right = joined.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.select("doc_id", "held_out").collect())


def test_language_edge_cases(spark):
    rows = [(i, "the cat sat on the mat and " * 9, "en") for i in range(40)] + [(100 + i, "der hund und die katze sind " * 9, "de") for i in range(40)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 !! \n", None), (None, "the cat and the", None), (503, "der hund " * 20_000, None), (504, "the cat", "en"), (504, "the cat", "en")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows + odd], "doc_id long, text string, lang string, score double")
    found = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    assert set(found) == {"de", "en"} and all(len(v) <= langid.DICTIONARY for v in found.values())
    got = langid.predict(docs, found).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out
    assert {r.lang_pred for r in langid.predict(docs.limit(3), {}).collect()} == {"und"}
    assert {r.score for r in langid.predict(docs.where("doc_id = 1"), {"en": b"the cat sat"}).collect()} == {1.0}
    assert langid.fit(docs.limit(0)) == {}


def plain_dictionaries(rows):
    """The dictionaries by plain loops over (doc_id, text, lang)."""
    import re
    import struct

    import xxhash

    signed = lambda data: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(data, seed=42).intdigest()))[0]
    normal = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).encode()
    out = {}
    for lang in {r[2] for r in rows}:
        first = {}
        for i, text, own in rows:
            if own == lang:
                h, data = signed(struct.pack("<q", i)), text.encode()
                key = h % 128
                first[key] = min(first.get(key, (2**63,)), (h, len(data), signed(data), text))
        left, whole = 112_000, []
        for h, n, _, text in sorted(first.values()):
            if n < left:
                whole.append(text)
                left -= n + 1
        out[lang] = b" ".join(map(normal, whole))
    return out


def test_language_against_plain_loops(spark):
    """Dictionaries and the compressed sizes are made again by plain loops."""
    import zlib

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    own = plain_dictionaries([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
    assert own == langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    made = {}
    for lang, data in own.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        made[lang] = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r for r in langid.op9_compression_langid(spark, "/root/testdata/sf0.01").collect()}
    for i, text, _ in rows[:150]:
        data = langid.normal(text)
        sizes = {lang: sum(len(c.compress(data[at : at + langid.PIECE])) for at in range(0, len(data), langid.PIECE)) for lang, c in made.items()}
        best, second = sorted(sizes.values())[:2]
        assert sizes[got[i].lang_pred] == best and abs(got[i].score - (second - best) / second) < 1e-12


def test_language_long_texts(spark):
    """A text that can't fit teaches from its start to its end if it is all there is, and is passed over otherwise."""
    long = "alpha " * 30_000 + "omega " * 30_000
    rows = [(1, long, "xx"), (2, long, "en"), (3, "the cat sat", "en"), (4, "the dog ran", "en"), (4, "the dog ran", "en")]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(found["en"].split()) == sorted(b"the cat sat the dog ran".split())
    assert b"alpha" in found["xx"] and b"omega" in found["xx"] and len(found["xx"]) <= langid.DICTIONARY
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), found).count() == 0
