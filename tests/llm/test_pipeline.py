"""The stages one after the other, each held against its own input."""

import re
import zlib

import numpy as np
import pytest
from test_jaccard import brute

import corpus_pipeline
from framesql.llm import common, sstable

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = common.read(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id for r in steps[1].collect()}
    assert not [r for r in labels if r.quality == 1 and r.doc_id not in kept]
    assert sum(r.doc_id in kept for r in labels if r.quality == 0) <= 3


def test_near_duplicate_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert {r.doc_id for r in steps[2].collect()} == want and steps[2].count() == len(want)


def test_decontamination_stage(spark, steps):
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda t: {tuple(words(t)[i : i + 10]) for i in range(len(words(t)) - 9)}
    bad = set().union(*[grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    want = {r.doc_id for r in steps[2].collect() if not grams(r.text) & bad}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_mixing_and_tokens(steps):
    from tokenizers import Tokenizer

    given, mixed, made = steps[3].collect(), steps[4].collect(), steps[5].collect()
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(mixed) / size(given) - 1.5) < 0.1
    assert max(np.unique([r.doc_id for r in mixed], return_counts=True)[1]) == 2
    tokenizer = Tokenizer.from_file(sstable.default_tokenizer())
    start = 0
    for r, d in zip(sorted(made, key=lambda r: r.start), sorted(mixed, key=lambda r: r.doc_id), strict=True):
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # Places are the order of training: within a source, documents of one copy stand as they are mixed.
    assert sorted(r.place for r in made) == list(range(len(mixed)))
    files = steps[4].select("_metadata.file_name", "_metadata.row_index", "doc_id").collect()
    assert [r.doc_id for r in sorted(files)] == [r.doc_id for r in sorted(made, key=lambda r: r.place)]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(None, "null id with some words in it", "en", None), (1, None, None, "a"), (1, "", "en", "a"), (2, "same text here as there", "en", "a"), (2, "same text here as there", "en", "a"), (3, "w " * 30_000, "en", "b")]
    docs = spark.createDataFrame([(*r, 5, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, place string, rid int")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for table, df in (("labels", labels), ("benchmark", spark.createDataFrame([(1, None)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
    given = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, [6, 5, 5, None, None], strict=True):
        given = common.written(stage(spark, given, str(tmp_path)), "odd")
        assert want is None or given.count() == want, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert given.columns == docs.columns, name
