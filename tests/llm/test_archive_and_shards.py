"""Operators 1 and 10: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesql.llm import common, sstable, warc

SF = "/root/testdata/sf0.001"


def test_archive_against_brute_force(spark):
    big = "x" * 1500
    huge = "y" * 20_000_000
    rows = [(10, "u", huge), (11, "u\r\n\r\nx", huge), (1, "u1", big), (5, "u\r\nEvil: 1", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "é" * 500), (9, "u", "é" * 500), (5, "again", big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, key int")
    folder = common.shared_dir(spark, "t")
    warc.write(pages, folder)
    got = sorted([tuple(r) for r in warc.read(spark, folder).collect()], key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        first = len(data) < 1000 or page == last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else last))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == 5

    # Original records come back byte by byte, also through plain files.
    records = {bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert any(r.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and r.endswith(b"\r\n\r\n\r\n\r\n") for r in records)
    assert not any(b"\r\nEvil" in r for r in records)
    files = warc.export(spark, folder, common.shared_dir(spark, "files"))
    assert files.agg({"records": "sum"}).first()[0] == len(rows)
    loaded = warc.load(files)
    assert {bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in loaded.collect()} == records


def test_damage_is_found(spark):
    folder = common.shared_dir(spark, "t")
    warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), folder)
    bad = common.shared_dir(spark, "bad")
    packed = warc._pack(b"abd")
    spark.read.parquet(f"{folder}/payloads").withColumn("packed", F.lit(packed)).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, bad).collect()


def test_empty_archive(spark):
    folder = common.shared_dir(spark, "t")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_shards_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = common.read(spark, SF, "documents")
    tokenizer = Tokenizer.from_file(sstable.default_tokenizer())
    got = sorted(sstable.op10_sorted_string_table(spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoding_of_odd_texts():
    from tokenizers import Tokenizer

    path = sstable.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "a b\tc\r\nd", "don't I'LL", "<|endoftext|> x<|startoftext|>y", "é é İ ßªµ", "a!!b##", "x" * 5000, "中文 \U0001f600", "\x85\x1c\x0b", "Wort. wort, WORT!", "n 12 3.4", "﻿q", "Å ǅ"]
    for _ in range(2):
        for text, ids in zip(texts, sstable.encode(texts, path), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", "Two  blanks\nand Lines.", "é a!!b", "<|endoftext|> x", "I'LL DON'T 12"]
    cased = json.loads(open(sstable.default_tokenizer(), encoding="utf-8").read())
    cased["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cased.json")):
        tokenizer = Tokenizer.from_file(path)
        assert not sstable._tokenizer(path)[1]
        assert [np.frombuffer(x, "<u4").tolist() for x in sstable.encode(texts, path)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sstable._tokenizer(sstable.default_tokenizer())[1]


def test_lookup_and_edge_cases(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(-50, 300, 3)] + [(7, "b", "x"), (7, "a", "x"), (None, "null key", "x"), (1000, None, "x")], "doc_id long, text string, start string")
    folder = common.shared_dir(spark, "sst")
    manifest = sstable.write(docs, folder, sstable.default_tokenizer(), shard_bytes=300)
    assert manifest.count() > 3
    rows = sstable.read(spark, folder, with_ids=True).collect()
    assert len(rows) == docs.count()
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, *sorted(r.doc_id for r in rows if r.doc_id is not None)]
    assert [r.start for r in by_start][1:] == np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()
    files = [r.file for r in manifest.orderBy("shard").collect()]
    found = {}
    for f in files:
        with sstable.Shard(f"{folder}/shards/{f}") as s:
            for key in (None, -50, 7, 1000, 8, 5000):
                found.setdefault(key, []).extend(x.tobytes() for x in s.get(key))
    for key, got in found.items():
        assert sorted(got) == sorted(bytes(r.ids) for r in rows if r.doc_id == key)
    assert sstable.encode_and_read(docs.limit(0)).count() == 0
    placed = sstable.encode_and_read(docs.withColumn("at", F.when(F.col("doc_id") != 10, F.col("doc_id") + 50)), place="at").collect()
    assert all(r["at"] == (None if r.doc_id in (None, 10) else r.doc_id + 50) for r in placed) and len(placed) == len(rows)


def test_shard_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 100)
    with open(tmp_path / "s", "wb") as out:
        w = sstable.ShardWriter(out)
        for i in range(500):
            w.add(sstable.key_of(i // 2), np.arange(i % 7, dtype="<u4").tobytes())
        with pytest.raises(ValueError):
            w.add(sstable.key_of(3), b"")
        w.close()
    with sstable.Shard(f"file://{tmp_path}/s") as s:
        assert s.blocks > 50 and s.entries == 500 and len(list(s.scan())) == 500
        assert [[len(x) for x in s.get(i)] for i in (0, 100, 249, 250)] == [[0, 1], [200 % 7, 201 % 7], [498 % 7, 499 % 7], []]
        assert sum(s.may_hold(sstable.key_of(i)) for i in range(1000, 2000)) < 50
