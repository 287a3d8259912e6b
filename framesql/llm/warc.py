"""Content-addressed WARC archive (operator 1).

``write`` keeps three things apart in one folder:

* ``payloads``: the bytes of every distinct payload once, as a zstandard frame, keyed by the SHA-256 of the plain bytes. While they are
  stored, each key's rows are checked to agree in length and in a second, unrelated digest, and
  the bytes that are read back are hashed again, so a damaged or clashing payload raises.
* ``headers``: the exact header block of every record and the key of its payload.

``records`` joins them to the original records; ``read`` parses the bytes of these records; ``export`` and ``load`` exchange them with plain
gzip-compressed ``.warc.gz`` files. Hot payloads are reduced to one row by each task before
they are shuffled, and joins on the key leave the splitting of a hot key to adaptive execution.

Defined cases: a null payload is an empty one; a null url is an empty field, line breaks in it become blanks; a row without page_id
takes part, and refers to the response like any other; of rows that repeat a page_id with equal
payloads all are responses if that id is the largest; payloads of any length are kept whole, as one value of a row (2 GB at most); an empty table
makes empty archives; extra columns, also under names that are used inside, are ignored.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 1000
URN = "urn:framesql:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("response_id").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")


def _each(column: str, change):
    """Changes one binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            # A few rows at a time: payloads may be long.
            for i in range(0, batch.num_rows, 100):
                some = batch.slice(i, 100)
                yield some.set_column(at, column, pa.array([change(x.as_py()) for x in some.column(at)], pa.binary()))

    return run


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> None:
    """``pages``: page_id, url, html. Writes ``folder/payloads`` and ``folder/headers``."""
    spark = pages.sparkSession
    common.find_package(spark)
    payload = common.row_text("html").cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    facts = keyed.select("page_id", "key", F.xxhash64("payload").alias("check"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "payload")
    packed = facts.withColumnRenamed("payload", "packed")
    stored = packed.mapInArrow(_each("packed", _pack), packed.schema).groupBy("key").agg(
        F.any_value("packed").alias("packed"), F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("records"),
        F.min("check").alias("low"), F.max("check").alias("high"), *[F.any_value(c).alias(c) for c in ("payload_bytes", "payload_digest")],
    )
    checked = F.when(F.col("low") == F.col("high"), F.col("packed")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    stored = stored.select("key", checked.alias("packed"), "response_id", "records", "payload_bytes", "payload_digest")
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    facts = spark.read.parquet(f"{folder}/payloads").select("key", "response_id", "payload_bytes", "payload_digest")
    first = F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when((F.col("payload_bytes") < revisit_bytes) | first, "response").otherwise("revisit")
    headers = keyed.select("page_id", "url", "key").join(facts, "key").withColumn("record_type", kind)
    headers.select("key", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: the record's own bytes, its header, and the payload that it stands for (for a revisit that of its response)."""
    common.find_package(spark)
    joined = spark.read.parquet(f"{folder}/headers").join(spark.read.parquet(f"{folder}/payloads").select("key", F.col("packed").alias("payload")), "key")
    # Payloads travel packed, and are hashed again when they are plain.
    plain = joined.mapInArrow(_each("payload", _unpack), joined.schema)
    same = F.unhex(F.sha2("payload", 256)) == F.col("key")
    joined = plain.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary")))
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the records of the archive say: each is put together again, and its bytes are parsed.

    The header is what stands before the first empty line, the block the ``Content-Length`` bytes after it; both have to fill the record. A response's
    payload is its block, a revisit's that of the response; lengths and digests are computed from them and compared with the header.
    """
    made = records(spark, folder).select("record", "payload")
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    size = F.octet_length("header") + 4
    parsed = made.withColumn("header", head).withColumns({"size": size, "length": _field("Content-Length").cast("int"), "record_type": _field("WARC-Type")})
    whole = (F.octet_length("record") == F.col("size") + F.col("length") + 4) & (F.substring("record", -4, 4) == F.lit(b"\r\n\r\n"))
    block = F.when(whole, F.expr("substring(record, size + 1, length)")).otherwise(F.raise_error(F.lit("a record does not end where its header says")).cast("binary"))
    parsed = parsed.withColumn("block", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(block)).withColumn("sha1", F.sha1("block"))
    same = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & whole
    digest = F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("a header's digest differs from its payload")))
    number = r"<" + URN + r"(-?[0-9]+)>"
    page = lambda name: F.regexp_extract(_field(name), number, 1).try_cast("bigint")
    return parsed.select(page("WARC-Record-ID").alias("page_id"), F.octet_length("block").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("WARC-Refers-To").alias("refers_to"))


def export(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Writes the records as ``.warc.gz`` files, a gzip member for each; returns file and records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(to)
        fs.create_dir(root, recursive=True)
        name, n = f"{TaskContext.get().partitionId():06d}.warc.gz", 0
        part = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for r in batch.column(0):
                    out.write(gzip.compress(r.as_py(), 6, mtime=0))
                    n += 1
        fs.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{to}/{name}"], "records": [n]})

    return common.written(records(spark, folder).select("record").mapInArrow(run, "file string, records long"), "warc-export")


def load(files: DataFrame) -> DataFrame:
    """Records of ``.warc.gz`` files (column ``file``): header, block. Reads record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with gzip.open(fs.open_input_file(path)) as file:
                    while line := file.readline():
                        head = [line]
                        while (line := file.readline()) not in (b"\r\n", b""):
                            head.append(line)
                        head.append(b"\r\n")
                        header = b"".join(head)
                        size = int(re.search(rb"(?mi)^content-length: *(\d+)", header)[1])
                        block = file.read(size)
                        if file.read(4) != b"\r\n\r\n":
                            raise ValueError(f"{uri}: a record has no end")
                        yield pa.RecordBatch.from_pydict({"header": [header], "block": [block]})

    return files.select("file").mapInArrow(run, "header binary, block binary")


def op1_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "warc")
    write(common.read(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM q
"""
