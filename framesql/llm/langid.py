"""Language identification by compression (operator 9).

For each language a bounded sample of labelled rows makes a raw-content zstandard dictionary. A
whole text, in pieces of ``PIECE`` bytes, is compressed with every dictionary, and the language
of the smallest total wins; of equal totals, that with more labelled documents. ``score`` is the share by which it beats the second; below
``margin`` the prediction is marked as rejected in ``confident``.

The sample: ``SAMPLE_SALTS`` documents per language, those of the smallest identifier hash in each of
as many hash classes. In the order of their hash, each whole text that still fits into ``DICTIONARY`` bytes joins the dictionary. If none fits, the shortest
gives ``SLICES`` slices, evenly from its start to its end. Every document is predicted, from its whole text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing could be learned; with one learned language the score is 1; a null doc_id counts as held out
(nothing is learned from it); repeated rows are predicted alike; texts of any length are
taken whole; an empty table gives no row; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

SAMPLE_SALTS, DICTIONARY, SLICES = 128, 112_000, 64
PIECE = 8_192
LEVEL = 9
#: More languages than this are an error, not a silent cut.
MOST_LANGUAGES = 500

_ODD = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-cased letters, all else as single blanks."""
    return _ODD.sub(" ", text.lower()).encode()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitting(sizes: list[int]) -> list[int]:
    """The places of the sizes that are taken, in their order, each with a blank before it, while all fit into ``DICTIONARY``."""
    taken, left = [], DICTIONARY
    for i, n in enumerate(sizes):
        if n < left:
            taken.append(i)
            left -= n + 1
    return taken


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary per language from rows with text, lang and doc_id; languages with more documents first."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("x"))
    best = F.min(F.struct("h", "bytes", "x")).alias("best")
    picked = own.groupBy("lang", F.pmod("h", F.lit(SAMPLE_SALTS)).alias("salt")).agg(best, F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES * SAMPLE_SALTS).collect()
    sample: dict[str, list] = {}
    docs_of: dict[str, int] = {}
    for r in picked:
        sample.setdefault(r["lang"], []).append(r["best"])
        docs_of[r["lang"]] = docs_of.get(r["lang"], 0) + r["n"]
    if len(sample) >= MOST_LANGUAGES:
        raise ValueError(f"{MOST_LANGUAGES} languages or more")
    wanted = set()
    for lang, rows in sample.items():
        rows.sort()
        taken = [rows[i] for i in fitting([r["bytes"] for r in rows])] or [min(rows, key=lambda r: r["bytes"])]
        wanted |= {(lang, r["h"], r["x"]) for r in taken}
    # A slice has at most four bytes a character.
    width, starts = DICTIONARY // (4 * SLICES) - 1, F.sequence(F.lit(0), F.lit(SLICES - 1))
    slices = F.transform(starts, lambda i: F.substring(F.col("text"), F.floor(i * F.greatest(F.char_length("text") - width, F.lit(0)) / (SLICES - 1)).cast("int") + 1, F.lit(width)))
    text = F.when(F.col("bytes") < DICTIONARY, F.col("text")).otherwise(F.array_join(slices, " ")).alias("text")
    rows = own.where(F.col("h").isin(sorted({h for _, h, _ in wanted}))).where(F.col("x").isin(sorted({x for _, _, x in wanted}))) if wanted else own.limit(0)
    # At most ``DICTIONARY`` bytes of a language reach the driver, but for rows that share a hash.
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.select("lang", "h", "x", text).dropDuplicates(["lang", "h", "x"]).collect():
        if (r["lang"], r["h"], r["x"]) in wanted:
            found.setdefault(r["lang"], []).append((r["h"], normal(r["text"])))
    made = {}
    for lang in sorted(found, key=lambda x: (-docs_of[x], x)):
        texts = [t for _, t in sorted(found[lang])]
        made[lang] = b" ".join(texts[i] for i in fitting([len(t) for t in texts]))
    return made


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.compressors = []
        for lang, data in dictionaries.items():
            if len(data) < 8:
                data = data.ljust(8)
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.compressors or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = normal(text)
        pieces = [data] if len(data) <= PIECE else [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), i) for i, (_, c) in enumerate(self.compressors))
        lang = self.compressors[sizes[0][1]][0]
        return (lang, 1.0) if len(sizes) == 1 else (lang, (sizes[1][0] - sizes[0][0]) / sizes[1][0])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score, confident for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            got = [classify(t.as_py()) for t in batch.column(2)]
            score = pa.array([s for _, s in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), score, pa.array([s >= margin for _, s in got])], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    common.find_package(docs.sparkSession)
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")


def op9_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
