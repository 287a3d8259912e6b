"""Line deduplication over the corpus (operator 7), in DataFrame operations only.

Lines are exploded with their position, normalised and hashed (128 bits); distinct documents are
counted per hash; lines over the threshold are dropped and the rest is put
together by position. Pairs of hash and document are made distinct before they are counted by hash with
map-side sums, so a hot line is spread over all tasks first and is one row of each after that. The set of hot
hashes is broadcast only if its counted size is below ``BROADCAST_ROWS``; beyond, a shuffled
join is left to adaptive execution, which splits hot keys.

Defined cases: a document is a doc_id, so rows that repeat one count once for a line; rows without doc_id are told apart
by their text; every row gets a result of its own; a null
or empty text is one empty line; lines whose key is shorter than ``min_chars`` stay; if all lines go, the kept text is empty;
a line of any length is trimmed in one pass over it; an empty table gives no row. Extra columns are kept by ``deduplicate``, also under
the names that are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

#: Rows of 16 bytes, so at most some tens of MB in an executor.
BROADCAST_ROWS = 1_000_000


def _key(line: Column) -> Column:
    return common.ascii_lower(common.strip(line))


def _document() -> list[Column]:
    """What tells documents apart: the identifier, and the text where that is null."""
    return [F.col("doc_id").alias("doc"), F.when(F.col("doc_id").isNull(), F.xxhash64(common.row_text())).alias("nameless")]


def deduplicate(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with columns kept_text, n_lines and n_dropped besides its own."""
    lines, first, second, drop = (common.add_unique(docs, c) for c in ("lines", "row_a", "row_b", "drop"))
    split = docs.withColumn(lines, F.split(common.row_text(), "\n", -1))
    a, b = common.hash128("doc_id", "text")

    def exploded(whole: bool) -> DataFrame:
        keys = F.transform(F.split(common.row_text(), "\n", -1), _key)
        own = docs.select(a.alias("a"), b.alias("b"), F.posexplode(keys)) if whole else docs.select(*_document(), F.explode(F.array_distinct(keys)).alias("col"))
        x, y = common.hash128("col")
        return own.where(F.char_length("col") >= min_chars).withColumns({"x": x, "y": y}).drop("col")

    pairs = exploded(False).distinct()
    hot = common.written(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("x", "y"), "hot-lines")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    places = exploded(True).join(hot, ["x", "y"], "left_semi").groupBy("a", "b").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    places = places.select(F.col("a").alias(first), F.col("b").alias(second), F.col("drop").alias(drop))
    joined = split.withColumns({first: a, second: b}).join(places, [first, second], "left")
    # The lines between one dropped position and the next: each is copied once, whatever the count.
    d, n = F.coalesce(F.col(drop), F.array().cast("array<int>")), F.size(lines)
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), d), F.concat(d, F.array(n)), lambda p, q: F.struct((p + 2).alias("at"), (q - p - 1).alias("n")))
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["n"] > 0), lambda g: F.slice(lines, g["at"], g["n"])))
    text = F.when(F.col(drop).isNull(), common.row_text()).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"kept_text": text, "n_lines": n.cast("long"), "n_dropped": F.size(d).cast("long")}).drop(lines, first, second, drop)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS ls,
                  coalesce(CAST(doc_id AS VARCHAR), 'none ' || md5(coalesce(text, ''))) AS doc FROM documents),
e AS (SELECT doc_id, row, doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT doc_id, row, doc, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, row
"""
