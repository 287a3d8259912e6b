"""Benchmark decontamination by template canonicalisation (operator 4), in DataFrame operations only.

A text becomes a row of tokens in which numbers, names and units stand as typed placeholders (``#``, ``@``,
``%``) and words as themselves in lower case. Windows of ``window`` tokens of every document are
hashed and joined with the windows of the benchmark items, so a question with other numbers, names or
units still matches. For windows with placeholders the slots must agree: along one alignment of an item and a
document, equal slot values of the item stand for equal values of the document and different ones for different ones.

A name is a capitalised word after another word, comma, semicolon or colon (not at the start of a sentence, where every word is a capitalised one and
stays a word); names that follow each other are one. Items shorter than a window are one
window of their own length. Windows of which less than half are words say nothing and are not used. An item that has no
other window, or less than ``MIN_TOKENS`` tokens, is looked for as a whole with its literal values: anywhere in a
document, or as a line of its own if it has less than ``LITERAL_TOKENS`` tokens.

The windows of the benchmark are broadcast only if their counted number is at most ``BROADCAST_ROWS``;
beyond, both sides are shuffled by the window's hash.

Defined cases: null or empty texts match nothing, on either side; texts of any length are taken whole; null identifiers stay null; repeated rows are reported alike, once per doc_id and item;
empty tables give no row; extra columns, also under names that are used inside, are kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

WINDOW, MIN_TOKENS, LITERAL_TOKENS = 10, 8, 3
BROADCAST_ROWS = 1_000_000
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Number words and units.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years meters metres miles feet inches grams kilograms pounds liters litres dollars euros cents percent mph kmh"


def _tokens(text: Column) -> Column:
    """Words, and placeholders with the value that they stand for behind them."""
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    marked = text.contains(NUMBER) | text.contains(NAME) | text.contains(UNIT)
    plain = F.when(marked, F.translate(text, NUMBER + NAME + UNIT, "   ")).otherwise(text)
    named = F.regexp_replace(plain, r"(?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})", NAME)
    with_units = F.regexp_replace(named, rf"([0-9] ?)(?=(?:{units}|[%€$£°])(?!\p{{L}}))", f"$1{UNIT}")
    numbers = F.regexp_replace(with_units, r"(?<![\p{L}\p{N}.,])(?=[0-9])", NUMBER)
    return F.regexp_extract_all(F.lower(numbers), F.lit(rf"{NUMBER}[0-9]+(?:[.,][0-9]+)*|{UNIT}(?:\p{{L}}+|[%€$£°])|{NAME}\p{{L}}++(?: {NAME}\p{{L}}++)*+|\p{{L}}+|[0-9]+"), F.lit(0))


def _kind(token: Column) -> Column:
    """The placeholder that stands for a token, null for a word."""
    mark = F.substring(token, 1, 1)
    return F.when(mark.between(NUMBER, UNIT), mark).when(token.isin(NUMBER_WORDS.split()), F.lit(NUMBER))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(F.coalesce(_kind(t), t)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once: an array read inside a lambda would be made for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(hashes: Column, lengths: list[int]) -> Column:
    """pos, n and h (hash) of every window of each length; the tokens are made and hashed once."""

    def of(h: Column) -> Column:
        def every(n: int) -> Column:
            last = F.size(h) - n
            each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), F.slice(h, i + 1, n)).alias("h")))
            return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<pos:int,n:int,h:bigint>>"))

        return F.concat(*map(every, lengths))

    return _once(hashes, of)


def _slots(tokens: Column, at: Column, n: Column) -> Column:
    """The placeholders of a window, with their values."""
    return F.filter(F.slice(tokens, at + 1, n), lambda t: _kind(t).isNotNull())


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, item (hash of the row), at, n, h, slots."""
    own = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("item_id", "text").alias("item"), _tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    own = own.withColumn("n", F.least(F.size("tokens"), F.lit(window))).withColumn("hashes", _hashes(F.col("tokens")))
    at = F.sequence(F.lit(0), F.size("tokens") - F.col("n"))
    rows = own.withColumn("at", F.explode(at)).withColumn("slots", _slots(F.col("tokens"), F.col("at"), F.col("n")))
    rows = rows.where(F.size("slots") * 2 <= F.col("n"))
    return rows.select("item_id", "item", "at", "n", F.xxhash64("n", F.slice("hashes", F.col("at") + 1, F.col("n"))).alias("h"), "slots").distinct()


def _literal(docs: DataFrame, benchmark: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """Documents with a whole copy of an item that has no usable window, None if there is no such item."""
    own = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("item_id", "text").alias("item"), _tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    own = own.join(items.select("item").distinct(), "item", "left_anti").withColumn("n", F.least(F.size("tokens"), F.lit(window)))
    facts = F.size("tokens").alias("size"), F.size(F.array_distinct(_slots(F.col("tokens"), F.lit(0), F.size("tokens")))).cast("long").alias("slots")
    own = own.select("item_id", "item", "tokens", "n", *facts).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("n"))))
    plain = lambda t: F.xxhash64(F.translate(t, NUMBER + NAME + UNIT, ""))  # noqa: E731  (whether a word is a name depends on the one before)
    hashes = F.transform(F.slice("tokens", F.col("at") + 1, F.col("n")), plain)
    own = common.written(own.select("item_id", "item", "at", "n", "size", "slots", F.xxhash64("n", hashes).alias("h")).distinct(), "literal-items")
    lengths = sorted(r["n"] for r in own.select("n").distinct().collect())  # at most ``window`` numbers
    if not lengths:
        return None
    a, b = common.hash128("doc_id", "text")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", a.alias("a"), b.alias("b"), "text")
    values = lambda c: F.transform(_tokens(F.col(c)), plain)
    few, more = [n for n in lengths if n < LITERAL_TOKENS], [n for n in lengths if n >= LITERAL_TOKENS]
    parts = []
    if few:
        lines = texts.select("doc_id", "a", "b", F.posexplode(F.split("text", r"[\r\n]")).alias("pos", "line")).withColumn("hashes", values("line")).withColumn("n", F.size("hashes"))
        parts.append(lines.where(F.col("n").isin(few)).select("doc_id", "a", "b", "pos", "n", F.xxhash64("n", "hashes").alias("h")))
    if more:
        parts.append(texts.withColumn("hashes", values("text")).select("doc_id", "a", "b", F.inline(_windows(F.col("hashes"), more))))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    # All windows of an item, one after the other.
    runs = every.join(wanted, ["h", "n"]).groupBy("a", "b", "doc_id", "item_id", "item", "size", "n", "slots", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count_distinct("at").alias("windows"))
    return runs.where(F.col("windows") == F.col("size") - F.col("n") + 1).groupBy("a", "b", "doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("slots").alias("slots"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document and item: a, b (key of the row), doc_id, item_id, windows, slots."""
    items = common.written(item_windows(benchmark, window), "item-windows")
    literal = _literal(docs, benchmark, items, window)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most ``window`` numbers
    wanted = items.select("h").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    a, b = common.hash128("doc_id", "text")
    tokens = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc_id"), a.alias("a"), b.alias("b"), _hashes(_tokens(F.col("text"))).alias("hashes"))
    if not lengths:
        return literal if literal is not None else docs.select("doc_id", a.alias("a"), b.alias("b"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("slots")).limit(0)
    every = tokens.select("doc_id", "a", "b", F.inline(_windows(F.col("hashes"), lengths)))
    found = common.written(every.join(wanted, "h", "left_semi"), "window-matches").distinct()
    pairs = found.join(items, ["h", "n"]).withColumn("shift", F.col("pos") - F.col("at"))

    free = pairs.where(F.size("slots") == 0).select("doc_id", "a", "b", "item_id", "item", "shift", "pos").withColumn("fits", F.lit(True)).withColumn("slots", F.lit(0).cast("long"))
    slotted = pairs.where(F.size("slots") > 0)
    # Only documents with a placeholder in a match are tokenised again, for the values.
    keys = slotted.select("a", "b").distinct()
    texts = docs.select(a.alias("a"), b.alias("b"), "text").join(keys, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("a", "b", _tokens(F.col("text")).alias("tokens"))
    zipped = slotted.join(texts, ["a", "b"]).withColumn("pair", F.explode(F.arrays_zip(F.col("slots").alias("x"), _slots(F.col("tokens"), F.col("pos"), F.col("n")).alias("y"))))
    group = ["a", "b", "item_id", "item", "shift"]
    seen = zipped.groupBy(*group, "pair").agg(F.any_value("doc_id").alias("doc_id")).groupBy(*group).agg(F.count(F.lit(1)).alias("slots"), F.count_distinct("pair.x").alias("xs"), F.count_distinct("pair.y").alias("ys"))
    judged = slotted.select("doc_id", *group, "pos").join(seen.withColumnsRenamed({c: f"{c}_" for c in group}), F.expr(" AND ".join(f"{c} <=> {c}_" for c in group))).withColumn("fits", (F.col("slots") == F.col("xs")) & (F.col("slots") == F.col("ys")))
    every = free.unionByName(judged.select(free.columns)).where("fits")
    runs = every.groupBy("doc_id", *group).agg(F.count_distinct("pos").alias("windows"), F.max("slots").alias("slots"))
    best = F.max("windows").alias("windows"), F.max("slots").alias("slots")
    found = runs.groupBy("a", "b", "doc_id", "item_id").agg(*best)
    return found if literal is None else found.unionByName(literal).groupBy("a", "b", "doc_id", "item_id").agg(*best)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents that match no item."""
    x, y = common.add_unique(docs, "key_a"), common.add_unique(docs, "key_b")
    found = common.written(matches(docs, benchmark, window).select(F.col("a").alias(x), F.col("b").alias(y)).distinct(), "contaminated")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    a, b = common.hash128("doc_id", "text")
    return docs.join(found, (a == F.col(x)) & (b == F.col(y)), "left_anti")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches: doc_id, item_id, windows, slots."""
    found = matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("slots").alias("slots"))
