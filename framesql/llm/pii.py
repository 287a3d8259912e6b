"""Personal data by bootstrapped contextual extraction (operator 6), in DataFrame operations only.

Base spans come from four patterns (``KINDS``), leftmost and non-overlapping per kind, followed by a
check; a match that fails it is dropped. They seed the method, and so do long keys (``KEY``: tokens of letters and digits such as hashes and access
tokens), which are uncertain: no base kind covers them and only their contexts tell whether they are secrets. The one to three words before
a mention and the one or two after it are lexical patterns, and identifier-like tokens (with a digit or an at sign) that no seed covers are
candidate instances. Patterns and instances form a graph that is scored in rounds:

* a pattern's trust for a kind is the confidence of the instances it introduces, summed over mentions,
  as a share of *all* places in the corpus where its words stand, and ``SMOOTH`` places more;
* an instance is as confident as its patterns together (1 - product of doubts); base seeds stay at 1, keys begin at ``KEY_BELIEF``.

Patterns with a trust of ``CONFIDENT`` and ``MIN_SEEDS`` different seeds then add the spans of their keys and unseen instances.

Words are what ASCII white space parts; the token that holds a mention is none of its words, and patterns do not reach over another mention of the same pass.

Defined cases: a null or empty text has no span; texts and words of any length are taken whole; nulls in doc_id stay nulls; every row gets a
result, rows repeated with one doc_id and text get the same and count once as evidence; spans of different kinds may overlap; added spans never
overlap base ones, and of several patterns the most trusted names the kind; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesql.llm import common

#: The contract's patterns in a form that runs in linear time: a match can only begin at the start of a run of its first
#: class or where the last match ended, and no quantifier ever has to give back.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: A token without blanks that holds a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Marks around a token belong to the sentence.
LEAD, TAIL = r"^[^\p{L}\p{N}+]*+", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: Seeds of the kind ``secret``: long tokens with letters and digits, in no word order of a language.
KEY = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,}+$"
SECRET, OTHER = "secret", "other"
#: Places are counted in one of so many parts of the corpus, then in larger ones, and last in all of it.
PARTS = (64, 8, 1)
MIN_SEEDS, ROUNDS, CONFIDENT, SMOOTH, KEY_BELIEF, MIN_LENGTH = 5, 3, 0.8, 0.2, 0.95, 6
WORDS_BEFORE, WORDS_AFTER = 3, 2
BROADCAST_ROWS = 500_000
#: So few grams are looked up before texts are exploded.
LITERALS = 2_000

_EDGE = "\ue003"


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.char_length(digits) <= 19, digits)), F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once: an array read inside a lambda would be made for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _gram(hashes: list[Column]) -> Column:
    return hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes)


def _words(text: Column, n: int) -> Column:
    """Up to n whole words that follow the token at the start of a text, up to the edge mark."""
    head = F.regexp_extract(text, rf"^\S*+((?:\s++\S++){{0,{n}}}+)", 1)
    return F.filter(F.split(common.strip(head), r"\s+"), lambda w: (w != "") & ~w.contains(_EDGE))


def _patterns(before: Column, after: Column) -> Column:
    """Structs of side and gram for the words before (nearest first) and after a mention."""

    def side(name: str, words: Column, most: int, reverse: bool) -> Column:
        def of(h: Column) -> Column:
            at = [F.get(h, F.lit(i)) for i in range(most)]
            return F.array(*[F.when(F.size(h) >= k, F.struct(F.lit(name).alias("side"), _gram(at[:k][::-1] if reverse else at[:k]).alias("gram"))) for k in range(1, most + 1)])

        return _once(F.transform(words, lambda w: F.xxhash64(F.lower(F.reverse(w) if reverse else w))), of)

    both = F.concat(side("l", before, WORDS_BEFORE, True), side("r", after, WORDS_AFTER, False))
    return F.filter(both, lambda p: p.isNotNull())


def _matches(kind: str, pattern: str, text: Column) -> Column:
    """Structs of kind, place in the order of matches, length of the gap before, value, and patterns."""
    empty = F.array().cast("array<struct<kind:string,at:int,gap:int,value:string,patterns:array<struct<side:string,gram:bigint>>>>")

    def of(gaps: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        three = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.size(gaps)), lambda p, g: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), g.alias("next")))
        found = F.filter(three, lambda p: p["value"].isNotNull())

        def row(p: Column, i: Column) -> Column:
            # A gap that begins or ends at another mention holds a part of that one's token there.
            before = F.reverse(F.concat(F.when(i > 0, F.lit(_EDGE)).otherwise(F.lit("")), p["gap"]))
            after = F.concat(p["next"], F.when(i < F.size(gaps) - 2, F.lit(_EDGE)).otherwise(F.lit("")))
            marks = _patterns(_words(before, WORDS_BEFORE), _words(after, WORDS_AFTER))
            return F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.char_length(p["gap"]).alias("gap"), p["value"].alias("value"), marks.alias("patterns"))

        return F.transform(found, row)

    needs = _NEEDS.get(kind)
    some = text.contains(needs) if needs else F.lit(True)
    return F.when(some & text.rlike("[0-9@]"), _once(F.split(text, pattern, -1), of)).otherwise(empty)


def mentions(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row per match: a, b (key of the row), kind, start, end, value, patterns."""
    every = F.concat(*[_matches(k, p, F.col("text")) for k, p in patterns.items()])
    rows = docs.select("a", "b", F.explode(every).alias("m")).select("a", "b", "m.*")
    size = F.char_length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(Window.partitionBy("a", "b", "kind").orderBy("at")))
    return rows.select("a", "b", "kind", (F.col("end") - size).alias("start"), "end", "value", "patterns")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _free(found: DataFrame) -> DataFrame:
    """Of mentions of kind ``other``, those that overlap no base one: one pass in each direction over the mentions of a document."""
    ahead = Window.partitionBy("a", "b").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("a", "b").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") != OTHER
    marked = found.withColumn("reached", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("ahead", F.min(F.when(base, F.col("start"))).over(back))
    clash = (F.coalesce("reached", F.lit(0)) > F.col("start")) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    return marked.where(base | ~clash).drop("reached", "ahead")


def _grams(docs: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Every run of one to three words of every text, or those that are wanted."""
    hashes = F.transform(F.split(common.strip(F.lower("text")), r"\s+"), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        cut = lambda at, less: F.slice(h, F.lit(at), F.greatest(F.size(h) - less, F.lit(0)))
        two = F.zip_with(cut(1, 1), cut(2, 1), lambda x, y: F.xxhash64(x, y))
        three = F.zip_with(F.zip_with(cut(1, 2), cut(2, 2), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), cut(3, 2), lambda p, z: F.xxhash64(p["x"], p["y"], z))
        every = F.concat(h, two, three)
        return every if wanted is None else F.filter(every, lambda g: g.isin(wanted))

    return docs.select(F.explode(_once(hashes, of)).alias("gram"))


def _places(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """context, places: how often the words of each pattern that can become confident stand in the corpus.

    A pattern without keys or unseen instances adds nothing. The places in a part of the corpus are at most those in all of it: a pattern
    that has too many there, were all its instances certain, is never confident and is not counted further. In the first, smallest part all
    runs of words are counted and then joined; what is left has few places beside its mentions, so the later joins grow with the
    mentions. The result is the same as with all patterns.
    """
    able = edges.groupBy("context", "gram").agg(F.sum("n").alias("most"), F.max(F.col("kind").isin(OTHER, SECRET).cast("int")).alias("open")).where("open = 1").drop("open")
    left = common.written(able, "pii-able")
    for part in PARTS:
        if left.isEmpty():
            break
        own = docs.where(F.pmod("a", F.lit(part)) == 0)
        grams = left.select("gram").distinct()
        if part == PARTS[0]:
            some = _grams(own)
        elif grams.count() <= LITERALS:
            some = _grams(own, [r["gram"] for r in grams.collect()])
        else:
            some = _grams(own).join(_small(grams), "gram", "left_semi")
        counted = some.groupBy("gram").agg(F.count(F.lit(1)).alias("places"))
        able = left.select("context", "gram", "most").join(counted, "gram", "left").withColumn("places", F.coalesce("places", F.lit(0)))
        left = common.written(able.where(F.col("most") / (F.col("places") + SMOOTH) >= CONFIDENT), "pii-places")
    return left.select("context", "places")


def discover(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Spans that confident patterns add: a, b, kind, start, end."""
    others = mentions(docs, {OTHER: CANDIDATE})
    lead = F.char_length(F.regexp_extract("value", LEAD, 0))
    tail = F.char_length(F.regexp_extract("value", TAIL, 0))
    others = others.withColumns({"start": F.col("start") + lead, "end": F.col("end") - tail, "value": F.regexp_replace(F.regexp_replace("value", LEAD, ""), TAIL, "")})
    others = others.where(F.char_length("value") >= MIN_LENGTH)
    kind = F.when((F.col("kind") == OTHER) & F.col("value").rlike(KEY), SECRET).otherwise(F.col("kind"))
    every = common.written(_free(base.unionByName(others)).withColumn("kind", kind), "pii-mentions")

    marks = every.select("kind", "value", F.explode("patterns").alias("p")).select("kind", "value", F.col("p.gram").alias("gram"), _context().alias("context"))
    short = marks.where(F.col("kind") != OTHER).groupBy("context").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= MIN_SEEDS).select("context")
    short = common.written(short, "pii-patterns")
    empty = every.select("a", "b", "kind", "start", "end").limit(0)
    if short.isEmpty():
        return empty
    # Edges between short-listed patterns and instances, and how often each pattern's words stand anywhere.
    edges = common.written(marks.join(_small(short), "context").groupBy("context", "gram", "kind", "value").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    total = _places(docs, edges)
    if total.isEmpty():
        return empty
    graph = common.written(edges.join(total, "context"), "pii-graph")

    # Each value's confidence in each kind; base seeds are certain.
    seed = graph.where(F.col("kind") != OTHER).select("value", F.col("kind").alias("of")).distinct()
    seed = common.written(seed.withColumn("belief", F.when(F.col("of") == SECRET, KEY_BELIEF).otherwise(1.0)), "pii-seeds")
    belief, confident = seed, None
    doubt = lambda c: F.log(F.greatest(F.lit(1e-9), 1 - F.least(c, F.lit(1.0))))
    for k in range(ROUNDS):
        known = F.count_distinct(F.when(F.col("kind") != OTHER, F.col("value"))).alias("seeds")
        scored = graph.join(belief, "value").groupBy("context", "of").agg((F.sum(F.col("n") * F.col("belief")) / (F.max("places") + SMOOTH)).alias("trust"), known)
        confident = common.written(scored.where((F.col("trust") >= CONFIDENT) & (F.col("seeds") >= MIN_SEEDS)), f"pii-round{k}")
        if confident.isEmpty():
            return empty
        told = graph.where(F.col("kind").isin(OTHER, SECRET)).join(confident, "context").groupBy("value", "of").agg(F.sum(doubt(F.col("trust"))).alias("doubt"))
        both = told.join(seed, ["value", "of"], "full").select("value", "of", F.coalesce("doubt", F.lit(0.0)).alias("doubt"), F.coalesce("belief", F.lit(0.0)).alias("first"))
        belief = both.select("value", "of", F.when(F.col("first") == 1, 1.0).otherwise(1 - F.exp(F.col("doubt") + doubt(F.col("first")))).alias("belief"))
    best = confident.groupBy("context").agg(F.max(F.struct("trust", "of")).alias("best"))
    added = every.where(F.col("kind").isin(OTHER, SECRET)).select("a", "b", "start", "end", F.explode("patterns").alias("p")).withColumn("context", _context()).join(_small(best), "context")
    return added.groupBy("a", "b", "start", "end").agg(F.max("best").alias("best")).select("a", "b", F.col("best.of").alias("kind"), "start", "end")


def _context() -> Column:
    return F.xxhash64("p.side", "p.gram")


def _distinct_rows(docs: DataFrame) -> DataFrame:
    """a, b, text: rows with a text, those that repeat a doc_id and text once."""
    a, b = common.hash128("doc_id", "text")
    own = docs.where(F.col("text").isNotNull()).select(a.alias("a"), b.alias("b"), "text")
    again = common.written(own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), "pii-repeated")
    if again.isEmpty():
        return own
    more = _small(again)
    return own.join(more, ["a", "b"], "left_anti").unionByName(own.join(more, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans, n_added, n_secret for every row."""
    own = _distinct_rows(docs)
    valid = F.lit(False)
    for kind in KINDS:
        valid = valid | ((F.col("kind") == kind) & _valid(kind, F.col("value")))
    base = common.written(mentions(own, KINDS).where(valid), "pii-base")
    added = common.written(discover(own, base), "pii-added")
    order = F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind")).cast("int")
    both = base.select("a", "b", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))
    span = F.struct(order.alias("order"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("said"), "base")
    count = lambda c: F.sum(c.cast("long"))
    counts = [count(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS] + [count(F.col("kind") == SECRET).alias(f"n_{SECRET}")]
    lists = both.groupBy("a", "b").agg(F.sort_array(F.collect_list(span)).alias("found"), *counts)
    a, b = common.hash128("doc_id", "text")
    rows = docs.select("doc_id", a.alias("a"), b.alias("b")).join(lists, ["a", "b"], "left")
    found = F.coalesce(F.col("found"), F.array().cast(lists.schema["found"].dataType))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter(found, lambda s: s["base"])), 256).alias("base_sha256"), said(found).alias("spans"), F.size(F.filter(found, lambda s: ~s["base"])).cast("long").alias("n_added"),
        F.coalesce(f"n_{SECRET}", F.lit(0)).cast("long").alias(f"n_{SECRET}"),
    )


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"))
