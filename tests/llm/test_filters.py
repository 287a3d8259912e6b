"""Operators 4, 5 and 6."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesql.llm import decontaminate, pii, quality

SF = "/root/testdata/sf0.01"


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = {}
    for b in bench:
        w = words(b.text)
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(b.item_id)
    want = set()
    for d in docs:
        w = words(d.text or "")
        want |= {(d.doc_id, item) for i in range(len(w) - 9) for item in grams.get(tuple(w[i : i + 10]), ())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_template_decontamination(spark, SF).collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("limit", [0, 10**6])
def test_templates_and_slots(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    text = "Then {} bought {} apples for {} euros and later gave {} apples to {} before lunch at noon today."
    rows = [
        (1, text.format("Tom", 12, 4, 5, "Mary")),
        (2, text.format("Bob", "seven", 9, "3.5", "Jane")),
        (3, text.format("Bob", 31, 31, 31, "Bob")),  # equal values where the item's differ
        (4, None),
        (5, ""),
        (6, "word " * 30_000 + text.format("Tom", 1, 2, 3, "Ann") + " word" * 30_000),
        (7, "A plain text that says nothing of fruit at all, whoever may read it here and now."),
        (None, text.format("Tom", 12, 4, 5, "Mary")),
        (1, text.format("Tom", 12, 4, 5, "Mary")),
        (8, " strange marks " + text.format("Tom", 1, 2, 3, "Ann")),
    ]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, item_id int, slots string")
    bench = spark.createDataFrame([(70, "Quiz: " + text.format("Ann", 3, 8, 2, "Sue"), 1), (71, None, 1), (72, "apples to", 1), (None, "x", 1)], "item_id long, text string, a int")
    found = decontaminate.matches(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("1", 70), ("2", 70), ("6", 70), ("8", 70), ("None", 70)]
    assert all(r.slots >= 3 for r in found)
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.remove(docs.limit(0), bench).count() == 0


def brute_templates(rows, items):
    """Documents and items that share a template window, by plain loops, for texts of words, numbers and names between blanks."""

    def tokens(text):
        out, words = [], text.split()
        for k, w in enumerate(words):
            bare = w.strip(".,")
            if re.fullmatch(r"[0-9.]+", bare):
                out.append(("#", bare))
            elif bare[:1].isupper() and k and not words[k - 1].endswith("."):
                if out[-1][0] == "@" and not words[k - 1].endswith(","):
                    out[-1] = ("@", out[-1][1] + " " + bare.lower())
                else:
                    out.append(("@", bare.lower()))
            else:
                out.append((bare.lower(), None))
        return out

    found = set()
    for item, told in items:
        x = tokens(told)
        for doc, text in rows:
            y = tokens(text)
            for shift in range(-len(x), len(y)):
                at = [i for i in range(len(x) - 9) if 0 <= i + shift <= len(y) - 10 and [k for k, _ in x[i : i + 10]] == [k for k, _ in y[i + shift : i + shift + 10]]]
                windows = [i for i in at if 2 * sum(v is not None for _, v in x[i : i + 10]) <= 10]
                if any(all(v is None for _, v in x[i : i + 10]) for i in windows):
                    found.add((doc, item))
                slots = {(x[i + k][1], y[i + shift + k][1]) for i in windows for k in range(10) if x[i + k][1] is not None}
                if slots and len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots}):
                    found.add((doc, item))
    return found


def test_templates_against_brute_force(spark):
    r = random.Random(9)
    names = ["Tom", "Mary", "Mary Ann", "Bob", "John Paul Jones", "Sue"]
    word = lambda: r.choice("apples gave bought later shop then of the with went some old green road house found".split())
    frames = [[r.choice(["{n}", "{v}", None, None, None, None]) or word() for _ in range(r.randrange(14, 24))] for _ in range(12)]
    fill = lambda frame, values: "so " + " ".join(values.get(w, w) if w not in ("{n}", "{v}") else (r.choice(names) if w == "{n}" else str(r.randrange(3, 9))) for w in frame)
    items = [(i, fill(f, {})) for i, f in enumerate(frames)]
    rows = [(i, " ".join([*(word() for _ in range(r.randrange(9))), fill(r.choice(frames), {}), *(word() for _ in range(r.randrange(9)))])) for i in range(150)]
    rows += [(200 + i, t) for i, t in items]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_templates(rows, items)
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert len([x for x in want if x[0] < 200]) > 20 and len({x for x in want if x[0] >= 200}) == 12


def test_short_item_is_one_window(spark):
    docs = spark.createDataFrame([(1, "so the quick brown fox jumps over a lazy dog said he"), (2, "the quick brown fox jumps over a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over a lazy dog")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.matches(docs, bench).collect()] == [1]


def test_items_without_usable_window_are_found_as_a_whole(spark):
    sums = "1 2 3 4 5 6 7 8 9 10 11 12 and 13"
    docs = spark.createDataFrame([(1, "Q: Who wrote Hamlet? A: he"), (2, f"so {sums} is"), (3, sums.replace("7", "0")), (4, "x\n2 + 2\ny"), (5, "it is 2 + 2 here"), (6, "who wrote it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, sums), (3, "2 + 2")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == [(1, 1), (2, 2), (4, 3)]
    assert sorted(r.doc_id for r in decontaminate.remove(docs, bench).collect()) == [3, 5, 6]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_keeps_clean_and_drops_bad(spark, sf):
    path = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = quality.op5_importance_resampling(spark, path).select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert good.count(1) / len(good) > 0.98 and bad.count(1) / len(bad) < 0.05


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("doc_id % 3 = 0").where("quality = 1 OR quality = 0").collect()
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 3 <> 0")).collect()}
    good, bad = [r.doc_id in kept for r in held if r.quality == 1], [r.doc_id in kept for r in held if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_resampling_against_brute_force(spark):
    import math

    import xxhash

    r = random.Random(6)
    good = lambda: " ".join(r.choice("the cat sat on a mat and saw one dog".split()) for _ in range(r.randrange(3, 30)))
    mixed = lambda: " ".join(r.choice("the cat buy now win cash dog at once one".split()) for _ in range(r.randrange(3, 30)))
    rows = [(i, good() if i % 2 else mixed()) for i in range(400)] + [(400, None), (401, ""), (None, good()), (7, good())]
    labels = [(i, int(i % 2), 0) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    # Words, pairs and shapes in buckets, by plain loops.
    known = {i for i, q, _ in labels if q}
    word = lambda t: xxhash.xxh3_64_intdigest(t.lower().encode()) >> 4

    def grams(text):
        tokens = (text or "").split()
        h = [word(t) for t in tokens]
        out = [x % quality.BUCKETS for x in h]
        out += [(((x * 0x9E3779B97F4A7C15 + y) * 0xC2B2AE3D27D4EB4F) % 2**64) >> 48 for x, y in zip(h, h[1:], strict=False)]
        shape = [0] + [8 if k and h[k] == h[k - 1] else 1 for k in range(len(h))] + [0]
        return out + [quality.BUCKETS + (a * 9 + b) * 9 + c for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)] if tokens else []

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in known:
            target.update(grams(t))
    part = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + 200) / (n * part + 200)) for g, n in raw.items()}
    weights = [sum(ratio[g] for g in grams(t)) for _, t in rows]
    noise = [((xxhash.xxh3_64_intdigest(f"{i}\0".encode() + (t or "").encode()) >> 12) + 0.5) / 2**52 for i, t in rows]
    for temperature, share in ((0.05, 1.0), (1.0, 1.0), (1.0, 0.5)):
        sums = [w / temperature - math.log(-math.log(u)) for w, u in zip(weights, noise, strict=True)]
        scored, _, least = quality.decide(df, told, share, temperature)
        assert np.allclose(sorted(x.log_weight for x in scored.collect()), sorted(weights)) and np.allclose(sorted(x.perturbed for x in scored.collect()), sorted(sums))
        above = quality.cut(scored, {i: bool(q) for i, q, _ in labels})
        k = int(share * sum(w >= above - 1e-9 for w in weights))
        want = sorted(str(rows[x]) for x in np.argsort(sums)[::-1][:k])
        assert sorted(str(tuple(x)) for x in quality.resample(df, told, share, temperature).collect()) == want
        # The noise decides where weights are close.
        by_weight = sorted(str(rows[x]) for x in np.argsort(weights)[::-1][:k])
        assert (want != by_weight) or temperature < 1


def test_quality_edge_cases(spark):
    good = [(i, f"The cat number {i} sat on the mat, and the dog looked on from the door.", "a") for i in range(300)]
    bad = [(1000 + i, f"BUY!! NOW!! {i} $$$ ### WIN!! WIN!! | x | y | BUY!! NOW!! $$$ ###", "b") for i in range(100)]
    odd = [(5000, None, "c"), (5001, "", "c"), (None, "The cat sat on the mat, and the dog looked on.", "c"), (3, good[3][1], "a"), (5002, "BUY!! $$$ | " * 20_000, "c")]
    docs = spark.createDataFrame([(*r, 0.0) for r in good + bad + odd], "doc_id long, text string, source string, log_weight double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, None) for i in range(0, 100, 2)] + [(None, 1, 0), (7, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.resample(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(300)) <= set(ids) and not [i for i in ids if i is not None and (1000 <= i < 1100 or i == 5002)]
    assert {5000, 5001, None} <= set(ids) and ids.count(3) == 2
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in quality.resample(docs.repartition(5), labels).collect())
    assert quality.resample(docs, labels.limit(0)).count() == docs.count()
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    r = np.random.default_rng(4)
    x = np.concatenate((r.normal(size=500), r.normal(size=100) * 1e6, np.full(50, 0.25), [1e-300, -1e-300]))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 77, 300, 400, len(x)):
        assert quality.kth_largest(df, "v", k) == np.sort(x)[-k]
    assert quality.kth_largest(df, "v", 0) == np.inf and quality.kth_largest(df.limit(0), "v", 3) == -np.inf


def luhn(s):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(s)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def brute_base(text):
    spans, counts = [], []
    for kind, pattern, good in BASE:
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m[0])]
        spans += own
        counts.append(len(own))
    return counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


def test_base_spans(spark):
    texts = [
        None, "", "a@b.c_x@d.e f@g.h.", "x.y+z@q-1.co.uk@r.s", "\U0001f600é ü a@b.de", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.4 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 5  5",
        "+1 (017) 555-7713. +12 +1 234 5678- ) +49.30.1234567890123456", "9" * 20_000, "a" * 60_000 + "@b.c", "a@b" * 3_000, "4111111111111111 " * 300, "@@.. +++ 1-1-1 -1", "1" * 5_000 + "." + "2" * 5_000, "٣٤٥@x.y 1٣",
    ]
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)] + [(4, texts[4], "k")], "doc_id long, text string, kind string")
    got = pii.find(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id or 0]
        counts, sha, spans = brute_base(text)
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, sha), text
        assert set(spans) <= set(filter(None, r.spans.split(",")))
    assert pii.find(docs.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please note: my phone is +1 (555) 010-{1000 + i} and that is all, {'word ' * (i % 7)}") for i in range(60)]
    rows += [(100 + i, f"Well, my phone is 555-01{10 + i} today. It is the year 2024-11 of the era.") for i in range(5)]
    rows += [(200 + i, f"the order is 77-{i}-1234567 as you know and the rest is 12-345{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in range(5):
        text = rows[60 + i][1]
        at = text.index("555")
        assert got[100 + i].spans == f"phone:{at}:{at + 8}" and got[100 + i].n_added == 1 and got[100 + i].n_phone == 0
    assert all(got[i].n_added == 0 for i in list(range(60)) + list(range(200, 230)))
    for i, text in rows:
        assert got[i].base_sha256 == brute_base(text)[1]


WS = r"[ \t\n\x0b\x0c\r]+"


def brute_added(rows):
    """The spans that the method adds, by plain loops over distinct rows."""
    seen, places = [], Counter()
    for key, text in enumerate(dict.fromkeys(rows)):
        text = text[1]
        words = re.split(WS, text.lower().strip(" \t\n\x0b\x0c\r"))
        places.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        found = []
        for kind, pattern, good in [*BASE, ("other", r"(?<!\S)[^\s0-9@]*[0-9@]\S*", lambda v: True)]:
            own = list(re.finditer(pattern, text))
            for i, m in enumerate(own):
                before = re.split(WS, text[own[i - 1].end() if i else 0 : m.start()])[bool(i) : -1]
                after = re.split(WS, text[m.end() : own[i + 1].start() if i + 1 < len(own) else None])[1 : -1 if i + 1 < len(own) else None]
                before, after = ([w.lower() for w in x if w] for x in (before, after))
                marks = [("l", tuple(before[-k:])) for k in (1, 2, 3) if len(before) >= k] + [("r", tuple(after[:k])) for k in (1, 2) if len(after) >= k]
                start, end, value = m.start(), m.end(), m[0]
                if kind == "other":
                    cut = re.sub(r"^[^\w+]+", "", value)
                    start += len(value) - len(cut)
                    value = re.sub(r"(?<=\w)\W+$", "", cut)
                    end = start + len(value)
                    if len(value) < 6 or any(s < end and start < e for _, s, e, *_ in found):
                        continue
                    if re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", value) and len(re.findall("[0-9]", value)) >= 4 and len(re.findall("[A-Za-z]", value)) >= 4:
                        found.append(("secret", start, end, value, marks))
                        continue
                elif not good(value):
                    continue
                found.append((kind, start, end, value, marks))
        seen += [(key, *f) for f in found]
    edges = Counter((mark, kind, value) for _, kind, _, _, value, marks in seen for mark in marks)
    seeds = {(v, k): 0.95 if k == "secret" else 1.0 for _, k, _, _, v, _ in seen if k != "other"}
    known = {}
    for mark, kind, value in edges:
        if kind != "other":
            known.setdefault(mark, set()).add(value)
    belief = dict(seeds)
    for _ in range(3):
        trust = Counter()
        for (mark, _, value), n in edges.items():
            for of in ("email", "ip", "card", "phone", "secret"):
                if (value, of) in belief:
                    trust[mark, of] += n * belief[value, of] / (places[mark[1]] + 0.2)
        sure = {x: t for x, t in trust.items() if t >= 0.8 and len(known.get(x[0], ())) >= 5}
        doubt = {x: 1 - b for x, b in seeds.items()}
        for mark, kind, value in edges:
            if kind in ("other", "secret"):
                for (m, of), t in sure.items():
                    if m == mark:
                        doubt[value, of] = doubt.get((value, of), 1.0) * max(1e-9, 1 - min(t, 1.0))
        belief = {x: 1 - d for x, d in doubt.items()}
    added = set()
    for key, kind, start, end, _, marks in seen:
        best = max(((t, of) for mark in marks for (m, of), t in sure.items() if m == mark), default=None)
        if kind in ("other", "secret") and best:
            added.add((key, best[1], start, end))
    return added


def test_added_spans_against_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 5)))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32))
    some = lambda: " ".join(word() for _ in range(r.randrange(1, 12)))
    seeds = {
        "phone": lambda: f"+1 (555) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}", "ip": lambda: f"10.{r.randrange(256)}.{r.randrange(256)}.7", "email": lambda: f"{word()}.{word()}@mail.example.org",
        "secret": key,
    }
    unseen = {"phone": lambda: f"555-{r.randrange(1000, 9999)}", "ip": lambda: f"10.{r.randrange(256)}.0.{r.randrange(256, 999)}", "email": lambda: f"{word()}.{word()}@intranet", "secret": lambda: f"{word()}{r.randrange(10**6, 10**7)}"}
    ways = {"phone": ("my phone is {},", "call {} or else"), "ip": ("the server at ({}) was", "ping {} ok"), "email": ("write to <{}> soon", "mail: {}; thanks"), "secret": ('token = "{}"', "API key {}!!")}
    rows, planted = [], set()
    for i in range(1000):
        parts, hidden = [some()], []
        for _ in range(r.randrange(3)):
            kind = r.choice(list(seeds))
            new = r.random() < 0.1
            value = (unseen if new else seeds)[kind]()
            parts += [r.choice(ways[kind]).format(value), some()]
            if new or kind == "secret":
                hidden.append((kind, value))
        if r.random() < 0.3:  # numbers that mean nothing, and keys in no context
            parts += [f"{r.randrange(10**6, 10**9)}", some(), key() if r.random() < 0.2 else "", some()]
        text = " ".join(parts).upper() if i % 50 == 3 else "\n".join(parts) if i % 50 == 4 else " ".join(parts)
        rows.append((i, text))
        for kind, value in hidden:
            at = text.lower().find(value.lower())
            planted.add((i, kind, at, at + len(value)))
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(5)
    got = pii.find(docs).collect()
    assert len(got) == 1020
    base = {i: set(brute_base(t)[2]) for i, t in rows}
    mine = {(x.doc_id, k, int(s), int(e)) for x in got for k, s, e in (y.split(":") for y in x.spans.split(",") if y and y not in base[x.doc_id])}
    want = brute_added(rows)
    assert mine == want, (len(mine), len(want), sorted(mine - want)[:5], sorted(want - mine)[:5])
    assert len(mine & planted) >= 0.9 * len(planted) and len(mine & planted) >= 0.9 * len(mine) and len(planted) > 200
    assert sum(x.n_added for x in got if x.doc_id >= 20) == sum(1 for x in mine if x[0] >= 20)


def test_secrets_of_the_given_documents(spark):
    want = [(x.doc_id, m.span(1)) for x in spark.read.parquet(f"{SF}/documents.parquet").collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', x.text or "")]
    got = [(x.doc_id, (int(s), int(e))) for x in pii.op6_contextual_pii(spark, SF).collect() for k, s, e in (y.split(":") for y in x.spans.split(",") if y) if k == "secret"]
    assert sorted(got) == sorted(want) and len(want) >= 5


def test_contexts_do_not_depend_on_corpus_size(spark):
    rows = [(i, f"Please note: my phone is +1 (555) 010-{1000 + i} and that is all") for i in range(5)] + [(9, "Well, my phone is 555-0110 today.")]
    crowd = [(1000 + i, " ".join(f"x{i}y{k}@mail.example" for k in range(1000))) for i in range(8)]
    # Common words before seeds, counted out by their places in a part of the corpus.
    crowd += [(2000 + i, f"it is of the +1 (555) 020-{1000 + i} or of the 77-{i}-1234" + " and of the rest" * 30) for i in range(200)]
    docs = spark.createDataFrame(rows + crowd, "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.find(docs).collect()}
    assert got[9] == ("phone:18:26", 1) and not any(n for i, (_, n) in got.items() if i != 9)


def test_repeated_rows_do_not_change_contexts(spark):
    rows = [(i, f"Please note: my phone is +1 (555) 010-{1000 + i} and that is all") for i in range(10)] + [(100, "Well, my phone is 555-0110 today.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r.doc_id: r for r in pii.find(docs).collect()}
    twice = pii.find(docs.unionAll(docs)).collect()
    assert once[100].spans == "phone:18:26" and len(twice) == 22
    assert all(r == once[r.doc_id] for r in twice)
