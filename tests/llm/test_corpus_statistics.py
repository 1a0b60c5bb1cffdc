import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relspark.llm import collocations, importance, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11


def mined(rows, least, top, max_n=5):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    often = {p for p, n in f.items() if len(p) > 2 and n >= least}

    def inside(p, x):
        return any(x[i : i + len(p) - 1] == p[1:] for i in range(1, len(x) - len(p) + 2))

    out = {}
    for p in often:
        lang, w, a = p[0], p[1:], f[p]
        cuts = [(1000 * a * total[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        if not any(x[0] == lang and len(x) > len(p) and f[x] >= a and inside(p, x) for x in often):
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def speech(n, seed, words="a b c d é the of in İ".split()):
    r = random.Random(seed)
    return ["".join(r.choice(words) + r.choice([" "] * 9 + ["  ", "\t", ". ", ", ", "\n", "!\x0b", "\r\n"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_collocations_against_brute_force(spark):
    texts = speech(80, 1) + [None, "", " \t ", "...", "A B", "New York city. New York city"] * 3 + ["new york city"] * 5
    rows = [(("en", "de", None)[i % 3 if i < 60 else 0], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, text string, n long, phrase string").repartition(3)
    for least, top in ((4, 1000), (2, 7), (10**6, 5)):
        got = sorted(tuple(r) for r in collocations.mine(df, least=least, top=top).collect())
        assert got == mined(rows, least, top)
    assert collocations.mine(df.limit(0), least=1).count() == 0


def test_collocations_keep_rows_without_language(spark):
    df = spark.createDataFrame([(None, "x y x y"), ("und", "x y")], "lang string, text string")
    assert [tuple(r) for r in collocations.mine(df, least=3).collect()] == mined([(None, "x y x y"), ("und", "x y")], 3, 9)


@pytest.mark.parametrize("chunk", [1, 9, 64])
def test_parts_of_a_long_text_count_like_the_whole(monkeypatch, chunk):
    texts = speech(12, 3) + ["w" * 200, "\n\n", ""]
    batch = [pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])]
    every = SimpleNamespace(value=np.full(collocations.MIN_BITS // 8, 255, np.uint8))

    def counted():
        out = Counter()
        for b in [*collocations._words(iter(batch)), *collocations._phrases(iter(batch), every, every, 5)]:
            for r in b.to_pylist():
                out[r["phrase"]] += r["n"]
        return out, sum(sum(b.column(1).to_pylist()) for b in collocations._pairs(iter(batch), every))

    whole, pairs = counted()
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "HELD", 5)
    monkeypatch.setattr(collocations, "CACHE", 3)
    assert counted() == (whole, pairs) and pairs == sum(n for p, n in whole.items() if p.count(" ") == 1)


@pytest.mark.parametrize("least", [20, 300])
def test_rare_runs_of_frequent_pairs_make_no_rows(least):
    r = random.Random(7)
    texts = [" ".join(r.choices([f"w{i}" for i in range(25)], k=40)) + ". new york city hall is" for _ in range(900)]
    parts = [[pa.RecordBatch.from_arrays([pa.array(["en"] * 100), pa.array(texts[i : i + 100])], names=["lang", "text"])] for i in range(0, 900, 100)]
    every = SimpleNamespace(value=np.full(collocations.MIN_BITS // 8, 255, np.uint8))
    slots = 1 << 18

    def counted(marked):
        out, rows = Counter(), 0
        for part in parts:
            for b in collocations._phrases(iter(part), every, every, 5, marked):
                rows += b.num_rows
                out.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
        return {p: n for p, n in out.items() if n >= least}, rows

    tallies = [b for part in parts for b in collocations._slotted(iter(part), every, every, 5, slots, least)]
    marked = np.zeros(slots // 8, np.uint8)
    for b in collocations._full(iter(tallies), least):
        for row in b.to_pylist():
            marked[row["i"] * collocations.BITMAP // 8 : (row["i"] + 1) * collocations.BITMAP // 8] = np.frombuffer(row["b"], np.uint8)
    often, few = counted(SimpleNamespace(value=marked))
    assert (often, True) == (counted(None)[0], "new york city hall is" in often) and few * 5 < counted(None)[1]


def test_bitmap_marks_spark_hashes(spark):
    words = [f"w{i}é" for i in range(500)]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, phrase string")
    bits = collocations.bitmap(df.select(F.xxhash64("lang", "phrase").alias("h")), "h", 500)
    at = collocations._Hashes(b"en")
    mine = np.array([at[w.encode()] for w in words], np.uint64)
    others = np.array([at[f"v{i}".encode()] for i in range(20_000)], np.uint64)
    assert collocations._in(bits, mine).all() and collocations._in(bits, others).mean() < 0.01


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right, n = 10**11 + 7, 3 * 10**12 + 1, 7 * 10**11 + 3, 10**14 + 9
    df = spark.createDataFrame([(a, left, right, n)], "a long, l long, r long, n long")
    got = df.select((collocations._decimal("a") * collocations._decimal("n") * 1000).alias("x"), (collocations._decimal("l") * collocations._decimal("r")).alias("y")).selectExpr("x div y").first()[0]
    assert got == math.floor(Fraction(1000 * a * n, left * right))


# --- op13


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def resampled(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(runs(x)[0])
    for x in target:
        t.update(runs(x)[0])
    big, small = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, x in docs:
        found, n = runs(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[2], r[1]))
    drawn = percent * len(fit) // 100
    return Counter([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in out if not r[4]])


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["Sun", "moon", "sea-side", "été", "x1", "THE", "of", "ÉTÉ", "z'z"]) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_importance_against_brute_force(spark, percent):
    docs = list(enumerate([None, "", "--", "one", "a b", *texts(120, 4)])) + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20)]
    target = [*texts(9, 5), None, ""]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, weight int").repartition(3)
    aim = spark.createDataFrame([("b", t) for t in target], "item_id string, text string")
    assert Counter(tuple(r) for r in importance.resample(df, aim, percent).collect()) == resampled(docs, target, percent)


def test_importance_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    none = df.limit(0)
    assert importance.resample(none, df).count() == 0
    assert Counter(tuple(r) for r in importance.resample(df, none, 100).collect()) == resampled([(1, "a b c " * 10)], [], 100)


@pytest.mark.parametrize("part", [1, 5, 100])
def test_buckets_of_parts(monkeypatch, part):
    monkeypatch.setattr(importance, "PART", part)
    for t in [*texts(20, 6), "", "a", "a b", "  a  b  c  ", "é" * 40]:
        got, n = importance.buckets(t.encode())
        found, words = runs(t)
        assert (sorted(got.tolist()), n) == (sorted(found), words)


# --- op12


def test_grammar_scores_clauses_in_context():
    s = toxicity.Scorer(toxicity.stated(), toxicity.composed())
    weight = lambda t: sum(s.clauses(t)[0])
    assert weight("the moon and the sea") == weight("") == weight(None) == 0
    assert weight("you are an idiot") > weight("an idiot") > weight("not an idiot") > 0
    assert weight("she said it is stupid") < weight("it is stupid")
    assert weight("i will kill you") > weight("i will kill weeds")
    assert weight("you. idiot") == weight("idiot") and weight("he wrote: stupid") == weight("stupid")
    assert weight("never ever in my life idiot") == weight("idiot")  # out of the negation's reach
    assert len(s.clauses("idiot! scum, trash\nloser")[0]) == 3 and s.clauses("Idiot's IDIOT")[1] == 2


def steps(words, kinds):
    """Weight of one clause, by the parts' own states side by side."""
    parts = (toxicity.negation, toxicity.reported, toxicity.aimed, toxicity.threatened)
    states, out = [0] * 4, 0.0
    for w in words:
        kind, own = kinds.get(w, (toxicity.OTHER, 0.0))
        arcs = [p(x, kind) for p, x in zip(parts, states, strict=True)]
        scale = math.prod(a[1] for a in arcs)
        out += scale * (own + sum(a[2] for a in arcs))
        states = [a[0] for a in arcs]
    return out


def test_composition_is_its_parts_side_by_side(monkeypatch):
    kinds = {"scum": (toxicity.INSULT, 2.0), "kill": (toxicity.THREAT, 0.2), "you": (toxicity.TARGET, 0.0), "not": (toxicity.NEGATION, 0.0), "said": (toxicity.REPORT, 0.0)}
    r = random.Random(8)
    for size in (1 << 20, 1, 11):
        monkeypatch.setattr(toxicity, "PART", size)
        s = toxicity.Scorer(toxicity.stated(), toxicity.composed())
        for _ in range(60):
            clauses = [[r.choice([*kinds, "x", "y", "z"]) for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 4))]
            want = [w for w in (steps(c, kinds) for c in clauses) if w]
            got, n = s.clauses(r.choice(".;!?\n").join(" ".join(c) for c in clauses))
            assert got == pytest.approx(want) and n == sum(map(len, clauses))


def toxic_docs(n):
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    out = []
    for i in range(n):
        words = [word(r.randint(3, 6)) for _ in range(60)]
        if bad := i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(60), "zorbl" + word(2) if i % 2 else "idiot")
        out.append((i, " ".join(words), bad))
    return out


def test_stems_are_learned_and_held_out_labels_unseen(spark):
    rows = toxic_docs(900) + [(900, None, False), (901, "", False), (902, "zorblabc " * 5, False)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows[:900]], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(df, labels).collect()}
    assert len(got) == 903 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    apart = [(got[i]["predicted"], b) for i, _, b in rows[:900] if got[i]["held_out"]]
    assert sum(p == b for p, b in apart) / len(apart) > 0.97
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.classify(df, flipped).collect()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_without_labels_and_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "You are an idiot!"), (1, "You are an idiot!"), (None, "hello there"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        got = sorted(((r["doc_id"] or 0, r["predicted"], r["held_out"]) for r in toxicity.classify(df, given).collect()))
        assert [g[:2] for g in got] == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert toxicity.classify(df.limit(0), labels).count() == 0
    many = spark.range(500).selectExpr("1 as doc_id", "concat('text ', id) as text")
    assert toxicity.sampled(many, labels, "doc_id", "text", "toxic", 5).count() == (0 if zlib.crc32(b"1") % 4 == 2 else 1)


def test_near_copies_count_once(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(str(i), 1, base + f" end{i}") for i in range(30)] + [(str(100 + i), 0, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(10)]
    kept = toxicity.unlike(spark.createDataFrame(rows, "id string, y int, text string")).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in kept}[0] == 10 and {r["y"]: r["count"] for r in kept}[1] <= 3
