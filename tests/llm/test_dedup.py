import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from relspark.llm import common, runindex, simhash

DOCS = "doc_id long, text string, TEXT2 string, h long, rid long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 9))) for _ in range(n))


def removed(texts):
    """Brute force over every window."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for t in data:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] += 1
    out = []
    for t in data:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                m[i : i + 200] = True
        out.append((len(t), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def test_matching_statistics_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        segs = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 6))]
        for s, got in zip(segs, runindex.matching_statistics(segs), strict=True):
            for p in range(len(s)):
                longest = max((n for n in range(1, len(s) - p + 1) if sum(t[q : q + n] == s[p : p + n] for t in segs for q in range(len(t) - n + 1)) > 1), default=0)
                assert got[p] == longest


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_are_removed(spark, hot, monkeypatch):
    monkeypatch.setattr(runindex, "HOT", hot)
    passage, whole = prose(1, 60), prose(2, 120)
    texts = [None, "", "short", whole, whole, prose(3, 80) + passage + prose(4, 9), passage + prose(5, 70), prose(6, 30) + passage[:199], "a" * 700, prose(7, 50) * 3, prose(8, 200)]
    texts += [prose(20 + i, 20) + " " + passage[20:190] + " " + prose(40 + i, 20) for i in range(6)]
    got = runindex.dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed(texts)


def test_copies_enter_the_index_as_run_lengths():
    r = random.Random(4)
    for _ in range(100):
        segs = list({bytes(r.choice(b"ab") for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 6))})
        copies = [r.randint(1, 3) for _ in segs]
        whole = [s for s, m in zip(segs, copies, strict=True) for _ in range(m)]
        each = dict(zip(whole, runindex.matching_statistics(whole), strict=True))
        for s, got in zip(segs, runindex.matching_statistics(segs, copies), strict=True):
            assert got.tolist() == each[s].tolist()


def test_texts_longer_than_a_block(spark, monkeypatch):
    import relspark.llm.runindex as m

    data = prose(9, 400).encode()
    ends = np.array([len(data)])
    whole = {(int(h), int(s), int(n)) for h, _, _, s, n in zip(*m.window_runs(np.frombuffer(data, np.uint8), ends), strict=True)}
    step = 1500
    parts = [(i, data[i : i + step]) for i in range(0, len(data) - 199, step - 199)]
    starts = sum(int(n) for i, d in parts for n in m.window_runs(np.frombuffer(d, np.uint8), np.array([len(d)]))[4])
    assert starts == sum(n for _, _, n in whole) == len(data) - 199


def test_an_empty_table_and_repeated_rows(spark):
    assert runindex.dedup(docs(spark, ["x"]).limit(0)).count() == 0
    t = prose(11, 80)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "unlike")], "doc_id long, text string")
    one = spark.createDataFrame([(7, prose(12, 90)), (7, prose(13, 90)), (7, prose(12, 90)[:250] + "x")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in runindex.dedup(one).orderBy("n_bytes").collect()] == sorted(removed([r["text"] for r in one.collect()]))
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in runindex.dedup(df).collect())
    n = len(t.encode())
    assert got == [(-1, n), (1, n), (1, n), (2, 0)]


def linked(fps):
    """Least id reachable over links of two bits, by comparing all."""
    par = list(range(len(fps)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", w) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("hot", [2048, 2])
def test_simhash_components(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    base = prose(30, 400).split()
    texts = [None, "", " \t", "One", "one", "one two", prose(31, 40)]
    for i in range(40):
        w = list(base)
        w[i % 7 * 50] = f"new{i}"
        texts.append(" ".join(w))
    got = simhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in got] == fps
    assert [r["component_id"] for r in got] == linked(fps)


def test_close_pairs_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 9, np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 9, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 9, np.uint64)) for _ in range(25)]))
    keys = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(keys, fps, chunk=50) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if keys[i] == keys[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert got == want and want


def test_one_of_each_keeps_columns(spark):
    t = prose(50, 60)
    out = simhash.one_of_each(docs(spark, [t, t, prose(51, 60), None, ""]))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_one_of_each_keeps_unlike_texts_of_one_id_or_none(spark):
    t = [prose(60 + i, 40) for i in range(4)]
    rows = [(7, t[0]), (7, t[1]), (None, t[2]), (None, t[3]), (None, t[3]), (9, t[0]), (3, t[1]), (3, t[1])]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, _first int, doc int, rank int")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == sorted([(7, t[0]), (3, t[1]), (-1, t[2]), (-1, t[3])])
    assert simhash.one_of_each(df.limit(0)).count() == simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "IN_MEMORY", 4)
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(20)]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    node, root = common._forest(*np.array(edges).T)
    assert {k: v for k, v in zip(node.tolist(), root.tolist(), strict=True) if k in got} == got
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_salted_ranks_are_whole(spark):
    df = spark.createDataFrame([(i % 2 if i % 5 else None, i) for i in range(200)], "g int, i long")
    for g, rows in __import__("itertools").groupby(sorted(common.salted_rank(df, ["g"], ["i"], "r", 200, 20).collect(), key=lambda r: str(r["g"])), key=lambda r: r["g"]):
        ranks = sorted(r["r"] for r in rows)
        assert ranks == list(range(len(ranks)))
