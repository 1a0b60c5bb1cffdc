"""The pipeline held against plain versions of its stages on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from relspark.llm import classifier


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(7), tmp_path_factory.mktemp("sf")
    clean = lambda: " ".join(r.choice(["the", "sea", "over", "hills", "quiet", "morning", "light", "house"]) + r.choice("abcdefgh") for _ in range(60))
    rows = []
    for i in range(120):
        t = clean() if i % 6 else " ".join(r.choice(["$$$", "BUY!!", "n0w%%"]) + r.choice("abc") for _ in range(40))
        rows.append([i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)])
    rows[11][1] = rows[10][1]
    rows[20][1] += ' token = "abcdefghijkl"'
    for x in rows:
        x[4] = len(x[1])
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), {x[0]: x[1] for x in rows}


def test_each_stage_takes_effect(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    one = P.quality(spark, docs, sf)
    scored = {r["doc_id"] for r in classifier.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == scored == {i for i in texts if i % 6}
    two = P.near_duplicates(spark, one, sf)
    kept = {r["doc_id"] for r in two.collect()}
    assert two.columns == names and kept == scored - {11}
    three = P.secret_scans(spark, two, sf)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in three.collect()}
    assert three.columns == names and set(got) == kept
    for i, (t, n) in got.items():
        want = texts[i].replace('token = "abcdefghijkl', "[secret]")
        assert t == want and n == len(want)
    four = P.mixture(spark, three, sf)
    assert four.columns == names and sorted(r["doc_id"] for r in four.collect()) == sorted(kept)
    assert len({r["source"] for r in four.limit(200).collect()[:64]}) > 2
    five = P.packed(spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == kept


def test_run_is_the_stages_in_turn(spark, folder):
    sf, texts = folder
    rows = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {i for i in texts if i % 6} - {11}
    for s in {r["sequence_id"] for r in rows}:
        assert sum(r["length"] for r in rows if r["sequence_id"] == s) <= 2048


def test_run_against_a_plain_version(spark, folder, monkeypatch):
    """Every piece's ids from the plain text with its secret replaced; the order of sequences from the schedule of the stage before."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from relspark.llm.queries import tokenizer_path

    sf, texts = folder
    t = Tokenizer.from_file(tokenizer_path())
    rows = P.run(spark, sf).collect()
    want = {}
    for i in {i for i in texts if i % 6} - {11}:
        ids = [*t.encode(texts[i].replace('token = "abcdefghijkl', "[secret]"), add_special_tokens=False).ids, 1]
        want |= {(i, at): (len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == want
    assert sorted({r["sequence_id"] for r in rows}) == list(range(len({r["sequence_id"] for r in rows})))

    def firsts(weights):
        monkeypatch.setattr(P, "STAGES", [*P.STAGES[:3], ("mixing", lambda s, d, f: P.mixing.mixed(d, weights, 1)), ("packing", lambda s, d, f: P.packing.pack(d, tokenizer_path(), place=P.row_order(d), window=16))])
        out = {}
        for r in P.run(spark, sf).collect():
            out.setdefault(r["sequence_id"], set()).add(r["doc_id"])
        return out

    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    a, b = firsts({"hot": 50.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0}), firsts({"hot": 0.02, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0})
    hot = lambda x: sum(sources[i] == "hot" for i in x[0]) / len(x[0])
    assert a != b and hot(a) > hot(b)


def test_tables_without_n_chars_and_empty_ones(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bare = docs.drop("n_chars").limit(20)
    for df in (bare, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            df = P.staged(stage(spark, df, sf), "test")
        assert P.STAGES[-1][1](spark, df, sf).count() >= 0


def test_registration():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and [n for n, _ in P.STAGES] and sum(k.startswith("op") for k in q) == 13
