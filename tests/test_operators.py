import pytest
from pyspark.sql import functions as F

from relspark.operators import containment as C
from relspark.operators import quantised, regression, reliability, splits, variants, vectors
from relspark.sources import records
from relspark.streaming import corpus


def words(a, n):
    return " ".join(f"{a}{i}" for i in range(n))


def test_union_and_maximum_differ(spark):
    text = words("w", 26)
    items = spark.createDataFrame([("i", text), ("j", words("q", 20)), ("k", "two words")], "id string, prompt string")
    parts = text.split()
    docs = spark.createDataFrame([("a", " ".join(parts[:14])), ("b", " ".join(parts[12:])), ("c", None)], "id string, text string")
    top = {r["item"]: r for r in C.containment_max(items, docs).collect()}
    all_ = {r["item"]: r for r in C.containment_union(items, docs).collect()}
    assert 0 < top["i"]["containment"] < all_["i"]["containment"] < 1
    assert top["j"]["verdict"] == all_["j"]["verdict"] == "unseen"
    assert all_["k"]["verdict"] == "too_short" and top["k"]["n_grams"] == 1


def test_the_scan_holds_a_part_of_a_batch(spark):
    import pyarrow as pa

    rows = 5_000
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(rows)]), pa.array([words("x", 100 + i % 50) for i in range(rows)])], names=["id", "text"])
    blocks = list(C._blocks(iter([batch])))
    assert max(sum(map(len, texts)) for _, texts in blocks) < C.BLOCK + 1_000 <= (1 << 20) and [i for ids, _ in blocks for i in ids] == batch.column(0).to_pylist()
    docs = spark.createDataFrame([("a", words("w", 20))], "id string, text string")
    C.matches(spark.createDataFrame([("i", [words("w", 13)])], "id string, g array<string>"), docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_texts_are_embedded_where_they_are(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "GRAMS", 5)
    docs = spark.createDataFrame([(1, "Él dijo: «sí», and then some more"), (2, "abc"), (3, "..."), (4, None), (5, "abcd abcd abcd")], "id long, text string")
    got = vectors.embedded_texts(docs, 64)
    want = docs.where("id in (1, 2, 5)").select("id", vectors.hashed_embedding(F.col("text"), 64).alias("e"))
    a, b = ({r[0]: r[1] for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_keeps_ties_by_id_over_parts():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(9_000, 8)))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    ids = r.permutation(len(x)).astype(np.int64)
    one = vectors.Search(ids[:30], x[:30], 5, True)
    for at in range(0, len(x), 2_500):
        one.add(ids[at : at + 2_500], x[at : at + 2_500])
    got = one.found().to_pydict()
    s = np.round(x[:30] @ x.T, 9)
    want = [int(n) for i in range(30) for n in ids[[j for j in np.lexsort((ids, -s[i])) if ids[j] != ids[i]][:5]]]
    assert got["neighbor"] == want and all((v > -np.inf).all() for v in one.least)


def test_gram_kernel_against_brute_force(spark, monkeypatch):
    """The one-pass kernel, in blocks of any size, and the shuffled way beyond its bound."""
    import random

    r = random.Random(6)
    text = lambda n: "".join(r.choice(["Alpha", "beta", "it's", "x-1", "élan", "İx", "42"]) + r.choice([" ", "  ", "\n", ", ", "\u00a0 "]) for _ in range(n))
    docs = [(str(i), text(r.randint(0, 60))) for i in range(60)] + [("null", None), ("copy", None)]
    items = [(str(i), docs[i][1][: r.randint(0, 200)] + " beta beta") for i in range(0, 60, 4)] + [("short", "beta it"), ("none", ""), ("twin", docs[0][1])]
    docs += [("held", "Beta, IT"), ("twice", docs[0][1] + " " + docs[0][1])]
    x, y = spark.createDataFrame(items, "id string, prompt string"), spark.createDataFrame(docs, "id string, text string").repartition(3)
    for plain, n in ((False, 5), (True, 3)):
        own, of = C.grams(x, "prompt", n, plain), C.grams(y, "text", n, plain)
        gram = lambda df: {v["id"]: set(v["g"]) for v in df.collect()}
        a, b = gram(own), gram(of)
        want = {(i, d): len(a[i] & b[d]) for i in a for d in b if a[i] & b[d]}
        got = {(v["item"], v["doc"]): v["n_shared"] for v in C.matches(own, y, n, plain).collect()}
        assert got == want and len(want) > 20
        with monkeypatch.context() as m:
            m.setattr(C, "BROADCAST", 3)
            few = {(v["item"], v["doc"]): v["n_shared"] for v in C.matches(own, y, n, plain).collect()}
        assert few == {k: v for k, v in want.items() if k[0] != "short"}
    assert C.matches(own, y.limit(0)).count() == 0 and C.matches(own.limit(0), y).count() == 0


def test_both_lexical_scans_agree(spark, monkeypatch):
    import random

    r = random.Random(12)
    text = lambda n: " ".join(r.choice(["alpha", "Beta", "gamma,", "délta", "x", "42", "of"]) for _ in range(n))
    docs = [(f"d{i}", text(r.randint(0, 40))) for i in range(60)] + [("null", None), ("in", "xx beta alpha42 yy"), ("tiny", "x of")]
    for least in (4, 1):
        items = [(f"i{i}", docs[i][1] + " " + text(r.randint(0, 12))) for i in range(20) if len(docs[i][1].split()) >= 4] + ([("s", "alpha"), ("t", "eta"), ("e", "")] if least == 1 else [])
        x, y = spark.createDataFrame(items, "id string, prompt string"), spark.createDataFrame(docs, "id string, text string").repartition(3)
        rows = lambda: sorted((v["item"], v["doc"], round(v["score"], 9), v["label"]) for v in C.lexical_scan(x, y).collect())
        whole = rows()
        with monkeypatch.context() as m:
            m.setattr(C, "HELD", -1)
            assert rows() == whole and len(whole) > 20
    assert C.lexical_scan(x, y.limit(0)).count() == 0 and C.lexical_scan(x.limit(0), y).count() == 0


def test_planted_items_are_seen(spark):
    items = spark.createDataFrame([(f"{k}{i}", words(f"{k}{i}x", 20)) for k in "pu" for i in range(5)], "id string, prompt string")
    docs = spark.createDataFrame([(f"d{i}", "noise before " + words(f"p{i}x", 20) + " and after") for i in range(5)] + [("n", words("z", 90))], "id string, text string")
    got = {r["item"]: r["verdict"] for r in C.containment_max(items, docs).collect()}
    assert all(v == ("seen" if k[0] == "p" else "unseen") for k, v in got.items())


ROW = "benchmark_id string, parent_id string, variant_type string, model string, skill string, arm string, normalized_predicted string, correct boolean, seq long"


def test_reliability_of_a_cluster(spark):
    rows = [("a", "p", "original", "m", "s", None, "1", True, 0), ("b", "p", "rephrasing", "m", "s", None, "1", True, 1), ("c", "p", "rephrasing", "m", "s", None, "2", False, 2)]
    r = reliability.clusters(spark.createDataFrame(rows, ROW)).first()
    assert abs(r["accuracy"] - 2 / 3) < 1e-9 and abs(r["consistency"] - 2 / 3) < 1e-9 and abs(r["reliability"] - 4 / 9) < 1e-9
    assert r["label_agreement"] == 0.5 and r["decoding_consistency"] == -1.0
    rows = [("a", "p", "original", "m", "s", None, "1", True, 0), ("b", "p", "numeric_perturbation", "m", "s", None, "7", True, 1), ("c", "p", "gsm_symbolic", "m", "s", None, "9", True, 2)]
    assert reliability.clusters(spark.createDataFrame(rows, ROW)).first()["consistency"] == 1.0


def test_stratification_removes_a_confounded_gap(spark):
    rows = [(f"e{i}", "contaminated", 0, True) for i in range(5)] + [(f"f{i}", "clean", 0, True) for i in range(5)] + [(f"h{i}", "clean", 1, False) for i in range(5)]
    df = spark.createDataFrame(rows, "parent_id string, label string, stratum int, correct boolean").withColumn("scope", F.lit("all"))
    r = reliability.stratified_gap(df, ["scope"], 60).first()
    assert r["unadjusted_gap"] == 0.5 and r["pooled_gap"] == 0.0 and r["ci_low"] <= 0 <= r["ci_high"] and r["n_clusters"] == 15


def test_did_recovers_a_planted_effect(spark):
    import random

    rng, rows = random.Random(1), []
    for arm, (o, p) in (("seen", (0.8, 0.55)), ("unseen", (0.5, 0.5))):
        for i in range(200):
            for k in range(4):
                rows.append((f"{arm}{i}_{k}", f"{arm}{i}", "original" if k == 0 else "gsm_symbolic", "m", "s", arm, "1", rng.random() < (o if k == 0 else p), k))
    r = reliability.did(spark.createDataFrame(rows, ROW), ["model"], 60).first()
    assert 0.1 < r["did"] < 0.4 and r["ci_low"] > 0


def test_bins_are_of_equal_frequency(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, score double")
    sizes = [r["count"] for r in reliability.difficulty_bins(df, "score", "id", 4).groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [2, 1, 2, 1]


def test_matched_arms_are_balanced(spark):
    pool = spark.createDataFrame([(i, i % 2, "seen" if i < 24 else "unseen") for i in range(48)], "id int, bin int, arm string")
    out = splits.matched(pool, 16).join(pool.drop("arm"), "id")
    assert out.groupBy("arm").count().select("count").distinct().collect()[0][0] == 16
    assert splits.balance(out.withColumnRenamed("bin", "stratum")).first()["balanced"]


def test_quantiles_are_exact_in_groups_of_any_make(spark, monkeypatch):
    """Ties, one value, heavy tails, a group with most rows, nulls, NaN and infinities; held against sorting."""
    import math
    import random

    from relspark.operators import quantiles as Q

    monkeypatch.setattr(Q, "BINS", 60)
    monkeypatch.setattr(Q, "FEW", 20)
    monkeypatch.setattr(Q, "ROUNDS", 12)
    r = random.Random(9)
    groups = {
        "hot": [r.gauss(0, 1) for _ in range(1500)], "tie": [2.5] * 400 + [1.0], "one": [7.0], "tail": [10.0 ** r.randint(-300, 300) for _ in range(200)], "wide": [-1.7e308, 1.7e308, 0.0, 1.0, -3.0] * 5,
        "none": [None, None], "gap": [float(i) for i in range(50)] + [None], None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double, g string").repartition(3)
    shares = {"least": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "most": 1.0}
    got = {x["k"]: x for x in Q.quantiles(df, ["k"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        v = sorted(x for x in vs if x is not None)
        for name, p in shares.items():
            if not v:
                assert got[g][name] is None
                continue
            h = (len(v) - 1) * p
            a, b = v[math.floor(h)], v[math.ceil(h)]
            want = a if a == b else a + (b - a) * (h - math.floor(h))
            assert got[g][name] == want or math.isclose(got[g][name], want, rel_tol=1e-12), (g, name)
    whole = sorted(v for _, v, _ in rows if v is not None)
    assert Q.quantiles(df, [], "x", {"m": 0.0}).first()["m"] == whole[0] and Q.quantiles(df.limit(0), [], "x", {"m": 0.5}).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (float("-inf"),), (0.0,)], "x double")
    assert Q.quantiles(odd, [], "x", {"a": 0.25, "b": 0.5, "c": 0.75}).first()[:3] == (0.0, 1.0, float("inf"))


@pytest.mark.parametrize("spread", [6.0, 0.01])
def test_relabelled_arms_keep_their_size(spark, spread):
    """Every replicate against ranking all draws; bounds that are too narrow are widened."""
    import hashlib

    from relspark.functions.answers import PRIME
    from relspark.operators import resampling

    rows = [(f"c{i}", float(i % 7), 1.0) for i in range(230)]
    df = spark.createDataFrame(rows, "parent_id string, k double, n double").repartition(3)
    for size in (0, 1, 90, 230):
        got = {r["rep"]: (r["k"], r["n"]) for r in resampling.relabelled(df, size, ["k", "n"], 40, spread=spread).collect()}
        digest = {c: hashlib.md5(f"{resampling.SEED}:{c}".encode()).hexdigest() for c, _, _ in rows}
        u = lambda c, rep: (int(digest[c][:8], 16) % PRIME + int(digest[c][8:16], 16) % PRIME * rep) % PRIME
        for rep in range(40):
            arm = sorted(rows, key=lambda x: (u(x[0], rep), x[0]))[:size]
            assert got[rep] == (sum(x[1] for x in arm), size)
    with pytest.raises(ValueError):
        resampling.relabelled(df, 231, ["k"], 4)


def test_logistic_standard_error(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), i % 2) for i in range(400)], "id int, y int, x int")
    fit = regression.fit_logistic(df, "y", [], "id")
    assert fit.converged and abs(fit.beta[0] + 1.0986) < 1e-3 and abs(fit.se[0] - 1 / (400 * 0.25 * 0.75) ** 0.5) < 0.02


def test_vector_search_is_exact_and_lists_reach_recall(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.top_k(df.where("id < 5"), df, 10)
    for q in range(5):
        want = set(np.argsort(-(u @ u[q]))[:10].tolist())
        assert {r["neighbor"] for r in got.where(F.col("query") == q).collect()} == want
    near = vectors.top_k_lists(df.where("id < 20"), df, vectors.fit_lists(df, 6), 10, 4)
    exact = {(r["query"], r["neighbor"]) for r in vectors.top_k(df.where("id < 20"), df, 10).collect()}
    assert len(exact & {(r["query"], r["neighbor"]) for r in near.collect()}) >= 0.9 * len(exact)


def test_quantised_index(spark, tmp_path):
    """Uniform vectors by codes alone; clustered ones (a third of them about one plane) by a fifth of the lists, saved and loaded again."""
    import numpy as np

    rng = np.random.default_rng(5)
    clustered = rng.normal(size=(150, 32))[rng.integers(0, 150, 3000)] + 0.15 * rng.normal(size=(3000, 32))
    clustered[:1000] = clustered[0] + rng.normal(size=(1000, 2)) @ rng.normal(size=(2, 32))
    for x, lists, probes, least in ((rng.normal(size=(2000, 32)), 10, None, 0.95), (clustered, 40, 8, 0.95)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
        q, codec = df.where("id % 100 = 0"), quantised.fit(df, lists)
        quantised.save(df, codec, f"{tmp_path}/{lists}")
        index, again = quantised.load(spark, f"{tmp_path}/{lists}")
        assert index.count() == len(x) and np.allclose(codec.words, again.words) and np.allclose(codec.centroids, again.centroids)
        got = quantised.search(q, index, again, 10, probes).collect()
        exact = {(r["query"], r["neighbor"]): r["cosine"] for r in vectors.top_k(q, df, 10).collect()}
        hits = [r for r in got if (r["query"], r["neighbor"]) in exact]
        assert len(hits) >= least * len(exact) and all(abs(exact[r["query"], r["neighbor"]] - r["cosine"]) < 1e-6 for r in hits)
        assert len(got) == len(q.collect()) * 10 and max(r["rank"] for r in got) == 10
    tables, (lists_, codes) = codec.tables(x[:3]), codec.encode(x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True))
    decoded = np.stack([np.concatenate([codec.words[j, c] for j, c in enumerate(row)]) for row in codes])
    assert np.linalg.norm(x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True) - codec.centroids[lists_] - decoded, axis=1).mean() < 0.2
    assert np.allclose(codec.scores(tables, codes), x[:3] @ decoded[:, : x.shape[1]].T)
    none = df.limit(0)
    assert quantised.search(none, index, codec, 3).count() == 0 and quantised.search(q, quantised.coded(none, quantised.fit(none)), quantised.fit(none), 3).count() == 0


def test_ids_beyond_their_width_differ(spark):
    df = spark.range(100_050).withColumnRenamed("id", "k")
    ids = records.numbered(df, ["k"], "x_")
    assert ids.select("id").distinct().count() == 100_050
    assert {r["id"] for r in ids.where("k in (7, 99999, 100000)").collect()} == {"x_00007", "x_99999", "x_100000"}


def test_surface_variants_keep_numbers():
    import re

    p = "Alice has 12 pencils. Bob takes 3 of them. How many pencils are there?"
    for f in variants.SURFACE.values():
        out = f("x", p)
        assert out and out != p and sorted(re.findall(r"\d+", out)) == ["12", "3"] and f("x", p) == out
    assert variants.reorder("x", p).endswith("?")


def test_numeric_templates():
    p, r = "Janet has 16 eggs, eats 3 and bakes 4. She sells the rest at 2 dollars.", "<<16-3-4=9>> then <<9*2=18>>"
    leaves, steps = variants.template(p, r, "18")
    assert leaves == [16, 3, 4, 2] and [v for _, v in steps] == [9, 18]
    assert variants.template(p, "<<16-3-4=8>>", "8").reason == "step_does_not_reproduce_result"
    assert variants.template("2 and 2 of 5", "<<2+5=7>>", "7").reason == "value_ambiguous_in_question"
    text, answer = variants.numeric_variant("a", p, r, "18")
    n = [int(x) for x in __import__("re").findall(r"\d+", text)]
    assert (n[0] - n[1] - n[2]) * n[3] == int(answer)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "1", "question": "q"}\n\n{"id": "2", "prompt": "", "input": "r"}\n')
    rows = records.benchmark_items(records.read_lines(spark, str(tmp_path), records.ITEM)).orderBy("id").collect()
    assert [(r["id"], r["prompt"], r["variant_type"]) for r in rows] == [("1", "q", "original"), ("2", "r", "original")]
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        records.read_lines(spark, str(tmp_path), records.ITEM).collect()
    assert records.read_lines(spark, str(tmp_path), records.ITEM, strict=False).count() == 2


def test_corpus_records_without_a_text(spark):
    raw = spark.createDataFrame([("1", "", "c"), ("2", "", None), ("3", None, None)], "id string, text string, content string").selectExpr("*", "cast(null as string) doc_id", "cast(null as string) document", "cast(null as string) source")
    assert [r["text"] for r in records.corpus_documents(raw, required=False).orderBy("id").collect()] == ["c", "", None]
    assert [r["text"] for r in records.corpus_documents(raw.where("id < 3")).orderBy("id").collect()] == ["c", ""]
    with pytest.raises(Exception, match="without a text"):
        records.corpus_documents(raw).collect()


def test_stream_scan_equals_the_table_scan(spark, tmp_path):
    items = spark.createDataFrame([("i", words("w", 20))], "id string, prompt string")
    for k in range(3):
        spark.createDataFrame([(f"d{k}", words("w", 13 + k), "s")], "id string, text string, source string").write.mode("append").parquet(str(tmp_path / "in"))
    own = tmp_path / "out"
    s = corpus.document_stream(spark, str(tmp_path / "in"), files=1)
    corpus.scan_stream(s, items, str(own), str(tmp_path / "c")).awaitTermination(120)
    want = C.containment_max(items, spark.read.parquet(str(tmp_path / "in"))).first()["containment"]
    assert corpus.best(spark, str(own)).first()["containment"] == want
