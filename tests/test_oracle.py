"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from relspark import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; the driver compares all of them.
NAMES = (
    "txt02_normalize_answer txt19_extract_answer txt34_qual01_degenerate num01_numeric_value cls07_difficulty con04_containment_max con03_containment_union agg05_reliability_summary agg07_accuracy_gap "
    "agg09_boot02_stratified_gap agg10_atlas mem01_boot03_did win04_stat02_stat03_mann_whitney agg31_agg32_agg33_judge_reliability join07_idx01_knn agg13_agg14_att02_profiles win10_matched_split src14_win09_interleave var12_premise_removal"
).split()


def same(a, b) -> bool:
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) == (b is None or b != b)
    return abs(a - b) < 1e-6 if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    got, want = df.toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    rows = lambda x: sorted((tuple(r) for r in x[cols].itertuples(index=False)), key=lambda r: tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_has_a_callable_and_names_are_unique():
    q, s = catalog.queries(), catalog.oracle_sql()
    assert len(q) > 150 and set(s) <= set(q) and all(map(callable, q.values()))


def test_corpus_reader_on_odd_documents(spark, tmp_path):
    """Empty, null and very long texts, ids below zero and none: rows as SQL has them, no error."""
    rows = [(i, t, "web") for i, t in enumerate(["", "", "", None, None, None, "  ", "a"])] + [(-i, f"n{i}", "web") for i in range(1, 4)] + [(None, "no id", "web"), (None, None, "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.unionAll(spark.range(8, 11).selectExpr("id", "repeat('long ', 4200000)", "'web'"))  # over 20 million characters
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "src01_src04_corpus_reader"
    want = con.execute(f"SELECT id, md5(text), source FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).selectExpr("id", "md5(cast(text as binary))", "source").collect()]
    assert len(want) == 16 and sorted(got, key=str) == sorted(want, key=str)


def test_route_attribution_at_any_number_of_grams(spark, tmp_path, monkeypatch):
    """Items and documents under 13 words, and documents without an id: the same rows on both sides of the bound on broadcast grams."""
    from relspark.operators import containment as C

    def words(a, n):
        return " ".join(f"{a}{i}" for i in range(n))

    items = [(0, "two words"), (1, words("a", 12)), (2, words("b", 13)), (3, words("c", 40)), (4, ""), (5, None), (6, "one"), (7, "Two, WORDS!"), (8, "...")]
    docs = [(0, "Two words.", "x"), (1, words("a", 12), "x"), (2, words("b", 13), "y"), (3, f"pre {words('c', 36)} post", "y"), (4, "", "z"), (5, None, "z"), (6, "One", "z"), (7, words("a", 13), "z")]
    docs += [(None, "one", "n"), (None, words("c", 40), "n")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "agg17_route_attribution"
    want = sorted(con.execute(f"SELECT source, item_set, n_items, n_rows FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert want == [("x", "set0", 1, 2), ("x", "set1", 2, 2), ("y", "set0", 1, 2), ("y", "set2", 1, 2), ("z", "set0", 1, 4)]
    held = []
    for most in (C.BROADCAST, 2):
        monkeypatch.setattr(C, "BROADCAST", most)
        assert sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select("source", "item_set", "n_items", "n_rows").collect()) == want
        held.append(sorted(tuple(r) for r in catalog.queries()["con04_containment_max"](spark, str(tmp_path)).select("item", "n_grams", "n_matched").collect()))
    assert held[0] == held[1] and ("3", 28, 28) in held[1]
