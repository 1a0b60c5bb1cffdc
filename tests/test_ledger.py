import pytest
from pyspark.sql import functions as F

from relspark import ledger

SCHEMA = "id string, v int"


def rows(df):
    return sorted(((r["id"] or "", r["v"]) for r in df.collect()))


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).repartition(2)


def test_a_run_killed_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    ledger.append_once(frame(spark, ("a", 1), ("b", 1), ("b", 1)), path, "id")
    with monkeypatch.context() as m:
        m.setattr(ledger, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ledger.append_once(frame(spark, ("c", 2), ("d", 2)), path, "id")
    assert rows(ledger.read(spark, path, frame(spark, ("a", 1)).schema)) == [("a", 1), ("b", 1)]
    got = ledger.append_once(frame(spark, ("b", 3), ("c", 3), ("c", 3), ("d", 3), (None, 3), (None, 4)), path, "id")
    assert [r[0] for r in rows(got)] == ["", "a", "b", "c", "d"] and dict(rows(got))["b"] == 1 and dict(rows(got))["c"] == 3
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 3 and ledger.manifest(spark, path)[0] == 2
    assert rows(ledger.append_once(frame(spark, (None, 9)), path, "id")) == rows(got)


def test_of_two_runs_at_once_one_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.append_once(frame(spark, ("a", 1)), path, "id")
    number, parts = ledger.manifest(spark, path)
    ledger.append_once(frame(spark, ("b", 2)), path, "id")
    with pytest.raises(ledger.Conflict):
        ledger._commit(spark, path, number + 1, parts)
    assert rows(ledger.read(spark, path, frame(spark, ("a", 1)).schema)) == [("a", 1), ("b", 2)]


def test_a_suite_is_resumed_and_merged(spark, tmp_path, monkeypatch):
    path, ran = str(tmp_path / "suite"), []

    def part(name, *pairs, fail=False):
        def make():
            ran.append(name)
            df = frame(spark, *pairs)
            return df.withColumn("v", F.raise_error(F.lit("stopped")).cast("int")) if fail else df

        return make

    first = {"originals": part("originals", ("a", 1), ("b", 1)), "variants": part("variants", ("c", 2), fail=True), "numeric": part("numeric", ("d", 3))}
    with pytest.raises(Exception, match="stopped"):
        ledger.suite(spark, path, first, "id")
    assert ledger.status(spark, path, list(first)) == {"originals": True, "variants": False, "numeric": False}
    again = first | {"variants": part("variants", ("b", 2), ("c", 2), ("c", 2))}
    assert rows(ledger.suite(spark, path, again, "id")) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert ran == ["originals", "variants", "variants", "numeric"]
    assert rows(ledger.suite(spark, path, again, "id")) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)] and len(ran) == 4
