import json

import pytest

from relspark import cli, workflow


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


@pytest.fixture
def config(tmp_path):
    text = "Alice has 12 pencils and gives 3 of them to Bob before she counts all of the rest twice over"
    items = [{"id": "a", "prompt": text, "answer": "9"}, {"id": "a_v", "prompt": text.replace("Alice", "Carol"), "answer": "9", "parent_id": "a", "variant_type": "entity_substitution"}, {"id": "b", "prompt": "short one", "answer": "4"}]
    docs = [{"id": "d1", "text": "x " + text + " y"}, {"id": "d2", "text": "nothing"}]
    gens = [{"benchmark_id": "a", "completion": "so #### 9"}, {"benchmark_id": "a_v", "completion": "The answer is 8."}, {"benchmark_id": "b", "completion": "#### 4"}]
    c = {"io": {"benchmark": write(tmp_path / "b.jsonl", items), "corpus": write(tmp_path / "c.jsonl", docs), "generations": write(tmp_path / "g.jsonl", gens)}, "output": str(tmp_path / "out")}
    (tmp_path / "c.yaml").write_text(json.dumps(c))
    return tmp_path / "c.yaml"


def test_a_study_runs_and_resumes(spark, config):
    c = workflow.Config.load(config)
    out = workflow.run(spark, c)
    assert {r["item"]: r["verdict"] for r in out["containment"].collect()}["a"] == "seen"
    assert {r["benchmark_id"]: r["correct"] for r in out["scores"].collect()} == {"a": True, "a_v": False, "b": True}
    gap = out["gap"].first()
    assert gap["n_contaminated"] == 2 and gap["n_clean"] == 1 and gap["gap"] == -0.5
    assert "Study" in "\n".join(r["value"] for r in spark.read.text(c.output + "/report").collect())
    assert workflow.run(spark, c)["atlas"].count() == out["atlas"].count()


def test_bad_settings_and_unknown_generations_raise(spark, config, tmp_path):
    (tmp_path / "x.yaml").write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        workflow.Config.load(tmp_path / "x.yaml")
    write(tmp_path / "g.jsonl", [{"benchmark_id": "zz", "completion": "1"}])
    with pytest.raises(Exception, match="without an item"):
        workflow.run(spark, workflow.Config.load(config))["scores"].collect()


def test_commands(capsys):
    assert cli.main(["list-queries"]) == 0 and "con04_containment_max" in capsys.readouterr().out


def test_a_changed_setting_makes_stages_again(spark, config):
    from dataclasses import replace

    c = workflow.Config.load(config)
    workflow.run(spark, c)
    again = workflow.run(spark, replace(c, ngram=3))
    assert {r["item"]: r["n_grams"] for r in again["containment"].collect()}["a"] > 10
    with pytest.raises(ValueError, match="not read"):
        workflow.run(spark, replace(c, min_accuracy=0.9))


def test_commands_write_their_tables(spark, config, tmp_path, capsys):
    c = workflow.Config.load(config)
    at = lambda n: str(tmp_path / n)
    assert cli.main(["scan-contamination", c.benchmark, c.corpus, at("scan"), "--ngram", "5"]) == 0
    assert cli.main(["scan-lexical", c.benchmark, c.corpus, at("lex")]) == 0 and spark.read.parquet(at("lex")).where("label = 'exact'").count() >= 1
    assert cli.main(["scan-embedding", c.benchmark, c.corpus, at("emb"), "--dims", "64"]) == 0 and spark.read.parquet(at("emb")).where("item = 'a' and doc = 'd1'").count() == 1
    assert cli.main(["make-variants", c.benchmark, at("var")]) == 0 and cli.main(["validate-variants", at("var"), at("val")]) == 0
    assert cli.main(["export-templates", at("var"), at("sheet")]) == 0
    sheet = spark.read.option("header", True).csv(at("sheet"))
    assert {"parent_id", "verdict"} <= set(sheet.columns) and sheet.count() >= 1
    sheet.withColumn("verdict", __import__("pyspark.sql.functions").sql.functions.lit("bad")).write.option("header", True).csv(at("done"))
    assert cli.main(["apply-template-review", at("var"), at("done"), at("kept")]) == 0
    bad = {r["parent_id"] for r in sheet.collect()}
    assert not bad & {r["parent_id"] for r in spark.read.parquet(at("kept")).collect()}
    assert cli.main(["score-generations", c.benchmark, c.generations, at("scores")]) == 0
    assert cli.main(["attribute", at("scan"), at("scores"), at("attr")]) == 0 and spark.read.parquet(at("attr")).count() >= 3
    assert cli.main(["check-termination", c.generations, at("term")]) == 1
    assert cli.main(["emergence", at("scores"), "unknown", "other", at("em")]) == 0
    assert cli.main(["memorization", at("scores"), at("memo"), "--n-bootstrap", "50"]) == 0


def test_strict_records_and_shards(spark, tmp_path):
    from relspark.sources import records

    lines = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    need = {"a": "string", "n": "long"}
    assert [tuple(r) for r in records.strict(lines({"a": "x", "n": 1}, {"n": 2, "a": "y", "z": 0.5}), need, {"z": "double"}).collect()] == [("x", 1, None), ("y", 2, 0.5)]
    for row, what in (({"a": "x", "n": 1, "q": 1}, "unknown fields"), ({"a": "x"}, "missing fields")):
        with pytest.raises(Exception, match=what):
            records.strict(lines(row), need).collect()
    (tmp_path / "s").mkdir()
    write(tmp_path / "s" / "1.jsonl", [{"k": 1, "t": "x"}])
    write(tmp_path / "s" / "2.jsonl", [{"k": "2", "other": [1]}])
    assert sorted((r["k"], r["t"]) for r in records.read_shards(spark, str(tmp_path / "s"), "k string, t string").collect()) == [("1", "x"), ("2", None)]


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    from datetime import datetime

    from relspark.streaming import corpus

    rows = [(1, "a", 1.0, datetime(2024, 1, 1, 0, 10)), (1, "a", 1.0, datetime(2024, 1, 1, 0, 10)), (2, "a", 2.0, datetime(2024, 1, 1, 0, 50)), (3, "b", 5.0, datetime(2024, 1, 2))]
    for i, part in enumerate((rows[:2], rows[2:], [(6, "b", 1.0, datetime(2024, 1, 3))], [(4, "a", 9.0, datetime(2024, 1, 1, 0, 20))], [(5, "b", 0.0, datetime(2024, 1, 4))])):
        spark.createDataFrame(part, "event_id long, event_type string, value double, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    schema = "event_id long, event_type string, value double, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = corpus.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/cw").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.table("w").collect()}
    assert got[("2024-01-01 00:00:00", "a")] == 3  # the row of 00:20 came after its window had closed
    d = corpus.first_by_id(stream).writeStream.format("memory").queryName("d").option("checkpointLocation", f"{tmp_path}/cd").trigger(availableNow=True).start()
    d.awaitTermination()
    ids = [r["event_id"] for r in spark.table("d").collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 3} <= set(ids)


def test_repair_appends_each_finished_key_once(spark, tmp_path):
    """The stream stops after each round and starts again; files of the table are only ever added."""
    from relspark.streaming import corpus

    schema = "id string, finished boolean, round int"
    rounds = [[("a", True, 0), ("b", False, 0), ("c", None, 0)], [("b", True, 1), ("a", True, 1), ("c", False, 1)], [("c", True, 2), ("b", True, 2)], [("a", True, 3)]]
    want = [[("a", 0)], [("a", 0), ("b", 1)], [("a", 0), ("b", 1), ("c", 2)], [("a", 0), ("b", 1), ("c", 2)]]
    files: set[str] = set()
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        corpus.repair_stream(stream, f"{tmp_path}/t", "id", f"{tmp_path}/cr").awaitTermination()
        corpus.open_keys(stream, f"{tmp_path}/open", "id", f"{tmp_path}/co").awaitTermination()
        table = spark.read.schema(schema).parquet(f"{tmp_path}/t")
        assert sorted((r["id"], r["round"]) for r in table.collect()) == want[i]
        assert {r["id"] for r in corpus.still_open(spark, f"{tmp_path}/open", "id").collect()} == {"a", "b", "c"} - {k for k, _ in want[i]}
        now = {p.name for p in (tmp_path / "t").glob("*.parquet")}
        assert files <= now
        files = now


def test_containment_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    from relspark.operators import containment as C
    from relspark.streaming import corpus

    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("i", " ".join(words)), ("j", " ".join(words[5:25])), ("k", "none of it here at all " * 4), ("s", "w1 w2")], "id string, prompt string")
    texts = [" ".join(words[a : a + 16]) for a in (0, 3, 20, 24)] + [" ".join(words[:30]), "noise", " ".join(words[10:40]), None]
    for plain in (False, True):
        at = tmp_path / str(plain)
        for i, part in enumerate((texts[:3], texts[3:5], texts[5:])):
            spark.createDataFrame([(f"{i}-{j}", t) for j, t in enumerate(part)], "id string, text string").write.mode("append").parquet(f"{at}/in")
            stream = corpus.document_stream(spark, f"{at}/in", "id string, text string", 1)  # a file a batch, and a restart after each part
            corpus.containment_stream(stream, items, f"{at}/out", f"{at}/c", plain=plain).awaitTermination()
            own, docs = C.grams(items, "prompt", 13, plain, not plain), spark.read.parquet(f"{at}/in")
            most = {r["item"]: r["n"] for r in C.matches(own, docs, 13, plain).groupBy("item").agg({"n_shared": "max"}).withColumnRenamed("max(n_shared)", "n").collect()}
            union = {r["item"]: r["n"] for r in C.hits(own, docs, 13, plain).select("item", "place").distinct().groupBy("item").count().withColumnRenamed("count", "n").collect()}
            got = {r["item"]: (r["n_max"], r["n_union"]) for r in corpus.progress(spark, f"{at}/out").collect()}
            assert got == {k: (most[k], union[k]) for k in most}
        assert got["i"][0] < got["i"][1]


def test_reports_registries_and_progress(spark):
    from pyspark.sql import Observation

    from relspark import report
    from relspark.operators import variants
    from relspark.sources import records
    from relspark.streaming import corpus

    rows = spark.createDataFrame([("a", 0.1, 0.7, 0.6, "emergent"), ("b", 0.9, 0.9, 0.0, "scale_independent")], "skill string, small double, large double, delta double, transition string")
    assert "| emergent | 1 |" in report.emergence_report(rows)
    got = json.loads(report.json_report({"x": rows}, 1))
    assert got["x"]["cut"] and got["x"]["rows"][0]["skill"] in ("a", "b")
    assert len(records.BENCHMARKS) == 11 and all(c.policy == "full" or c.limit for c in records.CORPORA.values()) and len(records.CORPORA) == 5
    seen = Observation("progress")
    df = corpus.observed(spark.createDataFrame([("x" * 50,), ("y",)], "text string"), seen)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "chars": 51, "short": 1}
    items = spark.createDataFrame([("i", "Alice has 12 pencils. Bob takes 3 of them. How many pencils are there?", "9")], "id string, prompt string, answer string")
    assert variants.suite(items, 2).count() == 3 and variants.suite(items, include_original=False).where("variant_type = 'original'").count() == 0
