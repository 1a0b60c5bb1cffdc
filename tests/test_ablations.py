from pyspark.sql import functions as F

from relspark.operators import ablations

ITEMS = [
    ("a", "Mrs. Tatiana owns a grocery store. Apples cost 40 cents for pens. Bananas cost 60 cents for pens. How much are two pens?", "#### 1,200", "<<40+60=100>>"),
    ("b", "She has 3 cats. They eat 15 fish. How many fish does each cat eat?", "5", "<<15/3=5>>"),
    ("c", "How many?", "1", ""), ("d", None, None, None), ("e", "Dr. No. 7 paid 9 dollars. Then 9 dollars came back. He paid 8 more. What is left?", "8", "<<9-9=0>><<0+8=8>>"),
]


def items(spark):
    return spark.createDataFrame(ITEMS, "id string, prompt string, answer string, rationale string")


def test_ablations_keep_their_promises(spark):
    x = items(spark)
    rows = {r["id"]: r for r in ablations.ablated(x).collect()}
    a = [rows[f"a__{c}"] for c in ablations.CELLS]
    assert all(r["prompt"].endswith("How much are two pens?") and r["sentence"] in r["prompt"] and r["answer"] == "#### 1,200" for r in a)
    assert a[1]["sentence"] == ablations.FRAME.format(qty="several", topic="pens") and a[0]["number"] is None and a[3]["number"] == a[2]["number"] not in (40, 60, None)
    moved = rows["a__reorder_safe"]["prompt"]
    assert moved != ITEMS[0][1] and sorted(moved.replace("Mrs. ", "Mrs_").split(". ")) != [] and "Mrs. Tatiana owns a grocery store." in moved and moved.endswith("How much are two pens?")
    assert "b__reorder_safe" not in rows and "e__reorder_safe" not in rows and not any(k.startswith(("c__", "d__")) for k in rows)
    assert ablations.violations(x, ablations.ablated(x)).count() == 0 and ablations.ablated(x.limit(0)).count() == 0


def test_a_question_given_apart_stands_alone(spark):
    x = spark.createDataFrame([("a", "One thing is. It met a.", None, "How many?"), ("b", "Then one st.", None, "How many?"), ("c", "No end", None, "How many?"), ("d", "One. Two?", None, None), ("e", "0 apples came. 1 went at 1", None, "How many?")], "id string, prompt string, answer string, question string")
    v = ablations.ablated(x)
    got = {r["id"]: r["prompt"] for r in v.where("variant_type = 'offtopic_noqty'").collect()}
    assert got["d__offtopic_noqty"].startswith("One. A separate") and got["d__offtopic_noqty"].endswith("question. Two?")
    for row in x.where("question is not null").collect():
        p = got[f"{row['id']}__offtopic_noqty"]
        assert p.startswith(row["prompt"] + " A separate log listing several") and p.endswith(" this question. How many?")
    assert ablations.violations(x, v).count() == 0
    assert "prompt altered" in {r["problem"] for r in ablations.violations(x, v.withColumn("prompt", F.replace("prompt", F.lit("One"), F.lit("Two")))).collect()}


def test_broken_promises_are_found(spark):
    x = items(spark)
    v = ablations.ablated(x).where("parent_id = 'a'")
    cell = F.col("variant_type")
    cases = {
        "answer changed": v.withColumn("answer", F.lit("7")), "no parent": v.withColumn("parent_id", F.lit("zz")),
        "sentence missing": v.withColumn("prompt", F.replace("prompt", F.lit("no bearing"), F.lit("a bearing"))), "prompt altered": v.withColumn("prompt", F.replace("prompt", F.lit("Apples"), F.lit("Pears"))),
        "number stands in the item": v.withColumn("number", F.when(cell.endswith("_qty"), 60)), "number in a cell without": v.withColumn("number", F.lit(None).cast("int")),
        "sentences changed": v.withColumn("prompt", F.replace("prompt", F.lit("Apples"), F.lit("Pears"))), "order unchanged": v.withColumn("prompt", F.lit(ITEMS[0][1])),
    }
    for problem, broken in cases.items():
        assert problem in {r["problem"] for r in ablations.violations(x, broken).collect()}, problem


def test_deletions_guard_abbreviations(spark):
    x = items(spark)
    got = {r["id"]: (r["removed"], r["prompt"]) for r in ablations.deletions(x).collect()}
    assert got["a__del0"] == ("Apples cost 40 cents for pens.", "Mrs. Tatiana owns a grocery store. Bananas cost 60 cents for pens. How much are two pens?")
    assert got["a__del1"][0] == "Bananas cost 60 cents for pens." and {k for k in got if k[0] == "b"} == {"b__del0", "b__del1"}
    assert {k: v[0] for k, v in got.items() if k[0] == "e"} == {"e__del0": "He paid 8 more."}  # 9 stands twice
    assert ablations.deletion_manifest(x).first().asDict() == {"scanned": 5, "too_short": 2, "no_removable": 0, "kept": 3, "n_variants": 5, "yield": 0.6}
    assert ablations.deletion_manifest(x.limit(0)).first()["scanned"] == 0
