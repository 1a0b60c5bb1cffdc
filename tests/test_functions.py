import duckdb
from pyspark.sql import functions as F

from relspark.functions import answers as A
from relspark.functions import rules as R
from relspark.functions import symbolic
from relspark.functions import text as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_answers_are_extracted(spark):
    cases = [
        (T.normalize_answer, "Reasoning here. #### 16", "16"), (T.normalize_answer, "The answer is: Yes.", "yes"), (T.extract_numeric, "so\n#### 16", "16"), (T.extract_numeric, "The answer is $1,234.", "1234"),
        (T.extract_numeric, "3 apples and 5 oranges", "5"), (T.extract_boxed, r"thus \boxed{42}", "42"), (T.extract_choice, "x\n#### C", "C"), (T.extract_choice, "The answer is B because", "B"), (T.extract_yes_no, "No, that is wrong", "no"),
    ]
    for f, text, want in cases:
        assert value(spark, f(F.lit(text))) == want, text


def test_words_end_where_sql_ends_them(spark):
    cases = [
        (T.final_answer, "Noñ 3/4", "No"), (T.final_answer, "Yesé, 687865", "Yes"), (T.normalize_answer, "Noñ 3/4", "no"), (T.normalize_answer, "#### «the cat», a dog", "«the cat» dog"), (T.extract_yes_no, "ñno yes", "no"), (T.extract_yes_no, "casino", "casino"),
        (T.extract_choice, "#### éB", "B"), (T.extract_choice, "#### dß or ſc", "D"), (T.after_hash, "#### 5\u2028x", "5\u2028x"), (lambda x: T.abstains(x).cast("string"), "ñcannot be solved", "true"), (lambda x: T.order_safe(x).cast("string"), "ñshe", "false"),
    ]
    con = duckdb.connect()
    for f, text, want in cases:
        assert value(spark, f(F.lit(text))) == want, text
        for pattern in (T.PHRASE, T.ANSWER_IS, T.ABSTAIN, T.PRONOUN, r"(?i)\b(yes|no|true|false)\b", r"(?m)####\s*(.+?)\s*$", r"a\sb"):
            assert value(spark, F.lit(text).rlike(T.as_sql(pattern))) == con.execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchone()[0], (text, pattern)


def test_whole_sentences_are_made_once_a_text(spark):
    df = spark.range(1).select(T.whole_sentences(F.lit("Dr. No met J. R. at 5. He left! Why? No. 7")).alias("v"))
    assert df.first()["v"] == ["Dr. No met J. R. at 5. He left!", "Why?", "No. 7"]
    assert df._jdf.queryExecution().analyzed().toString().count("split(trim(") == 1
    long = spark.range(1).select(F.size(T.whole_sentences(F.repeat(F.lit("So it is. "), 20_000))).alias("n"))
    assert long.first()["n"] == 20_000


def test_nouns_are_counted_where_they_are(spark):
    from relspark.plans.text_functions import nouns

    texts = [("a", "Pens cost more than these pens; paper cost"), ("b", "that this with"), ("c", None), ("d", "zebra apple zebra apple"), ("e", "apple Books zebra")]
    df = spark.createDataFrame(texts, "benchmark_id string, completion string")
    want = {"a": "pens", "d": "zebra", "e": "books"}
    got = nouns(df)
    assert dict(got.collect()) == want and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    again = df.unionAll(spark.createDataFrame([("d", "apple pear"), ("d", None)], df.schema))
    assert dict(nouns(again).collect()) == want | {"d": "apple"}


def test_text_normalisation_keeps_letters_of_any_alphabet(spark):
    assert value(spark, T.normalize_text(F.lit("  Él, (no)  dijo: «sí»!"))) == "él no dijo «sí»"
    assert value(spark, T.plain_tokens(F.lit("Él dijo 4x"))) == ["l", "dijo", "4x"]
    assert value(spark, T.normalize_text(F.lit(None).cast("string"))) == ""


def test_formulas_are_equal_by_value(spark):
    equal = [
        ("x^2-1", "(x-1)(x+1)"), (r"\frac{1}{2}", "0.5"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac12", "1/2"), (r"\sin^2 x+1", r"1+(\sin x)^2"), (r"\sqrt{x^2y}", r"\sqrt{x^2}\sqrt{y}"),
        (r"2\pi r", r"\pi\cdot 2 r"), (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt 3}"), ("(a+b)^3", "a^3+3a^2b+3ab^2+b^3"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"\sqrt{2738}", r"37\sqrt{2}"), ("1/2x", "x/2"),
        (r"\sqrt[3]{x}", "x^{1/3}"), (r"\sqrt{x+1}^2", "x+1"), ("-2^2", "-4"), (r"\left(x_1+x_2\right)", "x_2+x_1"),
    ]
    unequal = [("x", "y"), ("x^2", "x"), (r"\sqrt{2}", "1.4142135"), ("", ""), ("x+", "x+"), (None, "x"), (r"\sin x", r"\cos x"), ("-2^2", "4"), ("x^y", "y^x"), (r"\frac{1}{0}", "1/0"), ("(3,5)", "(3,5)"), ("(" * 99, "x"), ("9" * 500, "9" * 500)]
    rows = spark.createDataFrame([(*p, True) for p in equal] + [(*p, False) for p in unequal], "a string, b string, want boolean")
    got = rows.withColumn("got", symbolic.equal_formulas("a", "b")).withColumn("back", symbolic.equal_formulas("b", "a")).collect()
    assert [r for r in got if r["got"] != r["want"] or r["back"] != r["want"]] == []
    kinds = rows.select("a", "b", A.equivalent_formulas(F.col("a"), F.col("b"), F.lit("math")).alias("m"), A.equivalent_formulas(F.col("a"), F.col("b"), F.lit("text")).alias("t"))
    assert kinds.where("m").count() >= len(equal) and kinds.where("t and a = 'x^2-1'").count() == 0


def test_predictions_are_held_against_boxed_golds(spark):
    cases = [(r"so \boxed{\frac{\sqrt{2}}{2}} it is", r"\frac{1}{\sqrt{2}}", True), (r"\boxed{x^2-1}", "(x-1)(x+1)", True), (r"\boxed{x^2}", "x", False), (r"\boxed{\text{5}}", "5.0", True), ("7", None, False), (None, "7", False), ("a", "A", True)]
    rows = spark.createDataFrame(cases, "g string, p string, want boolean").select("want", A.correct(F.col("p"), F.col("g")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_random_polynomials_are_told_apart():
    import random

    r = random.Random(3)
    for _ in range(60):
        a, b, c, d = (r.randint(-9, 9) or 1 for _ in range(4))
        expanded = f"{a * c}x^2+({a * d + b * c})x+({b * d})"
        assert symbolic.equal(f"({a}x+({b}))({c}x+({d}))", expanded) and not symbolic.equal(f"({a}x+({b}))({c}x+({d}))", expanded + "+x")


def test_boxes_of_any_depth(spark):
    deep = "x"
    for _ in range(30):
        deep = "{a" + deep + "}"
    cases = {
        r"\boxed{42}": "42", r"\boxed{" + deep + "} end": deep, r"a \boxed{1} b \boxed{\frac{2}{3}} c": r"\frac{2}{3}", r"\boxed{1} then \boxed{x": "1", r"\boxed{a \boxed{b} c}": r"a \boxed{b} c",
        r"\boxed{x and \boxed{b}": None, "none": None, r"} \boxed{} {": "", r"\boxed{ {1} }}": "{1}", r"\box{1} \boxed {2}": None, r"\\boxed{7\}": "7\\",
    }
    for text, want in cases.items():
        assert value(spark, T.boxed_balanced(F.lit(text))) == want, text
    assert value(spark, T.boxed_balanced(F.lit(None).cast("string"))) is None


def test_grams_of_short_texts(spark):
    assert value(spark, T.word_grams(T.tokens(F.lit("one two")))) == ["one two"]
    assert value(spark, T.word_grams(T.tokens(F.lit("one two")), short=False)) == []
    assert value(spark, T.word_grams(T.tokens(F.lit("")))) == []
    assert value(spark, T.char_grams(F.lit("abc"))) == ["abc"]
    assert value(spark, T.char_grams(F.lit("abcdef"))) == ["abcde", "bcdef"]


def test_degenerate_completions(spark):
    q = value(spark, T.degenerate(F.lit("case? " * 40)))
    assert q["degenerate"] and set(q["reasons"]) == {"low_distinct_token_ratio", "repeated_trigram", "long_token_run"}
    assert value(spark, T.degenerate(F.lit("   ")))["reasons"] == ["empty"]
    assert not value(spark, T.degenerate(F.lit("#### 42")))["degenerate"]


def test_judge_verdicts(spark):
    for text, want in (("INCORRECT", False), ("Correct.", True), ("CORRECT or INCORRECT", None), ("unsure", None)):
        assert value(spark, T.judge_verdict(F.lit(text))) is want


def test_numbers(spark):
    for text, want in (("1/2", 0.5), ("$1,200", 1200.0), ("50%", 0.5), (r"\frac{3}{4}", 0.75), ("about 3", None), ("5d", None), ("", None)):
        assert value(spark, A.numeric_value(F.lit(text))) == want
    assert value(spark, A.equivalent(F.lit("1/2"), F.lit("0.5"), F.lit("numeric")))
    assert not value(spark, A.equivalent(F.lit("1/2"), F.lit("0.5"), F.lit("text")))


def test_integers_stand_alone(spark):
    for text, want in (("C bakes 4. D has 4 more.", 2), ("1.4", 0), ("14", 0)):
        assert value(spark, T.int_occurrences(F.lit(text), F.lit(4))) == want


def test_rules(spark):
    for (c, o), want in {(0.95, 0.0): "contaminated", (0.0, 0.7): "contaminated", (0.8, 0.0): "partial", (0.0, 0.4): "partial", (0.5, 0.1): "clean"}.items():
        assert value(spark, R.contamination_label(F.lit(c), F.lit(o))) == want
    for (a, b), want in {(0.6, 0.7): "scale_independent", (0.05, 0.6): "emergent", (0.1, 0.1): "scale_resistant", (0.2, 0.45): "amplified"}.items():
        assert value(spark, R.transition_class(F.lit(a), F.lit(b))) == want
    for (a, r), want in {(0.9, 0.6): "genuine", (0.9, 0.1): "fragile", (0.5, 0.35): "partial", (0.2, 0.1): "gap"}.items():
        assert value(spark, R.atlas_verdict(F.lit(a), F.lit(r), F.lit(9), F.lit(9))) == want


def test_closed_form_statistics(spark):
    for (g, lost), want in {(42, 15): 4.600e-04, (31, 13): 9.560e-03, (9, 5): 0.424, (9, 3): 0.146, (12, 9): 0.664, (17, 6): 0.035}.items():
        assert abs(A.mcnemar_exact(g, lost) - want) < 6e-4
    assert abs(A.minimum_detectable_effect(45 / 1591, 1591) - 0.0472) < 2e-4
    z, p = A.two_proportions(F.lit(90), F.lit(100), F.lit(40), F.lit(100))
    assert value(spark, p) < 0.001
    assert value(spark, A.two_proportions(F.lit(0), F.lit(0), F.lit(4), F.lit(10))[1]) > 1 - 1e-6
    low, high = A.wilson(F.lit(50), F.lit(100))
    assert abs(value(spark, low) - 0.404) < 1e-3 and abs(value(spark, high) - 0.596) < 1e-3
