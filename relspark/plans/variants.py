"""VAR, STR, REG and ORC queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import ablations as AB
from ..operators import containment as C
from ..operators import regression
from ..operators import variants as V
from ..sources.tables import docs, items, scores, table
from ..streaming import corpus as stream
from .reliability import query

Q = "(SELECT *, 'Item one has ' || (id::INT % 9 + 2) || ' parts. Alice buys ' || (id::INT % 7 + 11) || ' pencils. How many are there?' AS p, (id::INT % 9 + 2)::BIGINT AS a FROM {items})"
H = lambda *parts: A.hashed_sql("'6198'", "id", *parts)


def word_problems(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("int")
    p = F.concat(F.lit("Item one has "), (k % 9 + 2).cast("string"), F.lit(" parts. Alice buys "), (k % 7 + 11).cast("string"), F.lit(" pencils. How many are there?"))
    r = F.concat(F.lit("<<"), (k % 9 + 2).cast("string"), F.lit("+"), (k % 7 + 11).cast("string"), F.lit("="), (k % 9 + k % 7 + 13).cast("string"), F.lit(">>"))
    return items(s, d).select("id", p.alias("prompt"), (k % 9 + 2).cast("string").alias("answer"), r.alias("rationale"))


LIST = "[" + ", ".join(f"'{x}'" for x in V.DISTRACTORS) + "]"


@query("var03_irrelevant_context", f"SELECT id || '__irrelevant_context' AS id, id AS parent_id, 'irrelevant_context' AS variant_type, replace(p, ' How many', ' ' || ({LIST})[{H(chr(39) + 'context' + chr(39))} % 6 + 1] || ' How many') AS prompt, a::VARCHAR AS answer FROM {Q}")
def _(s, d):
    return V.irrelevant_context(word_problems(s, d))


@query("var07_resample", f"SELECT id || '__resample' || k AS id, id AS parent_id, 'resample' AS variant_type, p AS prompt, a::VARCHAR AS answer FROM {Q}, range(3) r(k)")
def _(s, d):
    return V.resample(word_problems(s, d), 3)


K, OP = f"({H(chr(39) + 'depth' + chr(39))} % 8 + 2)", f"({H(chr(39) + 'op' + chr(39))} % 2 = 0)"


@query("var10_depth_extension", f"SELECT id || '__depth_extension' AS id, id AS parent_id, 'depth_extension' AS variant_type, p || CASE WHEN {OP} THEN ' Finally, what is ' || {K} || ' times that amount?' ELSE ' Finally, what is that amount plus ' || {K} || '?' END AS prompt, (CASE WHEN {OP} THEN a * {K} ELSE a + {K} END)::VARCHAR AS answer FROM {Q}")
def _(s, d):
    return V.depth_extension(word_problems(s, d))


FREE = r"list_filter(range(13, 97), lambda v: NOT list_contains(regexp_extract_all(p, '\d+'), v::VARCHAR) AND v <> a)"


@query("var11_distractor_quantity", f"SELECT id || '__distractor_quantity' AS id, id AS parent_id, 'distractor_quantity' AS variant_type, replace(p, ' How many', ' An unrelated shipment of ' || ({FREE})[{H(chr(39) + 'quantity' + chr(39))} % len({FREE}) + 1] || ' boxes arrived on the same day and was never opened. How many') AS prompt, a::VARCHAR AS answer FROM {Q}")
def _(s, d):
    return V.distractor_quantity(word_problems(s, d))


@query("var12_premise_removal", f"SELECT id || '__removed0' AS id, id AS parent_id, 'premise_removal' AS variant_type, 'Alice buys ' || (id::INT % 7 + 11) || ' pencils. How many are there?' AS prompt, NULL::VARCHAR AS answer FROM {Q} WHERE a <> id::INT % 7 + 11")
def _(s, d):
    return V.premise_removal(word_problems(s, d))


@query("var13_quantity_ablation", f"SELECT id || '__' || c AS id, id AS parent_id, 'ablation_' || c AS variant_type, replace(CASE WHEN c LIKE 'removed%' THEN substr(p, position('Alice' IN p)) ELSE p END, ' How many', ' ' || CASE WHEN c LIKE '%number' THEN 'The shop is at 17 Mill Road.' ELSE 'The shop is on Mill Road.' END || ' How many') AS prompt, CASE WHEN c LIKE 'kept%' THEN a::VARCHAR END AS answer FROM {Q}, (SELECT unnest(['kept_plain', 'kept_number', 'removed_plain', 'removed_number']) AS c)")
def _(s, d):
    return V.quantity_ablation(word_problems(s, d))


@query("var17_dose_stream", "WITH a AS (SELECT id, prompt AS text, k::INT AS copy, 0 AS f FROM {items}, range(1, 4) r(k) UNION ALL SELECT id, text, 0, 1 FROM {docs}), t AS (SELECT *, sum(length(text)) OVER (ORDER BY f, md5('6198:' || id || ':' || copy)) AS total FROM a) SELECT id, copy FROM t WHERE total <= 100000")
def _(s, d):
    repeat = items(s, d).select("id", F.col("prompt").alias("text"))
    return V.dose_stream(repeat, docs(s, d).select("id", "text"), 3, 100_000).select("id", "copy")


@query("var14_var15_removal_yield", f"SELECT count(*) AS n_items, count(*) FILTER (WHERE a <> id::INT % 7 + 11) AS n_feasible FROM {Q}")
def _(s, d):
    w = word_problems(s, d)
    got = V.premise_removal(w).select(F.col("parent_id").alias("id")).distinct().withColumn("ok", F.lit(1))
    return w.join(got, "id", "left").agg(F.count(F.lit(1)).alias("n_items"), F.count("ok").alias("n_feasible"))


#: Benchmark texts as word problems: a number is put before each sentence, behind a word that ends in a full stop, and two of them are used.
NUMBERED = r"""(SELECT id, k, ss, array_to_string(list_transform(ss, lambda s, i: 'No. ' || (k + i) || ' ' || s), ' ') AS p, '<<' || (k + 1) || '+' || (k + 3) || '=' || (2 * k + 4) || '>>' AS r
FROM (SELECT id, id::INT % 50 + 100 AS k, list_filter(string_split(regexp_replace(trim(prompt), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM {items}))"""


def numbered(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("int") % 50 + 100
    parts = F.filter(T.sentence_parts(F.trim("prompt")), lambda x: x != "")
    text = F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("No. "), (k + i + 1).cast("string"), F.lit(" "), x)), " ")
    r = F.concat(F.lit("<<"), (k + 1).cast("string"), F.lit("+"), (k + 3).cast("string"), F.lit("="), (2 * k + 4).cast("string"), F.lit(">>"))
    return items(s, d).select("id", text.alias("prompt"), (2 * k + 4).cast("string").alias("answer"), r.alias("rationale"))


PLACE = "list_filter([1, 3], lambda i: i < len(ss))"


@query("var14_guarded_deletion", f"""SELECT id || '__del' || (j - 1) AS id, id AS parent_id, 'premise_deletion' AS variant_type, array_to_string(list_filter(list_transform(ss, lambda s, i: CASE WHEN i <> ({PLACE})[j] THEN 'No. ' || (k + i) || ' ' || s END), lambda s: s IS NOT NULL), ' ') AS prompt, NULL::VARCHAR AS answer,
'No. ' || (k + ({PLACE})[j]) || ' ' || ss[({PLACE})[j]] AS removed, len(ss)::INT AS n_sentences FROM {NUMBERED}, range(1, 3) r2(j) WHERE len(ss) >= 3 AND j <= len({PLACE})""")
def _(s, d):
    """Premises of benchmark texts taken away, where the solution's number goes with them; "No. 7" is not cut behind its full stop."""
    return AB.deletions(numbered(s, d))


@query("var15_deletion_manifest", f"""SELECT count(*) AS scanned, count(*) FILTER (WHERE len(ss) < 3) AS too_short, count(*) FILTER (WHERE len(ss) >= 3 AND len({PLACE}) = 0) AS no_removable, count(*) FILTER (WHERE len(ss) >= 3 AND len({PLACE}) > 0) AS kept,
sum(CASE WHEN len(ss) >= 3 THEN len({PLACE}) ELSE 0 END)::BIGINT AS n_variants, round(count(*) FILTER (WHERE len(ss) >= 3 AND len({PLACE}) > 0) / count(*), 6) AS yield FROM {NUMBERED}""")
def _(s, d):
    return AB.deletion_manifest(numbered(s, d))


ASKED = r"""(SELECT id, prompt || ' How many are there?' AS p, list_concat(list_filter(string_split(regexp_replace(trim(prompt), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), ['How many are there?']) AS ss FROM {items})"""


@query("var13_two_by_two", f"""WITH c AS (SELECT id, ss, {H("'quantity'")} % 84 + 13 AS n, ({list(AB.OFF_TOPIC)!r})[{H("'topic'")} % 10 + 1] AS topic FROM {ASKED})
SELECT id || '__' || kind AS id, kind AS variant_type, array_to_string(list_concat(list_concat(ss[1:len(ss) - 1], [replace(replace('{AB.FRAME}', '{{qty}}', CASE WHEN kind = 'offtopic_qty' THEN n::VARCHAR ELSE '{AB.FILLER}' END), '{{topic}}', topic)]), ss[len(ss):len(ss)]), ' ') AS prompt FROM c, (SELECT unnest(['offtopic_noqty', 'offtopic_qty']) AS kind)""")
def _(s, d):
    """The two cells off the subject, over benchmark texts with a question behind them; texts and answers hold no number."""
    x = items(s, d).select("id", "prompt", F.lit("How many are there?").alias("question"), F.lit(None).cast("string").alias("answer"))
    return AB.ablated(x).where("variant_type like 'offtopic%'").select("id", "variant_type", "prompt")


@query("var13_violations", "SELECT '0' AS id, 'none' AS problem WHERE false")
def _(s, d):
    """No ablation of a benchmark text breaks a promise."""
    x = numbered(s, d).withColumn("prompt", F.concat("prompt", F.lit(" How many are there?")))
    return AB.violations(x, AB.ablated(x))


@query("var01_var02_var04_var06_suite")
def _(s, d):
    return V.suite(word_problems(s, d))


@query("var05_var08_var09_numeric")
def _(s, d):
    k = F.col("id").cast("int")
    return V.numeric(word_problems(s, d).withColumn("answer", (k % 9 + k % 7 + 13).cast("string")), 2)


@query("var16_injection_mixture")
def _(s, d):
    """Hashed halves of the items injected or held out, beside filler that holds none of their grams."""
    i = items(s, d).withColumn("held", A.hashed(F.lit("6198"), F.col("id"), F.lit("mix")) % 2 == 0)
    x = docs(s, d).where(F.length("text") >= 200)
    hit = C.matches(C.grams(i, "prompt"), x, short=True).select(F.col("doc").alias("id")).distinct()
    filler = x.join(hit, "id", "left_anti").select("id", F.lit("filler").alias("role"))
    return i.select("id", F.when(F.col("held"), "held_out").otherwise("injected").alias("role")).unionByName(filler)


@query("str_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", 4)
def _(s, d):
    return stream.windowed_counts(table(s, d, "events"))


@query("str02_first_by_id", "SELECT event_id FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select("event_id", "ts")
    return stream.first_by_id(e.unionByName(e)).select("event_id")


@query("reg01_reg02_mem02_logistic")
def _(s, d):
    df = scores(s, d).where("arm is not null").select("parent_id", F.col("correct").cast("int").alias("y"), (F.col("arm") == "seen").cast("int").alias("seen"), F.col("variant_type").isin("gsm_symbolic", "numeric_perturbation").cast("int").alias("changed"), F.coalesce(F.log("magnitude_ratio"), F.lit(0.0)).alias("log_magnitude")).withColumn("both", F.col("seen") * F.col("changed"))
    fit = regression.fit_logistic(df, "y", ["seen", "changed", "both", "log_magnitude"], "parent_id")
    return s.createDataFrame([(k, float(b), float(e), float(p)) for k, b, e, p in zip(fit.names, fit.beta, fit.se, fit.p(), strict=True)], "term string, estimate double, se double, p double")


#: Question, annotated solution, answer, and why no template can be made of it; n and m are an item's own numbers.
FLAWS = [
    ("{n} birds.", "none", "1", "no_calc_annotations"),
    ("{n} birds.", "<<{n}+1={n}>>" * 9, "1", "chain_too_long"),
    ("{n} birds.", "<<{n}/1={n}.5>>", "1", "non_integer_step_result"),
    ("{n} birds.", "<<{n}+1={n}>>", "{n}", "step_does_not_reproduce_result"),
    ("{n} birds.", "<<{n}*1={n}>>", "7", "final_answer_mismatch"),
    ("{n} birds.", "<<{n}*1={n}>><<{n}/1={n}>>", "{n}", "duplicate_step_results"),
    ("{n} birds.", "<<{n}-{n}=0>>", "0", "value_repeated_within_step"),
    ("{n} birds and {n} more.", "<<{n}-{n}1=-{m}>>", "-{m}", "value_ambiguous_in_question"),
    ("Some birds.", "<<{n}*1={n}>>", "{n}", "no_substitutable_leaves"),
    ("2 3 4 5 6 7 8 birds.", "<<2+3+4+5+6+7+8=35>>", "35", "too_many_leaves"),
    ("{n} birds.", "<<{n}*1={n}>>", "{n}", "leaf_collides_with_step_result"),
    ("{n} birds.", "<<{n}*3={t}>>", "{t}", None),
]


@query("var08_rejections", "SELECT id, (" + repr([f[3] or "" for f in FLAWS]) + ")[id::INT % 12 + 1] AS reason FROM {items} WHERE id::INT % 12 <> 11")
def _(s, d):
    """Items with one flaw each, and one in twelve without."""
    n = F.col("id").cast("int") % 40 + 40
    put = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (9 * n + 1).cast("string")), F.lit("{t}"), (3 * n).cast("string"))
    pick = lambda i: F.get(F.array(*[put(f[i]) for f in FLAWS]), F.col("id").cast("int") % 12)
    rows = items(s, d).select("id", pick(0).alias("prompt"), pick(1).alias("rationale"), pick(2).alias("answer"))
    return V.rejections(rows).select("id", "reason")
