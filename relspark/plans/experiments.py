"""Scoring, splits, judge, probes, dose and run comparison: the remaining AGG, FLT, JOIN, SET, WIN, SCR, GATE, MEM and ORC queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import rules as R
from ..functions import text as T
from ..operators.quantiles import quantiles
from ..operators import reliability as O
from ..operators import splits, studies
from ..sources.tables import completions, judge, scores, table
from .reliability import CONF, KAPPA, confusion, draws, kappa, labelled, query
from .text_functions import NUM, q as quoted



def OK():  # noqa: N802
    return F.col("correct").cast("int")


def n_():
    return F.count(F.lit(1))


# scoring
@query("scr01_join01_score_generations", f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE {NUM} = gold) AS n_exact FROM {{completions}} GROUP BY 1")
def _(s, d):
    """Extract, compare, count; generations without an item would raise."""
    gold = completions(s, d).select("benchmark_id", "gold", "kind").withColumn("known", F.lit(True))
    g = completions(s, d).select("benchmark_id", "completion").join(gold, "benchmark_id", "left")
    kind = F.when(F.col("known"), F.col("kind")).otherwise(F.raise_error(F.lit("a generation without an item")))
    g = g.withColumn("kind", kind).withColumn("ok", F.coalesce(T.extract_numeric(F.col("completion")) == F.col("gold"), F.lit(False)))
    return g.groupBy("kind").agg(n_().alias("n"), F.count_if("ok").alias("n_exact"))


@query("join02_att01_retrieval_proxy", "SELECT benchmark_id, round(0.8 * score + 0.2 * coalesce(correct::INT, 0), 6) AS influence FROM (SELECT benchmark_id, score FROM {hits}) LEFT JOIN (SELECT parent_id, bool_or(correct) AS correct FROM {scores} GROUP BY 1) ON parent_id = benchmark_id")
def _(s, d):
    from ..sources.tables import hits

    ok = scores(s, d).groupBy(F.col("parent_id").alias("benchmark_id")).agg(F.bool_or("correct").alias("correct"))
    return hits(s, d).join(ok, "benchmark_id", "left").select("benchmark_id", (0.8 * F.col("score") + 0.2 * F.coalesce(OK(), F.lit(0))).alias("influence"))


@query("agg18_termination", "SELECT model, count(*) AS n, count(*) FILTER (WHERE finished) AS n_finished, max(v) FILTER (WHERE r = (m // 2) + 1) AS median_value, avg(finished::INT) >= 0.85 AS passes FROM (SELECT *, value AS v, row_number() OVER (PARTITION BY model ORDER BY value) AS r, count(*) OVER (PARTITION BY model) AS m FROM {scores}) GROUP BY 1")
def _(s, d):
    return studies.termination(scores(s, d))


@query("agg19_gate01_termination_did", "SELECT model, round((avg(f) FILTER (WHERE arm = 'seen' AND NOT c) - avg(f) FILTER (WHERE arm = 'unseen' AND NOT c)) - (avg(f) FILTER (WHERE arm = 'seen' AND c) - avg(f) FILTER (WHERE arm = 'unseen' AND c)), 6) AS second_difference FROM (SELECT model, arm, finished::INT AS f, variant_type IN ('gsm_symbolic', 'numeric_perturbation') AS c FROM {scores}) GROUP BY 1")
def _(s, d):
    f, c = F.col("finished").cast("int"), R.answer_changing(F.col("variant_type"))
    at = lambda arm, cond: F.avg(F.when((F.col("arm") == arm) & cond, f))
    return scores(s, d).groupBy("model").agg(((at("seen", ~c) - at("unseen", ~c)) - (at("seen", c) - at("unseen", c))).alias("second_difference"))


@query("agg20_extraction_tiers", rf"SELECT lang, CASE WHEN regexp_matches(completion, '####\s*.+') THEN '1_marker' WHEN regexp_matches(completion, '{quoted(T.ANSWER_IS)}') THEN '2_phrase' WHEN regexp_matches(completion, '-?\d') THEN '3_last_number' ELSE '4_no_number' END AS tier, count(*) AS n FROM {{completions}} GROUP BY ALL")
def _(s, d):
    return completions(s, d).groupBy("lang", R.extraction_tier(F.col("completion")).alias("tier")).agg(n_().alias("n"))


CAL = "WITH c AS (SELECT vec_id AS id, abs(embedding[1])::DOUBLE AS best, label % 2 = 0 AS truth FROM embeddings), t AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2])::DOUBLE AS t), a AS (SELECT t, count(*) FILTER (WHERE best >= t AND truth) AS tp, count(*) FILTER (WHERE best >= t AND NOT truth) AS fp, count(*) FILTER (WHERE best < t AND truth) AS fn FROM c, t GROUP BY 1), m AS (SELECT t, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM a), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM m)"


def calibrated(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.abs(F.get("embedding", 0)).cast("double").alias("best"), (F.col("label") % 2 == 0).alias("truth"))
    return studies.calibrated(e, [0.02, 0.05, 0.1, 0.15, 0.2])


@query("agg22_calibration", CAL + " SELECT t AS threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(s, d):
    return calibrated(s, d)


@query("agg23_best_threshold", CAL + " SELECT t AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, p DESC, t LIMIT 1")
def _(s, d):
    return studies.best_threshold(calibrated(s, d))


@query("agg24_metric_validation", "WITH c AS (SELECT parent_id, avg(correct::INT) AS a FROM {scores} GROUP BY 1), k AS (SELECT *, CASE WHEN substr(parent_id, -1) IN ('0', '1', '2') THEN 'genuine' ELSE 'fragile' END AS status FROM c) SELECT round(avg(a) FILTER (WHERE status = 'genuine'), 6) AS genuine, round(avg(a) FILTER (WHERE status = 'fragile'), 6) AS fragile, round(avg(a) FILTER (WHERE status = 'genuine') - avg(a) FILTER (WHERE status = 'fragile'), 6) AS separation FROM k")
def _(s, d):
    return studies.metric_validation(scores(s, d), F.right("parent_id", F.lit(1)).isin("0", "1", "2"))


@query("agg25_join08_validate_variants", "WITH o AS (SELECT parent_id, min(normalized_predicted) AS gold FROM {scores} WHERE variant_type = 'original' GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE gold IS NULL) AS n_orphans, count(*) FILTER (WHERE NOT c) AS n_preserving, count(*) FILTER (WHERE NOT c AND normalized_predicted = gold) AS n_ok FROM (SELECT s.*, gold, variant_type IN ('gsm_symbolic', 'numeric_perturbation') AS c FROM {scores} s LEFT JOIN o USING (parent_id) WHERE variant_type <> 'original')")
def _(s, d):
    return studies.validated_variants(scores(s, d), "normalized_predicted")


@query("agg26_magnitude_report", "SELECT count(m) AS n, round(median(m), 6) AS median, round(avg(ln(m)), 6) AS mean_log, round(avg((m > 1)::INT), 6) AS share_over_one, round(avg((m BETWEEN 0.8 AND 1.25)::INT), 6) AS in_band FROM (SELECT magnitude_ratio AS m FROM {scores} WHERE magnitude_ratio IS NOT NULL)")
def _(s, d):
    m, x = F.col("magnitude_ratio"), scores(s, d).where("magnitude_ratio is not null")
    middle = quantiles(x, [], "magnitude_ratio", {"median": 0.5})
    return x.agg(F.count(m).alias("n"), F.avg(F.ln(m)).alias("mean_log"), F.avg((m > 1).cast("int")).alias("share_over_one"), F.avg(m.between(0.8, 1.25).cast("int")).alias("in_band")).crossJoin(middle)  # one row each


@query("agg28_arm_balance", "SELECT max(abs(a - b)) AS max_imbalance, max(abs(a - b)) <= 1 AS balanced FROM (SELECT stratum, count(*) FILTER (WHERE arm = 'seen') AS a, count(*) FILTER (WHERE arm = 'unseen') AS b FROM {scores} GROUP BY 1)")
def _(s, d):
    return splits.balance(scores(s, d))


SPLIT = "WITH p AS (SELECT c_custkey AS id, c_custkey % 3 AS bin, CASE WHEN c_nationkey % 2 = 0 THEN 'seen' ELSE 'unseen' END AS arm, row_number() OVER (PARTITION BY c_custkey % 3, c_nationkey % 2 = 0 ORDER BY md5('6198:' || c_custkey)) AS r FROM customer), b AS (SELECT bin, count(*) FILTER (WHERE arm = 'seen') AS a, count(*) FILTER (WHERE arm = 'unseen') AS b FROM p GROUP BY 1), t AS (SELECT bin, least(a, b, 100 // 3) AS take FROM b), l AS (SELECT id, arm, row_number() OVER (PARTITION BY arm ORDER BY bin, r) AS k FROM p WHERE r > 33), c AS (SELECT sum(take) AS n FROM t), x AS (SELECT least(100 - (SELECT n FROM c), count(*) FILTER (WHERE arm = 'seen'), count(*) FILTER (WHERE arm = 'unseen')) AS e FROM l)"


def pool(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("bin"), F.when(F.col("c_nationkey") % 2 == 0, "seen").otherwise("unseen").alias("arm"))


@query("win10_matched_split", SPLIT + " SELECT id, arm FROM p JOIN t USING (bin) WHERE r <= take UNION ALL SELECT id, arm FROM l, x WHERE k <= e")
def _(s, d):
    return splits.matched(pool(s, d), 100)


@query("agg29_split_summary", SPLIT + """, o AS (SELECT id, arm FROM p JOIN t USING (bin) WHERE r <= take UNION ALL SELECT id, arm FROM l, x WHERE k <= e), cv AS (SELECT id, (id % 101) / 100e0 AS v FROM p), j AS (SELECT p.arm, o.id IS NULL AS out, v FROM p LEFT JOIN o USING (id) LEFT JOIN cv USING (id)),
a AS (SELECT arm, count(*) FILTER (WHERE NOT out) AS n, count(*) AS pool, count(*) FILTER (WHERE out AND arm = 'seen' AND v < 0.8) AS not_seen, count(*) FILTER (WHERE out AND arm = 'unseen' AND v > 0.1) AS not_unseen, count(*) FILTER (WHERE out AND NOT (arm = 'seen' AND v < 0.8) AND NOT (arm = 'unseen' AND v > 0.1)) AS unmatched FROM j GROUP BY 1)
SELECT *, CASE WHEN n >= 100 THEN 'full' WHEN not_seen + not_unseen > unmatched THEN 'evidence' ELSE 'matching' END AS diagnosis FROM a""")
def _(s, d):
    p = pool(s, d)
    return studies.split_summary(p.select("id", "arm"), splits.matched(p, 100), p.select("id", ((F.col("id") % 101) / 100.0).alias("containment")), 100)


@query("win11_step_matched", "WITH p AS (SELECT c_custkey AS id, c_custkey % 7 AS bin, CASE WHEN c_nationkey % 2 = 0 THEN 'seen' ELSE 'unseen' END AS arm, row_number() OVER (PARTITION BY c_custkey % 7, c_nationkey % 2 = 0 ORDER BY md5('6198:' || c_custkey)) AS r FROM customer), b AS (SELECT bin, least(count(*) FILTER (WHERE arm = 'seen'), count(*) FILTER (WHERE arm = 'unseen')) AS m FROM p GROUP BY 1) SELECT id, arm FROM p JOIN b USING (bin) WHERE r <= m")
def _(s, d):
    return splits.step_matched(pool(s, d).withColumn("bin", F.col("id") % 7))


@query("win12_hashed_pick", "SELECT c_custkey FROM customer ORDER BY md5('6198:' || c_custkey) LIMIT 25")
def _(s, d):
    return table(s, d, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.lit("6198:"), F.col("c_custkey").cast("string")))).limit(25)


@query("win15_prioritised_pick", "SELECT parent_id, benchmark_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY (NOT finished)::INT, seq) AS r FROM {scores}) WHERE r <= 2")
def _(s, d):
    w = Window.partitionBy("parent_id").orderBy((~F.col("finished")).cast("int"), "seq")
    return scores(s, d).withColumn("r", F.row_number().over(w)).where("r <= 2").select("parent_id", "benchmark_id")


@query("win14_trajectory_order", "SELECT model, coalesce(step, 99) AS step FROM (SELECT DISTINCT model FROM {scores}) LEFT JOIN (SELECT 'm0' AS model, 0 AS step UNION ALL SELECT 'm1', 1) USING (model)")
def _(s, d):
    dim = s.createDataFrame([("m0", 0), ("m1", 1)], "model string, step int")
    return scores(s, d).select("model").distinct().join(F.broadcast(dim), "model", "left").select("model", F.coalesce("step", F.lit(99)).alias("step"))


@query("win07_longest_run", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w), k AS (SELECT doc_id, word, pos - row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS k FROM p) SELECT doc_id, max(n) AS run FROM (SELECT doc_id, word, k, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1")
def _(s, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(s, d, "documents").select("doc_id", T.longest_run(words).alias("run")).where("run > 0")


# filters and sets
@query("flt09_verified_only", "SELECT count(*) AS n FROM {scores} s JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN 'seen' ELSE 'unseen' END AS verdict FROM customer) v ON parent_id = concat('c', cast(c_custkey AS string)) WHERE verdict = arm")
def _(s, d):
    v = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("parent_id"), F.when(F.col("c_custkey") % 5 < 2, "seen").otherwise("unseen").alias("verdict"))
    return scores(s, d).join(v, "parent_id").where("verdict = arm").agg(n_().alias("n"))


@query("flt10_answer_leakage", r"SELECT benchmark_id FROM {completions} WHERE NOT list_contains(regexp_extract_all(completion, '\d+'), gold)")
def _(s, d):
    return completions(s, d).where(~F.array_contains(F.regexp_extract_all("completion", F.lit(r"(\d+)"), F.lit(1)), F.col("gold"))).select("benchmark_id")


@query("flt11_flt12_first_row", "SELECT parent_id, model, min(seq) AS seq FROM {scores} WHERE finished GROUP BY ALL")
def _(s, d):
    return scores(s, d).where("finished").groupBy("parent_id", "model").agg(F.min("seq").alias("seq"))


@query("flt13_set02_merge_replace", "SELECT benchmark_id, variant_type, false AS fresh FROM {scores} WHERE variant_type NOT IN ('rephrasing') UNION ALL SELECT benchmark_id, variant_type, true FROM {scores} WHERE variant_type = 'rephrasing'")
def _(s, d):
    old, new = scores(s, d).withColumn("fresh", F.lit(False)), scores(s, d).where("variant_type = 'rephrasing'").withColumn("fresh", F.lit(True))
    return old.where(~F.col("variant_type").isin("rephrasing")).unionByName(new).select("benchmark_id", "variant_type", "fresh")


@query("set03_set04_pending", "SELECT cast(item_id AS string) AS id FROM benchmark WHERE cast(item_id AS string) NOT IN (SELECT cast(doc_id AS string) FROM documents WHERE doc_id % 2 = 0)")
def _(s, d):
    done = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id")).join(done, "id", "left_anti")


@query("set05_arm_disjoint", "SELECT c_custkey FROM customer WHERE c_nationkey < 15 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def _(s, d):
    c = table(s, d, "customer")
    return c.where("c_nationkey < 15").select("c_custkey").join(c.where("c_nationkey < 10").select("c_custkey"), "c_custkey", "left_anti")


@query("set06_id_collisions", "SELECT item_id AS id FROM benchmark INTERSECT SELECT doc_id FROM documents")
def _(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("id")).intersect(table(s, d, "documents").select("doc_id"))


SENTENCES = r"regexp_extract_all(text, '([^.!?]*[.!?]+\s*|[^.!?]+$)', 1)"


@query("set07_sentence_multiset", f"SELECT doc_id, list_sort(a) = list_sort(CASE WHEN doc_id % 5 = 0 THEN b[2:] ELSE b END) AS same FROM (SELECT doc_id, list_filter({SENTENCES}, lambda x: trim(x) <> '') AS a, list_reverse(list_filter({SENTENCES}, lambda x: trim(x) <> '')) AS b FROM documents)")
def _(s, d):
    """A reordered text has its original's sentences, each as often; every fifth one here has lost its first and must fail."""
    t = table(s, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("a")).withColumn("b", F.reverse("a"))
    b = F.when(F.col("doc_id") % 5 == 0, F.slice("b", 2, F.greatest(F.size("b"), F.lit(1)))).otherwise(F.col("b"))
    return t.select("doc_id", (F.array_sort("a") == F.array_sort(b)).alias("same"))


# joins over pairs
PAIR = "FROM (SELECT parent_id, bool_or(correct) FILTER (WHERE model = 'm0') AS a, bool_or(correct) FILTER (WHERE model = 'm1') AS b FROM {scores} GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"


def paired(s: SparkSession, d: str) -> DataFrame:
    on = lambda m: F.bool_or(F.when(F.col("model") == m, F.col("correct")))
    return scores(s, d).groupBy("parent_id").agg(on("m0").alias("a"), on("m1").alias("b")).where("a is not null and b is not null")


@query("join09_num13_mcnemar", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE b AND NOT a) AS gained {PAIR})
SELECT n, lost, gained, round(CASE WHEN lost + gained = 0 THEN 0 ELSE (abs(lost - gained) - 1) * (abs(lost - gained) - 1) / (lost + gained) END, 6) AS chi2,
 round(CASE WHEN lost + gained = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(lost + gained + 1) - lgamma(i + 1) - lgamma(lost + gained - i + 1) - (lost + gained) * ln(2))) FROM range(least(lost, gained) + 1) t(i))) END, 6) AS p_exact FROM c""")
def _(s, d):
    c = paired(s, d).agg(n_().alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(~F.col("a") & F.col("b")).alias("gained"))
    diff = F.abs(F.col("lost") - F.col("gained")) - 1
    return c.withColumn("chi2", F.coalesce(F.try_divide(diff * diff, F.col("lost") + F.col("gained")), F.lit(0.0))).withColumn("p_exact", A.binomial_tail(F.col("lost"), F.col("gained")))


HELD = "(SELECT concat('c', cast(c_custkey AS string)) FROM customer WHERE c_nationkey % 2 = 0)"


@query("join10_dose_contrast", f"SELECT held, count(*) AS n, round(avg(b::INT) - avg(a::INT), 6) AS effect FROM (SELECT *, parent_id IN {HELD} AS held {PAIR}) GROUP BY 1")
def _(s, d):
    """Contrast of two doses on items inside and outside a held-out list, told apart by a semi and an anti join."""
    held = table(s, d, "customer").where("c_nationkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("parent_id"))
    p = paired(s, d)
    p = p.join(held, "parent_id", "left_semi").withColumn("held", F.lit(True)).unionByName(p.join(held, "parent_id", "left_anti").withColumn("held", F.lit(False)))
    return p.groupBy("held").agg(n_().alias("n"), (F.avg(F.col("b").cast("int")) - F.avg(F.col("a").cast("int"))).alias("effect"))


KINDS = {"o": "original", "r": "rephrasing", "n": "numeric_perturbation", "g": "gsm_symbolic"}
CI = "round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps"
BY_KIND = f"SELECT parent_id, {', '.join(f'avg(correct::INT) FILTER (WHERE variant_type = {chr(39)}{v}{chr(39)}) AS {k}' for k, v in KINDS.items())} FROM {{scores}} GROUP BY 1"


def by_kind(s: SparkSession, d: str) -> DataFrame:
    """Mean correctness of each parent under each of four conditions, null where it has none."""
    return scores(s, d).groupBy("parent_id").agg(*[F.avg(F.when(F.col("variant_type") == v, OK())).alias(k) for k, v in KINDS.items()])


@query("join11_boot08_paired_contrast", f"WITH p AS (SELECT parent_id, r - o AS x FROM ({BY_KIND}) WHERE o IS NOT NULL AND r IS NOT NULL), e AS (SELECT rep, sum(x * w) / sum(w) AS e FROM {draws('p')} GROUP BY 1) SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(x), 6) FROM p) AS effect, {CI} FROM e")
def _(s, d):
    """Mean difference within parents that have both conditions, with a bootstrap over parents."""
    p = by_kind(s, d).where("o is not null and r is not null").select("parent_id", (F.col("r") - F.col("o")).alias("x"), F.lit(1).alias("one"))
    e = O.drawn(p, [], ["x", "one"], O.REPS).withColumn("estimate", F.try_divide("x", "one"))
    return p.agg(n_().alias("n"), F.avg("x").alias("effect")).crossJoin(O.interval(e, []))  # one row each


FACTORS = {"rewording": "(r + g - o - n) / 2", "numbers": "(n + g - o - r) / 2", "interaction": "(g - n) - (r - o)"}


@query("boot08_factorial", f"WITH p AS (SELECT * FROM ({BY_KIND}) WHERE o + r + n + g IS NOT NULL), f AS ({' UNION ALL '.join(f'SELECT parent_id, {chr(39)}{k}{chr(39)} AS effect, {x} AS x FROM p' for k, x in FACTORS.items())}), e AS (SELECT effect, rep, sum(x * w) / sum(w) AS e FROM {draws('f')} GROUP BY ALL), m AS (SELECT effect, count(*) AS n, round(avg(x), 6) AS estimate FROM f GROUP BY 1) SELECT effect, any_value(n) AS n, any_value(estimate) AS estimate, {CI} FROM e JOIN m USING (effect) GROUP BY effect")
def _(s, d):
    """Main effects and interaction of a two by two design over parents that have all four conditions."""
    p = by_kind(s, d).where("o + r + n + g is not null")
    f = p.select("parent_id", F.explode(F.array(*[F.struct(F.lit(k).alias("effect"), F.expr(x).alias("x")) for k, x in FACTORS.items()])).alias("f")).select("parent_id", "f.*", F.lit(1).alias("one"))
    e = O.drawn(f, ["effect"], ["x", "one"], O.REPS).withColumn("estimate", F.try_divide("x", "one"))
    return f.groupBy("effect").agg(n_().alias("n"), F.avg("x").alias("estimate")).join(O.interval(e, ["effect"]), "effect")


@query("join12_transitions", "SELECT coalesce(a.skill, b.skill) AS skill, round(coalesce(b.r, 0) - coalesce(a.r, 0), 6) AS delta, CASE WHEN coalesce(a.r, 0) >= 0.5 AND coalesce(b.r, 0) >= 0.5 THEN 'scale_independent' WHEN coalesce(b.r, 0) >= 0.5 AND coalesce(a.r, 0) < 0.1 THEN 'emergent' WHEN coalesce(b.r, 0) < 0.3 AND coalesce(a.r, 0) < 0.3 THEN 'scale_resistant' ELSE 'amplified' END AS transition FROM (SELECT skill, avg(correct::INT) AS r FROM {scores} WHERE model = 'm0' AND skill <> 'BUILDING' GROUP BY 1) a FULL JOIN (SELECT skill, avg(correct::INT) AS r FROM {scores} WHERE model = 'm1' AND skill <> 'MACHINERY' GROUP BY 1) b ON a.skill = b.skill")
def _(s, d):
    by = lambda m, no, name: scores(s, d).where((F.col("model") == m) & (F.col("skill") != no)).groupBy("skill").agg(F.avg(OK()).alias(name))
    j = by("m0", "BUILDING", "a").join(by("m1", "MACHINERY", "b"), "skill", "full_outer").fillna(0.0)
    return j.select("skill", (F.col("b") - F.col("a")).alias("delta"), R.transition_class(F.col("a"), F.col("b")).alias("transition"))


@query("join13_rl_effect", "SELECT a.skill, round(b.r - a.r, 6) AS delta FROM (SELECT skill, avg(correct::INT) AS r FROM {scores} WHERE model = 'm1' GROUP BY 1) a JOIN (SELECT skill, avg(correct::INT) AS r FROM {scores} WHERE model = 'm2' GROUP BY 1) b ON a.skill = b.skill")
def _(s, d):
    by = lambda m, name: scores(s, d).where(F.col("model") == m).groupBy("skill").agg(F.avg(OK()).alias(name))
    return by("m1", "a").join(by("m2", "b"), "skill").select("skill", (F.col("b") - F.col("a")).alias("delta"))


@query("join14_run_diff", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_b, b.k IS NULL AS only_a, coalesce(abs(a.v - b.v) <= 0.001, false) AS same FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier WHERE s_suppkey % 7 <> 0) b ON a.k = b.k")
def _(s, d):
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    a, b = t.where("k % 5 <> 0"), t.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))
    j = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"), "full_outer")
    return j.select(F.coalesce("a.k", "b.k").alias("k"), F.col("a.k").isNull().alias("only_b"), F.col("b.k").isNull().alias("only_a"), F.coalesce(F.abs(F.col("a.v") - F.col("b.v")) <= 0.001, F.lit(False)).alias("same"))


@query("join16_judge_backlog", "SELECT count(*) AS n FROM {judge} j JOIN orders ON benchmark_id = cast(o_orderkey AS string) WHERE NOT EXISTS (SELECT 1 FROM {judge} k WHERE k.benchmark_id = j.benchmark_id AND k.verdict IS NOT NULL)")
def _(s, d):
    j = judge(s, d)
    graded = j.where("verdict is not null").select("benchmark_id")
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("benchmark_id"))
    return j.join(o, "benchmark_id").join(graded, "benchmark_id", "left_anti").agg(n_().alias("n"))


# aggregates of the studies
@query("agg34_first_row_atlas", "SELECT arm, round(avg((correct = first)::INT), 6) AS consistency, round(avg(correct::INT), 6) AS accuracy FROM (SELECT *, first_value(correct) OVER (PARTITION BY parent_id ORDER BY seq) AS first FROM {scores}) WHERE arm IS NOT NULL GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("parent_id").orderBy("seq")
    f = scores(s, d).withColumn("first", F.first("correct").over(w)).where("arm is not null")
    return f.groupBy("arm").agg(F.avg((F.col("correct") == F.col("first")).cast("int")).alias("consistency"), F.avg(OK()).alias("accuracy"))


@query("agg35_ladder", "SELECT model, round(avg(correct::INT) FILTER (WHERE variant_type = 'original') - avg(correct::INT) FILTER (WHERE variant_type = 'gsm_symbolic'), 6) AS numeric_effect, round(avg(correct::INT) FILTER (WHERE variant_type = 'gsm_symbolic') - avg(correct::INT) FILTER (WHERE variant_type = 'numeric_perturbation'), 6) AS structural_effect FROM {scores} GROUP BY 1")
def _(s, d):
    at = lambda v: F.avg(F.when(F.col("variant_type") == v, OK()))
    return scores(s, d).groupBy("model").agg((at("original") - at("gsm_symbolic")).alias("numeric_effect"), (at("gsm_symbolic") - at("numeric_perturbation")).alias("structural_effect"))


@query("agg36_probe_rates", rf"SELECT kind, count(*) AS n, count(*) FILTER (WHERE label = 'recall') AS recall, count(*) FILTER (WHERE label = 'abstain') AS abstain, count(*) FILTER (WHERE label = 'other') AS other FROM (SELECT kind, CASE WHEN {NUM} = gold THEN 'recall' WHEN regexp_matches(completion, '{quoted(T.ABSTAIN)}') THEN 'abstain' ELSE 'other' END AS label FROM {{completions}}) GROUP BY 1")
def _(s, d):
    c = F.col("completion")
    label = R.probe_label(F.coalesce(T.extract_numeric(c) == F.col("gold"), F.lit(False)), T.abstains(c))
    return completions(s, d).withColumn("label", label).groupBy("kind").agg(n_().alias("n"), *[F.count_if(F.col("label") == k).alias(k) for k in ("recall", "abstain", "other")])


@query("agg37_abstention_discrimination", "SELECT arm, round(100 * (avg((verdict IS NULL)::INT) FILTER (WHERE condition = 'pruned') - avg((verdict IS NULL)::INT) FILTER (WHERE condition = 'control')), 6) AS discrimination FROM {judge} GROUP BY 1")
def _(s, d):
    quiet = F.col("verdict").isNull().cast("int")
    at = lambda c: F.avg(F.when(F.col("condition") == c, quiet))
    return judge(s, d).groupBy("arm").agg((100 * (at("pruned") - at("control"))).alias("discrimination"))


@query("agg38_consistency_by_arm", "WITH o AS (SELECT parent_id, arg_min(correct, seq) AS original FROM {scores} WHERE variant_type = 'original' GROUP BY 1), c AS (SELECT arm, parent_id, normalized_predicted, count(*) AS n FROM {scores} WHERE variant_type NOT IN ('gsm_symbolic', 'numeric_perturbation') AND arm IS NOT NULL GROUP BY ALL), k AS (SELECT arm, parent_id, max(n) / sum(n) AS cons FROM c GROUP BY ALL) SELECT arm, original, count(*) AS n_clusters, round(avg(cons), 6) AS consistency FROM k JOIN o USING (parent_id) GROUP BY ALL HAVING count(*) >= 10")
def _(s, d):
    """Answer consistency by arm, apart for parents whose original was answered rightly and wrongly."""
    o = scores(s, d).where("variant_type = 'original'").groupBy("parent_id").agg(F.min_by("correct", "seq").alias("original"))
    c = scores(s, d).where(~R.answer_changing(F.col("variant_type")) & F.col("arm").isNotNull()).groupBy("arm", "parent_id", "normalized_predicted").agg(n_().alias("n"))
    k = c.groupBy("arm", "parent_id").agg((F.max("n") / F.sum("n")).alias("cons")).join(o, "parent_id")
    return k.groupBy("arm", "original").agg(n_().alias("n_clusters"), F.avg("cons").alias("consistency")).where("n_clusters >= 10")


@query("agg39_paired_discordance", "SELECT count(*) FILTER (WHERE a >= 0.5 AND b < 0.5) AS lost, count(*) FILTER (WHERE a < 0.5 AND b >= 0.5) AS gained FROM (SELECT avg(correct::INT) FILTER (WHERE model = 'm0') AS a, avg(correct::INT) FILTER (WHERE model = 'm1') AS b FROM {scores} GROUP BY parent_id)")
def _(s, d):
    at = lambda m: F.avg(F.when(F.col("model") == m, OK()))
    p = scores(s, d).groupBy("parent_id").agg(at("m0").alias("a"), at("m1").alias("b"))
    return p.agg(F.count_if((F.col("a") >= 0.5) & (F.col("b") < 0.5)).alias("lost"), F.count_if((F.col("a") < 0.5) & (F.col("b") >= 0.5)).alias("gained"))


@query("agg41_label_counts", "SELECT source, count(*) FILTER (WHERE c = 'contaminated') AS contaminated, count(*) FILTER (WHERE c = 'partial') AS partial, count(*) FILTER (WHERE c = 'clean') AS clean FROM (SELECT source, CASE WHEN label IN ('contaminated', 'exact', 'near_duplicate') THEN 'contaminated' WHEN label IN ('partial', 'paraphrase_candidate') THEN 'partial' ELSE 'clean' END AS c FROM {hits}) GROUP BY 1")
def _(s, d):
    from ..sources.tables import hits

    return O.canonical_counts(hits(s, d)).fillna(0)


PRECISION = "case o_orderkey % 4 when 0 then 'bfloat16' when 1 then 'float16' else case when o_custkey % 2 = 0 then 'float32' else 'bfloat16' end end"


@query("agg42_precision_provenance", f"WITH p AS (SELECT o_orderpriority AS model, CASE WHEN o_orderpriority < '3' THEN 'bfloat16' ELSE {PRECISION} END AS precision FROM orders) SELECT model, list_sort(list(DISTINCT precision)) AS precisions, count(DISTINCT precision) > 1 AS mixed FROM p GROUP BY 1")
def _(s, d):
    """Precisions that each model's rows were made at; a model of more than one is flagged."""
    p = table(s, d, "orders").select(F.col("o_orderpriority").alias("model"), F.expr(f"case when o_orderpriority < '3' then 'bfloat16' else {PRECISION} end").alias("precision"))
    return p.groupBy("model").agg(F.sort_array(F.collect_set("precision")).alias("precisions")).withColumn("mixed", F.size("precisions") > 1)


@query("agg43_octiles", "SELECT o, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM (SELECT correct, least(7, (row_number() OVER (ORDER BY value, seq) - 1) * 8 // count(*) OVER ())::INT AS o FROM {scores}) GROUP BY 1")
def _(s, d):
    return O.difficulty_bins(scores(s, d).select("correct", "value", "seq"), "value", "seq", 8).groupBy(F.col("bin").alias("o")).agg(n_().alias("n"), F.avg(OK()).alias("accuracy"))


@query("agg44_having", "SELECT stratum, count(*) AS n, round(avg((verdict IS NULL)::INT), 6) AS rate FROM {judge} GROUP BY 1 HAVING count(*) >= 40")
def _(s, d):
    return judge(s, d).groupBy("stratum").agg(n_().alias("n"), F.avg(F.col("verdict").isNull().cast("int")).alias("rate")).where("n >= 40")


@query("agg45_boot11_binned_recall", f"WITH x AS (SELECT parent_id, least(4, floor((cast(floor(value) AS bigint) % 100) / 100e0 * 5))::INT AS bin, correct FROM {{scores}}), c AS (SELECT parent_id, bin, count(*) AS n, count(*) FILTER (WHERE correct) AS k FROM x GROUP BY ALL), e AS (SELECT bin, rep, sum(k * w) / sum(n * w) AS e FROM {draws('c')} GROUP BY ALL), m AS (SELECT bin, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 6) AS recall FROM c GROUP BY 1) SELECT bin, any_value(n) AS n, any_value(recall) AS recall, {CI} FROM e JOIN m USING (bin) GROUP BY bin")
def _(s, d):
    """Recall in five half-open bins of a share, with a bootstrap over parents in each bin."""
    x = (F.floor("value") % 100) / 100.0
    c = scores(s, d).groupBy("parent_id", F.least(F.lit(4), F.floor(x * 5)).cast("int").alias("bin")).agg(n_().alias("n"), F.count_if("correct").alias("k"))
    e = O.drawn(c, ["bin"], ["k", "n"], O.REPS).withColumn("estimate", F.try_divide("k", "n"))
    return c.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("recall")).join(O.interval(e, ["bin"]), "bin")


STEPS = r"list_distinct(regexp_extract_all({x}, '\d+'))"


@query("agg46_procedure_score", f"SELECT id, round(len(list_intersect({STEPS.format(x='substr(text, length(text) // 2 + 1)')}, own)) / len(own), 6) AS score FROM (SELECT id, text, {STEPS.format(x='left(text, length(text) // 2)')} AS own FROM {{docs}}) WHERE len(own) > 0")
def _(s, d):
    """Share of the distinct results of a worked solution (here a text's first half) that the completion (its second) reproduces."""
    from ..sources.tables import docs

    found = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))
    half = F.floor(F.length("text") / 2).cast("int")
    x = docs(s, d).select("id", found(F.left("text", half)).alias("own"), found(F.substring("text", half + 1, F.length("text"))).alias("made")).where(F.size("own") > 0)
    return x.select("id", (F.size(F.array_intersect("made", "own")) / F.size("own")).alias("score"))


@query("agg47_stratified_specificity", f"WITH c AS (SELECT stratum, arm, {CONF} FROM {{judge}} GROUP BY ALL), g AS (SELECT stratum, max(tn / (tn + fp)) FILTER (WHERE arm = 'seen') - max(tn / (tn + fp)) FILTER (WHERE arm = 'unseen') AS gap, sum(tn + fp) AS n FROM c WHERE tn + fp >= 15 GROUP BY 1) SELECT round(sum(gap * n) / sum(n), 6) AS gap, count(*) AS n_strata FROM g WHERE gap IS NOT NULL")
def _(s, d):
    c = confusion(judge(s, d), ["stratum", "arm"]).withColumn("m", F.col("tn") + F.col("fp")).where("m >= 15")
    at = lambda a: F.max(F.when(F.col("arm") == a, F.col("tn") / F.col("m")))
    g = c.groupBy("stratum").agg((at("seen") - at("unseen")).alias("gap"), F.sum("m").alias("m")).where("gap is not null")
    return g.agg((F.sum(F.col("gap") * F.col("m")) / F.sum("m")).alias("gap"), n_().alias("n_strata"))


@query("agg48_num08_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1", 4)
def _(s, d):
    x, rows = F.col("l_extendedprice").cast("double"), table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")
    moments = rows.groupBy("l_returnflag").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    return quantiles(rows, ["l_returnflag"], x, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).join(moments, "l_returnflag")


@query("agg49_group_sizes", "SELECT concat_ws('|', coalesce(arm, 'none'), variant_type) AS k, count(*) AS n FROM {scores} GROUP BY 1")
def _(s, d):
    return scores(s, d).groupBy(F.concat_ws("|", F.coalesce("arm", F.lit("none")), "variant_type").alias("k")).agg(n_().alias("n"))


@query("agg50_inventory", "SELECT model, count(*) AS n_rows, count(DISTINCT parent_id) AS n_ids FROM {scores} GROUP BY 1")
def _(s, d):
    return scores(s, d).groupBy("model").agg(n_().alias("n_rows"), F.count_distinct("parent_id").alias("n_ids"))


CELLS = {"s1": ("seen", "m1"), "u1": ("unseen", "m1"), "s0": ("seen", "m0"), "u0": ("unseen", "m0")}


def recall_did_sql(w: str) -> str:
    part = lambda c: f"(sum(k_{c}{w}) / sum(n_{c}{w}))"
    return f"{part('s1')} - {part('u1')} - {part('s0')} + {part('u0')}"


RECALL_CELLS = ", ".join(f"count(*) FILTER (WHERE arm = '{a}' AND model = '{m}'{' AND correct' * (x == 'k')}) AS {x}_{c}" for c, (a, m) in CELLS.items() for x in "kn")


@query("boot09_recall_did", f"WITH c AS (SELECT parent_id, {RECALL_CELLS} FROM {{scores}} GROUP BY 1), e AS (SELECT rep, {recall_did_sql(' * w')} AS e FROM {draws('c')} GROUP BY 1) SELECT (SELECT round({recall_did_sql('')}, 6) FROM c) AS did, {CI} FROM e")
def _(s, d):
    """Difference in differences of recall, arms by checkpoints, with a bootstrap over parents."""
    at = lambda a, m, x: F.sum(F.when((F.col("arm") == a) & (F.col("model") == m), OK() if x == "k" else F.lit(1)).otherwise(0))
    c = scores(s, d).groupBy("parent_id").agg(*[at(a, m, x).alias(f"{x}_{cell}") for cell, (a, m) in CELLS.items() for x in "kn"])
    names = [f"{x}_{c}" for c in CELLS for x in "kn"]
    rate = lambda c: F.try_divide(f"k_{c}", f"n_{c}")
    value = rate("s1") - rate("u1") - rate("s0") + rate("u0")
    e = O.drawn(c, [], names, O.REPS).withColumn("estimate", value)
    return c.agg(*[F.sum(x).alias(x) for x in names]).select(value.alias("did")).crossJoin(O.interval(e, []))  # one row each


@query("agg38_noise_floor", "WITH c AS (SELECT parent_id, normalized_predicted, count(*) AS n FROM {scores} WHERE variant_type = 'resample' GROUP BY ALL), k AS (SELECT parent_id, max(n) / sum(n) AS cons, sum(n) AS m FROM c GROUP BY 1) SELECT count(*) AS n, round(avg(cons), 6) AS floor FROM k WHERE m >= 2")
def _(s, d):
    k = O.clusters(scores(s, d)).where("n_resample >= 2")
    return k.agg(n_().alias("n"), F.avg("decoding_consistency").alias("floor"))


@query("orc06_checkpoints", """WITH c AS (SELECT lower(n_name) AS tag, [n_name, 'org/' || n_name] AS aliases, n_nationkey AS step, n_nationkey % 3 + 1 AS tier, n_nationkey >= 9 AS exposed FROM nation), o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'org/' || n_name ELSE 'none' END AS name FROM orders JOIN nation ON n_nationkey = o_custkey % 25),
t AS (SELECT tag, step, lag(tag) OVER (ORDER BY step) AS before, exposed AND NOT lag(exposed) OVER (ORDER BY step) AS intervention FROM c WHERE tier <= 2), r AS (SELECT o_orderkey, tag FROM o LEFT JOIN (SELECT tag, unnest(aliases) AS name FROM c UNION ALL SELECT tag, tag FROM c) a USING (name))
SELECT tag, step, before, coalesce(intervention, false) AS intervention, (SELECT count(*) FROM r WHERE r.tag = t.tag) AS n_rows FROM t""")
def _(s, d):
    """Rows resolved to checkpoints by any of their names; checkpoints up to a tier, each with the one before and whether it brings the exposure."""
    from ..operators import trajectory

    k = table(s, d, "nation").select(F.lower("n_name").alias("tag"), F.array("n_name", F.concat(F.lit("org/"), "n_name")).alias("aliases"), F.col("n_nationkey").alias("step"), (F.col("n_nationkey") % 3 + 1).alias("tier"), (F.col("n_nationkey") >= 9).alias("exposed"))
    names = table(s, d, "nation").select("n_nationkey", "n_name")
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("n_nationkey")).join(F.broadcast(names), "n_nationkey")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("n_name")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("org/"), "n_name")).otherwise("none").alias("name"))
    n = trajectory.resolved(o, k).groupBy("tag").agg(n_().alias("n_rows"))
    t = trajectory.transitions(k, 2)
    return t.join(n, "tag", "left").select("tag", "step", "before", "intervention", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


CHAINS = r"SELECT doc_id, doc_id % 4 = 0 AS both_ok, string_split(left(text, length(text) // 2), '. ') AS a, CASE WHEN doc_id % 3 = 0 THEN string_split(left(text, length(text) // 2) || '. ' || right(text, 40), '. ') ELSE string_split(substr(text, length(text) // 2 + 1), '. ') END AS b FROM documents WHERE text <> ''"
STEP = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


@query("txt36_divergence", f"""WITH c AS ({CHAINS}), k AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: {STEP.format(x='a[i]')} <> {STEP.format(x='b[i]')}), true), 0) - 1 AS first_,
 list_max(list_transform(b, lambda y: len(regexp_extract_all(y, '-?\\d+(?:\\.\\d+)?')))) >= 3 AND len(b) >= 5 AS heavy FROM c)
SELECT doc_id, CASE WHEN both_ok THEN 'no_divergence' WHEN first_ < 0 THEN CASE WHEN len(a) < len(b) THEN 'premature_conclusion' ELSE 'no_divergence' END WHEN first_ = 0 THEN 'strategy_mismatch' WHEN len(a) < len(b) - 1 AND first_ >= len(a) - 1 THEN 'premature_conclusion' WHEN heavy AND first_ >= len(b) // 2 THEN 'capacity_failure' ELSE 'error_propagation' END AS category FROM k""")
def _(s, d):
    """Two chains of steps, a text's first half and either its second half or the first half gone on with."""
    half = F.floor(F.length("text") / 2).cast("int")
    t = table(s, d, "documents").where("text <> ''").withColumns({"x": F.left("text", half), "y": F.substring("text", half + 1, F.length("text"))})
    a = F.split("x", r"\. ")
    b = F.when(F.col("doc_id") % 3 == 0, F.split(F.concat("x", F.lit(". "), F.right("text", F.lit(40))), r"\. ")).otherwise(F.split("y", r"\. "))
    return t.select("doc_id", splits.divergence(a, b, F.lit(True), F.col("doc_id") % 4 == 0).alias("category"))


@query("gen02_verbatim_match", "SELECT doc_id, round(list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: (a[i] = b[i])::INT)) / len(a), 6) AS share FROM (SELECT x.doc_id, string_split(x.text, ' ') AS a, string_split(y.text, ' ') AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE x.text <> '')")
def _(s, d):
    """Share of a document's tokens that stand at the same place in what was generated for it, here the next document."""
    t = table(s, d, "documents").select("doc_id", "text")
    pair = t.where("text <> ''").join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("made")), "doc_id")
    a, b = F.split("text", " "), F.split("made", " ")
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return pair.select("doc_id", (same / F.size(a)).alias("share"))


@query("gate01_extraction_suspect", "SELECT model, avg(correct::INT) < 0.02 AS suspect, avg(finished::INT) < 0.85 AS unfinished FROM {scores} GROUP BY 1")
def _(s, d):
    return scores(s, d).groupBy("model").agg((F.avg(OK()) < 0.02).alias("suspect"), (F.avg(F.col("finished").cast("int")) < 0.85).alias("unfinished"))


@query("str05_repair_truncated", "SELECT benchmark_id, CASE WHEN finished THEN 0 ELSE 1 END AS round FROM {scores}")
def _(s, d):
    """Unfinished rows are dropped and made again; the new rows take their place, finished ones stay."""
    from ..streaming.corpus import repaired

    old = scores(s, d).select("benchmark_id", "finished", F.lit(0).alias("round"))
    again = old.where("not finished").select("benchmark_id", F.lit(True).alias("finished"), F.lit(1).alias("round"))
    return repaired(old, again, "benchmark_id").select("benchmark_id", "round")


@query("agg20_tier_did", rf"""WITH t AS (SELECT benchmark_id::BIGINT % 2 AS arm, benchmark_id::BIGINT % 3 AS checkpoint, CASE WHEN regexp_matches(completion, '####\s*.+') THEN 1 WHEN regexp_matches(completion, '{quoted(T.ANSWER_IS)}') THEN 2 WHEN regexp_matches(completion, '-?\d') THEN 3 ELSE 4 END AS tier, {NUM} = gold AS ok FROM {{completions}})
SELECT checkpoint, round(avg((tier = 1)::INT) FILTER (WHERE arm = 0) - avg((tier = 1)::INT) FILTER (WHERE arm = 1), 6) AS marker_gap, round(avg((tier = 3)::INT) FILTER (WHERE arm = 0) - avg((tier = 3)::INT) FILTER (WHERE arm = 1), 6) AS number_gap, round(avg(ok::INT) FILTER (WHERE tier = 3), 6) AS last_number_accuracy FROM t GROUP BY 1""")
def _(s, d):
    """How far arms differ in the way their answers are read, by checkpoint, and how good the last-number reading is."""
    c = F.col("completion")
    t = completions(s, d).select((F.col("benchmark_id").cast("long") % 2).alias("arm"), (F.col("benchmark_id").cast("long") % 3).alias("checkpoint"), R.extraction_tier(c).alias("tier"), F.coalesce(T.extract_numeric(c) == F.col("gold"), F.lit(False)).cast("int").alias("ok"))
    gap = lambda k: F.avg(F.when(F.col("arm") == 0, (F.col("tier") == k).cast("int"))) - F.avg(F.when(F.col("arm") == 1, (F.col("tier") == k).cast("int")))
    return t.groupBy("checkpoint").agg(gap("1_marker").alias("marker_gap"), gap("3_last_number").alias("number_gap"), F.avg(F.when(F.col("tier") == "3_last_number", F.col("ok"))).alias("last_number_accuracy"))
