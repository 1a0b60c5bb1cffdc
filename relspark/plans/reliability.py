"""AGG, JOIN, WIN, MEM, BOOT and STAT queries over evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import answers as A
from ..functions import rules as R
from ..operators import reliability as O
from ..operators.resampling import relabelled
from ..operators.ranks import running
from ..sources.tables import hits, judge, scores, sql, table

REPS = O.REPS
CHG = "variant_type IN ('gsm_symbolic', 'numeric_perturbation')"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; a negative zero is zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_labels(scores(spark, sf_dir), O.strongest_labels(hits(spark, sf_dir)))


RANK = "CASE WHEN label IN ('contaminated', 'exact', 'near_duplicate') THEN 3 WHEN label IN ('partial', 'paraphrase_candidate') THEN 2 ELSE 1 END"
LABELS = f"(SELECT benchmark_id, CASE max({RANK}) WHEN 3 THEN 'contaminated' WHEN 2 THEN 'partial' ELSE 'clean' END AS label FROM {{hits}} GROUP BY 1)"
LAB = f"(SELECT s.*, coalesce(a.label, b.label, 'clean') AS label FROM {{scores}} s LEFT JOIN {LABELS} a USING (benchmark_id) LEFT JOIN {LABELS} b ON s.parent_id = b.benchmark_id)"


def query(name: str, body: str | None = None, places: int = 6):
    def add(f):
        @register(name, sql(body) if body else None)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), places)

        run.__doc__ = f.__doc__
        return f

    return add


@query("agg01_accuracy", "SELECT round(avg(correct::INT), 6) AS accuracy FROM {scores}")
def _(s, d):
    return O.accuracy(scores(s, d))


CONS = f"""
WITH c AS (SELECT parent_id, normalized_predicted AS a, count(*) AS n, count(*) FILTER (WHERE NOT {CHG}) AS kept, count(*) FILTER (WHERE variant_type = 'resample') AS again FROM {{scores}} GROUP BY ALL),
m AS (SELECT parent_id, CASE WHEN sum(kept) > 0 THEN max(kept) / sum(kept) ELSE max(n) / sum(n) END AS cons, CASE WHEN sum(again) >= 2 THEN max(again) / sum(again) ELSE -1 END AS dec, sum(kept)::BIGINT AS kept FROM c GROUP BY 1),
o AS (SELECT parent_id, arg_min(correct, seq) AS o FROM {{scores}} WHERE variant_type = 'original' GROUP BY 1),
p AS (SELECT s.parent_id, count(*) AS n, avg(correct::INT) AS acc, count(*) FILTER (WHERE {CHG}) AS chg, avg(correct::INT) FILTER (WHERE {CHG}) AS pacc, count(*) FILTER (WHERE variant_type = 'resample') AS again,
 avg((correct = o)::INT) FILTER (WHERE NOT {CHG} AND variant_type <> 'original') AS agree FROM {{scores}} s LEFT JOIN o USING (parent_id) GROUP BY 1)"""


@query("agg02_cluster_consistency", CONS + " SELECT parent_id, round(cons, 6) AS consistency FROM m")
def _(s, d):
    return O.clusters(scores(s, d)).select("parent_id", "consistency")


@query("agg03_agg04_label_agreement_decoding", CONS + " SELECT parent_id, round(coalesce(agree, -1), 6) AS label_agreement, round(dec, 6) AS decoding_consistency, again AS n_resample FROM m JOIN p USING (parent_id)")
def _(s, d):
    return O.clusters(scores(s, d)).select("parent_id", "label_agreement", "decoding_consistency", "n_resample")


@query("agg05_reliability_summary", CONS + " SELECT parent_id, n AS n_variants, kept AS n_preserving, round(acc, 6) AS accuracy, round(cons, 6) AS consistency, round(acc * cons, 6) AS reliability, round(coalesce(pacc, -1), 6) AS accuracy_under_perturbation, chg AS n_changing, round(coalesce(agree, -1), 6) AS label_agreement, round(dec, 6) AS decoding_consistency, again AS n_resample FROM m JOIN p USING (parent_id)")
def _(s, d):
    return O.clusters(scores(s, d))


@query("agg06_strongest_label", f"SELECT * FROM {LABELS}")
def _(s, d):
    return O.strongest_labels(hits(s, d))


@query("join03_contamination_label", f"SELECT label, count(*) AS n FROM {LAB} GROUP BY 1")
def _(s, d):
    return labelled(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("join04_difficulty_bin_fallback", "SELECT bin, count(*) AS n FROM (SELECT coalesce(c_custkey % 3, 0) AS bin FROM {scores} s LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON s.parent_id = concat('c', cast(c_custkey AS string))) GROUP BY 1")
def _(s, d):
    bins = table(s, d, "customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("benchmark_id"), (F.col("c_custkey") % 3).alias("bin"))
    return O.with_labels(scores(s, d), bins, "bin", 0).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


Z = "(c1 / n1 - c0 / n0) / sqrt((c1 + c0) / (n1 + n0) * (1 - (c1 + c0) / (n1 + n0)) * (1 / n1 + 1 / n0))"


@query("agg07_accuracy_gap", f"""
WITH g AS (SELECT concat_ws('::', benchmark, model) AS scope, count(*) FILTER (WHERE label = 'contaminated') AS n1, count(*) FILTER (WHERE label = 'contaminated' AND correct) AS c1, count(*) FILTER (WHERE label = 'partial') AS np,
 count(*) FILTER (WHERE label = 'partial' AND correct) AS cp, count(*) FILTER (WHERE label = 'clean') AS n0, count(*) FILTER (WHERE label = 'clean' AND correct) AS c0 FROM {LAB} GROUP BY 1),
z AS (SELECT *, {Z} AS z FROM g), p AS (SELECT *, least(1, 2 * {A.normal_sf_sql('abs(z)')}) AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, scope) AS r, count(*) OVER () AS m FROM p)
SELECT scope, n1 AS n_contaminated, np AS n_partial, n0 AS n_clean, round(c1 / n1 - c0 / n0, 6) AS gap, round(cp / np - c0 / n0, 6) AS partial_gap, round(z, 6) AS z, round(p, 6) AS p, 'measured' AS status, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS q FROM r""")
def _(s, d):
    return O.accuracy_gap(labelled(s, d))


@query("win03_bh_qvalues", f"""
WITH p AS (SELECT skill, model, 1.0::DOUBLE / (1 + count(*) FILTER (WHERE correct) % 97) AS p FROM {{scores}} GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, skill, model) AS r, count(*) OVER () AS m FROM p)
SELECT skill, model, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS q FROM r""")
def _(s, d):
    return O.bh_qvalues(scores(s, d).groupBy("skill", "model").agg((1.0 / (1 + F.count_if("correct") % 97)).alias("p")))


@query("stat04_bh_reject", """
WITH p AS (SELECT skill, model, 1.0::DOUBLE / (1 + count(*) FILTER (WHERE correct) % 97) AS p FROM {scores} GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, skill, model) AS r, count(*) OVER () AS m FROM p)
SELECT skill, model, r <= coalesce((SELECT max(r) FROM r WHERE p <= 0.05 * r / m), 0) AS rejected FROM r""")
def _(s, d):
    q = O.bh_qvalues(scores(s, d).groupBy("skill", "model").agg((1.0 / (1 + F.count_if("correct") % 97)).alias("p")))
    return q.select("skill", "model", (F.col("q") <= 0.05).alias("rejected"))


CELL = "sum(w * (label = 'contaminated')::INT) AS n1, sum(w * (label = 'contaminated' AND correct)::INT) AS c1, sum(w * (label = 'clean')::INT) AS n0, sum(w * (label = 'clean' AND correct)::INT) AS c0"
MH = "sum(n1 * n0 / (n1 + n0) * (c1 / n1 - c0 / n0)) / sum(n1 * n0 / (n1 + n0))"


@query("agg08_mantel_haenszel", f"WITH c AS (SELECT model, stratum, {CELL} FROM (SELECT *, 1 AS w FROM {LAB}) GROUP BY ALL) SELECT model, round({MH}, 6) AS pooled_gap FROM c WHERE n1 > 0 AND n0 > 0 GROUP BY 1")
def _(s, d):
    return O.pooled_gap(O.gap_cells(labelled(s, d), ["model"]), ["model"])


def draws(table: str, cluster: str = "parent_id", halves: bool = False) -> str:
    return A.weight_sql(cluster, O.SEED, REPS, table, halves)


@query("agg09_boot02_stratified_gap", f"""
WITH l AS (SELECT * FROM {LAB}), per AS (SELECT model, parent_id, stratum, {CELL} FROM (SELECT *, 1 AS w FROM l) GROUP BY ALL), cells AS (SELECT model, stratum, sum(n1) AS n1, sum(c1) AS c1, sum(n0) AS n0, sum(c0) AS c0 FROM per GROUP BY ALL),
b AS (SELECT model, rep, stratum, sum(n1 * w) AS n1, sum(c1 * w) AS c1, sum(n0 * w) AS n0, sum(c0 * w) AS c0 FROM {draws('per')} GROUP BY ALL),
e AS (SELECT model, rep, {MH} AS e FROM b WHERE n1 > 0 AND n0 > 0 GROUP BY ALL), ci AS (SELECT model, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, count(e) AS n FROM e GROUP BY 1),
u AS (SELECT model, sum(c1) / sum(n1) - sum(c0) / sum(n0) AS u FROM cells GROUP BY 1), p AS (SELECT model, {MH} AS p FROM cells WHERE n1 > 0 AND n0 > 0 GROUP BY 1), k AS (SELECT model, count(DISTINCT parent_id) AS k FROM l GROUP BY 1)
SELECT model, round(u, 6) AS unadjusted_gap, round(p, 6) AS pooled_gap, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, n AS n_reps, k AS n_clusters FROM u JOIN p USING (model) JOIN ci USING (model) JOIN k USING (model)""")
def _(s, d):
    return O.stratified_gap(labelled(s, d), ["model"], REPS)


@query("agg10_atlas", CONS + f""", k AS (SELECT parent_id, min(skill) AS skill FROM {{scores}} GROUP BY 1),
cc AS (SELECT p.parent_id, skill, unnest([coalesce(label, 'clean'), 'all']) AS level, acc, cons, acc * cons AS rel, kept FROM p JOIN m USING (parent_id) JOIN k USING (parent_id) LEFT JOIN {LABELS} l ON l.benchmark_id = p.parent_id),
g AS (SELECT skill, level, count(*) AS n, avg(acc) AS acc, avg(cons) AS cons, avg(rel) AS rel, count(*) FILTER (WHERE kept >= 2) AS multi FROM cc GROUP BY ALL),
e AS (SELECT skill, level, rep, CASE WHEN sum(w) > 0 THEN sum(rel * w) / sum(w) END AS e FROM {draws('cc')} GROUP BY ALL), ci AS (SELECT skill, level, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi FROM e GROUP BY ALL)
SELECT skill, level, n AS n_clusters, round(acc, 6) AS accuracy, round(cons, 6) AS consistency, round(rel, 6) AS reliability, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
CASE WHEN multi = 0 THEN 'accuracy_only' WHEN n < 3 THEN 'insufficient_data' WHEN acc >= 0.6 AND rel < 0.3 THEN 'fragile' WHEN rel >= 0.5 THEN 'genuine' WHEN rel >= 0.3 THEN 'partial' ELSE 'gap' END AS verdict FROM g JOIN ci USING (skill, level)""")
def _(s, d):
    return O.atlas(scores(s, d), O.strongest_labels(hits(s, d)))


@query("agg11_modal_metadata", "WITH n AS (SELECT parent_id, model, count(*) AS n FROM {scores} GROUP BY ALL) SELECT parent_id, model AS modal FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, model) AS r FROM n) WHERE r = 1")
def _(s, d):
    """Ties go to the least value."""
    n = scores(s, d).groupBy("parent_id", "model").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("parent_id").agg(F.min_by("model", F.struct(-F.col("n"), "model")).alias("modal"))


DIDC = f"count(*) FILTER (WHERE arm = 'seen' AND NOT {CHG}) AS n_so, count(*) FILTER (WHERE arm = 'seen' AND NOT {CHG} AND correct) AS c_so, count(*) FILTER (WHERE arm = 'seen' AND {CHG}) AS n_sp, count(*) FILTER (WHERE arm = 'seen' AND {CHG} AND correct) AS c_sp, count(*) FILTER (WHERE arm = 'unseen' AND NOT {CHG}) AS n_uo, count(*) FILTER (WHERE arm = 'unseen' AND NOT {CHG} AND correct) AS c_uo, count(*) FILTER (WHERE arm = 'unseen' AND {CHG}) AS n_up, count(*) FILTER (WHERE arm = 'unseen' AND {CHG} AND correct) AS c_up"
USE = "{scores} WHERE arm IN ('seen', 'unseen') AND variant_type <> 'resample'"
DIDV = "(c_so / n_so - c_uo / n_uo) - (c_sp / n_sp - c_up / n_up)"
NAMES = [f"{a}_{k}" for a in "nc" for k in ("so", "sp", "uo", "up")]


@query("agg12_did_cells", f"SELECT model, {DIDC} FROM {USE} GROUP BY 1")
def _(s, d):
    return O.did_cells(scores(s, d), ["model"])


def did_sql(source: str, keys: str = "model") -> str:
    sums = ", ".join(f"sum({c} * w) AS {c}" for c in NAMES)
    return f"""WITH per AS (SELECT {keys}, parent_id, {DIDC} FROM {source} GROUP BY ALL), cells AS (SELECT {keys}, {', '.join(f'sum({c})::BIGINT AS {c}' for c in NAMES)} FROM per GROUP BY {keys}),
b AS (SELECT {keys}, rep, {sums} FROM {draws('per')} GROUP BY ALL), ci AS (SELECT {keys}, quantile_cont({DIDV}, 0.025) AS lo, quantile_cont({DIDV}, 0.975) AS hi FROM b GROUP BY {keys})
SELECT {keys}, n_so, n_sp, n_uo, n_up, round({DIDV}, 6) AS did, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, 'measured' AS status FROM cells JOIN ci USING ({keys})"""


@query("mem01_boot03_did", did_sql(USE))
def _(s, d):
    return O.did(scores(s, d), ["model"], REPS)


MATCHED = USE + f" AND (NOT {CHG} OR magnitude_ratio BETWEEN 0.8 AND 1.2)"


@query("flt05_mem01_magnitude_matched", did_sql(MATCHED))
def _(s, d):
    r = F.col("magnitude_ratio")
    return O.did(scores(s, d).where(~R.answer_changing(F.col("variant_type")) | F.coalesce((r >= 0.8) & (r <= 1.2), F.lit(False))), ["model"], REPS)


@query("flt04_did_eligible", f"SELECT count(*) AS n FROM {USE}")
def _(s, d):
    return scores(s, d).where(F.col("arm").isin("seen", "unseen") & (F.col("variant_type") != "resample")).agg(F.count(F.lit(1)).alias("n"))


@query("mem04_purified_did", did_sql(USE + f" AND (SELECT label FROM {LABELS} q WHERE q.benchmark_id = parent_id) = CASE arm WHEN 'seen' THEN 'contaminated' ELSE 'clean' END"))
def _(s, d):
    """Only records whose parent's verified label fits their arm."""
    verified = O.strongest_labels(hits(s, d)).select(F.col("benchmark_id").alias("parent_id"), "label")
    keep = F.col("label") == F.when(F.col("arm") == "seen", "contaminated").otherwise("clean")
    return O.did(scores(s, d).join(verified, "parent_id").where(keep), ["model"], REPS)


@query("mem03_win05_trajectory", f"WITH c AS (SELECT model, {DIDC} FROM {USE} GROUP BY 1), t AS (SELECT model, {DIDV} AS did FROM c) SELECT model, round(did, 6) AS did, round(did - lag(did) OVER (ORDER BY model), 6) AS delta FROM t")
def _(s, d):
    w = Window.orderBy("model")  # a handful of checkpoints
    t = O.did_cells(scores(s, d), ["model"]).select("model", O.did_value().alias("did"))
    return t.select("model", "did", (F.col("did") - F.lag("did").over(w)).alias("delta"))


CONDITIONS = ("numeric_perturbation", "gsm_symbolic", "rephrasing", "entity_substitution")
BY_CONDITION = f"(SELECT s.*, c AS condition FROM {{scores}} s, (SELECT unnest({list(CONDITIONS)}) AS c) WHERE variant_type = 'original' OR variant_type = c) WHERE arm IS NOT NULL"


@query("mem05_multi_condition_did", did_sql(BY_CONDITION, "model, condition").replace(CHG, "variant_type <> 'original'"))
def _(s, d):
    """Difference in differences of each condition against the originals, with a bootstrap over parents."""
    v = F.col("variant_type")
    own = F.when(v == "original", F.array(*[F.lit(c) for c in CONDITIONS])).when(v.isin(*CONDITIONS), F.array(v)).otherwise(F.expr("cast(array() as array<string>)"))
    return O.did(scores(s, d).withColumn("condition", F.explode(own)), ["model", "condition"], REPS, changed=v != "original")


@query("cls08_did_reading", f"SELECT model, CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN 'no detectable difference between arms' WHEN did > 0 THEN printf('seen items lose %.3f more under perturbation', did) ELSE printf('unseen items lose %.3f more under perturbation', -did) END AS reading FROM ({did_sql(USE)})")
def _(s, d):
    """The measured difference in words."""
    return O.did(scores(s, d), ["model"], REPS).select("model", R.did_reading(F.col("did"), F.col("ci_low"), F.col("ci_high")).alias("reading"))


@query("boot01_mean_interval", CONS + f""", cc AS (SELECT parent_id, acc * cons AS rel FROM p JOIN m USING (parent_id)),
e AS (SELECT rep, sum(rel * w) / sum(w) AS e FROM {draws('cc')} GROUP BY 1)
SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps FROM e""")
def _(s, d):
    means = O.drawn(O.clusters(scores(s, d)).withColumn("one", F.lit(1)), [], ["reliability", "one"], REPS)
    return O.interval(means.withColumn("estimate", F.try_divide("reliability", "one")), [])


@query("boot04_rate_interval", f"""WITH c AS (SELECT arm, parent_id, count(*) FILTER (WHERE correct) AS k, count(*) AS n FROM {{scores}} WHERE arm IS NOT NULL GROUP BY ALL),
e AS (SELECT arm, rep, sum(k * w) / sum(n * w) AS e FROM {draws('c')} GROUP BY ALL)
SELECT arm, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps FROM e GROUP BY 1""")
def _(s, d):
    c = scores(s, d).where("arm is not null").groupBy("arm", "parent_id").agg(F.count_if("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    return O.interval(O.drawn(c, ["arm"], ["k", "n"], REPS).withColumn("estimate", F.try_divide("k", "n")), ["arm"])


BA = "(0.5e0 * (tp / (tp + fn) + tn / (tn + fp)))"
CONF = "count(*) FILTER (WHERE verdict AND truth) AS tp, count(*) FILTER (WHERE verdict AND NOT truth) AS fp, count(*) FILTER (WHERE NOT verdict AND truth) AS fn, count(*) FILTER (WHERE NOT verdict AND NOT truth) AS tn"


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn of judged rows; abstentions are left out."""
    v, t = F.col("verdict"), F.col("truth")
    return df.groupBy(*keys).agg(F.count_if(v & t).alias("tp"), F.count_if(v & ~t).alias("fp"), F.count_if(~v & t).alias("fn"), F.count_if(~v & ~t).alias("tn"))


def balanced():
    return 0.5 * (F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp")))


def kappa():
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))


KAPPA = "(((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))))"


@query("agg31_agg32_agg33_judge_reliability", f"WITH c AS (SELECT judge, arm, count(*) AS n, count(*) FILTER (WHERE verdict IS NULL) AS abstained, avg(truth::INT) AS base_rate, {CONF} FROM {{judge}} GROUP BY ALL) SELECT judge, arm, n, abstained, round(base_rate, 6) AS base_rate, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round({BA}, 6) AS balanced_accuracy, round({KAPPA}, 6) AS kappa FROM c")
def _(s, d):
    j = judge(s, d)
    base = j.groupBy("judge", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isNull()).alias("abstained"), F.avg(F.col("truth").cast("int")).alias("base_rate"))
    c = confusion(j, ["judge", "arm"]).join(base, ["judge", "arm"])
    return c.select("judge", "arm", "n", "abstained", "base_rate", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("sensitivity"), F.try_divide("tn", F.col("tn") + F.col("fp")).alias("specificity"), balanced().alias("balanced_accuracy"), kappa().alias("kappa"))


@query("boot05_judge_gap", f"""WITH per AS (SELECT arm, parent_id, {CONF} FROM {{judge}} GROUP BY ALL), b AS (SELECT arm, rep, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn, sum(tn * w) AS tn FROM {draws('per')} GROUP BY ALL),
e AS (SELECT rep, max({BA}) FILTER (WHERE arm = 'seen') - max({BA}) FILTER (WHERE arm = 'unseen') AS e FROM b GROUP BY 1) SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps FROM e""")
def _(s, d):
    ba = O.drawn(confusion(judge(s, d), ["arm", "parent_id"]), ["arm"], ["tp", "fp", "fn", "tn"], REPS).select("arm", "rep", balanced().alias("ba"))
    return O.interval(ba.groupBy("rep").agg((F.max(F.when(F.col("arm") == "seen", F.col("ba"))) - F.max(F.when(F.col("arm") == "unseen", F.col("ba")))).alias("estimate")), [])


@query("boot06_interaction", f"""WITH per AS (SELECT parent_id, arm, condition, count(*) AS n, count(*) FILTER (WHERE truth) AS k FROM {{judge}} GROUP BY ALL), b AS (SELECT rep, arm, condition, sum(k * w) / sum(n * w) AS r FROM {draws('per')} GROUP BY ALL),
e AS (SELECT rep, max(r) FILTER (WHERE arm = 'seen' AND condition = 'pruned') - max(r) FILTER (WHERE arm = 'seen' AND condition = 'control') - max(r) FILTER (WHERE arm = 'unseen' AND condition = 'pruned') + max(r) FILTER (WHERE arm = 'unseen' AND condition = 'control') AS e FROM b GROUP BY 1)
SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps FROM e""")
def _(s, d):
    per = judge(s, d).groupBy("parent_id", "arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("k"))
    b = O.drawn(per, ["arm", "condition"], ["k", "n"], REPS).withColumn("r", F.try_divide("k", "n"))
    at = lambda a, c: F.max(F.when((F.col("arm") == a) & (F.col("condition") == c), F.col("r")))
    return O.interval(b.groupBy("rep").agg((at("seen", "pruned") - at("seen", "control") - at("unseen", "pruned") + at("unseen", "control")).alias("estimate")), [])


@query("boot07_placebo_relabelling", f"""WITH per AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE truth) AS k FROM {{judge}} GROUP BY 1),
e AS (SELECT rep, sum(k * w) / sum(n * w) - sum(k * (1 - w)) / sum(n * (1 - w)) AS e FROM {draws('per', halves=True)} GROUP BY 1)
SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps FROM e""")
def _(s, d):
    """Clusters dealt to two halves by hash in each replicate; no difference is expected."""
    per = judge(s, d).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("k"))
    total = F.broadcast(per.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k")))  # one row
    half = O.drawn(per, [], ["n", "k"], REPS, halves=True).crossJoin(total)
    other = F.try_divide(F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n"))
    return O.interval(half.withColumn("estimate", F.try_divide("k", "n") - other), [])


@query("boot07_fixed_size_placebo", f"""WITH per AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE truth) AS k, bool_or(arm = 'seen') AS seen FROM {{judge}} GROUP BY 1), t AS (SELECT sum(n) AS n, sum(k) AS k, count(*) FILTER (WHERE seen) AS size FROM per),
d AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY u, parent_id::VARCHAR) AS place FROM (SELECT * FROM {draws('per', halves=True)})), a AS (SELECT rep, sum(n) AS n, sum(k) AS k FROM d WHERE place <= (SELECT size FROM t) GROUP BY 1), e AS (SELECT a.k / a.n - (t.k - a.k) / (t.n - a.n) AS e FROM a, t)
SELECT round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high, count(e) AS n_reps, (SELECT size FROM t) AS size FROM e""")
def _(s, d):
    """Arms drawn anew over the clusters, each as large as the seen arm is; no difference is expected."""
    per = judge(s, d).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("k"), F.bool_or(F.col("arm") == "seen").alias("seen"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count_if("seen").alias("size"))
    size = total.first()["size"]
    arm = relabelled(per, size, ["n", "k"], REPS).crossJoin(F.broadcast(total))  # one row
    estimate = F.try_divide("k", "n") - F.try_divide(F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n"))
    return O.interval(arm.withColumn("estimate", estimate), []).withColumn("size", F.lit(size).cast("long"))


SXY = "sum(w) AS n, sum(x * w) AS sx, sum(y * w) AS sy, sum(x * y * w) AS sxy, sum(x * x * w) AS sxx"


@query("num15_boot10_slope", f"""WITH r AS (SELECT model, parent_id, seq % 7 AS x, correct::INT AS y FROM {{scores}}), per AS (SELECT model, parent_id, {SXY} FROM (SELECT *, 1 AS w FROM r) GROUP BY ALL),
b AS (SELECT model, rep, sum(n * w) AS n, sum(sx * w) AS sx, sum(sy * w) AS sy, sum(sxy * w) AS sxy, sum(sxx * w) AS sxx FROM {draws('per')} GROUP BY ALL),
ci AS (SELECT model, quantile_cont(100 * (n * sxy - sx * sy) / (n * sxx - sx * sx), 0.025) AS lo, quantile_cont(100 * (n * sxy - sx * sy) / (n * sxx - sx * sx), 0.975) AS hi FROM b GROUP BY 1)
SELECT model, round(100 * regr_slope(y, x), 6) AS slope, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM r JOIN ci USING (model) GROUP BY 1""")
def _(s, d):
    """Slope of the success rate, in points; clusters are carried as sums of moments."""
    r = scores(s, d).select("model", "parent_id", (F.col("seq") % 7).alias("x"), F.col("correct").cast("int").alias("y"))
    per = r.groupBy("model", "parent_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    b = O.drawn(per, ["model"], ["n", "sx", "sy", "sxy", "sxx"], REPS)
    n, sx, sy, sxy, sxx = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx"))
    ci = O.interval(b.withColumn("estimate", 100 * (n * sxy - sx * sy) / (n * sxx - sx * sx)), ["model"]).drop("n_reps")
    return r.groupBy("model").agg((100 * F.regr_slope("y", "x")).alias("slope")).join(ci, "model")


RANKS = "(SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS t FROM (SELECT arm, cast(floor(value / 1000) AS bigint) AS v FROM {scores} WHERE arm IS NOT NULL))"


@query("win04_stat02_stat03_mann_whitney", f"""WITH a AS (SELECT count(*) FILTER (WHERE arm = 'seen') AS n1, count(*) FILTER (WHERE arm = 'unseen') AS n2, sum(r) FILTER (WHERE arm = 'seen') AS r1, sum(t * t - 1) AS ties, count(*) AS n FROM {RANKS}),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM a), z AS (SELECT *, least(u1, n1 * n2 - u1) AS u, (least(u1, n1 * n2 - u1) - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
SELECT round(u, 3) AS u, round(z, 6) AS z, round(least(1, 2 * {A.normal_sf_sql('abs(z)')}), 6) AS p, round(2 * u1 / (n1 * n2) - 1, 6) AS cliffs_delta FROM z""")
def _(s, d):
    """Ranks are counted over distinct values in ranges, so no task sorts them all."""
    v = scores(s, d).where("arm is not null").select("arm", F.floor(F.col("value") / 1000).alias("v"))
    t = v.groupBy("v").agg(F.count_if(F.col("arm") == "seen").alias("a"), F.count(F.lit(1)).alias("t"))
    t = running(t, "v", "t", "upto").withColumn("r", F.col("upto") - (F.col("t") - 1) / 2)
    a = t.agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * F.col("r")).alias("r1"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("ties"), F.sum("t").cast("double").alias("n"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    a = a.withColumn("u1", u1).withColumn("u", F.least("u1", n1 * n2 - F.col("u1")))
    a = a.withColumn("z", (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
    return a.select(F.round("u", 3).alias("u"), "z", F.least(F.lit(1.0), 2 * A.normal_sf(F.abs("z"))).alias("p"), (2 * F.col("u1") / (n1 * n2) - 1).alias("cliffs_delta"))


@query("win01_difficulty_bins", "SELECT benchmark_id, least(2, (row_number() OVER (ORDER BY floor(value / 1000), seq) - 1) * 3 // count(*) OVER ())::INT AS bin FROM {scores}")
def _(s, d):
    df = scores(s, d).select("benchmark_id", F.floor(F.col("value") / 1000).alias("score"), "seq")
    return O.difficulty_bins(df, "score", "seq").select("benchmark_id", "bin")


@query("win02_top_k", "SELECT parent_id, benchmark_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY value DESC, benchmark_id) AS r FROM {scores}) WHERE r <= 5")
def _(s, d):
    w = Window.partitionBy("parent_id").orderBy(F.desc("value"), "benchmark_id")
    return scores(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("parent_id", "benchmark_id", "rank")


@query("win06_max_step", "SELECT skill, round(max(x), 6) AS jump FROM (SELECT skill, acc - lag(acc) OVER (PARTITION BY skill ORDER BY model) AS x FROM (SELECT skill, model, avg(correct::INT) AS acc FROM {scores} GROUP BY ALL)) GROUP BY 1")
def _(s, d):
    c = scores(s, d).groupBy("skill", "model").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    return c.withColumn("x", F.col("acc") - F.lag("acc").over(Window.partitionBy("skill").orderBy("model"))).groupBy("skill").agg(F.max("x").alias("jump"))


@query("win08_lowest_reliability", CONS + " SELECT parent_id, round(acc * cons, 6) AS reliability FROM m JOIN p USING (parent_id) ORDER BY acc * cons, parent_id LIMIT 20")
def _(s, d):
    return O.clusters(scores(s, d)).select("parent_id", "reliability").orderBy("reliability", "parent_id").limit(20)


@query("agg30_icc", """WITH c AS (SELECT model, parent_id, count(*) AS n, sum(correct::INT) AS s FROM {scores} GROUP BY ALL HAVING count(*) > 1), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(s) AS sr, sum(n * n) AS n2, sum(s * s / n) AS b, sum(s) AS ss FROM c)
SELECT round(greatest(0, least(1, (msb - msw) / (msb + (n0 - 1) * msw))), 6) AS icc FROM (SELECT (b - sr * sr / nn) / (k - 1) AS msb, (ss - b) / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM t)""")
def _(s, d):
    c = scores(s, d).groupBy("model", "parent_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("s")).where("n > 1")
    t = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("right"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    N, k, S = F.col("total"), F.col("k"), F.col("right")
    t = t.select(((F.col("b") - S * S / N) / (k - 1)).alias("msb"), ((S - F.col("b")) / (N - k)).alias("msw"), ((N - F.col("n2") / N) / (k - 1)).alias("n0"))
    return t.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("n0") - 1) * F.col("msw")))).alias("icc"))
