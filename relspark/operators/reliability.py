"""Cluster consistency, reliability, contamination gaps and the atlas over evaluation records.

Records: benchmark_id, parent_id, variant_type, model, benchmark, skill, arm, normalized_predicted, correct, magnitude_ratio, seq. A
cluster is a parent's records; it is reduced to a few numbers by partial aggregation before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import two_proportions
from ..functions.rules import answer_changing, atlas_verdict, canonical_label, label_rank
from .ranks import ranked
from .resampling import REPS, SEED, drawn, interval  # noqa: F401


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col("correct").cast("int")), F.lit(0.0)).alias("accuracy"))


def clusters(df: DataFrame, by_model: bool = False) -> DataFrame:
    """One row a cluster: sizes, accuracy, modal-answer consistency and the secondary measures (-1 where not applicable)."""
    keys = ["parent_id", *(["model"] if by_model else [])]
    changing, resample = answer_changing(F.col("variant_type")), F.col("variant_type") == "resample"
    ok = F.col("correct").cast("int")
    # Answers are counted first, so a cluster of any size is small at the second step.
    counts = df.groupBy(*keys, "normalized_predicted").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~changing).alias("kept"), F.count_if(resample).alias("again"), F.sum(ok).alias("right"),
        F.count_if(changing).alias("moved"), F.sum(F.when(changing, ok).otherwise(0)).alias("moved_right"),
        F.count_if(~changing & (F.col("variant_type") != "original")).alias("others"), F.sum(F.when(~changing & (F.col("variant_type") != "original"), ok).otherwise(0)).alias("others_right"),
        F.min_by(F.when(F.col("variant_type") == "original", ok), F.when(F.col("variant_type") == "original", F.col("seq"))).alias("o"), F.min(F.when(F.col("variant_type") == "original", F.col("seq"))).alias("o_seq"),
    )
    c = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.max("n").alias("top"), F.max("kept").alias("top_kept"), F.sum("again").alias("again"), F.max("again").alias("top_again"),
        *[F.sum(k).alias(k) for k in ("right", "moved", "moved_right", "others", "others_right")], F.min_by("o", "o_seq").alias("o"),
    )
    cons = F.when(F.col("kept") > 0, F.col("top_kept") / F.col("kept")).otherwise(F.col("top") / F.col("n"))
    agree = F.when(F.col("o").isNull() | (F.col("others") == 0), -1.0).otherwise(F.when(F.col("o") == 1, F.col("others_right")).otherwise(F.col("others") - F.col("others_right")) / F.col("others"))
    acc = F.col("right") / F.col("n")
    return c.select(
        *keys, F.col("n").alias("n_variants"), F.col("kept").alias("n_preserving"), acc.alias("accuracy"), cons.alias("consistency"), (acc * cons).alias("reliability"),
        F.when(F.col("moved") > 0, F.col("moved_right") / F.col("moved")).otherwise(-1.0).alias("accuracy_under_perturbation"), F.col("moved").alias("n_changing"), agree.alias("label_agreement"),
        F.when(F.col("again") >= 2, F.col("top_again") / F.col("again")).otherwise(-1.0).alias("decoding_consistency"), F.col("again").alias("n_resample"),
    )


def strongest_labels(hits: DataFrame) -> DataFrame:
    """benchmark_id, label: each item's strongest contamination label, canonical."""
    top = hits.groupBy("benchmark_id").agg(F.max(label_rank(F.col("label"))).alias("r"))
    return top.select("benchmark_id", F.when(F.col("r") == 3, "contaminated").when(F.col("r") == 2, "partial").otherwise("clean").alias("label"))


def with_labels(scores: DataFrame, labels: DataFrame, value: str = "label", default: object = "clean") -> DataFrame:
    """Adds the record's label: its own, else its parent's, else the default."""
    own = labels.select("benchmark_id", F.col(value).alias("_own"))
    up = labels.select(F.col("benchmark_id").alias("parent_id"), F.col(value).alias("_up"))
    return scores.join(own, "benchmark_id", "left").join(up, "parent_id", "left").withColumn(value, F.coalesce("_own", "_up", F.lit(default))).drop("_own", "_up")


def bh_qvalues(df: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values over all rows of a table of tests (small by its nature: one row a scope)."""
    m = df.count()
    w = Window.orderBy(p, *[c for c in df.columns if c != p])
    ranked = df.withColumn("_r", F.row_number().over(w))
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min(F.col(p) * m / F.col("_r")).over(Window.orderBy(F.desc("_r"))))).drop("_r")


def accuracy_gap(labelled: DataFrame, per_benchmark: bool = True, per_model: bool = True) -> DataFrame:
    """Contaminated against clean accuracy by scope, with z, p, q and status."""
    scope = F.concat_ws("::", F.col("benchmark") if per_benchmark else F.lit("all"), F.col("model") if per_model else F.lit("all"))
    ok = F.col("correct").cast("int")
    agg = [x for lab in ("contaminated", "partial", "clean") for x in (F.count_if(F.col("label") == lab).alias(f"n_{lab}"), F.sum(F.when(F.col("label") == lab, ok).otherwise(0)).alias(f"c_{lab}"))]
    g = labelled.groupBy(scope.alias("scope")).agg(*agg)
    z, p = two_proportions(F.col("c_contaminated"), F.col("n_contaminated"), F.col("c_clean"), F.col("n_clean"))
    both = (F.col("n_contaminated") > 0) & (F.col("n_clean") > 0)
    gap = lambda a: F.try_divide(F.col(f"c_{a}"), F.col(f"n_{a}")) - F.try_divide(F.col("c_clean"), F.col("n_clean"))
    out = g.select("scope", "n_contaminated", "n_partial", "n_clean", F.when(both, gap("contaminated")).otherwise(0.0).alias("gap"), gap("partial").alias("partial_gap"), z.alias("z"), p.alias("p"), F.when(both, "measured").otherwise("no_treatment_group").alias("status"))
    return bh_qvalues(out)


def pooled_gap(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mantel-Haenszel gap over strata; cells: keys, stratum, n1, c1 (contaminated), n0, c0 (clean)."""
    full = cells.where((F.col("n1") > 0) & (F.col("n0") > 0))
    w = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    g = F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0")
    return full.groupBy(*keys).agg((F.sum(w * g) / F.sum(w)).alias("pooled_gap"))


def gap_cells(labelled: DataFrame, keys: list[str], weight=None) -> DataFrame:
    w = weight if weight is not None else F.lit(1)
    one, zero, ok = F.col("label") == "contaminated", F.col("label") == "clean", F.col("correct")
    total = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    return labelled.groupBy(*keys, "stratum").agg(total(one).alias("n1"), total(one & ok).alias("c1"), total(zero).alias("n0"), total(zero & ok).alias("c0"))


def stratified_gap(labelled: DataFrame, keys: list[str], reps: int = REPS, seed: int = SEED) -> DataFrame:
    """Unadjusted and pooled gap by scope with a cluster-bootstrap interval; clusters are reduced to cell counts first."""
    cells = gap_cells(labelled, keys)
    plain = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n1", "c1", "n0", "c0")])
    plain = plain.select(*keys, (F.try_divide("c1", "n1") - F.try_divide("c0", "n0")).alias("unadjusted_gap"))
    per = gap_cells(labelled, [*keys, "parent_id"])
    replicates = drawn(per, [*keys, "stratum"], ["n1", "c1", "n0", "c0"], reps, seed=seed)
    ci = interval(pooled_gap(replicates, [*keys, "rep"]).withColumnRenamed("pooled_gap", "estimate"), keys)
    n = labelled.groupBy(*keys).agg(F.count_distinct("parent_id").alias("n_clusters"))
    return plain.join(pooled_gap(cells, keys), keys).join(ci, keys).join(n, keys)


def atlas(scores: DataFrame, labels: DataFrame, reps: int = REPS, seed: int = SEED) -> DataFrame:
    """Mean accuracy, consistency and reliability of the clusters of each skill, by contamination level and over all, with a verdict.

    ci_low, ci_high: a cluster bootstrap of the mean reliability; a cell of one cluster has its value at both ends.
    """
    skill = scores.groupBy("parent_id").agg(F.min("skill").alias("skill"))
    c = clusters(scores).join(skill, "parent_id").join(labels.select(F.col("benchmark_id").alias("parent_id"), "label"), "parent_id", "left").withColumn("level", F.coalesce("label", F.lit("clean")))
    c = c.select("parent_id", "skill", "accuracy", "consistency", "reliability", "n_preserving", F.explode(F.array(F.col("level"), F.lit("all"))).alias("level"))
    keys = ["skill", "level"]
    cells = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), *[F.avg(m).alias(m) for m in ("accuracy", "consistency", "reliability")], F.count_if(F.col("n_preserving") >= 2).alias("n_multi"))
    means = drawn(c.withColumn("one", F.lit(1)), keys, ["reliability", "one"], reps, seed=seed).withColumn("estimate", F.try_divide("reliability", "one"))
    cells = cells.join(interval(means, keys).drop("n_reps"), keys)
    verdict = atlas_verdict(F.col("accuracy"), F.col("reliability"), F.col("n_clusters"), F.col("n_multi"))
    # The reference's order of tests: an unprobed cell is accuracy_only whatever its size.
    return cells.select(*keys, "n_clusters", "accuracy", "consistency", "reliability", "ci_low", "ci_high", F.when(F.col("n_multi") == 0, "accuracy_only").otherwise(verdict).alias("verdict"))


def canonical_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").pivot("canon", ["contaminated", "partial", "clean"]).count() if "canon" in hits.columns else canonical_counts(hits.withColumn("canon", canonical_label(F.col("label"))))


def did_cells(df: DataFrame, keys: list[str], changed: Column | None = None) -> DataFrame:
    """Counts of the 2 x 2 cells of arm and condition, resample copies and records without an arm left out.

    changed: which records are the perturbed ones; by default those whose variant changes the answer.
    """
    use = df.where(F.col("arm").isin("seen", "unseen") & (F.col("variant_type") != "resample"))
    changed, ok = answer_changing(F.col("variant_type")) if changed is None else changed, F.col("correct").cast("int")
    cell = lambda name, arm, cond: (F.count_if((F.col("arm") == arm) & cond).alias(f"n_{name}"), F.sum(F.when((F.col("arm") == arm) & cond, ok).otherwise(0)).alias(f"c_{name}"))
    return use.groupBy(*keys).agg(*cell("so", "seen", ~changed), *cell("sp", "seen", changed), *cell("uo", "unseen", ~changed), *cell("up", "unseen", changed))


def did_value(prefix_n: str = "n_", prefix_c: str = "c_"):
    r = lambda k: F.try_divide(F.col(prefix_c + k), F.col(prefix_n + k))
    return (r("so") - r("uo")) - (r("sp") - r("up"))


def did(df: DataFrame, keys: list[str], reps: int = REPS, seed: int = SEED, changed: Column | None = None) -> DataFrame:
    """Difference in differences by model: (seen - unseen) on originals less that on perturbed, with a cluster-bootstrap interval."""
    cells = did_cells(df, keys, changed)
    per = did_cells(df, [*keys, "parent_id"], changed)
    names = [f"{a}_{k}" for a in "nc" for k in ("so", "sp", "uo", "up")]
    ci = interval(drawn(per, keys, names, reps, seed=seed).withColumn("estimate", did_value()), keys)
    full = F.least(*[F.col(f"n_{k}") for k in ("so", "sp", "uo", "up")]) > 0
    return cells.join(ci, keys, "left").select(*keys, *[f"n_{k}" for k in ("so", "sp", "uo", "up")], F.when(full, did_value()).alias("did"), "ci_low", "ci_high", F.when(full, "measured").otherwise("insufficient_cells").alias("status"))


def difficulty_bins(df: DataFrame, score: str, tie: str, bins: int = 3, rows: int | None = None) -> DataFrame:
    """Equal-frequency bins by score, ties by `tie`: rank * bins div n. Ranks are counted over range partitions of the score."""
    n = rows or df.count()
    k = max(1, min(bins, n))
    return ranked(df, [], [score, tie], "_r").withColumn("bin", F.least(F.lit(k - 1), F.floor(F.col("_r") * k / n)).cast("int")).drop("_r")
