"""Classification rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ANSWER_IS, as_sql

CHANGING = ("gsm_symbolic", "gsm_symbolic_official", "numeric_perturbation")


def answer_changing(variant: Column, flag: Column | None = None) -> Column:
    return variant.isin(*CHANGING) | (F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False))


def lexical_label(query: Column, doc: Column, score: Column) -> Column:
    """query, doc: normalised texts."""
    return F.when((query == "") | (doc == ""), "none").when((query == doc) | doc.contains(query) | (score >= 0.98), "exact").when(score >= 0.72, "near_duplicate").when(score >= 0.45, "paraphrase_candidate").otherwise("none")


def contamination_label(cosine: Column, overlap: Column) -> Column:
    return F.when((cosine > 0.90) | (overlap > 0.60), "contaminated").when((cosine > 0.75) | (overlap > 0.30), "partial").otherwise("clean")


def containment_verdict(value: Column, n_grams: Column) -> Column:
    return F.when(n_grams == 0, "too_short").when(value >= 0.80, "seen").when(value <= 0.10, "unseen").otherwise("ambiguous")


def canonical_label(label: Column) -> Column:
    return F.when(label.isin("contaminated", "exact", "near_duplicate"), "contaminated").when(label.isin("partial", "paraphrase_candidate"), "partial").otherwise("clean")


def label_rank(label: Column) -> Column:
    return F.when(label.isin("contaminated", "exact", "near_duplicate"), 3).when(label.isin("partial", "paraphrase_candidate"), 2).otherwise(1)


def atlas_verdict(acc: Column, rel: Column, n_clusters: Column, n_multi: Column, least: int = 3) -> Column:
    return (
        F.when(n_clusters < least, "insufficient_data").when(n_multi == 0, "accuracy_only").when((acc >= 0.6) & (rel < 0.3), "fragile")
        .when(rel >= 0.5, "genuine").when(rel >= 0.3, "partial").otherwise("gap")
    )


def transition_class(small: Column, large: Column, high: float = 0.50, low: float = 0.30, zero: float = 0.10) -> Column:
    """Of a skill's reliability from a smaller to a larger model."""
    return F.when((small >= high) & (large >= high), "scale_independent").when((large >= high) & (small < zero), "emergent").when((large < low) & (small < low), "scale_resistant").otherwise("amplified")


def rl_verdict(accuracy: Column, consistency: Column, tol: float = 0.02) -> Column:
    """accuracy, consistency: gains by post-training."""
    better, steadier = accuracy > tol, consistency > tol
    return F.when(better & steadier, "genuine_improvement").when(better, "accuracy_only").when((accuracy < -tol) | (consistency < -tol), "regression").otherwise("no_change")


def quadrant(acc: Column, cons: Column, cut: float = 0.5) -> Column:
    return F.when(acc >= cut, F.when(cons >= cut, "genuine").otherwise("fragile")).otherwise(F.when(cons >= cut, "consistent_gap").otherwise("random"))


def difficulty(rationale: Column, level: Column, prompt: Column) -> tuple[Column, Column]:
    """(score, method): annotated steps, else the stated level, else words plus five times numbers."""
    steps = F.regexp_count(F.coalesce(rationale, F.lit("")), F.lit(r"<<[^=<>]+=[^<>]+>>"))
    stated = F.regexp_extract(F.lower(F.coalesce(level, F.lit(""))), r"level\s*(\d+)", 1).try_cast("double")
    words = F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""))
    proxy = words.cast("double") + 5.0 * F.regexp_count(prompt, F.lit(r"-?\d+(?:\.\d+)?"))
    return F.when(steps > 0, steps.cast("double")).otherwise(F.coalesce(stated, proxy)), F.when(steps > 0, "gsm8k_steps").when(stated.isNotNull(), "math_level").otherwise("length_quantity")


def record_arm(arm: Column) -> Column:
    return F.when(arm.isin("seen", "unseen"), arm)


def record_condition(variant: Column, flag: Column | None = None) -> Column:
    return F.when(answer_changing(variant, flag), "perturbed").otherwise("original")


def probe_label(recalled: Column, abstained: Column, recall_first: bool = True) -> Column:
    if recall_first:
        return F.when(recalled, "recall").when(abstained, "abstain").otherwise("other")
    return F.when(abstained, "abstain").when(recalled, "recall").otherwise("other")


def extraction_tier(text: Column) -> Column:
    """How an answer can be read: marked, by a phrase, as the last number, not at all."""
    return F.when(text.rlike(as_sql(r"####\s*.+")), "1_marker").when(text.rlike(as_sql(ANSWER_IS)), "2_phrase").when(text.rlike(r"-?\d"), "3_last_number").otherwise("4_no_number")


def did_reading(did: Column, low: Column, high: Column) -> Column:
    return F.when((low <= 0) & (high >= 0), "no detectable difference between arms").when(did > 0, F.format_string("seen items lose %.3f more under perturbation", did)).otherwise(F.format_string("unseen items lose %.3f more under perturbation", -did))
