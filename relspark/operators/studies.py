"""Checks that a study makes of its own parts: termination, thresholds, metrics, variants and split sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import answer_changing

RATE = 0.85  # share of finished rows that a model needs


def termination(df: DataFrame, value: str = "value", least: float = RATE) -> DataFrame:
    """model, n, n_finished, median_value (the upper one of an even number), passes."""
    upper = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    done = F.avg(F.col("finished").cast("int")) >= least
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("finished").alias("n_finished"), upper.alias("median_value"), done.alias("passes"))


def calibrated(df: DataFrame, thresholds: list[float], value: str = "best", truth: str = "truth") -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of a score against the truth; precision and recall are 1 where nothing speaks against them."""
    hit, right = F.col(value) >= F.col("threshold"), F.col(truth)
    a = df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    a = a.groupBy("threshold").agg(F.count_if(hit & right).alias("tp"), F.count_if(hit & ~right).alias("fp"), F.count_if(~hit & right).alias("fn"))
    rate = lambda c: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(c)), F.lit(1.0))
    a = a.withColumns({"precision": rate("fp"), "recall": rate("fn")})
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def best_threshold(calibration: DataFrame) -> DataFrame:
    """The threshold of greatest F1, then precision, then the least."""
    return calibration.orderBy(F.desc("f1"), F.desc("precision"), "threshold").limit(1).select("threshold", "f1")


def metric_validation(scores: DataFrame, genuine: Column) -> DataFrame:
    """genuine, fragile, separation: mean cluster accuracy of items that are known to be solved and those that are not."""
    c = scores.groupBy("parent_id").agg(F.avg(F.col("correct").cast("int")).alias("a")).withColumn("g", genuine)
    g, f = F.avg(F.when(F.col("g"), F.col("a"))), F.avg(F.when(~F.col("g"), F.col("a")))
    return c.agg(g.alias("genuine"), f.alias("fragile"), (g - f).alias("separation"))


def validated_variants(df: DataFrame, answer: str = "answer") -> DataFrame:
    """n, n_orphans, n_preserving, n_ok of variants against their originals: a preserving one keeps its original's answer."""
    gold = df.where("variant_type = 'original'").groupBy("parent_id").agg(F.min(answer).alias("gold"))
    v = df.where("variant_type <> 'original'").join(gold, "parent_id", "left")
    same = ~answer_changing(F.col("variant_type"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold").isNull()).alias("n_orphans"), F.count_if(same).alias("n_preserving"), F.count_if(same & (F.col(answer) == F.col("gold"))).alias("n_ok"))


def split_summary(pool: DataFrame, chosen: DataFrame, containment: DataFrame, per_arm: int, seen: float = 0.8, unseen: float = 0.1) -> DataFrame:
    """arm, n, pool, not_seen, not_unseen, unmatched, diagnosis: what each arm holds and why its other items were left out.

    pool: id, arm; chosen: id, arm; containment: id, containment.
    """
    df = pool.join(containment, "id", "left").join(chosen.select("id", F.lit(True).alias("in")), "id", "left")
    v, out = F.coalesce("containment", F.lit(0.0)), F.col("in").isNull()
    low, high = out & (F.col("arm") == "seen") & (v < seen), out & (F.col("arm") == "unseen") & (v > unseen)
    a = df.groupBy("arm").agg(F.count_if(~out).alias("n"), F.count(F.lit(1)).alias("pool"), F.count_if(low).alias("not_seen"), F.count_if(high).alias("not_unseen"), F.count_if(out & ~low & ~high).alias("unmatched"))
    short = F.when(F.col("n") >= per_arm, "full").when(F.col("not_seen") + F.col("not_unseen") > F.col("unmatched"), "evidence").otherwise("matching")
    return a.withColumn("diagnosis", short)
