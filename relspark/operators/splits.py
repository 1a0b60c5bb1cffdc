"""Matched treatment arms, balance, and where two chains of thought part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

SEED, BINS = 6198, 100_000


def _ranked(pool: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return ranked(pool.withColumn("_key", key), ["bin", "arm"], ["_key"], "r").withColumn("r", F.col("r") + 1).drop("_key")


def _small(bins: DataFrame) -> DataFrame:
    """A table of one row a bin, broadcast while there are at most BINS of them."""
    return F.broadcast(bins) if bins.limit(BINS + 1).count() <= BINS else bins


def matched(pool: DataFrame, per_arm: int, seed: int = SEED) -> DataFrame:
    """id, arm: as many of each arm from every bin as the smaller side allows, then topped up in pairs. pool: id, arm, bin."""
    places = _ranked(pool, seed)
    sizes = places.groupBy("bin").agg(F.count_if(F.col("arm") == "seen").alias("a"), F.count_if(F.col("arm") == "unseen").alias("b"))
    bins = sizes.agg(F.count(F.lit(1)).alias("k")).first()["k"]
    target = max(1, per_arm // max(1, bins))
    take = sizes.select("bin", F.least("a", "b", F.lit(target)).alias("take"))
    first = places.join(_small(take), "bin").where("r <= take").select("id", "arm")
    taken = take.agg(F.coalesce(F.sum("take"), F.lit(0)).alias("n")).first()["n"]
    left = ranked(places.where(F.col("r") > target), ["arm"], ["bin", "r"], "k").withColumn("k", F.col("k") + 1)
    spare = left.agg(F.count_if(F.col("arm") == "seen").alias("a"), F.count_if(F.col("arm") == "unseen").alias("b")).first()
    extra = min(per_arm - taken, spare["a"], spare["b"])
    return first.unionByName(left.where(F.col("k") <= extra).select("id", "arm"))


def step_matched(pool: DataFrame, seed: int = SEED) -> DataFrame:
    """Of every bin the smaller side's number from both arms."""
    places = _ranked(pool, seed)
    sizes = places.groupBy("bin").agg(F.least(F.count_if(F.col("arm") == "seen"), F.count_if(F.col("arm") == "unseen")).alias("m"))
    return places.join(_small(sizes), "bin").where("r <= m").select("id", "arm")


def balance(df: DataFrame, bin_: str = "stratum") -> DataFrame:
    b = df.groupBy(bin_).agg(F.count_if(F.col("arm") == "seen").alias("a"), F.count_if(F.col("arm") == "unseen").alias("b"))
    worst = F.max(F.abs(F.col("a") - F.col("b")))
    return b.agg(worst.alias("max_imbalance"), (worst <= 1).alias("balanced"))


def divergence(small: Column, large: Column, small_ok: Column, large_ok: Column) -> Column:
    """Category of the first step at which a small model's chain parts from a large one's."""
    plain = lambda a: F.transform(a, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    n = F.least(F.size(small), F.size(large))
    differs = F.zip_with(F.slice(plain(small), 1, n), F.slice(plain(large), 1, n), lambda x, y: x != y)
    at = F.coalesce(F.array_position(differs, F.lit(True)), F.lit(0)) - 1
    heavy = (F.array_max(F.transform(large, lambda x: F.regexp_count(x, F.lit(r"-?\d+(?:\.\d+)?")))) >= 3) & (F.size(large) >= 5)
    return (
        F.when(small_ok & large_ok, "no_divergence")
        .when(at < 0, F.when(F.size(small) < F.size(large), "premature_conclusion").otherwise("no_divergence"))
        .when(at == 0, "strategy_mismatch")
        .when((F.size(small) < F.size(large) - 1) & (at >= F.size(small) - 1), "premature_conclusion")
        .when(heavy & (at >= F.floor(F.size(large) / 2)), "capacity_failure")
        .otherwise("error_propagation")
    )
