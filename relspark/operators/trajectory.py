"""Checkpoints of a training run: names resolved to them, their order, and the step that brings an exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KNOWN = 10_000  # checkpoints


def resolved(rows: DataFrame, checkpoints: DataFrame, name: str = "name") -> DataFrame:
    """rows with the tag of the checkpoint that `name` names by tag or alias, in any case; null where it names none.

    checkpoints: tag, aliases, step, tier, exposed; a short list (KNOWN rows at most are taken to be one, which is what is broadcast).
    """
    own = checkpoints.select("tag", F.explode(F.concat(F.array("tag"), "aliases")).alias("_name")).select("tag", F.lower(F.trim("_name")).alias("_name")).distinct()
    own = F.broadcast(own) if checkpoints.count() <= KNOWN else own
    return rows.withColumn("_name", F.lower(F.trim(name))).join(own, "_name", "left").drop("_name")


def transitions(checkpoints: DataFrame, most: int = 3) -> DataFrame:
    """tag, step, before, intervention: checkpoints up to a tier in order, each with the one before it; intervention: it is exposed first."""
    w = Window.orderBy("step")  # a short list
    rows = checkpoints.where(F.col("tier") <= most)
    return rows.select("tag", "step", F.lag("tag").over(w).alias("before"), F.coalesce(F.col("exposed") & ~F.lag("exposed").over(w), F.lit(False)).alias("intervention"))
