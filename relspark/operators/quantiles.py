"""Exact quantiles of any group size, by refining a histogram about the wanted order statistics.

A wanted order statistic of a group starts with the group's least and greatest value. Each round counts the values between its two bounds in
BINS equal bins (of the values and of their logarithms in turn, so that a heavy tail is parted too), which tasks count before anything is
shuffled, and takes the bin that holds the rank: its own least and greatest value are the next bounds. When at most FEW values are left, they are sorted.
No round moves a value to another task but those last few, and the driver sees one row of counts a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dropped, fresh, staged

BINS, FEW, ROUNDS, BROADCAST = 2_000, 500, 200, 200_000  # BROADCAST: wanted order statistics


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _log(v: Column) -> Column:
    """A logarithm that keeps the order of all doubles: least magnitudes come to about 1, zero to 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.least(F.abs(v), F.lit(1.7976931348623157e308))) + 746.0))


def order_statistics(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, k, v: the k-th value (from 0) of each group. values: g, v (double, not null; NaN is the greatest); wanted: g, k, lo, hi, n."""
    open_ = wanted.withColumn("below", F.lit(0).cast("long"))
    done = None

    def settled(df: DataFrame) -> DataFrame:
        return df.where("lo = hi").select("g", "k", F.col("lo").alias("v"))

    open_ = staged(open_, "order-statistics")
    for turn in range(ROUNDS):
        done = settled(open_) if done is None else done.unionAll(settled(open_))
        left = open_.where("lo < hi")
        if not left.where(F.col("n") > FEW).limit(1).count():
            break
        inside = values.join(_few(left), "g").where("v between lo and hi")
        # The bounds' distance may pass the largest double: halves do not.
        v, lo, hi = (_log(F.col(c)) if turn % 2 else F.col(c) / 2 for c in ("v", "lo", "hi"))
        place = F.floor(F.try_divide(v - lo, hi - lo) * BINS)
        bin_ = F.when(F.col("v") == F.col("hi"), BINS - 1).otherwise(F.least(F.greatest(F.coalesce(F.when(F.isnan(place), 0).otherwise(place), F.lit(0)), F.lit(0)), F.lit(BINS - 1)))
        bins = inside.groupBy("g", "k", "below", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows a window
        open_ = staged(bins.withColumn("before", F.col("below") + before).where("k >= before and k < before + n").select("g", "k", "lo", "hi", "n", F.col("before").alias("below")), "order-statistics")
    else:
        raise RuntimeError(f"order statistics did not settle in {ROUNDS} rounds")
    last = values.join(_few(left), "g").where("v between lo and hi").groupBy("g", "k", "below").agg(F.sort_array(F.collect_list("v")).alias("some"))  # FEW values
    return done.unionAll(last.select("g", "k", F.get("some", (F.col("k") - F.col("below")).cast("int")).alias("v")))


def quantiles(df: DataFrame, group: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """group's columns and one for each of `shares` (name: share from 0 to 1): linear interpolation between order statistics.

    Null values are left out; a group without another value has nulls, a NaN counts as the greatest. Null is a group like any other, no
    group at all is one row (none for an empty table). One group may hold all rows, and all of its values may be equal.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [F.col(c) for c in group]
    rows = df.select(F.struct(*keys, F.lit(0).alias(fresh(df, "all"))).alias("g"), value.cast("double").alias("v"))
    rows = staged(rows.select(F.to_json("g", {"ignoreNullFields": "false"}).alias("g"), F.col("g").alias("own"), "v"), "quantile-values")
    sizes = staged(rows.groupBy("g").agg(F.first("own").alias("own"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-groups")
    at = [(name, (F.col("n") - 1) * F.lit(float(p))) for name, p in shares.items()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")) for _, h in at])))
    wanted = sizes.where("n > 0").select("g", F.explode(ranks).alias("k"), "lo", "hi", "n")
    found = order_statistics(rows.where("v is not null").select("g", "v"), wanted)
    found = staged(found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")), "quantile-found")  # two values a share
    dropped(rows)
    low, high = (lambda h: F.element_at("m", F.floor(h).cast("long"))), (lambda h: F.element_at("m", F.ceil(h).cast("long")))
    out = sizes.join(found, "g", "left")
    value_at = lambda h: F.when(F.col("n") > 0, F.when(low(h) == high(h), low(h)).otherwise(low(h) + (high(h) - low(h)) * (h - F.floor(h))))
    return out.select(*[F.col(f"own.`{c}`") for c in group], *[value_at(h).alias(name) for name, h in at])
