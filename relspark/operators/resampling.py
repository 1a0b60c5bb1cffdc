"""Cluster bootstrap: replicates as vectors of weights.

A cluster draws its weight in replicate r from u = (a r + b) mod PRIME, a and b set by a hash of the cluster: in one replicate the weights
of all clusters are independent, and of one cluster any two replicates are. No draw is shared, so nothing is shuffled but sums: each task
multiplies its clusters' values by their vectors of weights and passes on one row for each group and replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import PRIME, weight_cuts, weight_stream
from ..staging import dropped, fresh, staged

SEED, REPS, ROWS, GROUPS = 6198, 2_000, 512, 256


def drawn(df: DataFrame, keys: list[str], values: list[str], reps: int = REPS, cluster: str = "parent_id", seed: int = SEED, halves: bool = False) -> DataFrame:
    """keys, rep and the weighted sum of each of `values` in each replicate; df: rows of clusters that are reduced to sums before.

    Weights are Poisson(1), so a replicate's clusters are as many as there are on average; halves: 0 or 1 with equal chance. Null values
    count as 0, null keys are a group, a null cluster is one cluster. Groups whose weights are all 0 in a replicate have sums of 0 there.
    """
    a, b = (fresh(df, c) for c in ("a", "b"))
    first, step = weight_stream(F.col(cluster), seed)
    df = df.select(*keys, step.alias(a), first.alias(b), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    cuts, width = weight_cuts(halves), len(keys)
    schema = df.select(*keys).schema.add("rep", "integer")
    for v in values:
        schema = schema.add(v, "double")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            own = [pa.array([k[i] for k, _ in rows], kinds[i]).take(pa.array(np.repeat(np.arange(len(rows)), reps))) for i in range(width)]
            sums = np.concatenate([m for _, m in rows])
            return pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(reps, dtype=np.int32), len(rows))), *(pa.array(sums[:, i]) for i in range(len(values)))], names=schema.names)

        r = np.arange(reps, dtype=np.int64)
        for batch in batches:
            kinds = [batch.column(i).type for i in range(width)]
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                u = (part.column(width).to_numpy()[:, None] * r + part.column(width + 1).to_numpy()[:, None]) % PRIME
                w = sum((u >= c).astype(np.uint8) for c in cuts).astype(np.float64)
                x = np.stack([part.column(width + 2 + i).to_numpy() for i in range(len(values))], 1)
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*(part.column(j).to_pylist() for j in range(width)), strict=True) if width else [()] * part.num_rows):
                    groups.setdefault(k, []).append(i)
                for k, at in groups.items():
                    sums = w[at].T @ x[at]
                    held[k] = held[k] + sums if k in held else sums
                if len(held) > GROUPS:
                    yield out()
        if held:
            yield out()

    return df.mapInArrow(add, schema).groupBy(*keys, "rep").agg(*[F.sum(v).alias(v) for v in values])


def relabelled(df: DataFrame, size: int, values: list[str], reps: int = REPS, cluster: str = "parent_id", seed: int = SEED, spread: float = 6.0) -> DataFrame:
    """rep and, of each of `values`, the sum over the `size` clusters (one row each in df) that replicate draws into the arm: those of least u.

    Arms have the same size in every replicate, equal draws go by the cluster's name. The last cluster of an arm has a draw near size / N of
    the range: clusters well under that are added up where they are, only those within `spread` standard errors (some 2 * spread * the root
    of N in a replicate) become rows and are ranked. If a replicate's last cluster lies outside, all are counted again with wider bounds.
    Null values count as 0. size is 0 to N; others raise a ValueError.
    """
    n = df.count()
    if not 0 <= size <= n:
        raise ValueError(f"{size} of {n} clusters")
    a, b, name = (fresh(df, c) for c in ("a", "b", "name"))
    first, step = weight_stream(F.col(cluster), seed)
    rows = df.select(step.alias(a), first.alias(b), F.col(cluster).cast("string").alias(name), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    schema = "rep int, u long, cluster string, n long, " + ", ".join(f"v{i} double" for i in range(len(values)))
    while True:
        at, width = size / max(n, 1), spread * (0.25 / max(n, 1)) ** 0.5
        low, high = int(max(0.0, at - width) * PRIME), int(min(1.0, at + width) * PRIME)

        def part(batches: Iterator[pa.RecordBatch], low=low, high=high) -> Iterator[pa.RecordBatch]:
            r, kinds = np.arange(reps, dtype=np.int64), [pa.int32(), pa.int64(), pa.string(), pa.int64(), *(pa.float64(),) * len(values)]
            names = ["rep", "u", "cluster", "n", *(f"v{i}" for i in range(len(values)))]
            sums, below = np.zeros((reps, len(values))), np.zeros(reps, np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    some = batch.slice(lo, ROWS)
                    u = (some.column(0).to_numpy()[:, None] * r + some.column(1).to_numpy()[:, None]) % PRIME
                    x = np.stack([some.column(3 + i).to_numpy() for i in range(len(values))], 1)
                    under = u < low
                    sums += under.T.astype(np.float64) @ x
                    below += under.sum(0)
                    i, j = np.nonzero(~under & (u <= high))
                    cols = [j.astype(np.int32), u[i, j], some.column(2).take(pa.array(i)), np.ones(len(i), np.int64), *(x[i, k] for k in range(len(values)))]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            cols = [r.astype(np.int32), None, None, below, *sums.T]
            yield pa.RecordBatch.from_arrays([pa.nulls(reps, t) if c is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        found = staged(rows.mapInArrow(part, schema), "relabelled")
        total = found.where("u is null").groupBy("rep").agg(F.sum("n").alias("below"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(values))])
        near = found.where("u is not null").groupBy("rep").agg(F.sum("n").alias("near"))
        missed = total.join(near, "rep", "left").where((F.col("below") > size) | (F.col("below") + F.coalesce("near", F.lit(0)) < size)).limit(1).count()
        if not missed:
            break
        dropped(found)
        spread *= 4
    w = Window.partitionBy("rep").orderBy("u", "cluster")
    ranked = found.where("u is not null").withColumn("place", F.row_number().over(w)).join(F.broadcast(total.select("rep", "below")), "rep").where(F.col("place") + F.col("below") <= size)  # reps rows
    rest = ranked.groupBy("rep").agg(*[F.sum(f"v{i}").alias(f"r{i}") for i in range(len(values))])
    return total.join(rest, "rep", "left").select("rep", *[(F.col(f"s{i}") + F.coalesce(f"r{i}", F.lit(0.0))).alias(v) for i, v in enumerate(values)])


def interval(estimates: DataFrame, keys: list[str], value: str = "estimate") -> DataFrame:
    """ci_low, ci_high (2.5 and 97.5 percent) and n_reps of a statistic's replicates; nulls are left out."""
    return estimates.groupBy(*keys).agg(F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"), F.count(value).alias("n_reps"))
