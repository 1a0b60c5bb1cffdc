"""Shared helpers: the documents table, salted ranks and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import dealt, dropped, fresh, small_batches, staged  # noqa: F401


IN_MEMORY = 1 << 20  # edges that one task holds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; a small one of few files is dealt over all cores."""
    small_batches(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def row_order(df: DataFrame) -> Column | None:
    """The place of each row of a table in its files, which are numbered by the partitions that wrote them; None if df is not read from files."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return None
    number = lambda p: F.coalesce(F.regexp_extract("_metadata.file_name", p, 1).try_cast("int"), F.lit(0))
    return F.struct(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))


def salted_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, each: int | None = None) -> DataFrame:
    """Add `out`: 0-based rank within `group`, without ever putting one group into one task.

    Rows are dealt by a hash of `order` to buckets of about `each` rows (default: 2,000 or the root of `rows`, so that buckets and counts
    of buckets grow alike); the rank is the count of the group's earlier buckets plus the row's place in its own. df must give the same
    rows when it is read twice (a staged table); `rows` is its row count. Null is a group like any other.
    """
    salt, n, base, own = (fresh(df, c) for c in ("salt", "n", "base", "own"))
    keys = [fresh(df, f"group{i}") for i in range(len(group))]
    # Equal keys that are never null join and rank in one distribution of the rows.
    key = {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, group, strict=True)}
    df_ = df.withColumns(key | {salt: F.pmod(F.xxhash64(*order), F.lit(max(1, -(-rows // (each or max(2_000, isqrt(rows)))))))})
    before = F.sum(n).over(Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    before = df_.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias(n)).select(*keys, salt, F.coalesce(before, F.lit(0)).alias(base))
    left = df_.withColumn(own, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)) - 1)
    return left.join(before, [*keys, salt]).select(*df.columns, (F.col(own) + F.col(base)).cast("long").alias(out))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges; root is the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v -> one edge from each node to the least one that the rows at hand link it to, for IN_MEMORY rows at a time."""
    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, root = _forest(*(np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1)))
        more = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(root[more])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= IN_MEMORY:
            held = [solve(held)]
            if held[0].num_rows > IN_MEMORY // 2:
                yield held.pop()
    if held:
        yield solve(held)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected graph of longs (columns a, b): root is the component's least node.

    Tasks first contract their own edges to forests. What is left goes through alternating large-star and small-star rounds until it
    settles; once there are at most IN_MEMORY edges, which one task can hold, that task settles them at once. Each round is a table in
    the shared folder and the only thing that reaches the driver is one row of counts. Nodes without an edge to another node do not appear.
    """
    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = staged(df, "edges")
        return df, tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    # Edges are staged before they are contracted: a second Python function in one task would be a second worker beside the first.
    both, seen = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if seen[0] > IN_MEMORY:
        last = both
        both, seen = settle(both.mapInArrow(_contracted, "u long, v long"))
        dropped(last)
    for _ in range(max_rounds):
        if seen[0] <= IN_MEMORY:
            last = both
            both = staged(both.coalesce(1).mapInArrow(_contracted, "u long, v long"), "edges")
            dropped(last)
            break
        sym = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        last = both
        both, now = settle(small)
        dropped(last)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = both.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.unionAll(root.select(F.col("root").alias("node"), "root").distinct())
