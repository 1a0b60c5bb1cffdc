"""The corpus scan as a stream: documents arrive as files, each item's containment is kept up to date in keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.containment import grams, hits, matches


def document_stream(spark: SparkSession, path: str, schema: str = "id string, text string, source string", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def scan_stream(stream: DataFrame, items: DataFrame, out: str, checkpoint: str, n: int = 13) -> StreamingQuery:
    """Per micro-batch matches are appended to `out`; a document is one row, so its counts close within its batch.

    A batch that is run again after a failure overwrites its own folder, so results are exact.
    """
    own = grams(items, "prompt", n)

    def each(batch: DataFrame, number: int) -> None:
        matches(own, batch, n, short=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best(spark: SparkSession, out: str) -> DataFrame:
    """item, containment: maximum over all batches so far."""
    return spark.read.parquet(out).groupBy("item").agg(F.max(F.col("n_shared") / F.col("n_grams")).alias("containment"))


PROGRESS = "item string, n_grams long, n_max long, n_union long"


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, n_grams, place, doc) of one task -> for each batch and item one row: the most grams of one document, and places as a bitmap.

    A document's rows stand together in one task; those that run over a batch's end are kept for the next.
    """
    rest = pd.DataFrame()
    for b in batches:
        b = pd.concat([rest, b])
        last = b["doc"] == b["doc"].iloc[-1] if len(b) else pd.Series(dtype=bool)
        rest, b = b[last], b[~last]
        yield from _one(b)
    yield from _one(rest)


def _one(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(b):
        rows = []
        for (item, n), of in b.groupby(["item", "n_grams"]):
            most = int(of.groupby("doc")["place"].nunique().max())
            rows.append((item, n, most, sum(1 << int(p) for p in of["place"].unique()).to_bytes((int(n) + 7) // 8, "little")))
        yield pd.DataFrame(rows, columns=["item", "n_grams", "most", "bits"])


def _kept(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of an item: most grams of one document, bitmap of the grams found anywhere. A row goes out where either has grown."""
    most, bits = state.get if state.exists else (0, b"")
    was, n, found = (most, bits), 0, int.from_bytes(bits, "little")
    for f in frames:
        for row in f.itertuples():
            n, most, found = int(row.n_grams), max(most, int(row.most)), found | int.from_bytes(row.bits, "little")
    now = (most, found.to_bytes((n + 7) // 8, "little"))
    state.update(now)
    if now != was:
        yield pd.DataFrame({"item": [key[0]], "n_grams": [n], "n_max": [most], "n_union": [found.bit_count()]})


def containment_stream(stream: DataFrame, items: DataFrame, out: str, checkpoint: str, n: int = 13, plain: bool = False) -> StreamingQuery:
    """Both containments of each item over all documents of a stream (id, text), as rows of `out` in a folder for each micro-batch.

    Documents meet the items' grams in their own task, which sends on one row for each item and batch of rows; an item's state is two
    numbers' worth: its best document's count, and a bit for each of its grams. A batch that is run again after a failure overwrites its
    own folder; the state is Spark's, under `checkpoint`. A document is one row and is counted once for each time it comes. Items without
    a gram, and those that nothing held yet, have no row. plain: tokens of the union definition.
    """
    found = hits(grams(items, "prompt", n, plain, short=not plain), stream, n, plain)
    parts = found.mapInPandas(_summed, "item string, n_grams long, most long, bits binary")
    kept = parts.groupBy("item").applyInPandasWithState(_kept, PROGRESS, "most long, bits binary", "update", "NoTimeout")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return kept.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, out: str) -> DataFrame:
    """item, n_grams, n_max, n_union as they stand now: both only grow, so the greatest of an item's rows is its last."""
    return spark.read.schema(PROGRESS).parquet(out).groupBy("item", "n_grams").agg(F.max("n_max").alias("n_max"), F.max("n_union").alias("n_union"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in event-time windows; works on a stream (late rows dropped by watermark) and on a table."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_by_id(stream: DataFrame, late: str = "1 day", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Each id once: resume without doing anything twice."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def repaired(old: DataFrame, again: DataFrame, key: str, finished: str = "finished") -> DataFrame:
    """old without its unfinished rows, and the rows of `again` whose key has no finished row; of several in `again` any one is taken."""
    kept = old.where(F.coalesce(F.col(finished), F.lit(False)))
    return kept.unionByName(again.dropDuplicates([key]).join(kept.select(key), key, "left_anti"))


def repair_stream(stream: DataFrame, table: str, key: str, checkpoint: str, finished: str = "finished") -> StreamingQuery:
    """The finished rows of a stream, old ones and those made again alike, appended to `table` once for each key.

    Keys that have their row are keyed state, so a batch only adds files and rewrites nothing; the table is read with its log of committed
    batches, so a batch that was cut off leaves nothing behind. Of several finished rows of a key in one batch any one is taken.
    """
    once = stream.where(F.coalesce(F.col(finished), F.lit(False))).dropDuplicates([key])
    return once.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def open_keys(stream: DataFrame, out: str, key: str, checkpoint: str, finished: str = "finished") -> StreamingQuery:
    """Keys with rows of which none is finished, as they stand after each micro-batch: what has to be made again.

    A key's state is whether any row of it was finished; keys whose state has changed are written to the batch's folder.
    """
    state = stream.groupBy(key).agg(F.bool_or(F.coalesce(F.col(finished), F.lit(False))).alias("done"))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_open(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The keys that open_keys() left open: done only ever turns true."""
    return spark.read.parquet(out).groupBy(key).agg(F.bool_or("done").alias("done")).where("not done").select(key)


def observed(df: DataFrame, name: str = "progress", text: str = "text", least: int = 40) -> DataFrame:
    """df, whose rows, characters and short rows are counted as they pass: in a stream's progress under `name`, in a batch's observation."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("chars"), F.count_if(F.length(text) < least).alias("short"))
