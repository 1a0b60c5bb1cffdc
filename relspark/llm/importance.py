"""Importance resampling towards a target distribution over hashed word runs, by an external sort-count.

Every run of 1 to 3 words falls in one of BUCKETS buckets. Tasks write packed streams of uint16 bucket numbers, a block of documents to a
row, with the offset at which each document begins. The streams are read again twice: once a block at a time to be sorted and run-length
encoded, whose counts Spark merges (BUCKETS rows, whatever the corpus), and once for each document's weight, the sum of its buckets'
gains, gathered with np.add.reduceat over the offsets. Documents are drawn by weight and Gumbel noise that follows from their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import staged

BUCKETS, SIZE, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
BLOCK, PART = 1 << 20, 1 << 20  # buckets of one row of a stream, bytes of a text at once
#: A-Z in lower case, and blanks for what is no digit, letter or byte of a longer character.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def buckets(text: bytes | None) -> tuple[np.ndarray, int]:
    """Buckets (uint16) of all runs of 1 to SIZE words of a text, repeats included, and the number of its words; null: none."""
    folded = (text or b"").translate(FOLD)
    last: list[list[int]] = [[] for _ in range(SIZE - 1)]  # checksums of the runs that end where a part ended
    out, n, at = [], 0, 0
    while at < len(folded):
        end = min(len(folded), at + PART)
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        at, n = end, n + len(words)
        if not words:
            continue
        runs = list(map(zlib.crc32, words))
        out.append(np.array(runs, np.int64))
        # A run of k words is the checksum of the run before its last word, carried on over a blank and that word.
        joined = [b" " + w for w in words]
        for k in range(SIZE - 1):
            before = last[k] + runs
            last[k] = before[-1:]
            runs = list(map(zlib.crc32, joined[len(joined) + 1 - len(before) :], before))
            out.append(np.array(runs, np.int64))
    return (np.concatenate(out) % BUCKETS).astype(np.uint16) if out else np.zeros(0, np.uint16), n


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (ids, offsets, words, stream), BLOCK buckets at least but for a task's last row and a batch's; a text is never parted."""
    for b in batches:
        held: list[np.ndarray] = []
        words: list[int] = []
        first = full = 0

        def row(upto: int) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in held], dtype=np.int64)))
            arrays = [pa.array([b.column(0).slice(first, upto - first).to_pylist()], pa.list_(b.schema.field(0).type)), pa.array([ends], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([words], pa.list_(pa.int64())), pa.array([np.concatenate(held).astype("<u2").tobytes()], pa.binary())], names=["ids", "offsets", "words", "stream"])

        for i, text in enumerate(b.column(1).cast(pa.binary())):
            found, n = buckets(text.as_py())
            held.append(found)
            words.append(n)
            full += len(found)
            if full >= BLOCK:
                yield row(i + 1)
                held, words, first, full = [], [], i + 1, 0
        if held:
            yield row(b.num_rows)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed streams of a table's texts, written to the shared folder."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    return staged(df.mapInArrow(_written, f"ids array<{kind}>, offsets array<long>, words array<long>, stream binary"), "streams")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's stream is sorted and run-length encoded; a task sends on the sum of its blocks."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column(0):
            ordered = np.sort(np.frombuffer(x.as_py(), "<u2"))
            starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            total[ordered[starts]] += np.diff(np.concatenate((starts, [len(ordered)])))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def counts(written: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the streams; at most BUCKETS rows reach the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in written.select("stream").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's add-one smoothed share in the target over that in the corpus, in doubles."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document of the streams."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offsets, words, stream in zip(*b.columns, strict=True):
                ends = offsets.values.to_numpy()
                n, g = np.diff(ends), gain[np.frombuffer(stream.as_py(), "<u2")]
                weight, some = np.zeros(len(n), np.int64), n > 0
                if some.any():  # an empty document's offset is the next one's: reduceat is asked for the others alone
                    weight[some] = np.add.reduceat(g, ends[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = written.schema["ids"].dataType.elementType.simpleString()
    return written.mapInArrow(gather, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel draw that follows from seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with `least_words` words, floor(percent N / 100) of highest score are drawn, equal scores to the smaller id. A null or
    empty text, and one without a word, has no features and weight 0. Repeated rows count each for itself and are ranked one after the
    other, rows of one id by weight and features. A null id draws the noise of an empty one and comes before all others among equals. An
    empty table has no rows; an empty target gives gains of the corpus against no evidence. Other columns are not looked at. Texts of any
    length are read in parts; one text's buckets (two bytes a run) are one row's at least.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent is from 0 to 100")
    written = streams(docs, id_col, text_col)
    aim = counts(streams(target.withColumn(text_col, F.col(target_text)).select(F.lit(0).alias(id_col), text_col), id_col, text_col))
    scored = weighed(written, gains(counts(written), aim)).withColumn("score", F.col("weight") + noise("doc_id", seed))
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = ranked(scored.where(fit).withColumn("down", -F.col("score")), [], ["down", "doc_id", "weight", "n_features"], "at")
    cols = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~fit).select(*cols, F.lit(None).cast("long").alias("rank"))
    return order.select(*cols, F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank")).unionAll(rest)
