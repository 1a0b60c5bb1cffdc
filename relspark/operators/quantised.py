"""An approximate vector index: inverted lists over product-quantised codes, and an exact rerank of the best few.

A unit vector goes to the list of its nearest centroid; its difference from that is cut into parts of a few dimensions, each of which is
replaced by the nearest of 256 code words, so a row costs a byte a part. Centroids and code words are fitted on a bounded sample; every row has its list and its code. A search reads codes, not vectors:
queries are held exactly (asymmetric), a row's code stands for its vector, and in each task only the queries that probe a row's list
meet it. What each task keeps is the best RERANK times k of each query; of those the vectors are looked up and compared exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.answers import dot, unit
from ..staging import staged
from .vectors import PART, QUERIES, ROWS, _best, _unit, fit_lists

WORDS, DIMS, SAMPLE, RERANK = 256, 4, 20_000, 10  # code words of a part, dimensions of a part, sampled rows, exact comparisons for each of k


@dataclass(frozen=True)
class Codec:
    """Centroids of the lists (lists x dims) and code words (parts x WORDS x dims of a part)."""

    centroids: np.ndarray
    words: np.ndarray

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts, the last one filled up with zeros."""
        n, size = len(self.words), self.words.shape[2]
        return np.pad(x, ((0, 0), (0, n * size - x.shape[1]))).reshape(len(x), n, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit rows."""
        lists = np.round(x @ self.centroids.T, 9).argmax(1).astype(np.int32)
        cut = self.parts(x - self.centroids[lists])
        near = [((w * w).sum(1)[None, :] - 2 * cut[:, j] @ w.T).argmin(1) for j, w in enumerate(self.words)]
        return lists, np.stack(near, 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all code words: queries x (parts * WORDS)."""
        return np.einsum("qpd,pwd->qpw", self.parts(q), self.words).reshape(len(q), -1)

    def scores(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Queries x rows of one list: the sum over parts of the query's table at the row's code, less the query's product with the centroid."""
        out = np.zeros((len(tables), len(codes)))
        for j in range(codes.shape[1]):
            out += tables[:, j * WORDS + codes[:, j].astype(np.int64)]
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The rows that codes stand for, without their centroid: rows x (parts * dims); products with a query's parts are its scores()."""
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], 1)


def fit(index: DataFrame, lists: int | None = None, dims: int = DIMS, sample: int = SAMPLE, rounds: int = 8, seed: int = 6198) -> Codec:
    """Centroids and code words, by k-means on at most `sample` rows of least id hash. dims: dimensions of one part."""
    centroids = fit_lists(index, lists, sample, seed=seed)
    rows = index.orderBy(F.xxhash64("id")).limit(sample).select("embedding").toArrow().column(0)
    if not len(rows):
        return Codec(centroids, np.zeros((0, WORDS, dims)))
    x, rng = _unit(rows), np.random.default_rng(seed)
    cut = Codec(centroids, np.zeros((-(-x.shape[1] // dims), WORDS, dims))).parts(x - centroids[np.round(x @ centroids.T, 9).argmax(1)])
    words = []
    for j in range(cut.shape[1]):
        a = cut[:, j]
        w = a[rng.choice(len(a), WORDS, replace=len(a) < WORDS)]
        for _ in range(rounds):
            near = ((w * w).sum(1)[None, :] - 2 * a @ w.T).argmin(1)
            n = np.bincount(near, minlength=WORDS)
            sums = np.stack([np.bincount(near, a[:, d], WORDS) for d in range(dims)], 1)
            w = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], w)
        words.append(w)
    return Codec(centroids, np.stack(words))


def coded(df: DataFrame, codec: Codec) -> DataFrame:
    """(id, embedding, list, code) of every row."""
    held = df.sparkSession.sparkContext.broadcast(codec)  # LISTS centroids and WORDS words a part

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists, codes = held.value.encode(_unit(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "embedding", "list", "code"])

    df = df.select(F.col("id").cast("long").alias("id"), "embedding")
    return df.mapInArrow(encode, StructType([*df.schema.fields, StructField("list", IntegerType()), StructField("code", BinaryType())]))


def _probed(q: np.ndarray, codec: Codec, probes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each list the queries that probe it, and the lists that any does."""
    n = min(probes, len(codec.centroids))
    near = np.argsort(-np.round(q @ codec.centroids.T, 9), axis=1, kind="stable")[:, :n]
    by = [np.flatnonzero((near == i).any(1)) for i in range(len(codec.centroids))]
    return by, np.unique(near)


def search(queries: DataFrame, index: DataFrame, codec: Codec, k: int = 20, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query, neighbor, cosine, rank: the k best of each query by exact cosine among the rerank * k best by code, ties by id.

    queries: (id, embedding), a stated set, in blocks of QUERIES rows; index: coded() or a loaded table of it; probes: lists that a query
    looks into, by default all (then only codes save reading). A query without rows in its lists has none here; an empty table gives none.
    """
    spark, keep = index.sparkSession, k * rerank
    probes = probes or len(codec.centroids)
    blocks, near = max(1, -(-queries.count() // QUERIES)), None
    for block in range(blocks if len(codec.words) else 0):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select(F.col("id").cast("long").alias("id"), "embedding").toArrow()  # about QUERIES rows
        if not part.num_rows:
            continue
        ids, q = part.column("id").to_numpy(), _unit(part.column("embedding"))
        by, used = _probed(q, codec, probes)
        held = spark.sparkContext.broadcast((ids, q, by, codec))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, by, codec = held.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            full = 0

            def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                return _best(*(np.concatenate([best[i], *(m[i] for m in more)]) for i in range(3)), keep)

            for b in batches:
                own, lists = b.column(0).to_numpy(), b.column(1).to_numpy()
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                for one in np.unique(lists):
                    if not len(by[one]):
                        continue
                    rows = np.flatnonzero(lists == one)
                    for lo in range(0, len(by[one]), 256):  # a few queries at a time
                        some = by[one][lo : lo + 256]
                        cut, base = codec.parts(q[some]).reshape(len(some), -1), q[some] @ codec.centroids[one]
                        for at in range(0, len(rows), ROWS):
                            r = rows[at : at + ROWS]
                            s = cut @ codec.decoded(codes[r]).T + base[:, None]  # as scores(), in one product
                            least = np.partition(s, len(r) - keep, axis=1)[:, len(r) - keep] if len(r) > keep else np.full(len(some), -np.inf)
                            i, j = np.nonzero(s >= least[:, None])
                            more.append((some[i], own[r[j]], s[i, j]))
                            full += len(i)
                            if full > 1 << 20:
                                best, more, full = settled(), [], 0
            best = settled()
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "neighbor", "score"])

        rows = index if len(used) == len(codec.centroids) else index.where(F.col("list").isin(*used.tolist()))  # prunes the folders of lists
        found = rows.select("id", "list", "code").mapInArrow(scan, "query long, neighbor long, score double")
        first = Window.partitionBy("query").orderBy(F.desc("score"), "neighbor")
        found = staged(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).select("query", "neighbor"), "near-by-code")
        held.destroy()
        near = found if near is None else near.unionAll(found)
    if near is None:
        return spark.createDataFrame([], "query long, neighbor long, cosine double, rank int")
    vectors = index.select(F.col("id").alias("neighbor"), F.col("embedding").alias("x"))
    own = queries.select(F.col("id").cast("long").alias("query"), unit(F.col("embedding")).alias("q"))
    exact = vectors.join(near, "neighbor").join(own, "query").select("query", "neighbor", F.round(dot(F.col("q"), unit(F.col("x"))), 9).alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbor")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def save(index: DataFrame, codec: Codec, path: str) -> None:
    """The coded rows in a folder for each list, the centroids, the code words and a description beside them.

    Rows are dealt by list, and a list of over PART rows by id as well, so a list is a few files however many tasks wrote it.
    """
    spark = index.sparkSession
    rows = staged(coded(index, codec), "coded")
    sizes = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))  # one row a list
    dealt = rows.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt.repartition("list", "part").select(*rows.columns).write.partitionBy("list").parquet(f"{path}/rows")
    table = lambda x: spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "i int, v array<double>").coalesce(1)
    table(codec.centroids).write.parquet(f"{path}/centroids")
    table(codec.words).write.parquet(f"{path}/words")
    meta = {"kind": "inverted lists of codes", "metric": "cosine", "centroids": list(codec.centroids.shape), "words": list(codec.words.shape)}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Codec]:
    """The coded rows and the codec of a saved index; a ValueError if they are not what the description says."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])

    def array(name: str) -> np.ndarray:
        rows = sorted(spark.read.parquet(f"{path}/{name}").collect())  # as many rows as lists or parts
        flat = np.array([x for r in rows for x in r["v"]], np.float64)
        if flat.size != np.prod(meta[name]):
            raise ValueError(f"{path}/{name} holds {flat.size} numbers, not {meta[name]}")
        return flat.reshape(meta[name])

    return spark.read.parquet(f"{path}/rows"), Codec(array("centroids"), array("words"))
