"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are the distinct hashed byte 4-grams of the text, scaled by the class log-count ratio of each and brought to unit
length. A linear hinge-loss model is fitted to them by dual coordinate descent on at most SAMPLE labelled rows (those with the least
hash of their id), and its margins are turned into probabilities by a logistic curve fitted on a part of the sample that was left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

BITS, SAMPLE, FOLDS, CUT, BLEND, HELD = 16, 8_000, 5, 0.3, 0.5, 1 << 25  # HELD: buckets of all fitted rows together


def indicators(text: bytes | None, mask: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets of the byte 4-grams of a text (null: empty), which is held between blanks; mask: all False, stays so."""
    b = np.frombuffer(b"  " + (text or b"") + b"  ", np.uint8).astype(np.uint32)
    g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    mask[(g * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    at = np.flatnonzero(mask)
    mask[at] = False
    return at


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # class log-count ratio of each bucket
    weight: np.ndarray  # hinge weight times ratio of each bucket
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[at]).sum())) or 1.0
        return float(self.weight[at].sum()) / norm + self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -40, 40))))


def _ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for at, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[at] += 1
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, blend: float) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (the last one the bias') by dual coordinate descent; y: -1 or 1. blend: between mean magnitude and weights."""
    scaled = []
    for at in rows:
        x = ratio[at].astype(np.float64)
        scaled.append(x / (np.sqrt(np.square(x).sum()) or 1.0))
    w, bias, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    upper = np.where(y > 0, cost * max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), cost * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i], scaled[i]
            gradient = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (float(x @ x) + 1.0), 0.0), upper[i])
            if (d := new - alpha[i]) != 0:
                w[at] += d * y[i] * x
                bias += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return (1 - blend) * np.abs(w).sum() / max(1, np.count_nonzero(ratio)) + blend * w, bias


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, rounds: int = 20) -> Model:
    """rows: indicators. Without rows of both classes the model gives every text the share of label 1 (a half without any row)."""
    y = np.where(np.array(labels, np.int64) == 1, 1, -1) if labels else np.zeros(0, np.int64)
    if len(set(y.tolist())) < 2:
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(((y > 0).sum() + 0.5) / ((y < 0).sum() + 0.5))))
    apart = np.arange(len(rows)) % FOLDS == 0

    def train(keep: np.ndarray) -> Model:
        some = [r for r, k in zip(rows, keep, strict=True) if k]
        ratio = _ratio(some, y[keep])
        w, bias = _descend(some, y[keep], ratio, cost, rounds, BLEND)
        return Model(ratio, (w * ratio).astype(np.float32), bias, 1.0, 0.0)

    full = train(np.ones(len(rows), bool))
    part = train(~apart) if len(set(y[~apart].tolist())) == 2 and len(set(y[apart].tolist())) == 2 else full
    held = apart if part is not full else np.ones(len(rows), bool)
    a, b = _platt(np.array([part.margin(r) for r, k in zip(rows, held, strict=True) if k]), y[held])
    return Model(full.ratio, full.weight, full.bias, a, b)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that aren't held out; only their indicators reach the driver, HELD buckets at most.

    An id is fitted once, by the text of least hash among its rows. Ids are taken by their hash until either bound is met.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, bool)
        for b in batches:
            rows = [indicators(t, mask).astype("<u2").tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    df = df.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(F.col("id").cast("string"), F.col("y").cast("int"), "text")
    rows = staged(df.mapInArrow(features, "id string, y int, x binary"), "indicators")
    by_hash = lambda r: (zlib.crc32(r["id"].encode()), r["id"])
    ids, full = [], 0
    for r in sorted(rows.select("id", (F.octet_length("x") / 2).alias("n")).collect(), key=by_hash):  # `sample` rows
        if (full := full + r["n"]) > HELD:
            break
        ids.append((r["id"],))
    found = sorted(rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "id string")), "id", "left_semi").collect(), key=by_hash)
    return fit([np.frombuffer(r["x"], "<u2").astype(np.int64) for r in found], [r["y"] for r in found])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: the id), score and predicted of each row; no row is dropped, a null text counts as empty."""
    keep = keep or [id_col]
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights and ratios, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, m = np.zeros(1 << BITS, bool), held.value
        for b in batches:
            s = np.array([m.score(indicators(t.as_py(), mask)) for t in b.column(b.num_columns - 1).cast(pa.binary())], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    df = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "text")))
    return df.mapInArrow(score, docs.select(*keep).schema.add("score", "double").add("predicted", "integer"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose texts are predicted to be of label 1."""
    held, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample)), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, m = np.zeros(1 << BITS, bool), held.value
        for b in batches:
            yield b.filter(pa.array([m.score(indicators(t.as_py(), mask)) >= CUT for t in b.column(at).cast(pa.binary())], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each document; labels of held-out documents are never seen.

    Null and empty texts are scored like any other; a null id is not held out. An id labelled twice counts as the lower label. An empty
    labels table gives every text the score a half. Repeated rows are scored each for itself, an empty table has no rows. A text of any
    length is one set of 2**BITS indicators.
    """
    out = scored(docs, train(docs, labels, id_col, text_col, label_col, sample), id_col, text_col)
    return out.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")
