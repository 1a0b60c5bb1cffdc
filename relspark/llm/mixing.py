"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its i-th block (from 0) released at floor(i / w) and due at ceil((i + 1) / w); earliest deadline first among
the released blocks fills one slot after another, so after any number t of slots each source has had less than one block more or less
than w t. One hyperperiod of slots is scheduled on the driver and repeats, so a block's slot follows from its place in its source. It has
as many slots as make each source's share whole, so given weights are met as they are; weights that would need more than MAX_SLOTS are
rounded to that many, which drift() measures. Where no weights are given, they are the rounded roots of the sources' sizes. A source's documents are ordered by a
hash of their ids; places are counted in salted buckets, so no source is gathered in one task. All documents are kept: where a source
has run out, its slots stay empty and the others go on.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor, inf, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, salted_rank, staged

BLOCK, SLOTS, MAX_SLOTS, TEMPERATURE, SOURCES = 16, 1 << 14, 1 << 18, 0.5, 50_000
COLUMNS = ["block_index", "release", "deadline", "slot", "position"]


def targets(weights: dict[str, float]) -> dict[str, Fraction]:
    """Weights as shares of one, as they are written in decimals."""
    if any(not 0 < w < inf for w in weights.values()):
        raise ValueError("weights must be above zero")
    exact = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def shares(weights: dict[str, float], most: int = MAX_SLOTS) -> dict[str, int]:
    """Slots of each source in one hyperperiod: exact where `most` slots can hold whole shares, else rounded.

    Rounding is to the largest remainders over `most` slots, of which each source has one at least.
    """
    exact = targets(weights)
    whole = lcm(*(w.denominator for w in exact.values())) if exact else 1
    if whole <= most:
        return {s: int(w * whole) for s, w in exact.items()}
    slots = max(most, 4 * len(weights))
    out = {s: max(1, floor(w * slots)) for s, w in exact.items()}
    left = slots - sum(out.values())
    for s in sorted(exact, key=lambda s: (floor(exact[s] * slots) - exact[s] * slots, s))[: max(0, left)]:
        out[s] += 1
    return out


def drift(weights: dict[str, float]) -> float:
    """Blocks a slot by which the schedule's share of a source is off its weight at most; 0.0 where shares are exact.

    After t slots each source has had less than 1 + t drift() blocks more or less than its weight times t.
    """
    exact, parts = targets(weights), shares(weights)
    total = sum(parts.values())
    return max((float(abs(exact[s] - Fraction(k, total))) for s, k in parts.items()), default=0.0)


def schedule(parts: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """(release, deadline, slot) of each block of one hyperperiod, by source."""
    total = sum(parts.values())
    windows = {s: [(floor(Fraction(i * total, k)), ceil(Fraction((i + 1) * total, k))) for i in range(k)] for s, k in parts.items()}
    out: dict[str, list[tuple[int, int, int]]] = {s: [] for s in parts}
    waiting = [(w[0][0], s) for s, w in windows.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (windows[s][len(out[s])][1], s))
        due, s = heapq.heappop(ready)
        out[s].append((windows[s][len(out[s])][0], due, slot))
        if len(out[s]) < parts[s]:
            heapq.heappush(waiting, (windows[s][len(out[s])][0], s))
    return out


def _slotted(df: DataFrame, weights: dict[str, float] | None, block: int, source: str, order: list[str], temperature: float, at: dict[str, str]) -> DataFrame:
    """df, staged, with columns for block_index, release, deadline, slot and position, named by `at`; source: a column without nulls."""
    counts = {r[source]: r["n"] for r in df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: map them to fewer, by host family for one")
    given = weights or {s: n**temperature for s, n in counts.items()}
    if missing := set(counts) - set(given):
        raise ValueError(f"no weight for {sorted(missing)}")
    parts = shares(given) if weights else shares({s: max(1, round(w / sum(given.values()) * max(SLOTS, 4 * len(given)))) for s, w in given.items()})
    period = sum(parts.values())
    rows = [(s, i, parts[s], *x) for s, blocks in schedule(parts).items() for i, x in enumerate(blocks)]
    rank, k, i, r, d, s = (fresh(df, c) for c in ("rank", "k", "i", "r", "d", "s"))
    # One row for each slot of the hyperperiod: MAX_SLOTS or four a source at most, of which there are SOURCES.
    kinds = (pa.string(), *(pa.int64(),) * 5)
    plan = df.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[source, i, k, r, d, s]))
    ranked = salted_rank(df, [source], order, rank, sum(counts.values())).withColumn(at["block_index"], F.floor(F.col(rank) / block))
    ranked = ranked.join(F.broadcast(plan.select(source, k).distinct()), source).withColumn(i, F.col(at["block_index"]) % F.col(k))
    turn = F.floor(F.col(at["block_index"]) / F.col(k)) * period
    out = ranked.withColumn(k, turn).join(F.broadcast(plan.drop(k)), [source, i])
    return out.select(*df.columns, at["block_index"], *[(F.col(k) + F.col(c)).alias(at[n]) for n, c in (("release", r), ("deadline", d), ("slot", s))], (F.col(rank) % block).alias(at["position"]))


def _source(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, source, block_index, release, deadline, slot, position of each document; position orders documents within their slot.

    weights: by source, met as given (see shares() and drift()); without them a source weighs its number of documents to the power
    `temperature`, rounded to a whole number of slots. A source that weights does not
    name raises a ValueError, a named source without documents leaves its slots empty. Null is a source like any other (named "" in
    weights). Over SOURCES sources raise a ValueError, as the schedule is made on the driver. Documents of one id have places of their
    own; which of them has which makes no difference to the result. Texts and other columns are not looked at. An empty table has no rows.
    """
    df = staged(docs.select(F.col(id_col).alias("doc_id"), _source(source_col).alias("source")), "mixing")
    at = {c: c for c in COLUMNS}
    return _slotted(df.withColumn("_key", F.xxhash64("doc_id")), weights, block, "source", ["_key", "doc_id"], temperature, at).select("doc_id", "source", *COLUMNS)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """docs, all rows and columns, in the order of the mixture: ascending over partitions and within them, so files follow one another.

    Each row, repeated ones too, has a place of its own; rows of one id are ordered by their other columns' hash. Nulls, weights and empty
    tables are as for mix(). docs must give the same rows when it is read twice (a table).
    """
    src, key = fresh(docs, "mixture"), fresh(docs, "hash")
    df = docs.withColumns({src: _source(source_col), key: F.xxhash64(*[F.col(c) for c in docs.columns])})
    at = {c: fresh(df, c) for c in COLUMNS}
    order = [at["slot"], at["position"]]
    out = _slotted(df, weights, block, src, [key, id_col], temperature, at)
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
