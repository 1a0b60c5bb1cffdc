"""SimHash near-duplicates: fingerprints linked at a small Hamming distance by bit-sliced comparison.

Fingerprints are compared in buckets that share 2 of 4 bands of 16 bits (at most 2 differing bits leave 2 bands whole, so no link is
lost). In a bucket, blocks of 64 fingerprints are stored as 64 vertical bit planes; a query runs over the planes, carry-save counters
keep 64 distances at once, and a block is abandoned as soon as all its lanes exceed the radius. A bucket over HOT fingerprints is split
by the same rule: its other 32 bits are six bands, of which four have to be equal. At most 2**12 distinct fingerprints can share such a
part, whatever the corpus, and the parts are dealt over all tasks. A bucket is contracted to a forest before its links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fresh, staged

RADIUS, HOT, SEED = 2, 2048, 42
FULL = (1 << 64) - 1


def _left_out(bands: list[int], keep: int) -> list[int]:
    """Masks that leave out two of the bands (given as masks) and keep the rest of `keep`."""
    return [keep & ~(a | b) for a, b in combinations(bands, 2)]


TABLES = _left_out([0xFFFF << 16 * i for i in range(4)], FULL)
#: For each table, the masks that split a hot bucket: the 32 bits left out, in six bands of at most 6 bits, two of them left out.
PARTS = [_left_out([((1 << w) - 1) << 16 * i + o for i in range(4) if not t >> 16 * i & 0xFFFF for w, o in ((6, 0), (5, 6), (5, 11))], FULL) for t in TABLES]


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles of A-Z-lowered text; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) < 3:
        hashes = np.array([xxhash.xxh64_intdigest(buf, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-3] + 1))
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter([h(buf[a:b], SEED) for a, b in zip(starts.tolist(), ends[2:].tolist(), strict=True)], np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(x.as_py()) for x in b.column(1).cast(pa.binary())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """(doc_id long, fp long) for each row, with tag_col also (tag long); the fingerprint's 64 bits as a signed long."""
    more = [F.col(tag_col).alias("tag")] if tag_col else []
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return df.mapInArrow(_fingerprints, "doc_id long, fp long" + ", tag long" * len(more))


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: [bit, block], lane i of block k being fingerprint 64 k + i."""
    blocks = -(-len(fps) // 64)
    full = np.zeros(blocks * 64, "<u8")
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8), bitorder="little").reshape(blocks, 64, 64)
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1).reshape(64, blocks * 64), axis=1, bitorder="little")).view("<u8")


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with equal key (keys sorted) and at most `radius` (2 at most) differing bits; each pair once.

    chunk: queries times blocks at a time; should all their lanes be near, they give 64 pairs each.
    """
    if radius > 2:
        raise ValueError("the carry-save counters hold distances up to 2")
    n = len(fps)
    if n < 2:
        return
    planes, every = _planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    hi = np.searchsorted(keys, keys, side="right")
    first = np.arange(n) // 64
    many = np.where(hi - np.arange(n) > 1, (hi - 1) // 64 - first + 1, 0)
    ends = np.cumsum(many)
    lo = 0
    while lo < n:
        up = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, side="right")))
        q = np.repeat(np.arange(lo, up), many[lo:up])
        if len(q):
            blk = first[q] + np.arange(len(q)) - np.repeat(np.concatenate(([0], np.cumsum(many[lo:up])[:-1])), many[lo:up])
            yield from _scan(planes, fps, q, blk, hi[q], radius, every)
        lo = up


def _scan(planes: np.ndarray, fps: np.ndarray, q: np.ndarray, blk: np.ndarray, hi: np.ndarray, radius: int, every: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    def below(k: np.ndarray) -> np.ndarray:
        """Words whose lanes under k (0 to 64) are set."""
        k = np.clip(k, 0, 64)
        return np.where(k == 64, every, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))

    dead = ~(below(hi - blk * 64) & ~below(q + 1 - blk * 64))
    ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
    mine = fps[q]
    for bit in range(64):
        x = planes[bit][blk] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            gone = dead | over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
            keep = gone != every
            if not keep.all():
                q, blk, mine, ones, twos, over, dead, gone = (a[keep] for a in (q, blk, mine, ones, twos, over, dead, gone))
            if not len(q):
                return
    near = np.unpackbits((~gone).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, lane = np.nonzero(near)
    yield q[row], blk[row] * 64 + lane


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: for each linked fingerprint one edge to the least fingerprint that its bucket links it to."""
    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = np.arange(len(fps))
        for i, j in close_pairs(keys, fps.view(np.uint64)):
            while len(i):
                a, b = root[i], root[j]
                open_ = a != b
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                root = root[root]
        while (root != root[root]).any():
            root = root[root]
        at = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[root[at]])], names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        keys = np.concatenate((keys, b.column("key").to_numpy()))
        fps = np.concatenate((fps, b.column("fp").to_numpy()))
        if len(keys) >= 1 << 16 and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield solve(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield solve(keys, fps)


def _keys(fp: str, masks: list[int]) -> list[Column]:
    """One bucket key for each mask: the bits of the fingerprint that the mask keeps."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.xxhash64(F.lit(signed(m)), F.col(fp).bitwiseAND(F.lit(signed(m)))) for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp, no repeats) within RADIUS bits of each other."""
    rows = fps.select("fp", F.posexplode(F.array(*_keys("fp", TABLES))).alias("t", "key"))
    hot = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("key", F.lit(True).alias("hot")), "simhash-hot")
    parts = F.create_map(*[x for t, masks in enumerate(PARTS) for x in (F.lit(t), F.array(*_keys("fp", masks)))])
    rows = rows.join(hot, "key", "left").select("fp", F.explode(F.when(F.col("hot"), F.element_at(parts, F.col("t"))).otherwise(F.array("key"))).alias("key"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def _groups(prints: DataFrame) -> DataFrame:
    """(fp, root) of each fingerprint that is linked to another one; prints: a staged table with a column fp."""
    roots = components(links(staged(prints.select("fp").distinct(), "simhash-distinct")))
    return staged(roots.withColumnRenamed("node", "fp"), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, its own included).

    Null and empty texts and texts without a word have fingerprint zero and are linked like any other. Repeated rows give repeated
    result rows. A null id keeps its row; it never names a component unless all ids of the component are null. Other columns are not
    looked at. An empty table has no rows.
    """
    docs_fp = staged(fingerprints(docs, id_col, text_col), "simhash-fp")
    least = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = staged(least.join(_groups(docs_fp), "fp"), "simhash-linked")
    names = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    ids = staged(least.join(names, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-ids")
    return docs_fp.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each group of near-duplicates: that of least id, then of least text hash; null ids come last.

    Only rows that are linked to the one kept go: rows that share an id, or have none, but differ in text are documents of their own.
    Null and empty texts are one group. An empty table has no rows.
    """
    doc, text = fresh(docs, "doc"), fresh(docs, "tag")
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), text: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    prints = staged(fingerprints(keyed, doc, text_col, text), "simhash-fp")
    rows = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "tag")).alias("least"))
    kept = rows.join(_groups(prints), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least"))
    kept = staged(kept.select("least.*"), "simhash-kept").select(F.col("doc_id").alias(doc), F.col("tag").alias(text))
    # Of rows with one id and one text any is as good; the limit within a group acts before the shuffle.
    rank = fresh(docs, "rank")
    first = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(doc, text).orderBy(doc))).where(F.col(rank) == 1)
    return first.join(kept, [doc, text], "left_semi").select(*docs.columns)
