"""Substring dedup by a run-length index: bytes under a LENGTH-byte string that also starts elsewhere are removed.

Candidates first, so that no index has to hold the corpus. The least hash of the GRAM-byte grams in a LENGTH-byte window is the window's
anchor; equal windows have equal anchors. Consecutive windows with one anchor are a run of windows, kept as (anchor, hash of the run's
bytes, document, place). Runs whose anchor occurs once anywhere hold no repeated window. Equal runs are cut out of the texts once, with
their number. An anchor with over HOT different runs (a line that a large part of the corpus shares, in ever new surroundings) is dealt
out: its windows become runs of their own with the hash of the whole window as anchor, and pass the same way. So no anchor is left with
many different runs, and each has its place in a bucket.

The runs left are dealt by anchor to buckets of bounded size. In a bucket the run-compressed Burrows-Wheeler transform of its texts, in
all their copies, is built, with suffix-array samples at both ends of each run and the length of the match with the neighbour there.
Matching statistics are streamed along the text from these samples alone (they fall by one a byte between samples), and each window whose
match reaches LENGTH is marked. Hashes choose what enters the index; what is removed is what the index matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

LENGTH, GRAM, HOT, BLOCK, BUCKET = 200, 32, 2_000, 1 << 20, 1 << 20
END = 0xFF  # no byte of UTF-8
RUN = "h long, g long, doc long, tag long, pack long"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, and the powers of an odd base and of its inverse."""
    byte = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    powers = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
    return byte, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _span_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes at start, start + size of one block."""
    byte, powers, inverse = _tables()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[data] * powers[: len(data)], dtype=np.uint64)))
    return _mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64))


def window_runs(data: np.ndarray, ends: np.ndarray, single: bool = False) -> tuple[np.ndarray, ...]:
    """(anchor, hash, document, start, windows) of the runs in documents that stand end to end in data (BLOCK bytes at most).

    single: each window is a run of its own with its own hash as anchor.
    """
    n, empty = len(data), (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if n < LENGTH:
        return empty
    begins = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - begins)
    at = np.arange(n - LENGTH + 1)
    whole = at + LENGTH <= ends[doc[: len(at)]]
    if single:
        s = np.flatnonzero(whole)
        if not len(s):
            return empty
        h = _span_hash(data, s, np.full(len(s), LENGTH))
        return h, h, doc[s], s - begins[doc[s]], np.ones(len(s), np.int64)
    byte = _tables()[0]
    h, width = byte[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64)) + h[width:]
        width *= 2
    h = _mix(h)
    low = np.uint64(BLOCK - 1)
    key, width, most = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while width * 2 <= most:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < most:
        key = np.minimum(key[: len(key) - (most - width)], key[most - width :])
    anchor = (key & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(at)] != doc[: len(at) - 1]) | ~whole[:-1]
    s = np.flatnonzero(new & whole)
    if not len(s):
        return empty
    stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole)
    return h[anchor[s]], _span_hash(data, s, stop - s + LENGTH), doc[s], s - begins[doc[s]], stop - s + 1


def _rows(h: np.ndarray, g: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """A batch of RUN; pack holds the start and, in its low 8 bits, the number of windows."""
    columns = (h.view(np.int64), g.view(np.int64), doc, tag, start.astype(np.int64) << 8 | many)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["h", "g", "doc", "tag", "pack"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text -> RUN."""
    for b in batches:
        ids, tags, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary()).to_pylist()
        for lo, hi in _blocks([len(t) for t in texts]):
            part = texts[lo:hi]
            if hi - lo == 1 and len(part[0]) > BLOCK:  # a text over a block's size, in blocks that share what one window spans
                pieces = [(i, part[0][i : i + BLOCK]) for i in range(0, len(part[0]) - LENGTH + 1, BLOCK - LENGTH + 1)]
            else:
                pieces = [(0, b"".join(part))]
            for shift, data in pieces:
                ends = np.array([len(data)]) if len(pieces) > 1 else np.cumsum([len(t) for t in part])
                h, g, d, s, n = window_runs(np.frombuffer(data, np.uint8), ends)
                yield _rows(h, g, ids[lo + d], tags[lo + d], s + shift, n)


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > BLOCK:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text, packs -> RUN of single windows under the packed runs."""
    for b in batches:
        for doc, tag, text, packs in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            for p in packs:
                start, many = p >> 8, p & 0xFF
                data = np.frombuffer(text[start : start + many + LENGTH - 1], np.uint8)
                h, g, _, s, n = window_runs(data, np.array([len(data)]), single=True)
                yield _rows(h, g, np.full(len(h), doc), np.full(len(h), tag), s + start, n)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text, runs (h, g, pack, m) -> h, g, m, seg. Rows of one doc and tag have one text, of which one is cut."""
    last = None
    for b in batches:
        rows = []
        for doc, tag, text, runs in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (doc, tag) != last:
                rows += [(r["h"], r["g"], r["m"], text[(at := r["pack"] >> 8) : at + (r["pack"] & 0xFF) + LENGTH - 1]) for r in runs]
            last = (doc, tag)
        for i in range(0, len(rows), 20_000):
            cols = zip(*rows[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "g", "m", "seg"])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a byte array in order, by prefix doubling from eight bytes; only suffixes that are still tied are sorted again."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    rank, slots, width = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), 8
    key = key[order]
    while True:
        # A rank is the first slot of the suffixes that are equal so far.
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots), dtype=np.int32), 0))]
        rank[order[slots]] = first
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        after = at + width
        key = rank[at].astype(np.int64) << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        width *= 2


def _extent(text: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bytes in which the suffixes at p and q agree, up to the next END."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, END, np.uint8), np.arange(8, dtype=np.uint8)))
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    out, live, step = np.zeros(len(p), np.int64), np.arange(len(p)), 0
    while len(live):
        a, b = np.minimum(p[live] + step, n), np.minimum(q[live] + step, n)
        x = words[a] ^ words[b]
        same = (x == 0) & (a < n) & (b < n)
        low = x & (~x + np.uint64(1))
        out[live[~same]] = step + np.where(x[~same] == 0, 0, np.log2(np.maximum(low[~same], np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        live, step = live[same], step + 8
    return out


def matching_statistics(segments: list[bytes], copies: list[int] | None = None) -> list[np.ndarray]:
    """For each byte of each segment (no END in it): how far what starts there, within its segment, also stands elsewhere.

    From the run-length index alone: the transform's runs, suffix-array samples and match lengths at their two ends. copies: how often
    each segment stands in the collection. Copies of a suffix are neighbours in the transform with one letter before them all, so they
    are held as a run's length instead of rows; the match with such a neighbour reaches the segment's end. The letter before a segment's
    first byte is the end of another one in each copy, so a run starts there and is sampled.
    """
    text = np.frombuffer(b"".join(s + bytes([END]) for s in segments), np.uint8)
    n, sizes = len(text), np.array([len(s) + 1 for s in segments])
    ends, place = np.cumsum(sizes) - 1, np.arange(n, dtype=np.int32)
    reach = np.repeat(ends.astype(np.int32), sizes) - place  # to the segment's end
    before = text[place - 1].astype(np.int32)
    before[ends - sizes + 1] = 256 + np.arange(len(segments))
    sa = suffix_array(text)
    bwt = before[sa]
    edge = np.flatnonzero(bwt[1:] != bwt[:-1])
    del before, bwt
    beside = np.repeat(np.zeros(len(segments), bool) if copies is None else np.array(copies) > 1, sizes)
    best = np.zeros(n, np.int32)
    for ranks, other in ((np.concatenate(([0], edge + 1)), np.concatenate(([-1], edge))), (np.append(edge, n - 1), np.append(edge + 1, n))):
        at, length = sa[ranks], np.zeros(len(ranks), np.int32)
        own = beside[at]
        length[own] = reach[at[own]]
        real = ~own & (other >= 0) & (other < n)
        length[real] = _extent(text, sa[ranks[real]], sa[other[real]])
        sample = np.full(n, -1, np.int32)
        sample[at] = at
        sample = np.maximum.accumulate(sample)
        stream = np.zeros(n, np.int32)
        stream[at] = length
        stream = np.where(sample >= 0, stream[sample] - (place - sample), 0)
        best = np.maximum(best, np.minimum(stream, reach))
    return [best[e - len(s) : e] for s, e in zip(segments, ends, strict=True)]


def _mark(table: pa.Table) -> pa.Table:
    """h, g, m, seg of a bucket -> h, g, lo, hi: stretches of each run's bytes to remove. Repeats of one (h, g) are the same segment."""
    one = list({k: i for i, k in enumerate(zip(table.column("h").to_pylist(), table.column("g").to_pylist(), strict=True))}.values())
    table, out = table.take(one), []
    for i, ms in enumerate(matching_statistics(table.column("seg").to_pylist(), table.column("m").to_pylist())):
        hit = np.flatnonzero(ms >= LENGTH)
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) > LENGTH)
            out += [(i, a, b + LENGTH) for a, b in zip(hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True)]
    i, lo, hi = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    at = pa.array(i, pa.int64())
    return pa.table({"h": table.column("h").take(at), "g": table.column("g").take(at), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(with_text: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = merged([(s["lo"], s["hi"]) for s in spans or []])
                at, left = 0, []
                for lo, hi in spans:
                    left.append(text[at:lo])
                    at = hi
                rest = b"".join([*left, text[at:]])
                rows.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (4 + with_text)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return keep


def _many(n_bytes: int, each: int) -> int:
    return max(12, -(-n_bytes // each))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row (with_text: and the bytes kept).

    Null texts are empty; texts under LENGTH bytes are kept whole. Repeated rows are documents of their own, so what they hold of LENGTH
    bytes or more goes from each of them. A null id is an id like any other. Texts of one id are told apart by a 64-bit hash. Other
    columns are not looked at. An empty table has no rows.
    """
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(doc.alias("id"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    keys = ["doc", "tag"]

    def of_docs(packs: DataFrame, *cols: str) -> DataFrame:
        """The rows of `packs` gathered by document, beside the document's text."""
        own = packs.groupBy(*keys).agg(F.collect_list(cols[0] if len(cols) == 1 else F.struct(*cols)).alias("runs"))
        return df.select(*keys, "text").join(own, keys).select(*keys, "text", "runs")

    def repeated(runs: DataFrame, name: str) -> DataFrame:
        """The runs whose anchor stands more than once; only anchors and their counts are shuffled to find them."""
        often = staged(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "index-often")
        out = staged(runs.join(often, "h"), name)
        dropped(runs, often)
        return out

    def representatives(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h", "g").agg(F.count(F.lit(1)).alias("m"), F.first(F.struct(*keys, "pack")).alias("r")).select("h", "g", "m", "r.*")

    whole = F.octet_length("text") >= LENGTH
    runs = repeated(staged(df.where(whole).select(*keys, "text").mapInArrow(_runs, RUN), "index-runs"), "index-repeated")
    one = staged(representatives(runs), "index-one")
    hot = staged(one.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where(f"d > {HOT}").select("h"), "index-hot")
    if not hot.isEmpty():
        split = of_docs(runs.join(hot, "h").select(*keys, "pack").distinct(), "pack").mapInArrow(_single, RUN)
        split = repeated(staged(split, "index-split"), "index-windows")
        more = staged(representatives(split).unionByName(one.join(hot, "h", "left_anti")), "index-one")
        rest = staged(runs.join(hot, "h", "left_anti").unionByName(split), "index-all")
        dropped(runs, one, split)
        runs, one = rest, more
    total = one.agg(F.sum(F.col("pack").bitwiseAND(0xFF) + LENGTH)).first()[0] or 0
    # Segments are staged, so that the shuffled texts are gone before the segments are shuffled themselves.
    segments = staged(of_docs(one, "h", "g", "pack", "m").mapInArrow(_cut, "h long, g long, m long, seg binary"), "index-segments")
    dropped(one)
    bucket = F.pmod(F.xxhash64("h"), F.lit(_many(total, BUCKET)))
    marks = staged(segments.groupBy(bucket.alias("bucket")).applyInArrow(_mark, "h long, g long, lo int, hi int"), "index-marks")
    dropped(segments)
    start = F.shiftright("pack", 8)
    spans = runs.join(marks, ["h", "g"]).select(*keys, F.struct((start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi")).alias("span"))
    spans = staged(spans.groupBy(*keys).agg(F.collect_set("span").alias("spans")), "index-spans")
    dropped(runs, hot, marks)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return df.join(spans, keys, "left").select("id", "text", "spans").mapInArrow(_kept(with_text), schema)
