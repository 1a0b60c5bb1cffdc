"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised and cut into pieces of at most `size` ids. The histogram of piece lengths (at most `size` rows, whatever the
corpus) goes to the driver, which places lengths longest first into the open pack with the most room and only keeps how often each
packing pattern is used. Pieces then find their pattern by their rank among the pieces of their length; ranks are counted in salted
buckets, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import salted_rank, staged

END_ID, SIZE, CACHE, WINDOW = 1, 2048, 200_000, 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
TAIL, SHORT = ".,!?;:#$%&*|", 4
PROBES = ("The Quick brown fox, jumped: over 12 lazy dogs!", "x.y (a-b) don't [C]#1 f00?", "  unbelievably\tinternationalisation \n\n z ")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of white-space separated words, by the tokenizer file at `path`, with a bounded cache.

    The file's normaliser maps white space to a blank and its pre-tokeniser never joins text across one, so a text's ids are its
    words' ids in turn. Punctuation after a letter or digit is a token of its own, so it is looked up apart from its word.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.known: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        for x in PROBES:  # a file of other rules would give wrong ids
            own = b"".join(self.words([w.encode() for w in x.lower().split()]))
            if own != np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes():
                raise ValueError(f"{path} does not encode texts word by word in lower case")

    def _encode(self, words: list[bytes]) -> None:
        plain, other, known = [], [], self.known
        for w in words:
            if w.isascii():
                (plain if w.isalpha() else other).append(w)
            else:  # below U+0130 each letter is one code point that stays one when it is lower-cased
                text = w.decode()
                (plain if text.isalpha() and max(text) < "\u0130" else other).append(w)
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            e = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                known[w] = raw[at:end]
                at = end
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (lower-cased A-Z); `words` are distinct."""
        if len(self.known) > self.cache // 2:  # words of the generation before last that were not met since are forgotten
            self.old, self.known = self.known, {b"": b""}
        known, old = self.known, self.old
        found = list(map(known.get, words))
        lacking = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in lacking:
            w = words[i]
            if (v := old.get(w)) is None:
                new.append(w)
            else:
                known[w] = v
        self._encode(new)
        for i in lacking:
            found[i] = known[words[i]]
        return found

    @staticmethod
    def _parted(words: pa.Array) -> tuple[pa.Array, list[tuple[np.ndarray, pa.Array]]]:
        """Words without the punctuation at their end, and that punctuation as (places, tails) by its length, SHORT at most.

        A word is parted where a letter or digit stands before the punctuation, else it is left whole.
        """
        core = pc.ascii_rtrim(words, TAIL)
        last = pc.utf8_slice_codeunits(core, -1)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(core))
        whole = pc.or_(pc.ascii_is_alnum(last), pc.and_(pc.less(last, "\u0130"), pc.utf8_is_alpha(last)))
        parted = pc.and_(pc.and_(whole, pc.greater(cut, 0)), pc.less_equal(cut, SHORT))
        cut = np.where(parted.to_numpy(zero_copy_only=False), cut.to_numpy(), 0)
        tails = []
        for k in range(1, SHORT + 1):
            if len(at := np.flatnonzero(cut == k)):
                tails.append((at, pc.binary_slice(words.take(pa.array(at)).cast(pa.large_binary()), -k)))
        return pc.if_else(parted, core, words), tails

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls: none), end to end, and where each text's ids end."""
        texts = pa.concat_arrays([texts.cast(pa.large_string())])  # a copy: pyarrow's ascii_lower goes wrong on a slice
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = pc.dictionary_encode(lists.flatten())
        core, tails = self._parted(coded.dictionary)
        core = pc.dictionary_encode(core)
        # Units are the distinct cores, nothing, and the distinct tails; a word is its core's unit and its tail's.
        units = core.dictionary.cast(pa.large_binary()).to_pylist()
        tail_of = np.full(len(coded.dictionary), len(units))
        units.append(b"")
        for at, tail in tails:
            tail = pc.dictionary_encode(tail)
            tail_of[at] = len(units) + tail.indices.to_numpy()
            units += tail.dictionary.to_pylist()
        ids = self.words(list(dict.fromkeys(units)))
        if len(ids) < len(units):  # some tail stands as a word too
            one = dict(zip(dict.fromkeys(units), ids, strict=True))
            ids = [one[u] for u in units]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        unit = np.empty(2 * len(at), np.int64)
        unit[0::2], unit[1::2] = core.indices.to_numpy()[at], tail_of[at]
        many = size[unit]
        ends = np.cumsum(many)
        begin = (np.cumsum(size) - size)[unit] - (ends - many)
        held = many > 0
        out = flat[np.repeat(begin[held], many[held]) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(at) else np.zeros(0, "<u4")
        last = np.asarray(lists.offsets)[1:] - np.asarray(lists.offsets)[0]
        return out, np.concatenate(([0], ends))[2 * last]


def encoder(path: str) -> WordEncoder:
    """One encoder, and so one cache, for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block: int = 4 << 20, with_ids: bool = False, place: Column | None = None) -> DataFrame:
    """Pieces of at most `size` ids of each document: its text's ids, then end_id. A null or empty text has the one id end_id.

    place: a value of the document's row that its pieces carry on as column `place`.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            step, lo = np.cumsum(pc.fill_null(pc.binary_length(b.column(1).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + block, side="right")))
                ids, ends = enc.texts(b.column(1).slice(lo, hi - lo))
                rows, of, begin = [], [], 0
                for at, (doc, end) in enumerate(zip(b.column(0).slice(lo, hi - lo).to_pylist(), ends.tolist(), strict=True), lo):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    for s in range(0, len(own), size):
                        part = own[s : s + size]
                        rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(own), *([part.tolist()] if with_ids else [])))
                        of.append(at)
                kinds = [pa.int64()] * 5 + ([pa.list_(pa.int32())] if with_ids else [])
                names = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
                more = [b.column(2).take(pa.array(of))] if b.num_columns > 2 else []
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *more], names=names + ["place"] * len(more))
                lo = hi
        pa.default_memory_pool().release_unused()

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if place is None else [place.alias("place")]))
    kind = "" if place is None else f", place {df.schema['place'].dataType.simpleString()}"
    return df.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else "") + kind)


def shortest_pack_first(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns: (times used, lengths in order) that together hold every counted length once; lengths are 1 to size."""
    open_: dict[int, list[list]] = defaultdict(list)  # by room left: [times, lengths]
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, times: int, lengths: tuple[int, ...]) -> None:
        if room:
            open_[room].append([times, lengths])
        else:
            done.append((times, lengths))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                each = size // length
                full, rest = divmod(left, each)
                for times, k in ((full, each), (1, rest)):
                    if times and k:
                        put(size - k * length, times, (length,) * k)
                break
            pack = open_[room][-1]
            take = min(left, pack[0])
            pack[0] -= take
            if not pack[0]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            left -= take
            put(room - length, take, (*pack[1], length))
    return sorted([*done, *((t, p) for packs in open_.values() for t, p in packs)], key=lambda x: (x[1], x[0]), reverse=True)


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """For each slot of each pattern: its length, the first rank that it takes, the first sequence and the offset; by length and rank."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], base, offset))
            taken[length] += times
            offset += length
        base += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))


def _seats(slots: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and their rank among the pieces of that length."""
    lengths, first, sequence, offset = slots
    many = int(first.max()) + 1
    line = lengths * many + first  # lengths apart, ranks ascending
    at = np.searchsorted(line, length * many + np.minimum(rank, many - 1), side="right") - 1
    assert (lengths[at] == length).all()
    return sequence[at] + rank - first[at], offset[at]


def _placer(plan: list[tuple[int, tuple[int, ...]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    slots = _slots(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seats = _seats(slots, b.column("length").to_numpy(), b.column("_rank").to_numpy())
            keep = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, seats)], names=[*keep, "sequence_id", "offset"])

    return place


def _in_window(size: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the pieces of one window by their own histogram, ranks by place; its sequences are numbered by their earliest piece."""
    def place(table: pa.Table) -> pa.Table:
        t = table.sort_by("_place")
        length = t.column("length").to_numpy()
        values, counts = np.unique(length, return_counts=True)
        order = np.argsort(length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
        sequence, offset = _seats(_slots(shortest_pack_first(dict(zip(values.tolist(), counts.tolist(), strict=True)), size)), length, rank)
        first = np.full(int(sequence.max()) + 1, len(length))
        np.minimum.at(first, sequence, np.arange(len(length)))
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        total = np.bincount(sequence, length, len(first)).astype(np.int64)
        padded = np.where(total & (total - 1) == 0, np.minimum(total, size), size)[sequence]
        return t.drop_columns(["_place"]).append_column("sequence_id", pa.array(number[sequence])).append_column("offset", pa.array(offset)).append_column("padded", pa.array(padded))

    return place


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, place: Column | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece with its sequence and its offset there; sequences are gapless, 0 up.

    padded: the sequence's length as stored, `size` unless its ids fill a power of two. place: an order of the documents that the
    sequences follow: each `window` pieces in that order are packed among themselves, by their own histogram, in a task of their own;
    pieces of one length are dealt to patterns in that order, and a window's sequences are numbered by their earliest piece.
    Null and empty texts are pieces of the one id end_id. Rows with the same id are packed each for itself. Columns besides id and text
    are not looked at. An empty table gives no rows.
    """
    cut = staged(pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids=with_ids, place=place), "pieces")
    own = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    if place is not None:
        placed = ranked(cut, [], ["place", *own], "_place").drop("place").withColumn("window", F.floor(F.col("_place") / window))
        schema = placed.drop("_place").schema.add("sequence_id", "long").add("offset", "long").add("padded", "long")
        placed = staged(placed.groupBy("window").applyInArrow(_in_window(size), schema), "placed")
        before = F.sum("n").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1))  # one row a window
        base = placed.groupBy("window").agg((F.max("sequence_id") + 1).alias("n")).select("window", F.coalesce(before, F.lit(0)).alias("base"))
        out = placed.join(base, "window").withColumn("sequence_id", F.col("sequence_id") + F.col("base"))
        return out.drop("window", "base")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    plan = shortest_pack_first(counts, size)
    if not plan:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "padded": F.lit(0).cast("long")})
    ranks = salted_rank(cut, ["length"], own, "_rank", sum(counts.values()))
    placed = ranks.mapInArrow(_placer(plan), cut.schema.add("sequence_id", "long").add("offset", "long"))
    # A sequence's own length is its pattern's: patterns and their runs of sequence ids are as bounded as the plan.
    ends = np.cumsum([t for t, _ in plan])
    odd = [(int(e - t), int(e), sum(p)) for e, (t, p) in zip(ends, plan, strict=True) if sum(p) & (sum(p) - 1) == 0 and sum(p) < size]
    padded = F.lit(size)
    for lo, hi, n in odd:
        padded = F.when((F.col("sequence_id") >= lo) & (F.col("sequence_id") < hi), n).otherwise(padded)
    return placed.withColumn("padded", padded.cast("long"))
