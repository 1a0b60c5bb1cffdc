"""Phrase collocation mining: phrases of 2 to MAX_N words whose weakest cut is far stronger than chance, by language.

All 1- to MAX_N-word runs become rows (lang, phrase, count), tasks adding up what they hold before it is shuffled, and are counted by
language and phrase. A phrase found `least` times has only parts that are found as often, so longer runs are made only where each pair
of words in them is frequent: two bitmaps, of the frequent words' and of the frequent word pairs' hashes, tell where. Most runs of three
words and more that pass are rare all the same, so these are first counted by slots of their hashes, up to `least`: a third bitmap holds
the slots that reach it. The bitmaps have at most MAX_BITS bits whatever the corpus; a hash that clashes or a full bitmap makes more rows,
which the exact counts of whole phrases then drop, and never loses one. Frequent phrases join the counts of the two sides of each cut, are scored in decimals of 38 digits, lose
those that a one-word extension replaces, and are ranked in a window, of which each task sends on its best `top` alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

MAX_N, LEAST, TOP, NO_LANG = 5, 100, 2_000, "und"
CHUNK, HELD, CACHE = 1 << 21, 1 << 18, 1 << 17  # bytes at once, counts held by a task, cached word hashes
MIN_BITS, MAX_BITS, BITMAP = 1 << 20, 1 << 28, 1 << 15  # BITMAP: bits of one row of bitmap_construct_agg
SPARSE, SLOTS, WORDS_A_SLOT, SENT = 128, 1 << 27, 8, 64  # bits for each hash, the most slots, words for each slot, BITMAPs of slots in one batch
#: A-Z in lower case; a tab is a blank, what ends a piece a line feed. No byte of a longer UTF-8 character is below 128.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
PIECES, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


class _Hashes(dict):
    """Word -> the 64-bit hash that Spark's xxhash64(lang, phrase) gives, for one language; bounded."""

    def __init__(self, lang: bytes) -> None:
        self.seed = xxhash.xxh64_intdigest(lang, 42)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """(lang, folded texts of it, a line feed after each) for each batch."""
    for b in batches:
        by: dict[bytes, list[bytes]] = {}
        for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            yield lang, b"\n".join(texts).translate(FOLD)


def _chunks(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes, cut where a word ends."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and text[end] not in b" \n":
            stop = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0]
            end = min(stop, default=n)
        yield text[at:end]
        at = end


def _placed(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words of a folded text and the number of the piece that each stands in."""
    b = np.frombuffer(text, np.uint8)
    gap = (b == 32) | (b == 10)
    starts = ~gap
    starts[1:] &= gap[:-1]
    return text.split(), np.cumsum(b == 10, dtype=np.int32)[starts]


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray, int]]:
    """(lang, words, piece of each word, words that a former part held as well): the last n - 1 words of a part come again in the next."""
    for lang, text in _texts(batches):
        words: list[bytes] = []
        piece, last = np.zeros(0, np.int32), 0
        for part in _chunks(text):
            old = max(0, len(words) - n + 1)
            new, at = _placed(part)
            words, piece = words[old:] + new, np.concatenate((piece[old:], at + last))
            if len(new):
                yield lang, words, piece, len(words) - len(new)
            last += part.count(b"\n")


class _Held:
    """Counts by language and phrase, passed on as rows when there are HELD of them."""

    def __init__(self) -> None:
        self.by: dict[bytes, Counter] = {}

    def add(self, lang: bytes, phrases: list[bytes]) -> None:
        self.by.setdefault(lang, Counter()).update(phrases)

    def rows(self, least: int = HELD) -> Iterator[pa.RecordBatch]:
        if self.by and sum(map(len, self.by.values())) >= least:
            for lang, c in self.by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "phrase", "n"])
            self.by.clear()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for lang, text in _texts(batches):
        for part in _chunks(text):
            held.add(lang, part.split())
            yield from held.rows()
    yield from held.rows(1)


def _bits(parts: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of rows (i, b): bytes b from bit i * BITMAP on; bits / BITMAP rows at most."""
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["i"] * BITMAP // 8 : (r["i"] + 1) * BITMAP // 8] = np.frombuffer(r["b"], np.uint8)
    return out


def bitmap(hashes: DataFrame, col: str, rows: int) -> np.ndarray:
    """Bits of the hashes' low ends as bytes, lowest bit first: SPARSE for each of `rows` hashes, MIN_BITS to MAX_BITS in all."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (SPARSE * max(1, rows) - 1).bit_length()))
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    return _bits(hashes.groupBy(F.floor(at / BITMAP).alias("i")).agg(F.bitmap_construct_agg((at % BITMAP).cast("long")).alias("b")), bits)


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _longer(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of runs one word longer: of runs g and the words h that follow them."""
    with np.errstate(over="ignore"):
        out = g * np.uint64(0x9E3779B97F4A7C15) + h
    return out ^ out >> np.uint64(31)


def _paired(words: list[bytes], piece: np.ndarray, hashes: _Hashes, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word but the last: may it make a frequent pair with the next, and the pair's hash; the hash of each word."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    ok = _in(frequent, h)
    return ok[:-1] & ok[1:] & (piece[:-1] == piece[1:]), _longer(h[:-1], h[1:]), h


def _pairs(batches: Iterator[pa.RecordBatch], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (h, n): hashes of word pairs of frequent words and their counts."""
    by: dict[bytes, _Hashes] = {}
    held: list[np.ndarray] = []
    full = 0

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for lang, words, piece, old in _runs(batches, 2):
        ok, pair, _ = _paired(words, piece, by.setdefault(lang, _Hashes(lang)), frequent.value)
        held.append(pair[ok])  # the one word that comes again makes pairs with new ones only
        full += len(held[-1])
        if full >= 8 * HELD:
            yield counted()
            full = 0
    if held:
        yield counted()


def _candidates(batches: Iterator[pa.RecordBatch], frequent: Broadcast, pairs: Broadcast, max_n: int, marked: Broadcast | None = None) -> Iterator[tuple[bytes, list[bytes], list[tuple[np.ndarray, np.ndarray]]]]:
    """(lang, words, starts and hashes of its runs of 2, 3, ... max_n words) of each part: runs whose pairs, and longer runs if `marked` is given, are all marked."""
    by: dict[bytes, _Hashes] = {}
    for lang, words, piece, old in _runs(batches, max_n):
        ok, g, h = _paired(words, piece, by.setdefault(lang, _Hashes(lang)), frequent.value)
        run, out = ok & _in(pairs.value, g), []
        for n in range(2, max_n + 1):
            if n > 2:
                g, run = _longer(g[:-1], h[n - 1 :]), run[:-1] & run[1:]
            at = np.flatnonzero(run)
            if n > 2 and marked is not None:
                at = at[_in(marked.value, g[at])]
                run = np.zeros(len(run), bool)
                run[at] = True
            at = at[at + n > old]
            out.append((at, g[at]))
        yield lang, words, out


def _slotted(batches: Iterator[pa.RecordBatch], frequent: Broadcast, pairs: Broadcast, max_n: int, slots: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, at, n): of the BITMAP slots from i * BITMAP on those that runs of 3 to max_n words fall into, and how many do, `least` at most."""
    seen = np.zeros(slots, np.min_scalar_type(least))
    for _, _, runs in _candidates(batches, frequent, pairs, max_n):
        slot, n = np.unique(np.concatenate([g for _, g in runs[1:]]) & np.uint64(slots - 1), return_counts=True)
        slot = slot.astype(np.int64)
        seen[slot] = np.minimum(seen[slot] + n, least)
    for first in range(0, slots, SENT * BITMAP):
        rows = [(i, np.flatnonzero(x), x) for i, x in enumerate(seen[first : first + SENT * BITMAP].reshape(-1, BITMAP), first // BITMAP)]
        rows = [(i, at.astype(np.uint16).tobytes(), x[at].tobytes()) for i, at, x in rows if len(at)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["i", "at", "n"])


def _full(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, b): the bits of the slots that `least` runs or more fall into, in all rows of one i together."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if i not in held:
                held[i] = np.zeros(BITMAP, np.min_scalar_type(least))
            at = np.frombuffer(at, np.uint16)
            held[i][at] = np.minimum(held[i][at] + np.frombuffer(n, np.min_scalar_type(least)).astype(np.int64), least)
    for i, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(x >= least, bitorder="little").tobytes()], pa.binary())], names=["i", "b"])


def _phrases(batches: Iterator[pa.RecordBatch], frequent: Broadcast, pairs: Broadcast, max_n: int, marked: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, n) of the candidate runs of 2 to max_n words."""
    held = _Held()
    for lang, words, runs in _candidates(batches, frequent, pairs, max_n, marked):
        for n, (at, _) in enumerate(runs, 2):
            held.add(lang, [b" ".join(words[i : i + n]) for i in at.tolist()])
        yield from held.rows()
    yield from held.rows(1)


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of the phrases of 1 to max_n words found `least` times or more, and (lang, n) of all word occurrences."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "lang string, phrase string, n long"
    words = staged(texts.mapInArrow(_words, schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    often = words.where(F.col("n") >= least)

    def sent(hashes: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(bitmap(hashes, "h", hashes.count()))

    frequent = sent(often.select(F.xxhash64("lang", "phrase").alias("h")))
    # A clash of two pairs' hashes adds up their counts: one more pair is marked, none is lost.
    counts = texts.mapInArrow(lambda b: _pairs(b, frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = sent(staged(counts.select("h"), "pairs"))
    # As many tasks as cores: each adds up a phrase once, so the rows shuffled grow with the phrases and not with the files as well.
    few = texts.coalesce(spark.sparkContext.defaultParallelism)
    marked = None
    if max_n > 2:
        slots = min(SLOTS, max(MIN_BITS, 1 << ((words.agg(F.sum("n")).first()[0] or 0) // WORDS_A_SLOT).bit_length()))
        tallies = few.mapInArrow(lambda b: _slotted(b, frequent, pairs, max_n, slots, least), "i long, at binary, n binary")
        marked = spark.sparkContext.broadcast(_bits(tallies.repartition("i").mapInArrow(lambda b: _full(b, least), "i long, b binary"), slots))
    longer = few.mapInArrow(lambda b: _phrases(b, frequent, pairs, max_n, marked), schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    grams = staged(often.select("lang", "phrase", "n").unionAll(longer).withColumn("size", F.size(F.split("phrase", " "))), "phrases")
    for sent_ in filter(None, (frequent, pairs, marked)):
        sent_.destroy()
    return grams, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score and count, equals by their UTF-8 bytes.

    A phrase (2 to max_n words of one piece, a = its count, `least` or more) is cut at each place into a first part of count l and a rest
    of count r; score is floor(1000 a n / (l r)), n the language's words, at the cut where that is least (of equal ones the first). Phrases
    that a candidate of one more word holds as often (then any longer one that does so holds one of these) are dropped, and the rest ranked.
    Null texts are empty, a null language is `und`; empty texts, texts of separators and an empty table give no rows. Repeated rows count
    each time; ids and other columns are not looked at. Texts of any length are read in parts, their phrases counted whole.
    """
    grams, totals = phrase_counts(docs, max_n, least, lang_col, text_col)
    part = lambda c, n: grams.select(F.col("lang").alias(f"{c}_lang"), F.col("phrase").alias(c), F.col("n").alias(n))
    ws = F.split("phrase", " ")
    cut = grams.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.array_join(F.slice(ws, 1, F.col("k")), " "), "rest": F.array_join(F.slice(ws, F.col("k") + 1, F.col("size")), " ")})
    cut = cut.join(part("prefix", "l"), (F.col("lang") == F.col("prefix_lang")) & (F.col("first") == F.col("prefix")))
    cut = cut.join(part("suffix", "r"), (F.col("lang") == F.col("suffix_lang")) & (F.col("rest") == F.col("suffix"))).join(F.broadcast(totals), "lang")  # one row a language
    cut = cut.withColumns({"above": _decimal("a") * _decimal("n") * F.lit(1000), "below": _decimal("l") * _decimal("r")}).withColumn("score", F.expr("above div below"))
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    long_ = grams.where("size > 2").select("lang", F.col("n").alias("a"), F.explode(F.array(F.array_join(F.slice(ws, 1, F.col("size") - 1), " "), F.array_join(F.slice(ws, 2, F.col("size") - 1), " "))).alias("phrase"))
    kept = scored.join(long_, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS ws FROM pieces),
runs AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 6) AS s(size) WHERE len(ws) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM often c JOIN range(1, 5) AS ks(k) ON k < c.size
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:c.size], ' ')
  JOIN totals t ON t.lang = c.lang WHERE c.size > 1),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM often x WHERE x.lang = b.lang AND x.size > 1 AND x.f >= b.a AND x.phrase <> b.phrase AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
