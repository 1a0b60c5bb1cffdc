"""Containment of items in documents by an inverted index of word grams.

Items are the small side. While they have BROADCAST distinct grams at most, their hashes go to all tasks as a sorted array behind a table
of their high bits, and documents are read once: words are hashed (a cache knows most), a gram's hash is rolled over its words' hashes for
a block of documents at a time, and only grams whose hash is in the array are put together as text and joined with the items' own. Beyond
that the hashes of all grams are rows and the join is left to the planner, which shuffles both sides by gram. Both ways find the same
rows; a text under n words is one gram in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.rules import containment_verdict, lexical_label
from ..functions.text import normalize_text, plain_tokens, tokens, word_grams
from ..staging import small_batches, staged
from .ranks import ranked

BROADCAST, LEAST, HELD = 500_000, 0.45, 1 << 20  # HELD: characters of all items
BLOCK, ROWS, CACHE, HIGH, ODD = 1 << 19, 256, 1 << 17, 22, np.uint64(0x9E3779B97F4A7C15)  # bytes of a block, rows taken at once, cached words, bits of the table, base of the rolled hash
#: ASCII punctuation as blanks, as normalize_text() has it; and all but a-z and 0-9, as plain_tokens() has it.
PUNCTUATION = bytes(32 if 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E else b for b in range(256))
PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def grams(df: DataFrame, text: str, n: int = 13, plain: bool = False, short: bool = True) -> DataFrame:
    """id and g: distinct word grams of a text column."""
    words: Column = plain_tokens(F.col(text)) if plain else tokens(F.col(text))
    return df.select("id", word_grams(words, n, short).alias("g"))


def _gram_hashes(words: Column, n: int) -> Column:
    """One long for each n words in a row, from the words' own hashes; fewer words: one for all of them."""
    def slide(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= n, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), slide)[0]


class _Words(dict):
    """Word -> its 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n among the word hashes h."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * ODD + h[j : len(out) + j]
        return (out ^ out >> np.uint64(32)) * ODD + np.uint64(n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of BLOCK bytes or one row more."""
    for b in batches:
        ids, texts, size = [], [], 0
        for at in range(0, b.num_rows, ROWS):  # not the whole batch as Python's values at once
            some = b.slice(at, ROWS)
            for i, t in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                if (size := size + len(t)) >= BLOCK:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _scan(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, n: int, plain: bool) -> Iterator[pa.RecordBatch]:
    """(id, lower-cased text) -> (id, gram): the distinct grams of each text whose hash is wanted (sorted); a text under n words is one gram."""
    high = np.zeros(1 << HIGH, bool)
    high[wanted >> np.uint64(64 - HIGH)] = True
    words, fold = _Words(), PLAIN if plain else PUNCTUATION

    def hits(h: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(high[h >> np.uint64(64 - HIGH)])
        at = np.searchsorted(wanted, h[near])
        return near[wanted[np.minimum(at, len(wanted) - 1)] == h[near]] if len(wanted) else near[:0]

    for ids, texts in _blocks(batches):
        parted = [t.translate(fold).split() for t in texts]
        ends = np.cumsum([len(p) for p in parted])
        flat = [w for p in parted for w in p]
        h = np.fromiter(map(words.__getitem__, flat), np.uint64, len(flat))
        doc = np.repeat(np.arange(len(parted)), np.diff(ends, prepend=0))
        found = set()
        at = hits(_rolled(h, n))
        for i in at[doc[at] == doc[at + n - 1]].tolist():
            found.add((int(doc[i]), b" ".join(flat[i : i + n])))
        for i, p in enumerate(parted):
            if 0 < len(p) < n and len(hits(_rolled(h[ends[i] - len(p) : ends[i]], len(p)))):
                found.add((i, b" ".join(p)))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.string())], names=["doc", "gram"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        hs = [_rolled(np.array([words[w] for w in g.split(b" ")], np.uint64), g.count(b" ") + 1)[0] for g in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64))], names=["h"])


def _met(items: DataFrame, docs: DataFrame, n: int, plain: bool, short: bool = True) -> DataFrame:
    """item, n_grams, gram, doc of each document (id, text) where a gram of the items (id, g) stands; rows may repeat. short: as in matches()."""
    own = items.select(F.explode("g").alias("gram")).distinct()
    if own.limit(BROADCAST + 1).count() > BROADCAST:
        found = _met_shuffled(items, docs, n, plain)
        return found if short else found.where(F.size(F.split("gram", " ")) >= n)
    return hits(items, docs, n, plain).drop("place")


def hits(items: DataFrame, docs: DataFrame, n: int = 13, plain: bool = False) -> DataFrame:
    """item, n_grams, place, gram, doc: where the items' grams (id, g; BROADCAST distinct ones at most) stand in documents, a table or a stream.

    A document's rows follow one another; place is the gram's among the item's.
    """
    left = items.select(F.col("id").alias("item"), F.size("g").alias("n_grams"), F.posexplode("g").alias("place", "gram"))
    own = left.select("gram").distinct()
    wanted = np.unique(own.mapInArrow(_hashed, "h long").toArrow().column(0).to_numpy().view(np.uint64))  # BROADCAST longs at most
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    texts = docs.select(F.col("id").cast("string").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    hit = texts.mapInArrow(lambda b: _scan(b, held.value, n, plain), StructType([StructField("doc", StringType()), StructField("gram", StringType())]))
    return hit.join(F.broadcast(left), "gram").select("item", "n_grams", "place", "gram", F.col("doc").cast(docs.schema["id"].dataType).alias("doc"))


def _met_shuffled(items: DataFrame, docs: DataFrame, n: int, plain: bool) -> DataFrame:
    """_met() for any number of items' grams: all grams of the documents meet them in a shuffle."""
    left = items.select(F.col("id").alias("item"), F.size("g").alias("n_grams"), F.explode("g").alias("own"))
    left = left.withColumn("k", F.get(_gram_hashes(F.split("own", " "), n), 0)).where("k is not null")
    words = plain_tokens(F.col("text")) if plain else tokens(F.col("text"))
    doc = F.struct("id").alias("doc")  # meets itself without an id, too
    right = docs.select(doc, F.posexplode(_gram_hashes(words, n)).alias("at", "k"))
    # Longs alone are held against the items; words are put together again for the few documents in which some met.
    hit = staged(right.join(_few(left), "k").select("item", "n_grams", "own", "doc", "at"), "grams-met")
    gram = F.array_join(F.slice("w", F.col("at") + 1, n), " ")
    whole = docs.select(doc, "text").join(hit.select("doc").distinct(), "doc", "left_semi").select("doc", words.alias("w"))
    return hit.join(whole, "doc").where(gram == F.col("own")).select("item", "n_grams", F.col("own").alias("gram"), F.col("doc.id").alias("doc"))


def matches(items: DataFrame, docs: DataFrame, n: int = 13, plain: bool = False, short: bool = False) -> DataFrame:
    """item, doc, n_grams, n_shared of each item (id, g: its distinct grams) and document (id, text) with a gram of n words in common.

    short: items under n words, one gram each, are met whatever the number of grams. Not so without it, beyond BROADCAST distinct grams; every
    query asks for it.
    """
    return _met(items, docs, n, plain, short).distinct().groupBy("item", "doc", "n_grams").agg(F.count(F.lit(1)).alias("n_shared"))


def containment_max(items: DataFrame, docs: DataFrame, n: int = 13) -> DataFrame:
    """Per-document maximum: item, n_grams, n_matched, containment, verdict; items without a match have 0."""
    own = grams(items, "prompt", n)
    best = matches(own, docs, n, short=True).groupBy("item").agg(F.max("n_shared").alias("n_matched"))
    return _verdicts(own, best)


def containment_union(items: DataFrame, docs: DataFrame, n: int = 13) -> DataFrame:
    """Grams found anywhere in the corpus; plain tokens, items under n of them are too short."""
    own = grams(items, "prompt", n, plain=True, short=False)
    found = _met(own, docs, n, True).select("item", "gram").distinct()
    return _verdicts(own, found.groupBy("item").agg(F.count(F.lit(1)).alias("n_matched")))


def _verdicts(own: DataFrame, matched: DataFrame) -> DataFrame:
    df = own.select(F.col("id").alias("item"), F.size("g").alias("n_grams")).join(matched, "item", "left")
    value = F.coalesce(F.try_divide(F.coalesce("n_matched", F.lit(0)), F.col("n_grams")), F.lit(0.0))
    return df.select("item", "n_grams", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"), value.alias("containment"), containment_verdict(value, F.col("n_grams")).alias("verdict"))


def _char_hashes(t: Column, n: int = 5) -> Column:
    """A long for each distinct n-character window of a normalised text; a shorter text is one window."""
    def slide(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(n)])))

    return F.when(F.length(t) > n, F.transform(F.array(F.split(t, "")), slide)[0]).otherwise(F.array(F.xxhash64(t)))


def _counted(df: DataFrame, name: str, text: str, most: Column, *more: str) -> DataFrame:
    """name, kind (c: character gram, w: word), hash and count of each distinct feature of a text, beside its numbers of features.

    Texts of over `most` distinct character grams give their words only. more: columns that are carried along.
    """
    def feature(kind: str, k: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), n.alias("n"))

    t = df.select(F.col("id").alias(name), *more, normalize_text(F.col(text)).alias("t")).where("t <> ''")
    t = t.select(name, *more, _char_hashes(F.col("t")).alias("chars"), F.sort_array(F.split("t", " ")).alias("ws"))
    # Equal words stand together; a word's count is the way from its first place to the next word's.
    first = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (i == 0) | (F.get("ws", i) != F.get("ws", i - 1)))
    t = t.select(name, *more, "chars", "ws", first.alias("first"))
    words = F.transform("first", lambda i, j: feature("w", F.xxhash64(F.get("ws", i)), F.coalesce(F.get("first", j + 1), F.size("ws")) - i))
    chars = F.transform(F.when(F.size("chars") <= most, F.col("chars")).otherwise(F.expr("cast(array() as array<bigint>)")), lambda g: feature("c", g, F.lit(1)))
    numbers = [F.size("chars").alias("n_c"), F.size("first").alias("n_w"), F.size("ws").alias("total")]
    return t.select(name, *more, *numbers, F.explode(F.concat(chars, words)).alias("f")).select(name, *more, "n_c", "n_w", "total", "f.*")


def _rarest(left: DataFrame) -> DataFrame:
    """The features of each item without one of which no document can have a score of LEAST with it.

    A score of LEAST takes that share of the item's words, of its words as often as they stand, or of its character grams. Features are
    taken from the rarest on, until what is left is under that share. Any order serves; the number of items that hold a feature stands
    for the documents that do, which saves a pass over them.
    """
    often = left.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("often"))
    w = Window.partitionBy("item", "kind").orderBy("often", "k").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value: F.coalesce(F.sum(value).over(w), F.lit(0))
    f = left.join(often, ["kind", "k"]).withColumns({"places": before(F.lit(1)), "weight": before("i_n")})
    size, rest = F.when(F.col("kind") == "c", F.col("i_n_c")).otherwise(F.col("i_n_w")), 1 - LEAST + 1e-9
    return f.where((F.col("places") <= rest * size) | ((F.col("kind") == "w") & (F.col("weight") <= rest * F.col("i_total")))).select("item", "kind", "k", "i_n_c", "i_total")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _windows(t: str, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct n-character windows of a normalised text; a shorter text is one window."""
    c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(_rolled(c, min(n, len(c)))) if len(c) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class _Lookup:
    """Features of all items: sorted hashes, and for each the items that hold it and how often, one after another from `first` on."""

    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(features: list[tuple[np.ndarray, np.ndarray]]) -> _Lookup:
        h = np.concatenate([f for f, _ in features]) if features else np.zeros(0, np.uint64)
        item, times = np.repeat(np.arange(len(features)), [len(f) for f, _ in features]), np.concatenate([n for _, n in features]) if features else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        return _Lookup(hashes, np.append(first, len(h)), item[order], times[order])

    def met(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, item, its count) for each item that holds one of the distinct hashes h."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        own = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, np.int64)
        n = self.first[at[own] + 1] - self.first[at[own]]
        flat = np.arange(n.sum()) + np.repeat(self.first[at[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(own) else np.zeros(0, np.int64)
        return np.repeat(own, n), self.item[flat], self.times[flat]


def _pairs(batches: Iterator[pa.RecordBatch], held: tuple) -> Iterator[pa.RecordBatch]:
    """(id, normalised text) -> (item, doc, score, whole): the pairs with a score of LEAST, or all of whose item's character grams are held."""
    names, words, chars, n_w, n_c, total, most = held
    cache, few = _Words(), total < 4
    for b in batches:
        rows: list[tuple[int, int, float, bool]] = []
        for at, text in enumerate(b.column(1)):
            t = text.as_py()
            h, n = np.unique(np.fromiter(map(cache.__getitem__, t.encode().split(b" ")), np.uint64), return_counts=True)
            place, item, times = words.met(h)
            w, m = np.bincount(item, minlength=len(names)), np.bincount(item, np.minimum(n[place], times), minlength=len(names))
            g = _windows(t)
            near = (len(g) * LEAST <= n_c) | few if len(g) <= most else np.zeros(len(names), bool)
            c = np.where(near, np.bincount(chars.met(g)[1], minlength=len(names)), 0) if near.any() else np.zeros(len(names), np.int64)
            score = np.maximum(np.maximum(w / (len(h) + n_w - w), c / (len(g) + n_c - c)), m / total)
            whole = c == n_c
            rows += [(at, i, float(score[i]), bool(whole[i])) for i in np.flatnonzero((score >= LEAST) | whole).tolist()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in cols[1]], pa.string()), b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=["item", "doc", "score", "whole"])


def _counted_through(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item, doc, score, whole of lexical_scan()'s pairs, by counting every document through for all items; items: HELD characters at most."""
    own = [(r["id"], r["t"]) for r in items.select(F.col("id").cast("string").alias("id"), normalize_text(F.col("prompt")).alias("t")).where("t <> ''").collect()]
    cache = _Words()
    counts = [np.unique(np.array([cache[x] for x in t.encode().split(b" ")], np.uint64), return_counts=True) for _, t in own]
    grams = [_windows(t) for _, t in own]
    number = lambda xs: np.array(xs, np.float64)
    n_c, total = number([len(g) for g in grams]), number([int(n.sum()) for _, n in counts])
    most = 1 << 30 if (total < 4).any() else max([len(g) for g in grams], default=0) / LEAST
    lookups = _Lookup.of(counts), _Lookup.of([(g, np.ones(len(g), np.int64)) for g in grams])
    held = docs.sparkSession.sparkContext.broadcast(([i for i, _ in own], *lookups, number([len(h) for h, _ in counts]), n_c, total, most))
    texts = docs.select(F.col("id").cast("string").alias("id"), normalize_text(F.col("text")).alias("t")).where("t <> ''")
    pairs = texts.mapInArrow(lambda b: _pairs(b, held.value), "item string, doc string, score double, whole boolean")
    return pairs.select(F.col("item").cast(items.schema["id"].dataType).alias("item"), F.col("doc").cast(docs.schema["id"].dataType).alias("doc"), "score", "whole")


def lexical_scan(items: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """item, doc, score, label: the k best labelled documents of each item by word Jaccard, character 5-gram Jaccard or weighted word overlap.

    While the items have HELD characters at most, their features go to all tasks and each document is counted through where it is. Beyond
    that candidates share one of an item's rarest features; only they are counted through, by an inverted index of all features. A Jaccard of
    LEAST needs sizes within that ratio, so longer documents are not looked up by character grams unless an item has under four words:
    one of more words whose text a document holds has LEAST by its inner words alone. Texts are compared for the best k only. An item of
    under five characters is found as a word, not within one. Texts without a word have no hit. Ties go to the lesser document id.
    """
    size = items.agg(F.coalesce(F.sum(F.length("prompt")), F.lit(0)), F.coalesce(F.min(F.size(F.split(normalize_text(F.col("prompt")), " "))), F.lit(0))).first()
    pairs = _counted_through(items, docs) if size[0] <= HELD else _looked_up(items, docs)
    least = size[1]
    own = items.select(F.col("id").alias("item"), normalize_text(F.col("prompt")).alias("it"))
    texts = docs.select(F.col("id").alias("doc"), normalize_text(F.col("text")).alias("dt"))
    pairs = staged(pairs, "lexical-pairs")
    w = Window.partitionBy("item").orderBy(F.desc(F.round("score", 9)), "doc")
    best = pairs.where(F.col("score") >= LEAST).select("item", "doc", "score")
    if (least or 0) < 4:
        low = pairs.where((F.col("score") < LEAST) & F.col("whole")).join(own, "item").join(texts, "doc").where(F.col("dt").contains(F.col("it")))
        best = best.unionAll(low.select("item", "doc", "score"))
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.join(own, "item").join(texts, "doc").select("item", "doc", "score", lexical_label(F.col("it"), F.col("dt"), F.col("score")).alias("label"))


def _looked_up(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item, doc, score, whole of lexical_scan()'s pairs for any number of items: candidates by an inverted index, which shuffles features."""
    left = _counted(items, "item", "prompt", F.lit(1 << 30))
    widest, least = left.agg(F.max("n_c"), F.min("total")).first()
    most = F.lit(1 << 30 if (least or 0) < 4 else widest / LEAST)
    left = left.select("item", *[F.col(c).alias(f"i_{c}") for c in ("n_c", "n_w", "total", "n")], "kind", "k")
    near = f"kind = 'w' or n_c <= i_n_c / {LEAST} or i_total < 4"
    rare = _few(staged(_rarest(left), "rarest"))
    found = _counted(docs, "doc", "text", most).join(rare, ["kind", "k"]).where(near).groupBy(F.col("doc").alias("id")).agg(F.collect_set("item").alias("own"))
    some = docs.select("id", "text").join(staged(found, "candidates"), "id")
    hit = _counted(some, "doc", "text", most, "own").join(_few(left), ["kind", "k"]).where(f"({near}) and array_contains(own, item)")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    pairs = hit.groupBy("item", "doc", "n_c", "n_w", "i_n_c", "i_n_w", "i_total").agg(of("c", F.lit(1)).alias("c"), of("w", F.lit(1)).alias("w"), of("w", F.least("n", "i_n")).alias("m"))
    shared = lambda kind: F.col(kind) / (F.col(f"n_{kind}") + F.col(f"i_n_{kind}") - F.col(kind))
    score = F.greatest(shared("w"), shared("c"), F.col("m") / F.col("i_total"))
    return pairs.select("item", "doc", score.alias("score"), (F.col("c") == F.col("i_n_c")).alias("whole")).where((F.col("score") >= LEAST) | F.col("whole"))


def route_attribution(items: DataFrame, docs: DataFrame, threshold: float = 0.8, n: int = 13) -> DataFrame:
    """source, item_set, n_items, share, n_rows: distinct items of each set that a source's documents hold at the threshold."""
    hit = matches(grams(items, "prompt", n), docs, n, short=True).where(F.col("n_shared") / F.col("n_grams") >= threshold)
    sets = items.select(F.col("id").alias("item"), "item_set")
    per = hit.join(sets, "item").join(docs.select(F.col("id").alias("doc"), "source"), "doc").groupBy("source", "item_set").agg(F.count_distinct("item").alias("n_items"))
    sizes, rows = sets.groupBy("item_set").agg(F.count(F.lit(1)).alias("n")), docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return per.join(sizes, "item_set").join(rows, "source").select("source", "item_set", "n_items", (F.col("n_items") / F.col("n")).alias("share"), "n_rows")


def bands(values: DataFrame, value: str = "containment") -> DataFrame:
    """Counts at each threshold, greatest and upper-middle value (that at n div 2, descending), of one column."""
    v = F.col(value)
    cuts = {"ge_999": 0.999, "ge_900": 0.9, "ge_800": 0.8, "ge_500": 0.5, "ge_300": 0.3, "ge_100": 0.1}
    counts = values.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v >= c).alias(k) for k, c in cuts.items()], F.max(v).alias("max"))
    place = ranked(values.select((-v).alias("down")), [], ["down"], "place")
    return counts.join(place, F.col("place") == F.floor(F.col("n") / 2), "left").select(*counts.columns, (-F.col("down")).alias("median"))


def scan_manifest(docs: DataFrame, text: str = "text", least: int = 40, limit: int | None = None) -> DataFrame:
    """By source: rows, skipped short ones, whether most were skipped, whether the scan met its limit and so read a sample only."""
    n, short = F.count(F.lit(1)), F.count_if(F.length(text) < least)
    sampled = F.lit(False) if limit is None else n >= limit
    return docs.groupBy("source").agg(n.alias("rows_scanned"), short.alias("rows_skipped"), (short > n * 0.5).alias("suspect"), sampled.alias("sampled"), F.when(sampled, "a prefix of the source").otherwise("the whole source").alias("coverage"))
