"""Toxicity by a weighted finite-state pattern grammar: clauses are scored, not words by themselves.

Words go through a lexicon transducer (a trie of whole words and stems, the longest that matches) to classes: insult, threat, target,
negation, reported speech, or none. Small transducers over classes, each with a few states, say what a class is worth in its place:
an insult near a person it is aimed at weighs more, a threat only counts in full with its target, negation shortly before and reported
speech in the same clause take weight away. Their composition is one table (state, class) -> (state, factor, addend), made once; a
clause starts in its first state and its weight is what its path emits. A document's clause weights give a few numbers, which a
logistic curve turns into the score.

English words are stated below. Stems of any language are added from labelled texts: those found in far more toxic than other ones, and
in a SHARE of the toxic ones at least, with half the log ratio of their rates as weight; near copies in the sample count once. Stems and curve are fitted on at most SAMPLE labelled rows, those with the least hash of their id.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

SAMPLE, STEMS, CUT, HELD_OUT = 8_000, 2_000, 0.3, (4, 2)
SHORT, LONG, EVIDENCE, FOUND, SHARE = 4, 10, 6.0, 5, 0.01  # stem lengths, least z-value, least toxic texts and least share of them
PART, CACHE = 1 << 20, 1 << 17

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: The stated lexicon: a word, or a stem that ends in "*"; insults and threats with their weights.
WORDS: dict[int, dict[str, float]] = {
    INSULT: dict.fromkeys("idiot* moron* imbecile* cretin* scum* vermin* loser* trash* pathetic* worthless* disgusting* stupid* dumbass* clown* subhuman* filth* parasite* garbage lowlife* scumbag* bastard* bitch* asshole* jerk* fool*".split(), 2.0),
    THREAT: dict.fromkeys("kill killing murder murdering hurt hurting beat destroy strangle stab stabbing shoot shooting burn hang punch smash crush".split(), 0.2),
    TARGET: dict.fromkeys("you your yours youre yourself he him his she her they them their those people everyone".split(), 0.0),
    NEGATION: dict.fromkeys("not no never nobody nothing without isnt arent dont doesnt didnt wont cannot cant neither nor".split(), 0.0),
    REPORT: dict.fromkeys("said says saying claimed claims called calls wrote writes quoted quotes quote reportedly allegedly according alleged stated".split(), 0.0),
}

Arc = tuple[int, float, float]  # next state, factor on the word's own weight, addend


def negation(state: int, kind: int) -> Arc:
    """States: words that the last negation still reaches, 0 to 3."""
    return (3 if kind == NEGATION else max(0, state - 1)), (0.25 if state else 1.0), 0.0


def reported(state: int, kind: int) -> Arc:
    """States: 0, or 1 after a verb of speech, up to the clause's end."""
    return (1 if kind == REPORT else state), (0.5 if state else 1.0), 0.0


def aimed(state: int, kind: int) -> Arc:
    """States: words that the last target still reaches as the one insulted, 0 to 4."""
    return (4 if kind == TARGET else max(0, state - 1)), (1.5 if state and kind == INSULT else 1.0), 0.0


def threatened(state: int, kind: int) -> Arc:
    """States: words within which a threat still looks for its target, 0 to 3."""
    if kind == THREAT:
        return 3, 1.0, 0.0
    return (0, 1.0, 2.0) if kind == TARGET and state else (max(0, state - 1), 1.0, 0.0)


@dataclass(frozen=True)
class Machine:
    """A composed transducer: `after` and `factor`, `addend` by state and class; `idle[s][g]`: the state after g (REACH at most) other words."""

    after: list[list[int]]
    factor: list[list[float]]
    addend: list[list[float]]
    idle: list[list[int]]


REACH = 4


def composed(parts: tuple = (negation, reported, aimed, threatened), classes: int = 6) -> Machine:
    """Product of the parts over the states that can be reached: factors multiply, addends add up and are multiplied like weights."""
    at, todo, after, factor, addend = {(0,) * len(parts): 0}, [(0,) * len(parts)], [], [], []
    for state in todo:  # grows as new states are met
        rows: tuple[list[int], list[float], list[float]] = ([], [], [])
        for kind in range(classes):
            arcs = [p(s, kind) for p, s in zip(parts, state, strict=True)]
            to = tuple(a[0] for a in arcs)
            if to not in at:
                at[to] = len(at)
                todo.append(to)
            scale = math.prod(a[1] for a in arcs)
            for r, v in zip(rows, (at[to], scale, scale * sum(a[2] for a in arcs)), strict=True):
                r.append(v)
        for table, r in zip((after, factor, addend), rows, strict=True):
            table.append(r)
    idle = []
    for s in range(len(after)):
        row = [s]
        for _ in range(REACH):
            row.append(after[row[-1]][OTHER])
        idle.append(row)
    return Machine(after, factor, addend, idle)


@dataclass
class Lexicon:
    """Transducer of words to entries (class, weight): whole words, and stems of which the longest wins."""

    whole: dict[bytes, int] = field(default_factory=dict)
    stems: dict[bytes, int] = field(default_factory=dict)
    entries: list[tuple[int, float]] = field(default_factory=lambda: [(OTHER, 0.0)])

    def add(self, pattern: str, kind: int, weight: float) -> None:
        """pattern: a word, or a stem that ends in "*"; what is there already stays."""
        table, key = (self.stems, pattern[:-1].encode()) if pattern.endswith("*") else (self.whole, pattern.encode())
        if key not in table:
            table[key] = len(self.entries)
            self.entries.append((kind, weight))

    def entry(self, word: bytes) -> int:
        if (found := self.whole.get(word)) is not None:
            return found
        for k in range(min(len(word), self.longest()), 0, -1):
            if (found := self.stems.get(word[:k])) is not None:
                return found
        return 0

    def longest(self) -> int:
        return max(map(len, self.stems), default=0)


def stated() -> Lexicon:
    out = Lexicon()
    for kind, words in WORDS.items():
        for w, weight in words.items():
            out.add(w, kind, weight)
    return out


#: What ends a clause becomes a line feed, other ASCII signs but the apostrophe (dropped) become blanks.
FOLD = bytes(10 if b in b".;:!?\n\r\x0b\x0c" else 32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def _parts(text: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of a lower-cased text and the clause (counted from the part's first) that each stands in, PART bytes at a time, cut at blanks."""
    b = text.lower().encode().translate(FOLD, b"'")
    at = 0
    while at < len(b):
        end = min(len(b), at + PART)
        while end < len(b) and b[end] not in b" \n":
            end += 1
        bytes_ = np.frombuffer(b, np.uint8, end - at, at)
        gap = (bytes_ == 32) | (bytes_ == 10)
        starts = ~gap
        starts[1:] &= gap[:-1]
        yield b[at:end].split(), np.cumsum(bytes_ == 10)[starts]
        at = end


class _Entries(dict):
    """Word -> entry of a lexicon; bounded."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.longest = lexicon, lexicon.longest()
        self.seen = {len(s) for s in lexicon.stems}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = e = self.lexicon.entry(word)
        return e


class Scorer:
    """Clause weights of texts under one lexicon and one machine."""

    def __init__(self, lexicon: Lexicon, machine: Machine) -> None:
        self.at, self.entries, self.m = _Entries(lexicon), lexicon.entries, machine

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Weights of the clauses that have one, and the number of words of the text. A clause that runs over a part's end goes on in the next."""
        m, out, n_words = self.m, [], 0
        state, weight, last, clause, before = 0, 0.0, 0, 0, 0
        for words, where in _parts(text or ""):
            codes = np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))
            for i in np.flatnonzero(codes).tolist():
                kind, own = self.entries[codes[i]]
                now, place = before + int(where[i]), n_words + i
                if now != clause:
                    if weight:
                        out.append(weight)
                    state, weight, clause = 0, 0.0, now
                else:
                    state = m.idle[state][min(REACH, place - last - 1)]
                weight += own * m.factor[state][kind] + m.addend[state][kind]
                state, last = m.after[state][kind], place
            n_words += len(words)
            before += int(where[-1]) if len(where) else 0
        if weight:
            out.append(weight)
        return out, n_words

    def features(self, text: str | None) -> list[float]:
        """log of the clauses' sum, the heaviest clause, the log of their number and the log of the sum a thousand words."""
        weights, n = self.clauses(text)
        total = sum(weights)
        return [math.log1p(max(0.0, total)), min(20.0, max(weights, default=0.0)), math.log1p(len(weights)), math.log1p(1000 * max(0.0, total) / max(n, 50))]


#: Coefficients where nothing is labelled: one plain insult comes to about a half.
UNFITTED = (-2.5, np.array([0.7, 0.7, 0.0, 0.0]))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    machine: Machine
    bias: float
    slopes: np.ndarray

    def scorer(self):
        s, bias, slopes = Scorer(self.lexicon, self.machine), self.bias, self.slopes

        def score(text: str | None) -> float:
            return float(1 / (1 + math.exp(-min(40.0, max(-40.0, bias + float(slopes @ np.array(s.features(text))))))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, np.ndarray]:
    """Bias and slopes by Newton steps on a ridged log loss; slopes are no less than zero, as weight never makes a text cleaner."""
    spread = np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), x / spread])
    free, w = np.ones(z.shape[1], bool), np.zeros(z.shape[1])
    for _ in range(z.shape[1]):
        w[~free] = 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            g = z.T @ (p - y) / len(y) + ridge * w * (np.arange(len(w)) > 0)
            h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (ridge + 1e-9) * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        below = (w < 0) & (np.arange(len(w)) > 0)
        if not below.any():
            break
        free &= ~below
    w[1:] = np.maximum(w[1:], 0.0)
    return float(w[0]), w[1:] / spread


def stem_rows(text: str | None) -> Counter:
    """How often each stem (SHORT to LONG bytes of a word's beginning, cut at whole characters) and each whole shorter word ("^" ahead) occurs."""
    words: Counter = Counter()
    for part, _ in _parts(text or ""):
        words.update(part)
    out: Counter = Counter()
    for w, n in words.items():
        for k in range(SHORT, min(LONG, len(w)) + 1):
            if k == len(w) or w[k] & 0xC0 != 0x80:
                out[w[:k]] += n
    return out


def chosen_stems(counts: list[tuple[bytes, int, int, int, int]], texts: tuple[int, int], words: tuple[int, int]) -> list[tuple[str, float]]:
    """Stems and weights out of (stem, texts and occurrences with label 0, the same with label 1); none is the beginning of another."""
    rows = []
    for stem, d0, o0, d1, o1 in counts:
        p = (d0 + d1) / sum(texts)
        z = (d1 / texts[1] - d0 / texts[0]) / math.sqrt(p * (1 - p) * (1 / texts[0] + 1 / texts[1]) + 1e-12)
        if z >= EVIDENCE and d1 >= max(FOUND, SHARE * texts[1]):
            weight = math.log((o1 + 0.5) / (words[1] + 1)) - math.log((o0 + 0.5) / (words[0] + 1))
            if weight > 1:
                rows.append((-round(z, 6), -len(stem), stem, min(4.0, weight / 2)))
    out: dict[bytes, float] = {}
    inner: set[bytes] = set()
    for _, _, stem, weight in sorted(rows):
        if stem not in inner and not any(stem[:k] in out for k in range(SHORT, len(stem))):
            out[stem] = weight
            inner.update(stem[:k] for k in range(SHORT, len(stem) + 1))
        if len(out) >= STEMS:
            break
    return [(s.decode() + "*", w) for s, w in sorted(out.items())]


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % HELD_OUT[0] == HELD_OUT[1]


def minima(text: str | None) -> list[int]:
    """Least of four mixed hashes of the text's three-word runs: near copies share one, other texts hardly ever."""
    words = [zlib.crc32(w) for part, _ in _parts(text or "") for w in part]
    h = np.array(words + [0] * max(0, 3 - len(words)), np.uint64)
    with np.errstate(over="ignore"):
        runs = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        return [int(((runs ^ runs >> np.uint64(29)) * np.uint64(odd)).min() >> np.uint64(1)) for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, y, text) of at most `sample` labelled ids that aren't held out, one row for each: the text of least hash, the lower label."""
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), "text")


def unlike(rows: DataFrame) -> DataFrame:
    """Rows of a sample, one of each group of near copies of a label, so that the words of a text that is often copied count once."""
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([minima(t.as_py()) for t in b.column(2)], pa.list_(pa.int64()))], names=["id", "y", "m"])

    seen: set[tuple[int, int, int]] = set()
    ids = []
    for r in sorted(rows.mapInArrow(sketched, "id string, y int, m array<long>").collect(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"])):  # four numbers a row of the sample
        marks = {(r["y"], i, m) for i, m in enumerate(r["m"])}
        if not marks & seen:
            ids.append((r["id"],))
        seen |= marks
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(ids, "id string")), "id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Stems are counted by tasks over the sample, of which at most 20 * STEMS reach the driver, then the sample's clause features do."""
    rows = unlike(staged(sampled(docs, labels, id_col, text_col, label_col, sample), "toxic-sample"))
    lexicon, machine = stated(), composed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for stem, n in stem_rows(text).items():
                    r = held.setdefault(stem, [0, 0, 0, 0])
                    r[2 * y] += 1
                    r[2 * y + 1] += n
                if len(held) > 1 << 18:
                    yield packed(held)
        if held:
            yield packed(held)

    def packed(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        columns = np.array(list(held.values()), np.int64).reshape(-1, 4).T
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), *[pa.array(c) for c in columns]], names=["stem", "d0", "o0", "d1", "o1"])
        held.clear()
        return out

    texts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(texts) < 2:
        return Model(lexicon, machine, *UNFITTED)
    all_ = rows.select("y", "text").mapInArrow(count, "stem binary, d0 long, o0 long, d1 long, o1 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d0", "o0", "d1", "o1")])
    rate = lambda y: F.col(f"d{y}") / F.lit(float(texts[y]))
    found = all_.where((F.col("d1") >= FOUND) & (rate(1) > 2 * rate(0))).orderBy(F.desc(rate(1) - rate(0)), "stem").limit(20 * STEMS).collect()
    # Words of each class are only a scale for the rates; their bytes stand for them.
    size = {r["y"]: r["n"] or 0 for r in rows.groupBy("y").agg(F.sum(F.length("text")).alias("n")).collect()}
    for pattern, weight in chosen_stems([(bytes(r["stem"]), *r[1:]) for r in found], (texts[0], texts[1]), (size[0], size[1])):
        lexicon.add(pattern, INSULT, weight)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(lexicon, machine)
        for b in batches:
            x = [s.features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = sorted(rows.mapInArrow(features, "id string, y int, x array<double>").collect(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))  # `sample` rows of four numbers
    return Model(lexicon, machine, *_logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], np.float64)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score and predicted of each row; no row is dropped."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # STEMS entries at most, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for b in batches:
            s = np.array([of(t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[id_col, "score", "predicted"])

    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(fresh(docs, "text")))
    return df.mapInArrow(score, docs.select(id_col).schema.add("score", "double").add("predicted", "integer"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each document; labels of held-out documents are never seen.

    Null and empty texts are scored like any other (no clause); a null id is not held out. An id labelled twice counts as the lower label,
    an id of several rows lends one of its texts. Without labels of both kinds the stated lexicon and fixed coefficients are used. Repeated
    rows are scored each for itself, other columns are not looked at, an empty table has no rows. Texts of any length are read in parts;
    a clause goes on over a part's end.
    """
    out = scored(docs, train(docs, labels, id_col, text_col, label_col, sample), id_col, text_col)
    return out.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")
