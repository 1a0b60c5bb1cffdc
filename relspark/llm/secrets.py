"""Secret scans, in DataFrame functions only: pattern spans, and random-looking tokens by a battery of randomness tests.

A token is a maximal run of at least MIN_TOKEN encoding characters. Its encoding is inferred from its alphabet; chi-squared uniformity
over the alphabet, a runs test about its middle and lag-1 serial correlation measure how far it is from random in that encoding. A
token's p-value is the chance that an ordinary one of its length (LONGEST where it is longer) has so low a sum of the three: characters
drawn by their shares in WORDS (English letters with some capitals, digits and separators) and scored among 64, or, for a token of
digits only, even digits scored among 16. The chances of the uniformity score are summed exactly over all letter counts and joined with
those of the two order scores, as for characters in an order without any rule (a chi-squared sum of two; letters that lie to one side
of the alphabet score higher there, so the chance is too large rather than too small). So p-values are the same in a corpus of any size.
Benjamini-Hochberg, with weights by the bits that a length holds, bounds the false discoveries over the tokens that are not letters
only as words are written. Only counts by length and score (2 x CLASSES x SCORES cells at most,
whatever the corpus) leave the table of documents; the limits found enter the last pass as constants.
"""

from __future__ import annotations

from functools import cache
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

# Span patterns; a match counts from `least` characters of its group on.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"  # the whole match has 16 characters; a run's first AKIA leaves the longest match
HEX = r"([0-9a-f]{32,})"
KINDS = ("assign", "access", "hex", "random")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding, the pattern of its tokens and its alphabet in order; the first that fits is taken.
ENCODINGS = [
    ("hex", "^(?=.*[0-9])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^(?=.*[0-9])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])[A-Z2-7]+$", UPPER + "234567"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "^.+$", UPPER + LOWER + DIGITS + "+/"),
]
MIN_TOKEN, LONGEST, SCORES, STEP, RATE = 20, 100, 1024, 16, 0.01
CLASSES = LONGEST - MIN_TOKEN + 1
TOKEN = rf"([A-Za-z0-9+/_-]{{{MIN_TOKEN},}})"
#: Letters of English text in percent, a to z (rounded published counts).
ENGLISH = (8.17, 1.49, 2.78, 4.25, 12.7, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.095, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.074)
#: What ordinary tokens (words, identifiers, paths) are taken to be drawn from: 90 % lower case, 3 % capitals, 4 % digits, 3 % in two
#: separators. A fixed assumption; tokens of more mixed make are less unlike random ones than it says.
WORDS = (*(0.9 * x / sum(ENGLISH) for x in ENGLISH), *(0.03 * x / sum(ENGLISH) for x in ENGLISH), *(0.004,) * 10, *(0.015,) * 2)
FLOOR = 1e-30  # the least p-value
HIT, CHUNK = "struct<start:int,end:int,match:string>", 512


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _chunks(array: Column) -> Column:
    """An array as arrays of at most CHUNK elements, so that a step over each element and one over each chunk stay short."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda i: F.slice(array, i * CHUNK + 1, CHUNK))


def found(text: Column, pattern: str, least: int = 1) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches whose group 1 has `least` characters; code points."""
    none = F.expr(f"cast(array() as array<{HIT}>)")

    def local(chunk: Column) -> Column:
        """A chunk's matches, placed from the chunk's own beginning, and its length."""
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            hit = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match"))
            return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(parts: Column) -> Column:
        bases = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
        shift = lambda p, base: F.transform(p["out"], lambda h: F.struct((h["start"] + base).alias("start"), (h["end"] + base).alias("end"), h["match"].alias("match")))
        return _let(bases, lambda b: F.flatten(F.zip_with(parts, F.slice(b, 1, F.size(parts)), shift)))

    def place(s: Column) -> Column:
        zipped = F.slice(F.arrays_zip(s["p"].alias("p"), s["m"].alias("m"), s["g"].alias("g")), 1, F.size(s["m"]))
        return _let(F.transform(_chunks(zipped), local), moved)

    matches = _let(F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("g")), place)
    return F.when(text.rlike(pattern), matches).otherwise(none)


def badness(token: Column) -> Column:
    """0 up: squared normal scores of the three tests of the token in its inferred encoding, summed; low looks random."""
    size, alphabet = F.lit(64.0), F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        size, alphabet = F.when(token.rlike(pattern), float(len(letters))).otherwise(size), F.when(token.rlike(pattern), letters).otherwise(alphabet)

    def tests(s: Column) -> Column:
        t, k, letters = s["t"], s["k"], s["a"]
        n, df = F.length(t).cast("double"), k - 1
        chars = F.split(t, "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0)))
        spread = 2.0 / (9.0 * df)
        chi = (F.pow((squares * k / n - n) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        chi = F.when(squares * k / n - n <= 0, 0.0).otherwise(F.greatest(chi, F.lit(0.0)))

        def order(v: Column) -> Column:
            pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            runs = F.size(F.filter(pairs, lambda p: (p["a"] < 0) != (p["b"] < 0))) + 1
            runs_z = (runs - ((n - 1) / 2 + 1)) / (F.sqrt(n - 1) / 2)
            serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["a"] * p["b"]) / ((k * k - 1) / 12)
            return F.pow(runs_z, F.lit(2.0)) + F.pow(serial / F.sqrt(n - 1), F.lit(2.0))

        return F.pow(chi, F.lit(2.0)) + _let(F.transform(chars, lambda c: F.instr(letters, c) - 1 - (k - 1) / 2), order)

    return _let(F.struct(token.alias("t"), size.alias("k"), alphabet.alias("a")), tests)


def length_class(token: Column) -> Column:
    """Classes by length, the last one open; those of tokens of digits only come after the others."""
    c = F.least(F.length(token), F.lit(LONGEST)) - MIN_TOKEN
    return (c + F.when(token.rlike("^[0-9]+$"), CLASSES).otherwise(0)).cast("int")


@cache
def nulls(digits: bool) -> list[list[float]]:
    """For each length and each score below SCORES, the chance that the three tests of an ordinary token sum up to at most that score.

    The sum of squared character counts decides the chi-squared statistic; its distribution is summed character by character for all
    lengths at once, up to the sums that SCORES can need, and then spread by the chances of the order tests' score.
    """
    order = 1 - np.exp(-np.arange(1, SCORES + 1) / (2 * STEP))  # at most that many steps
    k, shares = (16, (0.1,) * 10) if digits else (64, WORDS)
    df = k - 1
    spread = 2.0 / (9.0 * df)
    most = df * (1 - spread + (SCORES / STEP * spread) ** 0.5) ** 3  # chi-squared at the last score
    top = int((most + LONGEST) * LONGEST / k) + 1
    table = np.zeros((LONGEST + 1, top + 1))  # by characters placed and sum of squared counts
    table[0, 0] = 1.0
    for share in shares:
        more = np.zeros_like(table)
        for m in range(int(top**0.5) + 1):
            more[m:, m * m :] += share**m / factorial(m) * table[: LONGEST + 1 - m, : top + 1 - m * m]
        table = more
    out = []
    for n in range(MIN_TOKEN, LONGEST + 1):
        chi = np.cbrt(np.maximum(np.arange(top + 1) * k / n - n, 0.0) / df) - (1 - spread)
        score = np.minimum(np.maximum(chi, 0.0) ** 2 / spread * STEP, SCORES).astype(int)
        sums = np.convolve(np.bincount(score, table[n], SCORES + 1)[:SCORES], order)[:SCORES] * float(factorial(n))
        out.append(np.clip(sums, FLOOR, 1.0).tolist())
    return out


def null(c: int) -> list[float]:
    return nulls(c >= CLASSES)[c % CLASSES]


def limits(cells: list[tuple[int, int, int]], rate: float = RATE) -> list[int]:
    """Greatest score of each length class that is a discovery, -1 for none. cells: class, score, tokens.

    Benjamini-Hochberg at `rate` over p-values p / w, w being the class's bits over the mean bits of all tokens.
    """
    total = sum(n for _, _, n in cells)
    bits = lambda c: 4.0 * (c % CLASSES + MIN_TOKEN)
    mean = sum(bits(c) * n for c, _, n in cells) / total if total else 1.0
    ranked = sorted((min(1.0, null(c)[s] * mean / bits(c)) if s < SCORES else 1.0, c, s, n) for c, s, n in cells)
    rank, cut, own = 0, -1.0, {}
    for i, (p, _, _, n) in enumerate(ranked):
        rank += n
        if (i + 1 == len(ranked) or ranked[i + 1][0] > p) and p <= rate * rank / total:
            cut = p
    for p, c, s, _ in ranked:
        if p <= cut:
            own[c] = max(own.get(c, -1), s)
    return [own.get(c, -1) for c in range(2 * CLASSES)]


def _features(text: Column) -> Column:
    """base: spans of the patterns; tokens: (start, end, c, s, ref) of the tokens that no base span touches."""
    text = F.coalesce(text, F.lit(""))

    def of_kind(kind: int, pattern: str, least: int) -> Column:
        return F.transform(found(text, pattern, least), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    base = F.concat(of_kind(0, ASSIGN, 8), of_kind(1, ACCESS, 1), of_kind(2, HEX, 1))

    def tokens(base: Column) -> Column:
        def free(chunk: Column) -> Column:
            """The chunk's tokens that no base span touches; each is held against the spans about the chunk alone."""
            near = F.filter(base, lambda b: (b["start"] < F.element_at(chunk, -1)["end"]) & (chunk[0]["start"] < b["end"]))
            return _let(near, lambda n: F.filter(chunk, lambda t: ~F.exists(n, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))

        plain = _let(found(text, TOKEN), lambda a: F.when(F.size(a) > 0, F.flatten(F.transform(_chunks(a), free))).otherwise(a))
        score = lambda t: F.least(F.floor(badness(t["match"]) * STEP), F.lit(SCORES)).cast("int")
        scored = F.transform(plain, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), length_class(t["match"]).alias("c"), score(t).alias("s"), t["match"].rlike("^[A-Za-z][a-z]*$").alias("ref")))
        return F.struct(base.alias("base"), scored.alias("tokens"))

    return _let(base, tokens)


def _limits(features: DataFrame, rate: float) -> Column:
    """Limits by length class as a constant; features: a column f of _features()."""
    tokens = features.select(F.explode("f.tokens").alias("t")).where("not t.ref")
    cells = tokens.groupBy("t.c", "t.s").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 x CLASSES x SCORES rows at most
    return F.array(*[F.lit(x) for x in limits([(r["c"], r["s"], r["n"]) for r in cells], rate)])


def _spans(f: Column, cut: Column) -> Column:
    """All spans as (start, kind, end), sorted; kind is a place in KINDS."""
    more = F.transform(F.filter(f["tokens"], lambda t: (t["s"] <= F.get(cut, t["c"])) & ~t["ref"]), lambda t: F.struct(F.lit(3).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return F.sort_array(F.transform(F.concat(f["base"], more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def _listed(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans of each row.

    Null and empty texts have no span. Repeated rows are scanned each for itself, equal ones alike; other columns are not looked at. An
    empty table has no rows. Texts of any length are scanned whole, their matches in chunks.
    """
    df = staged(docs.select(F.col(id_col).alias("doc_id"), _features(F.col(text_col)).alias("f")), "secret-tokens")
    df = df.select("doc_id", _spans(F.col("f"), _limits(df, rate)).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return df.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by `mark`; texts without a span, null ones included, are as they were.

    Each row is redacted for itself, repeated ones too; an empty table has no rows. Texts are looked through once: rows are staged
    beside their features, from which the limits are counted and the spans taken.
    """
    f = fresh(docs, "features")
    rows, text = staged(docs.withColumn(f, _features(F.col(text_col))), "secret-features"), F.col(text_col)
    cut = _limits(rows.select(F.col(f).alias("f")), rate)

    def replace(spans: Column) -> Column:
        """The text between spans, in pieces that are joined once; spans that lie in earlier ones add nothing."""
        def step(acc: Column, x: Column) -> Column:
            return F.struct(F.greatest(x["end"], acc["at"]).alias("at"), F.when(x["start"] >= acc["at"], F.array_append(acc["cuts"], F.struct(acc["at"].alias("a"), x["start"].alias("b")))).otherwise(acc["cuts"]).alias("cuts"))

        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("cuts"))
        piece = lambda c: F.substring(text, c["a"] + 1, c["b"] - c["a"])
        clean = _let(F.aggregate(spans, start, step), lambda acc: F.concat(F.array_join(F.transform(acc["cuts"], piece), mark), F.lit(mark), F.substring(text, acc["at"] + 1, F.length(text))))
        return F.when(F.size(spans) > 0, clean).otherwise(text)

    return rows.withColumn(text_col, _let(_spans(F.col(f), cut), replace)).select(*docs.columns)
