"""Quality rules, in DataFrame functions only: line, symbol and repetition rules, then a hashed n-gram log-likelihood ratio.

Word uni- and bigrams are hashed to BUCKETS buckets. Two multinomials are counted over them: the raw one over all documents, the
trusted one over all documents with a trusted label. A document's verdict is its mean log ratio of the two, held against a threshold set
by the spread of the trusted documents' own ratios; no draw is made, so equal texts are treated equally. The table of ratios has BUCKETS
entries, whatever the corpus, and enters the plan as a constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS, LOST, BROADCAST, DIGITS = 10_000, 0.002, 2_000_000, 4  # BROADCAST: ids
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def buckets(ws: Column, n: int = BUCKETS) -> Column:
    """Buckets of a word array's uni- and bigrams; bigrams of an array without two words: none."""
    pairs = F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int"))
    return F.concat(F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int")), F.when(F.size(ws) > 1, pairs).otherwise(F.expr("cast(array() as array<int>)")))


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words which is found twice or more in the array."""
    n = F.size(ws)

    def let(value: Column, body) -> Column:  # evaluates value once
        return F.transform(F.array(value), body)[0]

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            m = F.size(p) - 1
            same = F.zip_with(F.slice(p, 1, m), F.slice(p, 2, m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.expr("cast(array() as array<int>)")))
            return F.sort_array(F.array_distinct(F.flatten(same)))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(width), p - acc["last"])).alias("sum"))
        return F.aggregate(let(pairs, positions), start, step, lambda acc: acc["sum"])

    def windows(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(width)]))

    found = let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(0))
    return F.when(n < width + 1, 0).otherwise(found).cast("long")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id) of the rows with a trusted label, each once."""
    return labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n: int = BUCKETS) -> list[float]:
    """log p_trusted - log p_raw of each bucket, add-one smoothed; all zero where no row has a trusted label."""
    ids = trusted_ids(labels, id_col, label_col).withColumn("hit", F.lit(1))
    # Few ids go to the texts; many meet them in a shuffle.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws")).join(ids, "id", "left")
    grams = rows.select("hit", F.explode(buckets(F.col("ws"), n)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("hit").alias("good")).collect()  # at most n rows
    raw, good = [1] * n, [1] * n
    for r in counts:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    if sum(good) == n:
        return [0.0] * n
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(math.log(g) - math.log(r) + shift, 5) for g, r in zip(good, raw, strict=True)]


def points(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """The least values, to DIGITS digits, that those shares of the rows do not exceed, None without rows.

    Values are counted by their first DIGITS digits, so the points are the same however the rows are dealt. A mean log ratio of two
    smoothed shares is within a few tens of zero, so at most some 10**DIGITS times that many counts reach the driver.
    """
    scale = 10**DIGITS
    counts = sorted((r["v"], r["n"]) for r in df.where(F.col(col).isNotNull()).groupBy(F.floor(F.col(col) * scale).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, out = sum(n for _, n in counts), []
    for share in shares:
        need, seen = max(1, math.ceil(share * total)), 0
        for v, n in counts:
            seen += n
            if seen >= need:
                out.append(v / scale)
                break
        else:
            out.append(None)
    return out


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float | None = None, n: int = BUCKETS, lost: float = LOST) -> DataFrame:
    """One row for each document with its base counts, base_failed, llr and kept.

    threshold: the least ratio of a kept document. By default it lies half as far again below the median of the trusted documents that
    pass the base rules as the ratio which all but a share `lost` of them reach, so that hardly any trusted text falls below it and no
    single one moves it (without any trusted document, all that pass are kept). A null or empty text, or one of white space, has no words: all counts 0,
    base_failed true, llr null, kept false. Repeated rows are judged each for itself, and each counts in the raw multinomial. Columns
    besides id and text are not looked at. An empty table has no rows. A text's words are held as one array, however long it is.
    """
    table = F.split(F.lit(",".join(map(str, ratios(docs, labels, id_col, text_col, label_col, n)))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("ws", words(F.col("text"))).withColumn("lines", lines)
    df = df.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.aggregate(buckets(F.col("ws"), n), F.lit(0.0), lambda acc, b: acc + F.get(table, b)).alias("sum"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    llr = F.when(F.col("n_words") > 0, F.col("sum") / (2 * F.col("n_words") - 1))
    df = staged(df.withColumn("llr", llr).drop("sum"), "quality")
    if threshold is None:
        passed = df.where("not base_failed").join(trusted_ids(labels, id_col, label_col).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        low, middle = points(passed, "llr", [lost, 0.5])
        threshold = None if low is None else low - (middle - low) / 2
    verdict = F.coalesce(F.col("llr") >= (-math.inf if threshold is None else threshold), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & verdict)
