"""Ablations of word problems that must not change the answer, deletions that must take it away, and the checks of both.

All of it is Column expressions over one row an item; what an ablation promises is looked up again in the finished rows by violations().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import hashed
from ..functions.text import STOP, is_question, order_safe, whole_sentences

SEED = 6198
# The inserted sentence, its word where it has no number, subjects of no word problem, titles and abbreviations that end in a
# full stop, the four cells of the two by two.
FRAME, FILLER = "A separate log listing {qty} entries about {topic} was filed in another office and has no bearing on this question.", "several"
OFF_TOPIC = ("weather", "glacier", "seabed", "pollen", "tectonic", "auroral", "sunspot", "meteorite", "volcanic", "planetary")
TITLES = "Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|Inc|Ltd|No|Fig"
CELLS = ("offtopic_noqty", "domain_noqty", "offtopic_qty", "domain_qty")
LOW, HIGH = 13, 96  # of an inserted number


def integers(x: Column) -> Column:
    """Distinct whole numbers of a text, commas left out, as decimals."""
    found = F.regexp_extract_all(x, F.lit(r"(\d[\d,]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(38,0)")), lambda v: v.isNotNull()))


def gold(answer: Column) -> Column:
    """The first whole number of an answer."""
    return F.replace(F.regexp_substr(answer, F.lit(r"-?\d[\d,]*")), F.lit(","), F.lit("")).try_cast("decimal(38,0)")


def noun(prompt: Column) -> Column:
    """The most frequent lower-case word of four letters or more that is no stop word, plurals before others, then the earliest; else null."""
    words = F.filter(F.regexp_extract_all(prompt, F.lit(r"\b([a-z]{4,})\b"), F.lit(1)), lambda w: ~w.isin(*STOP))

    def best(ws: Column) -> Column:
        plural = lambda w: F.when(w.endswith("s") & ~w.endswith("ss"), 0).otherwise(1)
        ranked = F.transform(F.array_distinct(ws), lambda w: F.struct(plural(w).alias("other"), (-F.size(F.filter(ws, lambda x: x == w))).alias("n"), F.array_position(ws, w).alias("at"), w.alias("word")))
        return F.array_min(ranked)["word"]

    return F.transform(F.array(words), best)[0]


def question_at(parts: Column) -> Column:
    """Place of the last question, else of the last sentence."""
    asked = F.filter(F.transform(parts, lambda p, i: F.when(is_question(p), i)), lambda i: i.isNotNull())
    return F.greatest(F.coalesce(F.array_max(asked), F.size(parts) - 1), F.lit(0))


def _prepared(items: DataFrame) -> DataFrame:
    asked = F.trim(F.coalesce("question", F.lit(""))) if "question" in items.columns else F.lit("")
    df = items.select("id", F.concat_ws(" ", "prompt", asked).alias("prompt"), "answer", _parts(items).alias("parts"), asked.alias("asked"))
    return df.withColumn("q", F.when(F.col("asked") != "", F.size("parts") - 1).otherwise(question_at(F.col("parts")))).drop("asked")


def _parts(items: DataFrame) -> Column:
    """Sentences of the prompt and, behind them, the question where it is given apart: no sentence before it runs on into that."""
    parts = whole_sentences(F.trim(F.coalesce("prompt", F.lit(""))))
    parts = F.concat(parts, F.array(F.coalesce("question", F.lit("")))) if "question" in items.columns else parts
    return F.filter(parts, lambda p: F.trim(p) != "")


def ablated(items: DataFrame) -> DataFrame:
    """id, parent_id, variant_type, prompt, answer, sentence, number of each item's ablations; items: id, prompt, answer, or beside them
    the question, where it stands behind the prompt as a sentence of its own.

    Four have one inserted sentence before the question, on the item's own subject or on none, with a number from LOW to HIGH that stands
    nowhere in the item or without one; `reorder_safe` has its premises in another order where nothing binds them to one another. Items of
    one sentence, and cells whose noun or number is missing, have no row. Nulls count as empty; an empty table has no rows.
    """
    df = _prepared(items).where(F.size("parts") >= 2)
    draw = lambda what, n: (hashed(F.lit(str(SEED)), F.col("id"), F.lit(what)) % n).cast("int")
    taken = F.concat(integers(F.col("prompt")), F.array(F.abs(gold(F.col("answer")))))
    free = F.array_except(F.transform(F.sequence(F.lit(LOW), F.lit(HIGH)), lambda v: v.cast("decimal(38,0)")), taken)
    df = df.withColumns({"free": free, "noun": noun(F.col("prompt"))}).withColumn("number", F.get("free", draw("quantity", F.greatest(F.size("free"), F.lit(1)))).cast("int"))
    off = F.get(F.array(*[F.lit(t) for t in OFF_TOPIC]), draw("topic", F.lit(len(OFF_TOPIC))))
    rows = F.array(*[F.struct(F.lit(c).alias("kind"), (off if c.startswith("off") else F.col("noun")).alias("topic"), (F.col("number") if c.endswith("_qty") else F.lit(None).cast("int")).alias("n"), F.lit(c.endswith("_qty")).alias("asks")) for c in CELLS])
    cells = df.select("id", "prompt", "answer", "parts", "q", F.explode(rows).alias("c")).where("c.topic is not null and (c.n is not null or not c.asks)")
    sentence = F.replace(F.replace(F.lit(FRAME), F.lit("{qty}"), F.coalesce(F.col("c.n").cast("string"), F.lit(FILLER))), F.lit("{topic}"), F.col("c.topic"))
    put = F.concat(F.slice("parts", 1, F.col("q")), F.array("sentence"), F.slice("parts", F.col("q") + 1, F.size("parts")))
    cells = cells.withColumn("sentence", sentence).select("id", "answer", F.col("c.kind").alias("kind"), _joined(put).alias("prompt"), "sentence", F.col("c.n").alias("number"))
    return cells.unionByName(_reordered(df)).select(F.concat_ws("__", "id", "kind").alias("id"), F.col("id").alias("parent_id"), F.col("kind").alias("variant_type"), "prompt", "answer", "sentence", "number")


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.trim(p)), " ")  # trim alone would be given the place as well


def _reordered(df: DataFrame) -> DataFrame:
    head = F.slice("parts", 1, F.col("q"))
    fit = lambda p: (F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 4) & p.rlike(r"^\p{Lu}") & order_safe(p)
    safe = df.where((F.size("parts") >= 3) & (F.col("q") >= 2)).withColumn("head", head).where(F.forall("head", fit))
    keyed = F.sort_array(F.transform("head", lambda p, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(SEED)), "id", i.cast("string"))).alias("key"), p.alias("p"))))
    # An order that came out as it was is turned by one.
    safe = safe.withColumn("new", F.transform(keyed, lambda x: x["p"]))
    turned = F.concat(F.slice("head", 2, F.size("head")), F.slice("head", 1, 1))
    safe = safe.withColumn("new", F.when(F.col("new") == F.col("head"), turned).otherwise(F.col("new"))).where("new <> head")
    tail = F.slice("parts", F.col("q") + 1, F.size("parts"))
    return safe.select("id", "answer", F.lit("reorder_safe").alias("kind"), _joined(F.concat("new", tail)).alias("prompt"), F.lit(None).cast("string").alias("sentence"), F.lit(None).cast("int").alias("number"))


def violations(items: DataFrame, variants: DataFrame) -> DataFrame:
    """id, problem of each promise that a finished ablation breaks: the answer kept, the sentence there, its number new, none where none is
    due, the rest of the prompt and, of a new order, the sentences as they were. items as for ablated(); variants as it returns them."""
    apart = "question" in items.columns
    was = _joined(_parts(items)) if apart else F.coalesce("prompt", F.lit(""))
    own = items.select(F.col("id").alias("parent_id"), was.alias("was"), F.col("answer").alias("due"))
    df = variants.join(own, "parent_id", "left")
    sentences = lambda x: F.sort_array(F.transform(F.filter(whole_sentences(F.trim(x)), lambda p: F.trim(p) != ""), lambda p: F.trim(p)))
    moved, number = F.col("variant_type") == "reorder_safe", F.col("number").cast("decimal(38,0)")
    text = F.coalesce("prompt", F.lit(""))
    left_out = F.array_sort(F.array_except(sentences(text), F.array(F.coalesce("sentence", F.lit("")))))
    checks = {
        "no parent": F.col("was").isNull(),
        "answer changed": ~F.col("answer").eqNullSafe(F.col("due")) & F.col("was").isNotNull(),
        "sentences changed": moved & (sentences(text) != sentences(F.col("was"))),
        "order unchanged": moved & (_joined(whole_sentences(F.trim("was"))) == text),
        "sentence missing": ~moved & ~F.coalesce(text.contains(F.col("sentence")), F.lit(False)),
        # Before a question given apart, the inserted sentence may stand behind one that seems to run on.
        "prompt altered": ~moved & ((F.replace(text, F.concat("sentence", F.lit(" ")), F.lit("")) != F.col("was")) if apart else (left_out != F.array_sort(F.array_distinct(sentences(F.col("was")))))),
        "number stands in the item": ~moved & (F.array_contains(integers(F.col("was")), number) | (F.abs(gold(F.col("due"))) == number)),
        "number in a cell without": ~moved & F.col("number").isNull() & F.col("sentence").rlike(r"\d"),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("problem"))


def guarded(x: Column) -> Column:
    """Sentences, not cut behind a title or a common abbreviation."""
    kept = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), rf"\b({TITLES})\.\s", "$1.\x01")
    return F.transform(F.split(kept, r"(?<=[.!?])\s+"), lambda p: F.replace(p, F.lit("\x01"), F.lit(" ")))


def _removable(items: DataFrame) -> DataFrame:
    """id, parts and the places of the premises that can go: they state a number of the solution that stands nowhere else in the prompt."""
    df = items.select("id", guarded(F.col("prompt")).alias("parts"), integers(F.coalesce("rationale", F.lit(""))).alias("used"))
    df = df.withColumn("nums", F.transform("parts", integers))

    def goes(i: Column) -> Column:
        own = F.array_intersect(F.get("nums", i), "used")
        return F.size(F.array_except(own, F.flatten(F.filter("nums", lambda x, j: j != i)))) > 0

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("parts") - 2, F.lit(0))), lambda i: goes(i) & (i < F.size("parts") - 1))
    return df.select("id", "parts", F.when(F.size("parts") >= 3, places).otherwise(F.expr("cast(array() as array<int>)")).alias("places"))


def deletions(items: DataFrame, most: int = 2) -> DataFrame:
    """id, parent_id, variant_type, prompt, answer (null), removed, n_sentences: the first `most` removable premises, each taken away alone.

    items: id, prompt, rationale. Items of under three sentences have none; a repeated item has its rows again.
    """
    df = _removable(items).select("id", "parts", F.posexplode(F.slice("places", 1, most)).alias("j", "at"))
    rest = F.filter("parts", lambda p, i: i != F.col("at"))
    return df.select(F.concat("id", F.lit("__del"), F.col("j").cast("string")).alias("id"), F.col("id").alias("parent_id"), F.lit("premise_deletion").alias("variant_type"),
                     F.array_join(rest, " ").alias("prompt"), F.lit(None).cast("string").alias("answer"), F.get("parts", F.col("at")).alias("removed"), F.size("parts").alias("n_sentences"))


def deletion_manifest(items: DataFrame, most: int = 2) -> DataFrame:
    """One row: scanned, too_short, no_removable, kept, n_variants, yield (kept / scanned; 0 for an empty table)."""
    df = _removable(items).select(F.size("parts").alias("n"), F.size("places").alias("places"))
    n = F.count(F.lit(1))
    return df.agg(n.alias("scanned"), F.count_if(F.expr("n < 3")).alias("too_short"), F.count_if(F.expr("n >= 3 and places = 0")).alias("no_removable"), F.count_if(F.expr("places > 0")).alias("kept"),
                  F.coalesce(F.sum(F.least("places", F.lit(most))), F.lit(0)).alias("n_variants"), F.coalesce(F.try_divide(F.count_if(F.expr("places > 0")), n), F.lit(0.0)).alias("yield"))
