"""Record readers: JSON lines with field synonyms, chat payloads and benchmark adapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..staging import fresh

MESSAGES = "array<struct<role:string,content:string,value:string,text:string>>"
ITEM = "id string, uid string, prompt string, question string, input string, answer string, parent_id string, variant_type string"
DOCUMENT = "id string, doc_id string, text string, content string, document string, source string"
GENERATION = "benchmark_id string, id string, completion string, prediction string, response string, model string"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones raise (strict) or are dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(sorted_json(df).alias("value")).write.text(path)


def sorted_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)))


def write_sheet(df: DataFrame, path: str) -> None:
    """A CSV sheet with a header, quoted as spreadsheets do."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV sheet with a header; empty cells are empty texts."""
    out = spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return out.fillna("", [c for c, t in out.dtypes if t == "string"])


def reviewed(verdicts: DataFrame) -> DataFrame:
    """parent, rejected: any bad verdict, in any case and spacing, rejects a parent."""
    return verdicts.groupBy("parent").agg(F.bool_or(F.lower(F.trim("verdict")) == "bad").alias("rejected"))


def first_of(*names: str) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"a record without {what}"))).otherwise(value)


def benchmark_items(raw: DataFrame, more: list[str] | None = None) -> DataFrame:
    return raw.select(first_of("id", "uid").alias("id"), _required(first_of("prompt", "question", "input"), "a prompt").alias("prompt"), "answer", "parent_id", F.coalesce("variant_type", F.lit("original")).alias("variant_type"), *(more or []))


def corpus_documents(raw: DataFrame, required: bool = True) -> DataFrame:
    """id, text, source: the first text that is not empty, else the empty one. A record without any raises, or has null if none is required."""
    names = ("text", "content", "document")
    text = F.coalesce(first_of(*names), *names)
    return raw.select(first_of("id", "doc_id").alias("id"), (_required(text, "a text") if required else text).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))


#: Fields that stand in for a missing text, in order.
INSTEAD = ("problem", "question", "solution", "answer", "messages")


def corpus_rows(raw: DataFrame, source: str, order: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """id, text, source of any dataset's rows: the text field, else the fields of INSTEAD that the table has, joined by blanks.

    A field may be a text or chat messages. Rows without any text are left out; ids number the others by `order` (a prefix of `limit`).
    """
    def said(c: str) -> Column:
        kind = raw.schema[c].dataType.simpleString()
        return F.coalesce(chat_text(F.col(c)) if kind.startswith("array<struct") else F.col(c).cast("string"), F.lit(""))

    own = F.nullif(said(text), F.lit("")) if text in raw.columns else F.lit(None).cast("string")
    others = [said(c) for c in INSTEAD if c in raw.columns]
    rows = raw.select(F.col(order).alias("_order"), F.coalesce(own, F.trim(F.concat_ws(" ", *others))).alias("text")).where("text <> ''")
    out = numbered(rows, ["_order"], source.replace("/", "_") + "_", 7)
    out = out if limit is None else out.orderBy("id").limit(limit)
    return out.select("id", "text", F.lit(source).alias("source"))


def generations(raw: DataFrame) -> DataFrame:
    return raw.select(first_of("benchmark_id", "id").alias("benchmark_id"), _required(first_of("completion", "prediction", "response"), "a completion").alias("completion"), F.coalesce("model", F.lit("unknown")).alias("model"))


def strict(raw: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Records of JSON lines (column value) with the required fields and no other than these and the optional ones, else an error.

    Both are name: type. Missing optional fields are null.
    """
    known = required | (optional or {})
    # Keys as they stand in the line, whatever their values' types.
    keys = F.coalesce(F.json_object_keys("value"), F.raise_error(F.lit("a line that is no JSON object")).cast("array<string>"))
    odd, lacking = F.array_except(keys, F.array(*[F.lit(k) for k in known])), F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    value = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(odd, ", "))).cast("string")).when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(lacking, ", "))).cast("string")).otherwise(F.col("value"))
    return raw.select(F.from_json(value, ", ".join(f"`{k}` {t}" for k, t in known.items()), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of many (compressed) shards whose schemas differ: each line is read by itself, so no schema is unified over shards.

    schema: the fields wanted; those that a shard lacks are null there. Blank lines are skipped. shard: the file's name.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("shard"), F.trim("value").alias("value")).where("value <> ''")
    return lines.select("shard", F.from_json("value", schema).alias("r")).select("shard", "r.*")


def score_union(frames: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Score tables of differing columns as one, missing values by default."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(defaults)


def chat_text(messages: Column) -> Column:
    """Non-empty contents, joined by a blank."""
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), " ")


def row_text(messages: Column, *others: Column) -> Column:
    """Messages' content, value or text by lines; without any, the first other text."""
    said = F.filter(F.transform(messages, lambda m: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in ("content", "value", "text")])), lambda c: c.isNotNull())
    return F.coalesce(F.nullif(F.array_join(said, "\n"), F.lit("")), *[F.nullif(o, F.lit("")) for o in others])


def numbered(df: DataFrame, order: list, prefix: str, width: int = 5) -> DataFrame:
    """Adds id: the prefix and the row's 0-based place by `order`, of `width` digits, or more where the place has more."""
    n = fresh(df, "place")
    return ranked(df, [], order, n).withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col(n).cast("string"), F.greatest(F.lit(width), F.length(F.col(n).cast("string"))), F.lit("0")))).drop(n)


def gsm8k_answer(x: Column) -> Column:
    return F.replace(F.trim(F.element_at(F.split(x, "####"), -1)), F.lit(","), F.lit(""))


def interleaved(df: DataFrame, group: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows of the groups in turn: the first of each, then the second of each; a limit is spread over the groups."""
    n = fresh(df, "turn")
    out = ranked(ranked(df, [group], [order], n), [], [n, group], "place").drop(n)
    return out if limit is None else out.where(F.col("place") < limit)


def letter(index: Column) -> Column:
    return F.when(index >= 0, F.char(65 + index))


def options(choices: Column) -> Column:
    """'A. text' lines."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(65 + i), F.lit(". "), c)), "\n")


def capped(df: DataFrame, parent: str, order: str, most: int) -> DataFrame:
    """Originals and at most `most` other rows of each parent."""
    n = F.row_number().over(Window.partitionBy(parent, F.col("variant_type") == "original").orderBy(order))
    return df.withColumn("_n", n).where((F.col("variant_type") == "original") | (F.col("_n") <= most)).drop("_n")


def templates(df: DataFrame) -> DataFrame:
    """Instances of templates: each template's original once, every instance as an answer-changing variant."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy("template_id").orderBy("instance"))).where("_n = 1")
    heads = first.select(F.concat(F.lit("t"), F.col("template_id").cast("string")).alias("id"), F.col("template_id"), F.lit("original").alias("variant_type"))
    each = df.select(F.concat(F.lit("t"), F.col("template_id").cast("string"), F.lit("_"), F.col("instance").cast("string")).alias("id"), "template_id", F.lit("gsm_symbolic_official").alias("variant_type"))
    return heads.unionByName(each)


@dataclass(frozen=True)
class Benchmark:
    name: str
    skill: str
    answer: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Corpus:
    name: str
    policy: str  # full or sampled
    limit: int | None = None


# The benchmarks and corpora that have adapters.
BENCHMARKS = {b.name: b for b in (
    Benchmark("gsm8k", "arithmetic", gsm8k_answer), Benchmark("gsm8k_train", "arithmetic", gsm8k_answer), Benchmark("gsm_symbolic", "arithmetic", gsm8k_answer), Benchmark("gsm_symbolic_p1", "arithmetic", gsm8k_answer),
    Benchmark("gsm_symbolic_p2", "arithmetic", gsm8k_answer), Benchmark("math", "mathematical"), Benchmark("arc_challenge", "scientific"), Benchmark("logiqa2", "logical"), Benchmark("bbh", "multi_step"), Benchmark("reclor", "logical"), Benchmark("humaneval", "code"),
)}
CORPORA = {c.name: c for c in (Corpus("stage2", "full"), Corpus("dolmino", "sampled", 200_000), Corpus("open_web_math", "sampled", 200_000), Corpus("smoltalk", "sampled", 300_000), Corpus("tulu3", "sampled", 300_000))}
