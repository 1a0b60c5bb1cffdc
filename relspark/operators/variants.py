"""Benchmark variants: surface, structural, ablation and numeric generators, one row to none or more.

Every choice is set by an md5 of (seed, id, generator), so a variant is a function of its row alone. Generators that a Column expression
can state are Column expressions; renaming, reordering, rewording and templates are Arrow functions over batches of rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import hashed
from ..functions.text import QUESTION, sentence_parts
from .ranks import running

SEED = 6198
# Name, object, distractor and rewording lists.
NAMES = ["Alice", "Bob", "Carol", "David", "Emma", "Frank", "Grace", "Henry", "Irene", "Jack", "Karen", "Liam", "Maya", "Noah", "Olivia", "Peter"]
OBJECTS = ["pencils", "marbles", "apples", "coins", "stickers", "books", "oranges", "cards", "candies", "balloons", "cookies", "erasers"]
DISTRACTORS = [
    "The weather that day was pleasant.",
    "The items were stored in a blue box.",
    "This happened on a Tuesday afternoon.",
    "A friend watched the whole time.",
    "The shop had recently been repainted.",
    "Everyone was in a cheerful mood.",
]
REWORDINGS = [
    (r"\bHow many\b", "In total, how many"),
    (r"\bare there\b", "are present"),
    (r"\bare in\b", "can be found in"),
    (r"\bthen\b", "after that"),
    (r"\bIf\b", "Suppose that"),
    (r"\breceives\b", "gets"),
    (r"\bsells\b", "gives away"),
]
SCHEMA = "id string, parent_id string, variant_type string, prompt string, answer string"


def _pick(n: int, *parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, (SEED, *parts))).encode()).hexdigest()[:8], 16) % n


def _order(values: list, *parts: object) -> list:
    """The values in an order set by the parts."""
    return sorted(values, key=lambda v: hashlib.md5(":".join(map(str, (SEED, *parts, v))).encode()).hexdigest())


def rename(id_: str, prompt: str) -> str | None:
    """Known names and objects replaced by others of their list, all at once."""
    swap: dict[str, str] = {}
    for pool in (NAMES, OBJECTS):
        present = [w for w in pool if re.search(rf"\b{w}\b", prompt)]
        swap |= dict(zip(present, _order([w for w in pool if w not in present], id_, "rename"), strict=False))
    return re.sub(r"\b(" + "|".join(swap) + r")\b", lambda m: swap[m[1]], prompt) if swap else None


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]


def _asks(sentence: str) -> bool:
    return bool(re.search(QUESTION, sentence.strip().lower()))


def reorder(id_: str, prompt: str) -> str | None:
    """Premises in another order; the last question keeps its place."""
    parts = _sentences(prompt)
    at = next((i for i in reversed(range(len(parts))) if _asks(parts[i])), len(parts) - 1)
    body = parts[:at] + parts[at + 1 :]
    if len(body) < 2:
        return None
    moved = [body[i] for i in _order(list(range(len(body))), id_, "reorder")]
    if moved == body:
        moved = body[1:] + body[:1]
    return None if moved == body else " ".join(moved[:at] + [parts[at]] + moved[at:])


def reword(id_: str, prompt: str) -> str | None:
    out = prompt
    for pattern, new in REWORDINGS:
        out = re.sub(pattern, new, out, count=1)
    return out if out != prompt else None


SURFACE: dict[str, Callable[[str, str], str | None]] = {"entity_substitution": rename, "premise_reordering": reorder, "rephrasing": reword}


def surface(items: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Answer-preserving variants; items: id, prompt, answer."""
    use = {k: SURFACE[k] for k in kinds or SURFACE}

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}__{k}", i, k, new, a) for i, p, a in zip(b["id"], b["prompt"], b["answer"], strict=True) for k, f in use.items() if (new := f(i, p or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return items.select("id", "prompt", "answer").mapInPandas(make, SCHEMA)


def _chosen(values: list, *parts: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), hashed(F.lit(str(SEED)), *parts) % len(values))


def _built(df: DataFrame, kind: str, prompt: Column, answer: Column | None = None) -> DataFrame:
    return df.select(F.concat("id", F.lit(f"__{kind}")).alias("id"), F.col("id").alias("parent_id"), F.lit(kind).alias("variant_type"), prompt.alias("prompt"), (answer if answer is not None else F.col("answer")).alias("answer"))


def _before_last(parts: Column, extra: Column) -> Column:
    """The extra sentence before the last one; a single sentence is followed by it."""
    n = F.size(parts)
    return F.when(n >= 2, F.concat_ws(" ", F.array_join(F.slice(parts, 1, n - 1), " "), extra, F.element_at(parts, -1))).otherwise(F.concat_ws(" ", F.array_join(parts, " "), extra))


def irrelevant_context(items: DataFrame) -> DataFrame:
    return _built(items, "irrelevant_context", _before_last(sentence_parts(F.rtrim("prompt")), _chosen(DISTRACTORS, F.col("id"), F.lit("context"))))


def resample(items: DataFrame, copies: int = 5) -> DataFrame:
    df = items.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return df.select(F.concat("id", F.lit("__resample"), F.col("k").cast("string")).alias("id"), F.col("id").alias("parent_id"), F.lit("resample").alias("variant_type"), "prompt", "answer")


def gold(answer: Column) -> Column:
    s = F.replace(F.trim(F.element_at(F.split(answer, "####"), -1)), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("bigint"))


def depth_extension(items: DataFrame) -> DataFrame:
    """One more dependent step: a product or a sum of the parent's answer."""
    g, k = gold(F.col("answer")), hashed(F.lit(str(SEED)), F.col("id"), F.lit("depth")) % 8 + 2
    times = hashed(F.lit(str(SEED)), F.col("id"), F.lit("op")) % 2 == 0
    clause = F.when(times, F.format_string(" Finally, what is %d times that amount?", k)).otherwise(F.format_string(" Finally, what is that amount plus %d?", k))
    return _built(items.where(g.isNotNull()), "depth_extension", F.concat(F.rtrim("prompt"), clause), F.when(times, g * k).otherwise(g + k).cast("string"))


def distractor_quantity(items: DataFrame) -> DataFrame:
    """A sentence with a number of 13 to 96 that neither the prompt nor the answer holds."""
    g = gold(F.col("answer"))
    present = F.concat(F.transform(F.regexp_extract_all("prompt", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int")), F.array(F.abs(g).cast("int")))
    free = F.array_except(F.sequence(F.lit(13), F.lit(96)), present)
    df = items.where(g.isNotNull()).withColumn("free", free).where(F.size("free") > 0)
    n = F.get("free", (hashed(F.lit(str(SEED)), F.col("id"), F.lit("quantity")) % F.size("free")).cast("int"))
    return _built(df, "distractor_quantity", _before_last(sentence_parts(F.rtrim("prompt")), F.format_string("An unrelated shipment of %d boxes arrived on the same day and was never opened.", n)), g.cast("string"))


def premise_removal(items: DataFrame, per_item: int = 1, strict: bool = True) -> DataFrame:
    """Premises taken away whose number occurs nowhere else (strict) and whose loss does not leave the answer in the text."""
    df = items.withColumn("parts", sentence_parts(F.rtrim("prompt"))).where(F.size("parts") >= 2)
    df = df.select("id", "answer", "parts", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("at", "premise")).where(F.col("premise").rlike(r"\d") & ~F.col("premise").rlike(r"\?\s*$"))
    rest = F.filter("parts", lambda s, i: i != F.col("at"))
    df = df.withColumn("rest", F.array_join(rest, " ")).withColumn("n", F.regexp_extract("premise", r"(\d+)", 1))
    left = F.regexp_extract_all("rest", F.lit(r"(\d+)"), F.lit(1))
    g = F.coalesce(gold(F.col("answer")).cast("string"), F.lit(""))
    keep = ~F.array_contains(left, g) & (~F.array_contains(left, F.col("n")) if strict else F.lit(True))
    ranked = df.where(keep).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.md5(F.concat_ws(":", F.lit(str(SEED)), "id", F.col("at").cast("string"))).alias("h"), "at", "rest"))), 1, per_item).alias("c"))
    each = ranked.select("id", F.explode("c").alias("c"))
    return each.select(F.concat("id", F.lit("__removed"), F.col("c.at").cast("string")).alias("id"), F.col("id").alias("parent_id"), F.lit("premise_removal").alias("variant_type"), F.col("c.rest").alias("prompt"), F.lit(None).cast("string").alias("answer"))


def quantity_ablation(items: DataFrame) -> DataFrame:
    """Two by two: a premise removed or kept, an unrelated sentence with a number or without one."""
    parts = sentence_parts(F.rtrim("prompt"))
    df = items.withColumn("parts", parts).where(F.size("parts") >= 3)
    conditions = F.explode(F.array(*[F.struct(F.lit(r).alias("removed"), F.lit(n).alias("number")) for r in (False, True) for n in (False, True)]))
    df = df.withColumn("c", conditions)
    kept = F.when(F.col("c.removed"), F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts"))
    extra = F.when(F.col("c.number"), F.lit("The shop is at 17 Mill Road.")).otherwise(F.lit("The shop is on Mill Road."))
    name = F.concat(F.when(F.col("c.removed"), "removed").otherwise("kept"), F.when(F.col("c.number"), "_number").otherwise("_plain"))
    return df.select(F.concat("id", F.lit("__"), name).alias("id"), F.col("id").alias("parent_id"), F.concat(F.lit("ablation_"), name).alias("variant_type"), _before_last(kept, extra).alias("prompt"), F.when(~F.col("c.removed"), F.col("answer")).alias("answer"))


# Annotated steps, their numbers, and how many steps and leaves a template may have.
CHAIN, NUMBER = re.compile(r"<<([^=<>]+)=([^<>]+)>>"), re.compile(r"\d+\.?\d*|\.\d+")
STEPS, LEAVES = 8, 6


def evaluated(expr: Column) -> Column:
    """Values of arithmetic expressions; null for anything else."""
    def value(e: str | None) -> float | None:
        try:
            return evaluate(e or "", {})
        except ValueError:
            return None

    def values(batch: pd.Series) -> pd.Series:
        return pd.Series([value(e) for e in batch], dtype="float64")

    return F.pandas_udf(values, "double")(expr)


class Rejected(NamedTuple):
    reason: str
    detail: str = ""


def _whole(text: str) -> int | None:
    text = text.strip().replace(",", "")
    return int(text) if re.match(r"-?\d+\Z", text) else None


def _chain(rationale: str, answer: str) -> list[tuple[str, int]] | Rejected:
    """(expression, result) of each annotated step of a chain that can be recomputed and ends in the answer."""
    steps = [(e.strip(), v) for e, v in CHAIN.findall(rationale)]
    if not steps:
        return Rejected("no_calc_annotations")
    if len(steps) > STEPS:
        return Rejected("chain_too_long", f"{len(steps)} steps")
    if odd := [v for _, v in steps if _whole(v) is None]:
        return Rejected("non_integer_step_result", odd[0])
    whole = [(e, _whole(v)) for e, v in steps]
    for expr, value in whole:
        try:
            if evaluate(expr, {}) != value:
                return Rejected("step_does_not_reproduce_result", f"{expr} != {value}")
        except ValueError:
            return Rejected("step_does_not_reproduce_result", f"{expr} != {value}")
    results = [v for _, v in whole]
    if _whole(answer) != results[-1]:
        return Rejected("final_answer_mismatch", f"answer={answer} last_step={results[-1]}")
    return Rejected("duplicate_step_results") if len(set(results)) < len(results) else whole


def template(prompt: str, rationale: str, answer: str) -> tuple[list[int], list[tuple[str, float]]] | Rejected:
    """(leaf numbers, (expression, value) steps) of an annotated solution, or why it has none.

    A leaf is a whole number of a step that the question states and no earlier step has made; a number of the chain alone stays as it is.
    """
    chain = _chain(rationale, answer)
    if isinstance(chain, Rejected):
        return chain
    used = Counter(int(t) for e, _ in chain for t in NUMBER.findall(e) if "." not in t)
    leaves: dict[int, None] = {}
    made: set[int] = set()
    for expr, value in chain:
        own = Counter(NUMBER.findall(expr))
        for t, times in own.items():
            if "." in t or (n := int(t)) in made or n in leaves:
                continue
            if times > 1:
                return Rejected("value_repeated_within_step", f"{n} in '{expr}'")
            asked = len(re.findall(rf"(?<![\d.,]){n}(?!\d)(?![.,]\d)", prompt))
            if asked > used[n]:
                return Rejected("value_ambiguous_in_question", f"{n} appears {asked}x in question but {used[n]}x in chain")
            if asked:
                leaves[n] = None
        made.add(value)
    if not leaves:
        return Rejected("no_substitutable_leaves")
    if len(leaves) > LEAVES:
        return Rejected("too_many_leaves", str(len(leaves)))
    if leaves.keys() & made:
        return Rejected("leaf_collides_with_step_result")
    return list(leaves), [(e, float(v)) for e, v in chain]


def rejections(items: DataFrame) -> DataFrame:
    """id, reason, detail of each item that no template can be made of; items: id, prompt, rationale, answer. Nulls count as empty."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *got) for i, p, r, a in zip(b["id"], b["prompt"], b["rationale"], b["answer"], strict=True) if isinstance(got := template(p or "", r or "", a or ""), Rejected)]
            yield pd.DataFrame(rows, columns=["id", "reason", "detail"])

    return items.select("id", "prompt", "rationale", "answer").mapInPandas(judge, "id string, reason string, detail string")


def evaluate(expr: str, values: dict[str, float]) -> float:
    """An expression of numbers, given names, + - * / // % ** and brackets."""
    import ast
    import operator as op

    binary = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Div: op.truediv, ast.FloorDiv: op.floordiv, ast.Mod: op.mod, ast.Pow: op.pow}

    def walk(node: ast.AST) -> float:
        match node:
            case ast.Expression():
                return walk(node.body)
            case ast.Constant(value=int() | float()):
                return float(node.value)
            case ast.Name() if node.id in values:
                return values[node.id]
            case ast.UnaryOp(op=ast.USub()):
                return -walk(node.operand)
            case ast.BinOp() if type(node.op) in binary:
                return float(binary[type(node.op)](walk(node.left), walk(node.right)))
        raise ValueError(f"not arithmetic: {expr}")

    try:
        return walk(ast.parse(expr.strip(), mode="eval"))
    except (SyntaxError, ZeroDivisionError, OverflowError) as e:
        raise ValueError(str(e)) from None


def numeric_variant(id_: str, prompt: str, rationale: str, answer: str, copy: int = 0, low: float = 0.8, high: float = 1.25) -> tuple[str, str] | None:
    """(prompt, answer) with every leaf drawn anew near its value and the chain recomputed; whole, positive results only."""
    built = template(prompt, rationale, answer)
    if isinstance(built, Rejected):
        return None
    leaves, steps = built
    for attempt in range(40):
        new: dict[float, float] = {}
        for n in leaves:
            pool = [v for v in range(max(1, int(n * low)), int(n * high) + 2) if v != n and v not in new.values()]
            if not pool:
                return None
            new[float(n)] = float(pool[_pick(len(pool), id_, copy, attempt, n)])
        now = dict(new)
        for expr, value in steps:
            fresh = re.sub(r"\d+\.?\d*|\.\d+", lambda m: repr(now.get(float(m[0]), float(m[0]))), expr)
            try:
                now[value] = evaluate(fresh, {})
            except ValueError:
                break
        else:
            result = now[steps[-1][1]]
            if all(v > 0 and v == int(v) for v in now.values()):
                swap = {str(int(a)): str(int(b)) for a, b in new.items()}
                text = re.sub(r"(?<![\d.,])(" + "|".join(swap) + r")(?!\d)(?![.,]\d)", lambda m: swap[m[1]], prompt)
                return text, str(int(result))
    return None


def numeric(items: DataFrame, copies: int = 1) -> DataFrame:
    """Answer-changing variants of items with an annotated rationale; items: id, prompt, rationale, answer."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}__numeric{k}", i, "gsm_symbolic", *new) for i, p, r, a in zip(b["id"], b["prompt"], b["rationale"], b["answer"], strict=True) for k in range(copies) if (new := numeric_variant(i, p or "", r or "", a or "", k))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return items.select("id", "prompt", "rationale", "answer").mapInPandas(make, SCHEMA)


def suite(items: DataFrame, max_variants: int | None = None, include_original: bool = True) -> DataFrame:
    """Originals with all their variants, or with the first max_variants of each by id; the originals may be left out."""
    heads = items.select("id", F.col("id").alias("parent_id"), F.lit("original").alias("variant_type"), "prompt", "answer")
    out = heads
    for part in (surface(items), irrelevant_context(items), depth_extension(items), distractor_quantity(items), premise_removal(items)):
        out = out.unionByName(part)
    if max_variants is not None:
        place = F.row_number().over(Window.partitionBy("parent_id", F.col("variant_type") == "original").orderBy("id"))
        out = out.withColumn("_place", place).where((F.col("variant_type") == "original") | (F.col("_place") <= max_variants)).drop("_place")
    return out if include_original else out.where("variant_type <> 'original'")


def dose_stream(repeat: DataFrame, filler: DataFrame, dose: int, budget: int) -> DataFrame:
    """id, copy, text up to a fixed budget of characters: each repeated text `dose` times, then filler, in hashed order."""
    again = repeat.select("id", "text", F.explode(F.sequence(F.lit(1), F.lit(dose))).alias("copy")).withColumn("first", F.lit(0))
    rest = filler.select("id", "text", F.lit(0).alias("copy"), F.lit(1).alias("first"))
    key = F.concat_ws(":", "first", F.md5(F.concat_ws(":", F.lit(str(SEED)), "id", F.col("copy").cast("string"))))
    all_ = again.unionByName(rest).select("id", "copy", key.alias("key"), "text", F.length("text").cast("long").alias("n"))
    # Lengths alone are ordered and summed; texts join what is within the budget.
    within = running(all_.drop("text"), "key", "n", "total").where(F.col("total") <= budget).select("key")
    return all_.join(within, "key").select("id", "copy", "text")
