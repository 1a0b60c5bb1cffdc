"""Numeric answers: parsing, tolerance, equivalence and small statistics, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbolic import equal_answers, equal_formulas
from .text import boxed_balanced, canonical_number, normalize_answer_text

PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FRACTION = r"\\d?frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"
#: Abramowitz and Stegun 7.1.26, absolute error of erf under 1.5e-7.
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def plain_float(x: Column) -> Column:
    return F.when(x.rlike(PLAIN), x.try_cast("double"))


def numeric_value(x: Column) -> Column:
    """A scalar answer's number: fractions, decimals, currency, grouping and percent; null for anything else."""
    s = F.trim(x)
    percent = s.endswith("%")
    s = F.regexp_replace(F.trim(F.rtrim(s, F.lit("%"))), r"[$, ]", "")
    parts = F.split(s, "/")
    latex = F.try_divide(plain_float(F.regexp_extract(s, FRACTION, 1)), plain_float(F.regexp_extract(s, FRACTION, 2)))
    ratio = F.when(F.size(parts) == 2, F.try_divide(plain_float(F.get(parts, 0)), plain_float(F.get(parts, 1))))
    v = F.when(s.rlike(FRACTION), latex).when(s.contains("/"), ratio).otherwise(plain_float(s))
    return F.when(percent, v / 100).otherwise(v)


def close(a: Column, b: Column, rel: float = 1e-6, abs_: float = 1e-9) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_)), F.lit(False))


def equivalent(gold: Column, pred: Column, kind: Column) -> Column:
    """Equal as text; for numeric and math kinds also equal as numbers; equivalent_formulas() adds formulas."""
    text = normalize_answer_text(gold) == normalize_answer_text(pred)
    return F.coalesce(text | (kind.isin("numeric", "math") & close(numeric_value(gold), numeric_value(pred))), F.lit(False))


def equivalent_formulas(gold: Column, pred: Column, kind: Column) -> Column:
    """equivalent(), and for the math kind equal as formulas. Only what the cheaper ways leave open goes to a Python worker."""
    plain = equivalent(gold, pred, kind)
    open_ = (kind == "math") & ~plain
    return plain | F.coalesce(equal_formulas(F.when(open_, gold), F.when(open_, pred)), F.lit(False))


def symbolic_equal(gold: Column, pred: Column) -> Column:
    """Equality as formulas (functions/symbolic.py); sides that are equal as texts already are not looked at."""
    differ = normalize_answer_text(gold) != normalize_answer_text(pred)
    return F.coalesce(equal_formulas(F.when(differ, gold), F.when(differ, pred)), F.lit(False)) | F.coalesce(~differ, F.lit(False))


def correct(pred: Column, gold: Column) -> Column:
    """A prediction against a gold answer that may still carry its solution: the gold's box is unwrapped, then texts, then values compared."""
    own = F.coalesce(boxed_balanced(gold), gold)
    p, g = canonical_number(pred), canonical_number(own)
    same = F.coalesce((p == g) | (F.upper(F.trim(p)) == F.upper(F.trim(g))) | equivalent(own, pred, F.lit("math")), F.lit(False))
    return same | F.coalesce(equal_answers(gold, pred), F.lit(False))


def answer_kind(benchmark: Column, skill: Column, answer: Column, has_choices: Column) -> Column:
    yes_no = F.lower(F.trim(F.coalesce(answer, F.lit("")))).isin("yes", "no", "true", "false")
    return F.when((benchmark == "math") | (skill == "mathematical"), "math").when(benchmark.isin("arc_challenge", "logiqa2", "reclor") | has_choices, "multiple_choice").when((benchmark == "gsm8k") | (skill == "arithmetic"), "numeric").when(yes_no, "yes_no").otherwise("text")


def normal_sf(z: Column) -> Column:
    """1 - Phi(z), by a rational approximation that SQL can state too."""
    p, coef = ERF
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(coef):
        poly = (poly + c) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_sf_sql(z: str) -> str:
    p, coef = ERF
    x = f"(abs({z}) / {math.sqrt(2)!r}::DOUBLE)"
    t = f"(1 / (1 + {p}::DOUBLE * {x}))"
    poly = "0::DOUBLE"
    for c in reversed(coef):
        poly = f"(({poly} + {c}::DOUBLE) * {t})"
    tail = f"({poly} * exp(-{x} * {x}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def two_proportions(c1: Column, n1: Column, c2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled z and two-sided p; (0, 1) where a group is empty or nothing varies."""
    pool = F.try_divide(c1 + c2, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.coalesce(F.when(se > 0, F.try_divide(F.try_divide(c1, n1) - F.try_divide(c2, n2), se)), F.lit(0.0))
    return z, F.least(F.lit(1.0), 2 * normal_sf(F.abs(z)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = F.try_divide(k, n), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def int_or_none(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^-?\d+$"), F.trim(x).try_cast("bigint"))


def format_number(x: Column) -> Column:
    """Whole numbers without a fraction, others as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def hashed(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 set by the parts alone, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def hashed_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


#: Distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975085)


#: Weights in bootstrap replicates are drawn from 0 to PRIME - 1.
PRIME = (1 << 31) - 1


def weight_cuts(halves: bool = False) -> list[int]:
    """A weight is the number of these that its draw reaches: Poisson(1), or 0 and 1 with equal chance."""
    return [PRIME // 2] if halves else [math.ceil(c * PRIME) for c in POISSON]


def weight_stream(cluster: Column, seed: int) -> tuple[Column, Column]:
    """Start and step of a cluster's draws: draw r is (start + step r) mod PRIME."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), cluster.cast("string")))
    at = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") % PRIME
    return at(1), at(9)


def weight_sql(cluster: str, seed: int, reps: int, table: str, halves: bool = False) -> str:
    """The rows of `table` in each replicate (rep) with their weight (w)."""
    at = lambda i: f"('0x' || substr(md5(concat_ws(':', '{seed}', {cluster})), {i}, 8))::BIGINT % {PRIME}"
    cuts = " + ".join(f"(u >= {c})::INT" for c in weight_cuts(halves))
    return f"(SELECT *, {cuts} AS w FROM (SELECT t.*, rep, (b0 + b1 * rep) % {PRIME} AS u FROM (SELECT *, {at(1)} AS b0, {at(9)} AS b1 FROM {table}) t, range({reps}) r(rep)))"


def binomial_tail(lost: Column, gained: Column) -> Column:
    """Two-sided exact McNemar p of discordant pairs: twice the lower tail of a fair binomial, 1 at most."""
    n, k = lost + gained, F.least(lost, gained)
    # From each term to the next: C(n, i) = C(n, i - 1) (n - i + 1) / i, in logarithms, so that no power of two underflows.
    start = F.struct((-n * math.log(2)).cast("double").alias("at"), F.exp(-n * math.log(2)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        at = acc["at"] + F.log((n - i + 1) / i)
        return F.struct(at.alias("at"), (acc["sum"] + F.exp(at)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step, lambda acc: acc["sum"]))


def mcnemar_exact(gained: int, lost: int) -> float:
    """Two-sided exact McNemar p of discordant pairs."""
    n, k = gained + lost, min(gained, lost)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def design_effect(size: Column, icc: Column) -> Column:
    """What clustering costs: rows of clusters of `size` are worth their number over this."""
    return 1 + (size - 1) * icc


def detectable(p0: Column, n: Column, alpha_z: float = 1.959963984540054, power: float = 0.8, rounds: int = 40) -> Column:
    """minimum_detectable_effect() as a Column, by the rational approximation of the normal tail."""
    def reached(s: Column, d: Column) -> Column:
        p1 = s["p"] + d
        pool = (s["p"] + p1) / 2
        s0, s1 = F.sqrt(2 * pool * (1 - pool) / s["n"]), F.sqrt((s["p"] * (1 - s["p"]) + p1 * (1 - p1)) / s["n"])
        return F.when(s1 > 0, normal_sf((alpha_z * s0 - d) / s1)).otherwise(1.0) >= power

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.transform(F.array(reached(acc, mid)), lambda ok: F.struct(acc["p"].alias("p"), acc["n"].alias("n"), F.when(ok, acc["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(acc["hi"]).alias("hi")))[0]

    start = F.struct(p0.cast("double").alias("p"), n.cast("double").alias("n"), F.lit(0.0).alias("lo"), (1 - p0.cast("double")).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc["p"] + acc["hi"])


def minimum_detectable_effect(p0: float, n: int, alpha_z: float = 1.959963984540054, power: float = 0.8) -> float:
    """Smallest rate above p0 that two groups of n tell apart from it with the power, by bisection; n counts rows."""
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))

    def reached(d: float) -> float:
        p1 = p0 + d
        pool = (p0 + p1) / 2
        s0, s1 = math.sqrt(2 * pool * (1 - pool) / n), math.sqrt((p0 * (1 - p0) + p1 * (1 - p1)) / n)
        return phi((d - alpha_z * s0) / s1) if s1 else 1.0

    lo, hi = 0.0, 1 - p0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reached(mid) >= power else (mid, hi)
    return p0 + hi
