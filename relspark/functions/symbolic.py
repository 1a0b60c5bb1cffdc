"""Equality of two formulas in a subset of LaTeX, by their values at hashed points modulo two primes.

A formula is parsed to a tree; its symbols stand for squares that follow from a hash of their names and a trial's number. Two formulas
are taken to be equal if their values are equal at TRIALS points under each prime: a true identity always is, and two rational functions
of degree d that differ agree at one point with a chance of about d / 2**64. Square roots are powers (p + 1) / 4, which are true
roots where the radicand is a square; both primes have the numbers up to 100 as squares, so roots of such products come out as in the
reals, and points where a radicand is none are passed over, as is a division by zero. Functions and other powers stand for a hash of
their name and argument's value, so they are equal where their arguments are. What cannot be parsed is equal to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import count, islice
from math import isqrt, prod

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

TRIALS, TRIES, LONGEST, DEEPEST = 8, 100, 400, 40
SMALL = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97)
TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|\\([A-Za-z]+)|([A-Za-z])|(\*\*|[-+*/^(){}\[\]!_]))")
FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "exp", "arcsin", "arccos", "arctan", "cot", "sec", "csc")
#: Left out as they are only set with; then the names of the operators.
SPACING = re.compile(r"\\left(?![a-z])|\\right(?![a-z])|\\displaystyle|\\[!,;: ]|\\%|[$%]|\\mathrm|\\text\{\s*\}")
BOX = "\\boxed{"
PRODUCTS = {"cdot": "*", "times": "*", "div": "/"}

Tree = tuple


class Unequal(ValueError):
    """The formula is outside the subset."""


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in SMALL:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


@cache
def primes() -> tuple[int, int]:
    """The two least primes one under a multiple of 8 and of all SMALL: by reciprocity each of SMALL is a square under them."""
    step = 4 * prod(SMALL)
    first, second = islice((n for k in count(1) if _is_prime(n := k * step - 1)), 2)
    return first, second


class _Parser:
    def __init__(self, text: str) -> None:
        text = SPACING.sub("", text)
        if not text.strip() or len(text) > LONGEST:
            raise Unequal
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Unequal
            number, command, letter, sign = m.groups()
            if command in PRODUCTS:
                sign, command = PRODUCTS[command], None
            self.tokens.append(("number", number) if number else ("command", command) if command else ("letter", letter) if letter else ("sign", "^" if sign == "**" else sign))
            at = m.end()
        self.at, self.depth = 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str) -> bool:
        if self.peek() == ("sign", sign):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise Unequal

    def whole(self) -> Tree:
        out = self.sum()
        if self.peek()[0] != "end":
            raise Unequal
        return out

    def sum(self) -> Tree:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unequal
        out = self.product()
        while True:
            if self.take("+"):
                out = ("+", out, self.product())
            elif self.take("-"):
                out = ("+", out, ("*", ("number", Fraction(-1)), self.product()))
            else:
                self.depth -= 1
                return out

    def product(self) -> Tree:
        if self.take("-"):
            return ("*", ("number", Fraction(-1)), self.product())
        if self.take("+"):
            return self.product()
        out = self.power()
        while True:
            if self.take("*"):
                out = ("*", out, self.signed())
            elif self.take("/"):
                out = ("/", out, self.signed())
            elif self.peek()[0] in ("number", "letter", "command") or self.peek() in (("sign", "("), ("sign", "{")):
                out = ("*", out, self.power())
            else:
                return out

    def signed(self) -> Tree:
        return ("*", ("number", Fraction(-1)), self.signed()) if self.take("-") else self.power()

    def power(self) -> Tree:
        base = self.atom()
        if self.take("!"):
            base = ("call", "!", base)
        if self.take("^"):
            exponent = ("*", ("number", Fraction(-1)), self.power()) if self.take("-") else self.power()
            return ("^", base, exponent)
        return base

    def group(self) -> Tree:
        """What a command takes: a group in braces, or one sign."""
        if self.take("{"):
            out = self.sum()
            self.need("}")
            return out
        kind, value = self.peek()
        if kind == "number":  # \frac12 is 1 over 2
            if not value.isdigit():
                raise Unequal
            self.tokens[self.at] = ("number", value[1:])
            self.at += len(value) == 1
            return ("number", Fraction(value[0]))
        return self.atom()

    def atom(self) -> Tree:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return ("number", Fraction(value.rstrip(".") or "0"))
        if kind == "sign" and value in "({[":
            out = self.sum()
            self.need({"(": ")", "{": "}", "[": "]"}[value])
            return out
        if kind == "letter" or (kind == "command" and value not in FUNCTIONS and not value.startswith(("frac", "dfrac", "tfrac", "sqrt"))):
            name = value
            if self.take("_"):
                name += "_" + repr(self.group())
            return ("symbol", name)
        if kind == "command" and value in ("frac", "dfrac", "tfrac"):
            top = self.group()
            return ("/", top, self.group())
        if kind == "command" and value == "sqrt":
            n: Tree = ("number", Fraction(2))
            if self.take("["):
                n = self.sum()
                self.need("]")
            return ("^", self.group(), ("/", ("number", Fraction(1)), n))
        if kind == "command" and value in FUNCTIONS:
            power = self.group() if self.take("^") else None
            inner = self.atom() if self.peek() in (("sign", "("), ("sign", "{")) else self.power()
            out = ("call", {"ln": "log"}.get(value, value), inner)
            return out if power is None else ("^", out, power)
        raise Unequal


def parsed(text: str) -> Tree:
    return _Parser(text).whole()


def constant(tree: Tree) -> Fraction | None:
    """The tree's value where it is a plain rational number."""
    if tree[0] == "number":
        return tree[1]
    if tree[0] in "+*/^" and (a := constant(tree[1])) is not None and (b := constant(tree[2])) is not None:
        if tree[0] == "+":
            return a + b
        if tree[0] == "*":
            return a * b
        if tree[0] == "/":
            return a / b if b else None
        if b.denominator == 1 and abs(b) <= 64 and (a or b > 0):
            return a ** int(b)
        if b == Fraction(1, 2) and a >= 0 and isqrt(a.numerator) ** 2 == a.numerator and isqrt(a.denominator) ** 2 == a.denominator:
            return Fraction(isqrt(a.numerator), isqrt(a.denominator))
    return None


class _Elsewhere(Exception):
    """The point is of no use: a division by zero, a radicand that is no square."""


def _rooted(value: Fraction) -> tuple[int, Fraction]:
    """(s, t) with value = s * s * t, for the factors s up to 1000 of a whole number."""
    s, t = 1, value.numerator
    for q in range(2, 1001):
        while t % (q * q) == 0 and t:
            s, t = s * q, t // (q * q)
    return s, Fraction(t, value.denominator)


def evaluated(tree: Tree, p: int, trial: int) -> int:
    known = constant(tree)
    if known is not None:
        return known.numerator * pow(known.denominator, -1, p) % p
    kind = tree[0]
    if kind == "symbol":
        return pow(xxhash.xxh64_intdigest(tree[1], trial) % p, 2, p)
    if kind == "call":
        return xxhash.xxh64_intdigest(f"{tree[1]}:{evaluated(tree[2], p, trial)}", 1) % p
    a = evaluated(tree[1], p, trial)
    if kind == "^":
        e = constant(tree[2])
        if e is None:
            return xxhash.xxh64_intdigest(f"{a}^{evaluated(tree[2], p, trial)}", 2) % p
        if abs(e.numerator) > 1000 or e.denominator > 1000 or (a == 0 and e <= 0):
            raise _Elsewhere
        if e.denominator == 1:
            return pow(a, int(e), p)
        if e.denominator == 2:
            base = constant(tree[1])
            if base is not None and base < 0:
                raise Unequal
            s, root = 1, a
            if base is not None:
                s, rest = _rooted(base)
                root = rest.numerator * pow(rest.denominator, -1, p) % p
            elif pow(a, (p - 1) // 2, p) != 1:
                raise _Elsewhere
            return pow(s * pow(root, (p + 1) // 4, p), e.numerator, p)
        return xxhash.xxh64_intdigest(f"{a}^{e}", 3) % p
    b = evaluated(tree[2], p, trial)
    if kind == "+":
        return (a + b) % p
    if kind == "*":
        return a * b % p
    if b == 0:
        raise _Elsewhere
    return a * pow(b, -1, p) % p


def equal(a: str | None, b: str | None) -> bool:
    """Do two formulas have one value at all points tried? False where either is null, empty, outside the subset or has no value."""
    try:
        x, y = parsed(a or ""), parsed(b or "")
        for p in primes():
            done = 0
            for trial in range(TRIES):
                try:
                    if evaluated(x, p, trial) != evaluated(y, p, trial):
                        return False
                except (_Elsewhere, ZeroDivisionError):
                    continue
                if (done := done + 1) == TRIALS:
                    break
            if done < TRIALS:
                return False
        return True
    except (Unequal, ValueError, OverflowError, RecursionError):
        return False


def unboxed(text: str) -> str:
    """What the last closed box of a text holds; without one, the text. Boxes are read one after another."""
    out, at = text, 0
    while (at := text.find(BOX, at)) >= 0:
        end, depth = at + len(BOX), 1
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        if not depth:
            out = text[at + len(BOX) : end - 1]
        at = end
    return out


@F.pandas_udf(BooleanType())
def equal_answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """equal() of a gold answer, out of its box, and a prediction."""
    for a, b in batches:
        yield pd.Series([x is not None and y is not None and equal(unboxed(x), y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def equal_formulas(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """equal() of two columns, in Arrow batches; repeated pairs of a batch are compared once."""
    for a, b in batches:
        seen: dict[tuple, bool] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in seen:
                seen[pair] = equal(*pair)
            out.append(seen[pair])
        yield pd.Series(out, dtype=bool)
