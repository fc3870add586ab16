r"""Symbolic equality of answers, by their values at random points of finite fields.

Nothing is evaluated as code. An answer (LaTeX or plain) is parsed into a tree of numbers, symbols, sums, products, powers, roots and
named functions. Two trees are the same expression if they take the same values at POINTS random points; a wrong verdict of "same" has a
chance of about (degree / 2**61) ** POINTS. Length, number of terms, exponents and radicands are not bounded.

Letters are symbols, side by side they are multiplied; pi is a symbol. A field has principal roots that multiply as real ones do, once
every number of the expressions has a root there; fields are drawn until that holds. A function such as \sin is known by name and
argument only, so that its identities (and nested roots) are not found: such pairs count as different.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.comparison import verdict

#: Points at which both have to agree, and fields that are tried for them.
POINTS, FIELDS = 20, 1200
#: Bits of an exponent that is worked out.
EXPONENT_BITS = 4096

# Names that are read as one token.
_FUNCTIONS = ("arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp")
_SIGNS = {r"\cdot": "*", r"\times": "*", r"\div": "/", r"\pi": "pi", r"\frac": "frac", r"\dfrac": "frac", r"\tfrac": "frac", r"\sqrt": "sqrt", "**": "^", "{": "(", "}": ")"}
_TOKEN = re.compile(r"\s*(\\[a-zA-Z]+|\d+\.\d+|\.\d+|\d+\.?|sqrt|pi|" + "|".join(_FUNCTIONS) + r"|[A-Za-z]|\*\*|[-+*/^(){}])")
_SKIPPED = re.compile(r"\\(?:left|right|displaystyle|limits|mathrm|text)(?![a-zA-Z])")

Node = tuple


class Unclear(Exception):
    """The text is no expression of the supported kind."""


class Beyond(Exception):
    """The expression is one, but cannot be worked out."""


class _NoRoot(Exception):
    """A value has no root in this field."""


def tokens(text: str) -> list[str]:
    found, at, text = [], 0, _SKIPPED.sub(" ", text).strip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise Unclear
        token = match.group(1)
        token = _SIGNS.get(token, token)
        if token.startswith("\\"):
            token = token[1:]
            if token not in _FUNCTIONS and len(token) < 2:
                raise Unclear
            token = token if token in _FUNCTIONS else "\\" + token  # a Greek letter or the like: a symbol by its name
        found.append(token)
        at = match.end()
    if not found:
        raise Unclear
    return found


class Parser:
    """Recursive descent: sum, product (also of neighbours), sign, power, atom."""

    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def accept(self, *wanted: str) -> str:
        token = self.peek()
        if token and token in wanted:
            self.at += 1
            return token
        return ""

    def whole(self) -> Node:
        node = self.sum()
        if self.peek():
            raise Unclear
        return node

    def sum(self) -> Node:
        parts = [self.product()]
        while sign := self.accept("+", "-"):
            part = self.product()
            parts.append(("neg", part) if sign == "-" else part)
        return parts[0] if len(parts) == 1 else ("sum", parts)

    def product(self) -> Node:
        parts = [self.signed()]
        while self.peek() and self.peek() not in ("+", "-", ")"):
            sign = self.accept("*", "/")
            part = self.signed() if sign else self.power()
            parts.append(("over", part) if sign == "/" else part)
        return parts[0] if len(parts) == 1 else ("product", parts)

    def signed(self) -> Node:
        negative = False
        while sign := self.accept("+", "-"):
            negative ^= sign == "-"
        node = self.power()
        return ("neg", node) if negative else node

    def power(self) -> Node:
        base = self.atom()
        return ("power", base, self.signed()) if self.accept("^") else base

    def group(self) -> Node:
        if not self.accept("("):
            return self.atom()
        node = self.sum()
        if not self.accept(")"):
            raise Unclear
        return node

    def atom(self) -> Node:
        token = self.peek()
        if token == "(":
            return self.group()
        self.at += 1
        if token == "frac":
            return ("product", [self.group(), ("over", self.group())])
        if token == "sqrt":
            return ("root", self.group())
        if token in _FUNCTIONS:
            return ("function", token, self.group() if self.peek() == "(" else self.power())
        if token[:1].isdigit() or token[:1] == ".":
            return ("number", Fraction(token.rstrip(".")))
        if token.isalpha() or token.startswith("\\"):
            return ("symbol", token)
        raise Unclear


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        for part in node[1:]:
            todo += part if isinstance(part, list) else [part] if isinstance(part, tuple) else []


def _exponent(node: Node) -> Fraction:
    """The value of an exponent, which has to be a rational number."""
    kind = node[0]
    if kind == "number":
        return node[1]
    if kind == "neg":
        return -_exponent(node[1])
    if kind == "over":
        return 1 / _exponent(node[1])
    if kind in ("sum", "product"):
        total = Fraction(kind == "product")
        for part in node[1]:
            total = total * _exponent(part) if kind == "product" else total + _exponent(part)
        return total
    if kind == "power":
        base, n = _exponent(node[1]), _exponent(node[2])
        if n.denominator != 1:
            raise Unclear
        if abs(n) * max(base.numerator.bit_length(), base.denominator.bit_length()) > EXPONENT_BITS:
            raise Beyond
        return base ** int(n)
    raise Unclear


def _prime(n: int) -> bool:
    """Whether n is a prime, by Miller-Rabin with bases that decide below 2**64."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _rooted(n: int) -> bool:
    """Whether 3, 5, 7, 11 and 13 have roots in a prime field of n = 7 modulo 8, by quadratic reciprocity."""
    return all(pow(n % q, (q - 1) // 2, q) == (1 if q % 4 == 1 else q - 1) for q in (3, 5, 7, 11, 13))


@lru_cache(maxsize=None)
def _field(i: int) -> int:
    """The i-th prime in which -1 has no root, but 2, 3, 5, 7, 11 and 13 have."""
    at = (1 << 61) - 1 if i == 0 else _field(i - 1) - 8
    while True:
        at -= (at - 7) % 8
        if _rooted(at) and all(at % q for q in (17, 19, 23, 29, 31, 37, 41, 43, 47, 53)) and _prime(at):
            return at
        at -= 8


class _Point:
    """A field and a value for each symbol."""

    def __init__(self, i: int) -> None:
        self.i, self.p = i, _field(i)

    def random(self, *what: object) -> int:
        return 2 + xxhash.xxh3_64_intdigest(repr((self.i, what)).encode()) % (self.p - 3)

    def root(self, value: int) -> int:
        if value and pow(value, (self.p - 1) // 2, self.p) != 1:
            raise _NoRoot
        return pow(value, (self.p + 1) // 4, self.p)

    def inverse(self, value: int) -> int:
        if not value:
            raise ZeroDivisionError
        return pow(value, -1, self.p)

    def value(self, node: Node) -> int:
        kind, p = node[0], self.p
        if kind == "number":
            return node[1].numerator * self.inverse(node[1].denominator % p) % p
        if kind == "symbol":
            return self.random(node[1])
        if kind == "sum":
            return sum(map(self.value, node[1])) % p
        if kind == "product":
            total = 1
            for part in node[1]:
                total = total * self.value(part) % p
            return total
        if kind == "neg":
            return -self.value(node[1]) % p
        if kind == "over":
            return self.inverse(self.value(node[1]))
        if kind == "root":
            return self.root(self.value(node[1]))
        if kind == "function":
            return self.random(node[1], self.value(node[2]))
        base, n = self.value(node[1]), _exponent(node[2])
        if n.denominator == 2:
            base, n = self.root(base), n * 2
        if n.denominator != 1:
            raise Unclear
        return pow(self.inverse(base) if n < 0 else base, abs(int(n)), p)

    def has_roots(self, numbers: set[int]) -> bool:
        return all(pow(n % self.p, (self.p - 1) // 2, self.p) == 1 for n in numbers)


def compared(a: str, b: str) -> bool | None:
    """Whether two normal forms are the same expression; false if either is none; null if it stays open.

    Open are pairs that have values at too few points of the FIELDS fields (roots of negative or of very many unrelated
    numbers), powers in an exponent of more than EXPONENT_BITS bits, and parentheses nested beyond Python's recursion.
    """
    try:
        trees = [Parser(x).whole() for x in (a, b)]
        nodes = [n for t in trees for n in _walk(t)]
        rooted = any(n[0] == "root" or n[0] == "power" and _exponent(n[2]).denominator == 2 for n in nodes)
        numbers = {abs(x) for n in nodes if n[0] == "number" for x in (n[1].numerator, n[1].denominator) if x} if rooted else set()
        agreed = undefined = without = 0
        for i in range(FIELDS):
            point = _Point(i)
            if not point.has_roots(numbers):
                continue
            try:
                if point.value(trees[0]) != point.value(trees[1]):
                    return False
                agreed += 1
            except _NoRoot:
                without += 1
            except ZeroDivisionError:
                undefined += 1
            if agreed == POINTS:
                return True
            if undefined == POINTS:
                return False
            if without - 20 * agreed == 10 * POINTS:
                return None
        return None
    except (Beyond, RecursionError):
        return None
    except (Unclear, ZeroDivisionError):
        return False


def equal(a: str, b: str) -> bool:
    """Whether two normal forms are found to be the same expression; open pairs count as different."""
    return bool(compared(a, b))


def _equal_pairs(p: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else equal(a, b) for a, b in zip(p, g, strict=True)], dtype="object")


def with_comparison(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the boolean `name`: compared() of two columns of normal forms, null where it stays open."""

    def pairs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or g is None else compared(p, g) for p, g in zip(x, y, strict=True)], dtype="object")

    return df.withColumn(name, F.pandas_udf(pairs, T.BooleanType()).asNondeterministic()(F.col(a), F.col(b)))


def with_equivalence(df: DataFrame, pred: str, gold: str, name: str = "equivalent") -> DataFrame:
    """df with the boolean `name`: whether two answers are equivalent by text, number or expression.

    Python gets two short columns, which are null wherever text or numbers decide.
    """
    same = F.pandas_udf(_equal_pairs, T.BooleanType()).asNondeterministic()
    marked = df.withColumn("_verdict", verdict(F.col(pred), F.col(gold)))
    marked = marked.withColumn("_symbolic", same(F.col("_verdict.p"), F.col("_verdict.g")))
    return marked.withColumn(name, F.coalesce("_verdict.same", "_symbolic", F.lit(False))).drop("_verdict", "_symbolic")
