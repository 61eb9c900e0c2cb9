"""A subset of PromQL, compiled to vector plans.

Selectors with matchers, ranges, offsets, @ and sub-queries; aggregations by and without; range, label
and arithmetic functions; arithmetic, comparisons and set operators with on, ignoring and group_left. A
query is evaluated at one time; evaluate_range() does so at each step of a range and unites the results.
Samples have a `name`, a `t` in microseconds, a `value` and a column for each label.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import divided

from . import range as r
from .select import match
from .vector import AGGREGATES, Vector, constant, label_join, label_replace, scalar

_TOKEN = re.compile(
    r"\s*(?:(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![0-9a-zA-Z_.])|[iI]nf\b|[nN]a[nN]\b)|(?P<duration>(?:\d+(?:ms|[smhdwy]))+)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_:.]*)|(?P<op>==|!=|>=|<=|=~|!~|[-+*/%^(){}\[\],=<>@:]))"
)
_UNIT = {"ms": 1_000, "s": r.SECOND, "m": 60 * r.SECOND, "h": 3600 * r.SECOND, "d": 86400 * r.SECOND, "w": 604800 * r.SECOND, "y": 31536000 * r.SECOND}
_LEVELS = [["or"], ["and", "unless"], ["==", "!=", ">", ">=", "<", "<="], ["+", "-"], ["*", "/", "%"]]
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "%": lambda a, b: F.try_mod(a, b), "^": lambda a, b: F.pow(a, b),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}
_OVER = {"count", "sum", "avg", "min", "max", "stddev", "last", "present"}


def duration(text: str) -> int:
    """Microseconds of a text like 1h30m."""
    return sum(int(n) * _UNIT[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


@dataclass
class Selector:
    name: str
    matchers: list[tuple[str, str, str]]
    range: int | None = None
    offset: int = 0
    at: int | None = None


@dataclass
class Sub:
    inner: object
    range: int
    step: int
    offset: int = 0


@dataclass
class Call:
    name: str
    args: list
    by: list[str] | None = None
    without: list[str] | None = None


@dataclass
class Binary:
    op: str
    left: object
    right: object
    on: list[str] | None = None
    ignoring: list[str] | None = None
    group: bool = False
    bool_: bool = False


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 12]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][1] in values and self.tokens[self.i][0] != "string"

    def take(self, kind: str | None = None) -> str:
        if self.i >= len(self.tokens) or kind and self.tokens[self.i][0] != kind:
            raise ValueError(f"expected {kind or 'more'} after {' '.join(t for _, t in self.tokens[:self.i])!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def eat(self, value: str) -> None:
        if not self.peek(value):
            raise ValueError(f"expected {value!r} after {' '.join(t for _, t in self.tokens[:self.i])!r}")
        self.i += 1

    def parse(self):
        out = self.binary(0)
        if self.i < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.i][1]!r}")
        return out

    def labels(self) -> list[str]:
        self.eat("(")
        out = []
        while not self.peek(")"):
            out.append(self.take("name"))
            if not self.peek(")"):
                self.eat(",")
        self.eat(")")
        return out

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.power()
        left = self.binary(level + 1)
        while self.peek(*_LEVELS[level]):
            b = Binary(self.take(), left, None)
            while self.peek("bool", "on", "ignoring", "group_left"):
                word = self.take()
                if word == "bool":
                    b.bool_ = True
                elif word == "group_left":
                    b.group = True
                    if self.peek("("):
                        self.labels()
                else:
                    setattr(b, word, self.labels())
            b.right = self.binary(level + 1)
            left = b
        return left

    def power(self):
        base = self.unary()
        if self.peek("^"):
            self.take()
            return Binary("^", base, self.power())
        return base

    def unary(self):
        if self.peek("-", "+"):
            sign, x = self.take(), self.unary()
            return Binary("*", -1.0, x) if sign == "-" else x
        return self.suffixes(self.primary())

    def primary(self):
        kind, text = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        if kind == "number":
            return float(self.take())
        if kind == "string":
            return self.take()[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if self.peek("("):
            self.take()
            out = self.binary(0)
            self.eat(")")
            return out
        if self.peek("{"):
            return self.selector("")
        name = self.take("name")
        if self.peek("by", "without") or self.peek("("):
            call = Call(name, [])
            if self.peek("by", "without"):
                setattr(call, self.take(), self.labels())
            self.eat("(")
            while not self.peek(")"):
                call.args.append(self.binary(0))
                if not self.peek(")"):
                    self.eat(",")
            self.eat(")")
            if self.peek("by", "without"):
                setattr(call, self.take(), self.labels())
            return call
        return self.selector(name)

    def selector(self, name: str) -> Selector:
        out = Selector(name, [])
        if self.peek("{"):
            self.take()
            while not self.peek("}"):
                key, op, value = self.take("name"), self.take("op"), self.take("string")
                out.matchers.append((key, op, value[1:-1].replace('\\"', '"').replace("\\\\", "\\")))
                if not self.peek("}"):
                    self.eat(",")
            self.eat("}")
        return out

    def suffixes(self, x):
        while self.peek("[", "offset", "@"):
            word = self.take()
            if word == "[":
                span = duration(self.take("duration"))
                if self.peek(":"):
                    self.take()
                    x = Sub(x, span, duration(self.take("duration")) if not self.peek("]") else 60 * r.SECOND)
                elif isinstance(x, Selector):
                    x.range = span
                else:
                    raise ValueError("a range needs a selector")
                self.eat("]")
            elif word == "offset":
                sign = -1 if self.peek("-") and self.take() else 1
                x.offset = sign * duration(self.take("duration"))
            else:
                x.at = int(float(self.take("number")) * r.SECOND)
        return x


class Evaluator:
    """Evaluates a parsed query on samples whose labels are these columns."""

    def __init__(self, samples: DataFrame, labels: Sequence[str], lookback: int = r.LOOKBACK):
        self.samples, self.labels, self.lookback = samples, tuple(labels), lookback

    def eval(self, x, at: int) -> Vector | float | str:
        if isinstance(x, (float, str)):
            return x
        if isinstance(x, Selector) and not x.range:
            d, t = self.rows(x), x.at if x.at is not None else at
            return r.instant(d, self.labels, t, self.lookback, x.offset)
        if isinstance(x, Binary):
            return self.binary(x, at)
        if isinstance(x, Call):
            return self.call(x, at)
        raise ValueError("a range vector needs a function")

    def rows(self, s: Selector) -> DataFrame:
        matchers = ([("name", "=", s.name)] if s.name else []) + [("name" if k == "__name__" else k, o, v) for k, o, v in s.matchers]
        return self.samples.where(match(matchers)).select(*self.labels, "t", "value")

    def window(self, x, at: int) -> tuple[DataFrame, tuple[str, ...], r.Grid]:
        """Samples, keys and window of a range selector or a sub-query."""
        if isinstance(x, Selector) and x.range:
            t = (x.at if x.at is not None else at) - x.offset
            return self.rows(x), self.labels, r.Grid.instant(t, x.range)
        if isinstance(x, Sub):
            end = at - x.offset
            grid = r.Grid.instant(end, x.range)
            if isinstance(x.inner, Selector):
                return r.subquery(self.rows(x.inner), self.labels, end - x.range, end, x.step, self.lookback), self.labels, grid
            first = -(-(end - x.range) // x.step) * x.step
            parts = [(t, self.eval(x.inner, t)) for t in range(first, end + 1, x.step)]
            if len(parts) > 500 or not all(isinstance(p, Vector) for _, p in parts):
                raise ValueError("a sub-query has at most 500 steps of a vector")
            keys = parts[0][1].keys
            return reduce(DataFrame.unionByName, [p.df.withColumn("t", F.lit(t)) for t, p in parts]), keys, grid
        raise ValueError("expected a range vector")

    def call(self, c: Call, at: int) -> Vector | float:
        name, args = c.name, c.args
        if name in AGGREGATES or name in ("topk", "bottomk", "quantile"):
            v = self.eval(args[-1], at)
            by = [k for k in v.keys if k not in c.without] if c.without is not None else [k for k in c.by or [] if k in v.keys]
            if name in ("topk", "bottomk"):
                return v.top(int(self.eval(args[0], at)), by, name == "topk")
            if name == "quantile":
                return Vector(v.df.groupBy(*by).agg(F.percentile("value", self.eval(args[0], at)).alias("value")), tuple(by))
            return v.agg(name, by)
        if name in ("rate", "increase", "changes"):
            d, keys, g = self.window(args[0], at)
            made = {"rate": r.rate, "increase": r.increase, "changes": r.changes}[name](d, keys, g)
            return Vector.of(made, keys)
        if name.endswith("_over_time"):
            how = name.removesuffix("_over_time")
            d, keys, g = self.window(args[-1], at)
            if how not in _OVER and how != "quantile":
                raise ValueError(f"unknown function {name}")
            return Vector.of(r.over_time(how, d, keys, g, *([self.eval(args[0], at)] if how == "quantile" else [])), keys)
        if name == "predict_linear":
            d, keys, g = self.window(args[0], at)
            return Vector.of(r.predict_linear(d, keys, g, self.eval(args[1], at)), keys)
        if name == "histogram_quantile":
            v = self.eval(args[1], at)
            keys = [k for k in v.keys if k != "le"]
            return Vector.of(r.histogram_quantile(self.eval(args[0], at), v.df, keys), keys)
        if name == "time":
            return at / r.SECOND
        if name == "vector":
            return constant(self.samples.sparkSession, self.eval(args[0], at))
        if name == "scalar":
            v = self.eval(args[0], at)
            return Vector(v.df.agg(scalar(v).alias("value")), ())
        v = self.eval(args[0], at)
        if name == "timestamp" and isinstance(args[0], Selector):
            d = r.over_time("timestamp", self.rows(args[0]), self.labels, r.Grid.instant(at - args[0].offset, self.lookback))
            return Vector.of(d, self.labels)
        if name == "label_replace":
            return label_replace(v, *[args[i] for i in (1, 2, 3, 4)])
        if name == "label_join":
            return label_join(v, *args[1:])
        if name in ("abs", "ceil", "floor", "exp", "ln", "sqrt"):
            f = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "exp": F.exp, "ln": F.ln, "sqrt": F.sqrt}[name]
            return v.map(f)
        if name in ("clamp_min", "clamp_max"):
            k = F.lit(self.eval(args[1], at))
            return v.map(lambda x: F.greatest(x, k) if name == "clamp_min" else F.least(x, k))
        raise ValueError(f"unknown function {name}")

    def binary(self, b: Binary, at: int) -> Vector | float:
        x, y = self.eval(b.left, at), self.eval(b.right, at)
        if b.op in ("and", "or", "unless"):
            on = self.matched(b, x)
            return {"and": x.and_, "or": x.or_, "unless": x.unless}[b.op](y, on)
        if not isinstance(x, Vector) and not isinstance(y, Vector):
            if b.op in _COMPARE:
                return float({"==": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[b.op])
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y if y else float("nan"), "%": lambda: x % y, "^": lambda: x**y}[b.op]()
        if b.op in _COMPARE:
            f = _COMPARE[b.op]
            if not isinstance(y, Vector):
                return x.map(lambda v: f(v, F.lit(y)).cast("double")) if b.bool_ else x.where(lambda v: f(v, F.lit(y)))
            if not isinstance(x, Vector):
                return y.map(lambda v: f(F.lit(x), v).cast("double")) if b.bool_ else y.where(lambda v: f(F.lit(x), v))
            keep = (lambda p, q: f(p, q).cast("double")) if b.bool_ else (lambda p, q: F.when(f(p, q), p))
            return self.join(b, x, y, keep)
        g = _ARITHMETIC[b.op]
        if not isinstance(y, Vector):
            return x.map(lambda v: g(v, F.lit(y)))
        if not isinstance(x, Vector):
            return y.map(lambda v: g(F.lit(x), v))
        return self.join(b, x, y, g)

    @staticmethod
    def matched(b: Binary, x: Vector) -> list[str] | None:
        return b.on if b.on is not None else [k for k in x.keys if k not in b.ignoring] if b.ignoring is not None else None

    def join(self, b: Binary, x: Vector, y: Vector, f: Callable[[Column, Column], Column]) -> Vector:
        on = self.matched(b, x)
        return x.group_left(y, f, on or []) if b.group else x.binary(y, f, on)


def evaluate(text: str, samples: DataFrame, labels: Sequence[str], at: int, lookback: int = r.LOOKBACK) -> Vector:
    out = Evaluator(samples, labels, lookback).eval(Parser(text).parse(), at)
    return out if isinstance(out, Vector) else constant(samples.sparkSession, float(out))


def evaluate_range(text: str, samples: DataFrame, labels: Sequence[str], start: int, end: int, step: int, lookback: int = r.LOOKBACK) -> DataFrame:
    """(labels, at, value) at each step; at most 500 steps."""
    times = list(range(start, end + 1, step))
    if not 0 < len(times) <= 500:
        raise ValueError("a range has 1 to 500 steps")
    return reduce(DataFrame.unionByName, [evaluate(text, samples, labels, t, lookback).df.withColumn("at", F.lit(t)) for t in times])
