"""Predicates: label matchers, scopes, log requests and a portable log query language."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


# --- label matchers -------------------------------------------------------------------------------

#: A matcher is (label, operator, value); an absent label is the empty string; patterns are anchored at both ends.
Matcher = tuple[str, str, str]


def label(name: str, labels: str | None = None) -> Column:
    c = F.col(labels)[name] if labels else F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def match(matchers: Sequence[Matcher], labels: str | None = None) -> Column:
    """All of the matchers, on plain columns or on a map column of labels."""
    out = []
    for name, op, value in matchers:
        c = label(name, labels)
        if op in ("=~", "!~"):
            literal = literal_alternatives(value)
            hit = c.isin(literal) if literal is not None else c.rlike(f"^(?:{value})$")
            out.append(hit if op == "=~" else ~hit)
        elif op in ("=", "!="):
            out.append(c == value if op == "=" else c != value)
        else:
            raise ValueError(f"unknown matcher {op!r}")
    return _all(out)


def literal_alternatives(pattern: str) -> list[str] | None:
    """The alternatives of a pattern that is only literals, so that it can be a set lookup; else None."""
    parts = pattern.split("|")
    return None if any(re.search(r"[\\.^$*+?()\[\]{}]", p) for p in parts) else parts


def merge_matchers(own: Sequence[Matcher], added: Sequence[Matcher]) -> list[Matcher]:
    """own with added spliced in; an added matcher replaces those of its label."""
    names = {m[0] for m in added}
    return [m for m in own if m[0] not in names] + list(added)


_SELECTOR = re.compile(r"([A-Za-z_:][A-Za-z0-9_:]*)\s*\{([^{}]*)\}")
_PAIR = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_]*)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*,?')


def parse_selector(text: str) -> tuple[str, list[Matcher]]:
    """`name{label="value", ...}`."""
    m = _SELECTOR.fullmatch(text.strip())
    if not m:
        if re.fullmatch(r"[A-Za-z_:][A-Za-z0-9_:]*", text.strip()):
            return text.strip(), []
        raise ValueError(f"not a selector: {text!r}")
    return m[1], [(k, op, v.replace('\\"', '"').replace("\\\\", "\\")) for k, op, v in _PAIR.findall(m[2])]


def splice(expression: str, added: Sequence[Matcher], prefix: str = "") -> str:
    """Every selector in an expression whose name has the prefix, with matchers merged in."""

    def one(m: re.Match) -> str:
        if not m[1].startswith(prefix):
            return m[0]
        merged = merge_matchers(parse_selector(m[0])[1], added)
        return m[1] + "{" + ",".join(f'{k}{op}"{v}"' for k, op, v in merged) + "}"

    return _SELECTOR.sub(one, expression)


def in_set(column: str, ids: Sequence) -> Column:
    """Membership; an empty list matches nothing, so that an empty scope reads nothing."""
    return F.col(column).isin(list(ids)) if ids else F.lit(False)


def identity(pairs: Sequence[Mapping[str, object]]) -> Column:
    """Any of several identities, each of which needs all its columns."""
    return _any([_all([F.col(k) == v for k, v in p.items()]) for p in pairs])


OPERATORS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def compare(column: str | Column, op: str, value: float) -> Column:
    """A comparison filter: rows that don't match go."""
    c = F.col(column) if isinstance(column, str) else column
    return getattr(c, OPERATORS[op])(value)


def unset_is(column: str, value: str | None) -> Column:
    """value None: any; '': unset, that is null or empty; else equal."""
    if value is None:
        return F.lit(True)
    return F.coalesce(F.col(column), F.lit("")) == value


SEVERITIES = ["debug", "info", "warning", "error", "critical"]


def severity_floor(column: str, floor: str) -> Column:
    return F.col(column).isin(SEVERITIES[SEVERITIES.index(floor):])


def like_any(columns: Sequence[str], text: str) -> Column:
    """The text, literally and in any case, in any of the columns."""
    return _any([F.lower(F.col(c).cast("string")).contains(text.lower()) for c in columns])


# --- log requests ---------------------------------------------------------------------------------


#: The logical fields of logs that filters may name; all but the message are keywords.
FIELDS = [
    "device_id", "cluster_id", "namespace", "workload", "pod", "container", "node", "service_name", "service_namespace", "service_version", "instance_id", "environment", "source_id", "level",
    "file", "unit", "trace_id", "span_id", "message",
]


def logical_filters(filters: Sequence[tuple[str, str, Sequence]], columns: Mapping[str, str]) -> list[tuple[str, str, Sequence]]:
    """Filters on logical fields as filters on columns; a field outside FIELDS, or that the logs don't have, is an error."""
    for name, _, _ in filters:
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        if name not in columns:
            raise ValueError(f"these logs have no field {name!r}")
    return [(columns[name], op, values) for name, op, values in filters]


@dataclass
class LogRequest:
    """A search that doesn't depend on where logs lie: [start, end] in microseconds, scope, keywords, field filters."""

    start: int
    end: int
    scope: Mapping[str, Sequence] = field(default_factory=dict)
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    mode: str = "any"
    filters: Sequence[tuple[str, str, Sequence]] = ()
    limit: int = 100
    descending: bool = True

    def validate(self) -> LogRequest:
        if self.start >= self.end:
            raise ValueError("start must be before end")
        if self.end - self.start > 30 * 86_400_000_000:
            raise ValueError("the range is over 30 days")
        if len(self.include) + len(self.exclude) > 20 or len(self.filters) > 20:
            raise ValueError("more than 20 keywords or filters")
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be 1 to 1000")
        if self.mode not in ("any", "all", "phrase"):
            raise ValueError(f"unknown keyword mode {self.mode!r}")
        return self

    def condition(self, half_open: bool = False) -> Column:
        """The predicate; half_open is (start, end], as counts take it."""
        t = F.col("t")
        parts = [t > self.start if half_open else t >= self.start, t <= self.end]
        parts += [in_set(k, v) for k, v in self.scope.items() if v]
        message = F.lower("message")
        words = [message.contains(k.lower()) for k in self.include]
        if words:
            parts.append(_any(words) if self.mode == "any" else _all(words))
        parts += [~message.contains(k.lower()) for k in self.exclude]
        parts += [field_filter(*f) for f in self.filters]
        return _all(parts)


def field_filter(name: str, op: str, values: Sequence) -> Column:
    """eq, neq, in, exists or prefix; on the message they ignore case and look anywhere in it."""
    c = F.col(name)
    if name == "message" and op in ("eq", "neq"):
        hit = F.lower(c).contains(str(values[0]).lower())
        return hit if op == "eq" else ~hit
    if op == "eq" and values[0] == "":
        return F.coalesce(c.cast("string"), F.lit("")) == ""
    if op == "eq":
        return c == values[0]
    if op == "neq":
        return F.coalesce(c != values[0], F.lit(True))
    if op == "in":
        return in_set(name, values)
    if op == "exists":
        return c.isNotNull() & (c.cast("string") != "")
    if op == "prefix":
        return c.cast("string").startswith(str(values[0]))
    raise ValueError(f"unknown filter {op!r}")


_STAGE = re.compile(r'\s*(\|=|!=|\|~|!~)\s*("(?:[^"\\]|\\.)*"|`[^`]*`)')


def log_query(text: str) -> Column:
    """`{label="x", ...} |= "a" != "b" |~ "c|d"`: matchers and literal line filters; anything else is an error."""
    m = re.match(r"\s*\{([^{}]*)\}", text)
    if not m:
        raise ValueError("a log query begins with a selector")
    pairs = _PAIR.findall(m[1])
    if _PAIR.sub("", m[1]).strip():
        raise ValueError(f"bad selector: {m[1]!r}")
    parts, at = [match(pairs)], m.end()
    while at < len(text) and text[at:].strip():
        s = _STAGE.match(text, at)
        if not s:
            raise ValueError(f"not portable: {text[at:].strip()!r}")
        raw = s[2][1:-1] if s[2][0] == "`" else s[2][1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if s[1] in ("|=", "!="):
            hit = F.col("message").contains(raw)
        else:
            insensitive = raw.startswith("(?i)")
            words = literal_alternatives(raw.removeprefix("(?i)"))
            if words is None:
                raise ValueError(f"only literal alternatives are portable: {raw!r}")
            c = F.lower("message") if insensitive else F.col("message")
            hit = _any([c.contains(w.lower() if insensitive else w) for w in words])
        parts.append(hit if s[1][0] == "|" else ~hit)
        at = s.end()
    return _all(parts)


# --- spans, flows, vectors ------------------------------------------------------------------------


def span_query(service: str | None = None, environment: str | None = None, error: bool = False, min_ns: int | None = None, devices: Sequence[str] | None = None) -> Column:
    """Predicates on flattened spans; None is any, '' is unset."""
    parts = []
    for key, value in (("service.name", service), ("deployment.environment", environment)):
        if value is not None:
            parts.append(F.coalesce(F.col("resource")[key], F.lit("")) == value)
    if error:
        parts.append(F.col("status").isin("STATUS_CODE_ERROR", "2", "error"))
    if min_ns is not None:
        parts.append(F.col("end_ns") - F.col("start_ns") >= min_ns)
    if devices is not None:
        parts.append(F.col("resource")["device_id"].isin(list(devices)) if devices else F.lit(False))
    return _all(parts)


_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*"|\'[^\']*\')|\{\{\s*([^{}]+?)\s*\}\}|(==|!=|>=|<=|>|<|contains\b)|([^\s"\'{}=!<>]+))')


def path(variant: str, dotted: str) -> Column:
    """A value of a JSON text by a dotted path with indexes; null where it isn't there."""
    return F.get_json_object(variant, "$." + dotted)


def flow_condition(text: str, context: str) -> Column:
    """`left op right` or a single operand for its truth. Operands: {{path}}, quoted or bare literals. Numbers compare as numbers."""
    tokens = [m for m in _TOKEN.finditer(text) if m[0].strip()]

    def operand(m: re.Match) -> Column:
        if m[2]:
            return path(context, m[2])
        return F.lit(m[1][1:-1] if m[1] else m[4])

    if len(tokens) == 1:
        c = operand(tokens[0])
        return c.isNotNull() & ~F.lower(c).isin("", "false", "0", "null")
    if len(tokens) != 3 or not tokens[1][3]:
        raise ValueError(f"not a condition: {text!r}")
    a, op, b = operand(tokens[0]), tokens[1][3], operand(tokens[2])
    if op == "contains":
        return F.coalesce(a.contains(b), F.lit(False))
    x, y = a.try_cast("double"), b.try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    name = OPERATORS[op]
    return F.coalesce(F.when(both, getattr(x, name)(y)).otherwise(getattr(a, name)(b)), F.lit(op == "!="))


def template(text: str, context: str) -> Column:
    """Text with {{path}} filled in; a missing path is empty, but null where it is the whole text."""
    whole = re.fullmatch(r"\{\{\s*([^{}]+?)\s*\}\}", text.strip())
    if whole:
        return path(context, whole[1])
    parts = re.split(r"\{\{\s*([^{}]+?)\s*\}\}", text)
    return F.concat(*[F.coalesce(path(context, p), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
