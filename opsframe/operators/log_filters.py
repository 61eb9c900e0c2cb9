"""Log filters as people write them: chains of line filters, and labels in them that belong into the selector.

All on columns, so that a table of rules is one projection. A text is null: the result is that of an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels of log streams that a selector may name.
LABELS = ["detected_level", "device_id", "filename", "identifier", "level", "source", "service_name", "unit"]
#: Other names of labels.
OTHER_LABELS = {"priority": "level", "severity": "level"}
#: Selectors of rules that have none.
JOURNAL, EVERYTHING = '{source=~"journald(:.*)?"}', '{source=~".+"}'
#: Operators of line filters and of matchers, each before those that begin like it.
STAGES, SIGNS = ["|=~", "|=", "|~", "!=", "!~"], ["!=", "=~", "!~", "="]
#: A label before what is looked for, `level=error .*text`, or one of several, `(level|severity)[=:]error.*text`.
_VALUE = r'"?([A-Za-z0-9_:/-]+(?:\.[A-Za-z0-9_:/-]+)*)"?\s*(?:\.\*)?(.*)$'
LABEL_FIRST = rf"(?i)^(?:\(\?i\))?\s*({'|'.join([*LABELS, *OTHER_LABELS])})\s*(=|!=|=~|!~)\s*{_VALUE}"
LABELS_FIRST = rf"(?i)^(?:\(\?i\))?\s*\(([^)]+)\)\s*\[=:\]\s*{_VALUE}"

_OP = "(?>" + "|".join(s.replace("|", r"\|") for s in STAGES) + ")"
_QUOTED = r'"(?!")([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_STAGE = rf"\s*+({_OP})\s*+(?:{_QUOTED}|((?>[^\"\s].*?(?=[ \t]{_OP}|\z))))"
_PAIR = r'([A-Za-z_][A-Za-z0-9_]*)\s*(=~|!~|!=|=)\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_KNOWN = "array(" + ",".join(f"'{x}'" for x in LABELS) + ")"
_MATCHERS = "array<struct<key:string,op:string,value:string>>"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def unquote(c: Column) -> Column:
    """What a quoted string's inside stands for; where it has other escapes than of quotes, backslashes and white space, itself."""
    # pairs of backslashes come first, so that the second one escapes nothing
    parts = F.transform(F.split(c, r"\\\\"), _unescaped)
    odd = F.regexp_replace(c, r"\\\\", "").rlike(r'\\(?!["ntr])')
    return F.when(odd, F.regexp_replace(c, '^"+|"+$', "")).otherwise(F.array_join(parts, "\\"))


def _unescaped(c: Column) -> Column:
    for char, letter in (('"', '"'), ("\n", "n"), ("\t", "t"), ("\r", "r")):
        c = F.replace(c, F.lit("\\" + letter), F.lit(char))
    return c


def quote(c: Column) -> Column:
    for char, raw in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(char), F.lit(raw))
    return F.concat(F.lit('"'), c, F.lit('"'))


def literal(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(c, r"[\\.+*?()|\[\]{}^$]", r"\\$0")


def is_chain(text: Column) -> Column:
    """Whether a text without white space around it is a chain."""
    return text.rlike(rf"(?s)^(?:{_STAGE})+\s*$")


def stages(text: Column) -> Column:
    """`|= "a" |~ b != "c"` as (op, body) in order. What is no chain is one stage; without an operator its op is empty."""
    return let(strip(text), _stages)


def _stages(t: Column) -> Column:
    found = [F.regexp_extract_all(t, F.lit(f"(?s){_STAGE}"), F.lit(i)).alias(n) for i, n in ((1, "op"), (2, "quoted"), (3, "bare"))]
    chain = F.transform(F.arrays_zip(*found), lambda s: _stage(s["op"], F.when(s["quoted"] != "", unquote(s["quoted"])).otherwise(strip(s["bare"]))))
    op, inside = F.regexp_extract(t, rf"(?s)^({_OP})", 1), r'(?s)^"(.*)"$'
    one = let(strip(F.regexp_replace(t, rf"^{_OP}", "")), lambda rest: F.array(_stage(op, F.when(rest.rlike(inside), unquote(F.regexp_extract(rest, inside, 1))).otherwise(rest))))
    return F.when(t == "", F.slice(one, 1, 0)).when(is_chain(t), chain).otherwise(one)


def _stage(op: Column, body: Column) -> Column:
    return F.struct(F.when(op == "|=~", "|~").otherwise(op).alias("op"), body.alias("body"))


def known(key: Column) -> Column:
    return F.array_contains(F.expr(_KNOWN), key)


def named(key: Column) -> Column:
    out = F.trim(key)
    for other, name in OTHER_LABELS.items():
        out = F.when(F.lower(F.trim(key)) == other, name).otherwise(out)
    return out


def _matcher(key: Column, op: Column | str, value: Column) -> Column:
    return F.struct(key.alias("key"), (F.lit(op) if isinstance(op, str) else op).alias("op"), value.alias("value"))


def _label_first(b: Column) -> Column:
    """(matcher, rest) of a stripped text that begins with a label and goes on; the matcher is null for others."""
    names = F.filter(F.transform(F.split(F.regexp_extract(b, LABELS_FIRST, 1), r"\|"), named), lambda k: known(k))
    one = F.struct(named(F.regexp_extract(b, LABEL_FIRST, 1)).alias("key"), F.regexp_extract(b, LABEL_FIRST, 2).alias("op"), F.regexp_extract(b, LABEL_FIRST, 3).alias("value"), strip(F.regexp_extract(b, LABEL_FIRST, 4)).alias("rest"))
    any_of = F.struct(F.get(names, F.lit(0)).alias("key"), F.lit("=").alias("op"), F.regexp_extract(b, LABELS_FIRST, 2).alias("value"), strip(F.regexp_extract(b, LABELS_FIRST, 3)).alias("rest"))
    found = F.when(b.rlike(LABEL_FIRST), one).when(b.rlike(LABELS_FIRST), any_of)
    return let(found, lambda x: F.when(known(x["key"]) & (x["rest"] != ""), x))


def _label_only(t: Column) -> Column:
    """The matcher that a whole stripped text is; the first sign that occurs decides. Null for others."""
    sign = F.lit(None)
    for s in reversed(SIGNS):
        sign = F.when(F.instr(t, s) > 1, s).otherwise(sign)
    cut = let(sign, lambda s: _matcher(strip(F.call_function("substring_index", t, s, F.lit(1))), s, F.regexp_replace(strip(F.substring(t, F.call_function("instr", t, s) + F.length(s), F.length(t))), '^"+|"+$', "")))
    return let(cut, lambda m: F.when(known(m["key"]) & (m["value"] != ""), m))


def line_filter(text: Column) -> Column:
    """(pattern, matchers): what to look for in lines, and the labels that were among it.

    The stages of a chain become alternatives of one pattern, literal ones escaped; negative stages too, as in the original.
    """

    def part(s: Column) -> Column:
        b = strip(s["body"])
        only = F.when(s["op"] != "", let(strip(F.regexp_replace(b, r"^\(\?i\)", "")), _label_only))
        return F.struct(s.alias("s"), let(b, _label_first).alias("first"), only.alias("only"))

    def pattern(p: Column) -> Column:
        body = F.when(p["s"]["op"] == "|=", literal(p["s"]["body"])).otherwise(p["s"]["body"])
        return F.when(p["first"].isNotNull(), p["first"]["rest"]).when(p["only"].isNull(), body)

    def matcher(p: Column) -> Column:
        return F.when(p["first"].isNotNull(), _matcher(p["first"]["key"], p["first"]["op"], p["first"]["value"])).otherwise(p["only"])

    return let(F.transform(stages(text), part), lambda parts: F.struct(
        F.array_join(F.filter(F.transform(parts, pattern), lambda x: x != ""), "|").alias("pattern"),
        F.filter(F.transform(parts, matcher), lambda m: m.isNotNull()).cast(_MATCHERS).alias("matchers"),
    ))


def matchers(selector: Column) -> Column:
    """The matchers of `{key="value", ...}` in order; what is none is left out."""
    s = F.coalesce(selector, F.lit(""))
    found = [F.regexp_extract_all(s, F.lit(_PAIR), F.lit(i)).alias(n) for i, n in ((1, "key"), (2, "op"), (3, "value"))]
    return F.transform(F.arrays_zip(*found), lambda m: _matcher(m["key"], m["op"], unquote(m["value"]))).cast(_MATCHERS)


def first_of_each(m: Column) -> Column:
    """The first matcher of each label."""
    return let(m, lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, lambda y: y["key"]), x["key"]) == i + 1))


def shown(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(m, lambda x: F.concat(x["key"], x["op"], quote(x["value"]))), ","), F.lit("}"))


def stream_matchers(selector: Column, fallback: str) -> Column:
    """A selector's matchers on known labels, the first of each; fallback's where there is none. A job that names the journal is its source."""

    def taken(m: Column) -> Column:
        journal = F.exists(m, lambda x: (x["key"] == "job") & F.lower(x["value"]).contains("journal"))
        own = F.filter(m, lambda x: x["key"] == "source")
        others = F.filter(m, lambda x: known(x["key"]) & (x["key"] != "source"))
        guessed = F.concat(F.when(F.size(own) > 0, own).otherwise(matchers(F.lit(JOURNAL))), others)
        m = F.transform(F.when(journal, guessed).otherwise(m), lambda x: _matcher(named(x["key"]), x["op"], x["value"]))
        return F.filter(m, lambda x: known(x["key"]))

    return let(let(matchers(selector), taken), lambda m: F.when(F.size(m) > 0, first_of_each(m)).otherwise(matchers(F.lit(fallback))))


def split_query(query: Column) -> Column:
    """(selector, filter) of `{...}` with a chain or nothing after it; null for other texts."""
    head = r'(?s)^(\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*+\})(.*)$'
    parts = let(strip(query), lambda q: F.when(q.rlike(head), F.struct(F.regexp_extract(q, head, 1).alias("selector"), strip(F.regexp_extract(q, head, 2)).alias("filter"))))
    return let(parts, lambda p: F.when((p["filter"] == "") | is_chain(p["filter"]), p))
