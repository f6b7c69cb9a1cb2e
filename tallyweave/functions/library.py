"""The functions of form expressions, each from typed values to a typed value."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.lang.syntax import ExpressionError
from tallyweave.lang.values import Value, as_bool, as_date, as_num, as_text, as_time, boolean, is_empty, num, text, words


@dataclass
class Context:
    """What functions may ask for besides their arguments."""

    now: dt.datetime = dt.datetime(2026, 1, 1)
    seconds: Column | None = None
    index: Column | None = None
    seed: int = 0
    row_key: Column | None = None
    draws: int = field(default=0)


Function = Callable[[list[Value], Context], Value]
FUNCTIONS: dict[str, Function] = {}


def register(*names: str, args: tuple[int, int | None] | None = None) -> Callable[[Function], Function]:
    """Add a function under its names; ``args`` bounds the number of arguments."""

    def add(f: Function) -> Function:
        def checked(values: list[Value], ctx: Context) -> Value:
            if args and not (args[0] <= len(values) and (args[1] is None or len(values) <= args[1])):
                raise ExpressionError(f"{names[0]}() can't take {len(values)} arguments")
            return f(values, ctx)

        for name in names:
            FUNCTIONS[name] = checked
        return f

    return add


def call(name: str, values: list[Value], ctx: Context) -> Value:
    if name not in FUNCTIONS:
        raise ExpressionError(f"unknown function {name}()")
    return FUNCTIONS[name](values, ctx)


def _int(v: Value) -> Column:
    n = as_num(v)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("int")


def _finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def _split(sep: Value, items: Value) -> Column:
    if not isinstance(sep.literal, str) or not sep.literal:
        raise ExpressionError("the separator must be a constant")
    s = as_text(items)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, re.escape(sep.literal), -1))


# text


@register("string", args=(1, 1))
def _string(a, ctx):
    return text(as_text(a[0]))


@register("concat")
def _concat(a, ctx):
    return text(F.concat(*(as_text(v) for v in a))) if a else text("")


@register("substr", args=(2, 3))
def _substr(a, ctx):
    s = as_text(a[0])
    n = F.char_length(s)
    clip = lambda i: F.when(i < 0, F.greatest(F.lit(0), n + i)).otherwise(i)
    start = clip(_int(a[1]))
    stop = F.coalesce(clip(_int(a[2])), n) if len(a) == 3 else n
    return text(F.coalesce(F.when(F.least(stop, n) > start, s.substr(start + 1, F.least(stop, n) - start)).when(start.isNotNull(), ""), F.lit("")))


@register("string-length", args=(1, 1))
def _length(a, ctx):
    return num(F.char_length(as_text(a[0])).cast("double"))


@register("lower", "lower-case", args=(1, 1))
def _lower(a, ctx):
    return text(F.lower(as_text(a[0])))


@register("upper", "upper-case", args=(1, 1))
def _upper(a, ctx):
    return text(F.upper(as_text(a[0])))


@register("contains", args=(2, 2))
def _contains(a, ctx):
    return boolean(as_text(a[0]).contains(as_text(a[1])))


@register("starts-with", args=(2, 2))
def _starts(a, ctx):
    return boolean(as_text(a[0]).startswith(as_text(a[1])))


@register("ends-with", args=(2, 2))
def _ends(a, ctx):
    return boolean(as_text(a[0]).endswith(as_text(a[1])))


@register("translate", args=(3, 3))
def _translate(a, ctx):
    if not (isinstance(a[1].literal, str) and isinstance(a[2].literal, str)):
        return text(F.translate(as_text(a[0]), as_text(a[1]), as_text(a[2])))
    to = a[2].literal
    table = {c: to[k] if k < len(to) else "" for k, c in enumerate(a[1].literal)}  # of a repeated character the last counts
    there = [c for c in table if table[c]] + [c for c in table if not table[c]]
    return text(F.translate(as_text(a[0]), "".join(there), "".join(table[c] for c in there)))


@register("linebreak", args=(0, 0))
def _linebreak(a, ctx):
    return text("\n")


@register("regex", args=(2, 2))
def _regex(a, ctx):
    if not isinstance(a[1].literal, str):
        raise ExpressionError("the pattern of regex() must be a constant")
    try:
        re.compile(a[1].literal)
    except re.error as e:
        raise ExpressionError(f"bad pattern {a[1].literal!r}: {e}") from e
    return boolean(as_text(a[0]).rlike(a[1].literal))


@register("hash")
def _hash(a, ctx):
    return text(F.sha2(F.concat_ws("|", *(as_text(v) for v in a)), 256))


@register("format-number", args=(1, 1))
def _format_number(a, ctx):
    n = as_num(a[0])
    part = F.regexp_replace(F.format_number(n, 4), "[.]?0+$", "")
    return text(F.coalesce(F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(part), F.lit("")))


# multiple answers and lists


@register("selected", args=(2, 2))
def _selected(a, ctx):
    return boolean(F.array_contains(words(a[0]), as_text(a[1])))


@register("count-selected", args=(1, 1))
def _count_selected(a, ctx):
    return num(F.size(words(a[0])).cast("double"))


@register("selected-at", args=(2, 2))
def _selected_at(a, ctx):
    return text(F.coalesce(F.get(words(a[0]), _int(a[1])), F.lit("")))


@register("count-items", args=(2, 2))
def _count_items(a, ctx):
    return num(F.size(_split(a[0], a[1])).cast("double"))


@register("item-at", args=(3, 3))
def _item_at(a, ctx):
    return text(F.coalesce(F.get(_split(a[0], a[1]), _int(a[2])), F.lit("")))


@register("item-index", args=(3, 3))
def _item_index(a, ctx):
    return num((F.array_position(_split(a[0], a[1]), as_text(a[2])) - 1).cast("double"))


@register("item-present", args=(3, 3))
def _item_present(a, ctx):
    return boolean(F.array_contains(_split(a[0], a[1]), as_text(a[2])))


@register("de-duplicate", args=(2, 2))
def _de_duplicate(a, ctx):
    return text(F.array_join(F.array_distinct(_split(a[0], a[1])), a[0].literal))


@register("rank-value", args=(2, 2))
def _rank_value(a, ctx):
    numbers = F.filter(F.transform(words(a[1]), lambda w: as_num(text(w))), lambda x: x.isNotNull())
    at = F.array_position(F.sort_array(numbers, asc=False), as_num(a[0]))
    return num(F.coalesce(F.when(at > 0, at.cast("double")), F.lit(999.0)))


# numbers


@register("number", args=(1, 1))
def _number(a, ctx):
    return num(as_num(a[0]))


@register("int", args=(1, 1))
def _truncate(a, ctx):
    n = as_num(a[0])
    return num(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("double"))


@register("abs", args=(1, 1))
def _abs(a, ctx):
    return num(F.abs(as_num(a[0])))


@register("round", args=(1, 2))
def _round(a, ctx):
    by = F.pow(F.lit(10.0), F.coalesce(_int(a[1]).cast("double"), F.lit(0.0))) if len(a) == 2 else F.lit(1.0)
    return num(F.floor(as_num(a[0]) * by + 0.5).cast("double") / by)


@register("pow", args=(2, 2))
def _pow(a, ctx):
    return num(_finite(F.pow(as_num(a[0]), as_num(a[1]))))


for _name, _f in {"exp": F.exp, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}.items():
    register(_name, args=(1, 1))(lambda a, ctx, f=_f: num(_finite(f(as_num(a[0])))))


@register("atan2", args=(2, 2))
def _atan2(a, ctx):
    return num(F.atan2(as_num(a[0]), as_num(a[1])))


@register("pi", args=(0, 0))
def _pi(a, ctx):
    return num(3.141592653589793)


@register("min", args=(1, None))
def _min(a, ctx):
    """Of several values; of one variable that isn't in a repeat it is no number (in one, the aggregate is joined before)."""
    return num(F.least(*map(as_num, a)) if len(a) > 1 else F.lit(None).cast("double"))


@register("max", args=(1, None))
def _max(a, ctx):
    return num(F.greatest(*map(as_num, a)) if len(a) > 1 else F.lit(None).cast("double"))


@register("count", args=(1, 1))
def _count(a, ctx):
    return num(F.size(words(a[0])).cast("double"))


@register("count-non-empty", args=(1, None))
def _count_non_empty(a, ctx):
    return num(sum((F.when(is_empty(v), 0.0).otherwise(1.0) for v in a), F.lit(0.0)))


# dates


@register("today", args=(0, 0))
def _today(a, ctx):
    return Value("date", F.lit(ctx.now.date()))


@register("now", args=(0, 0))
def _now(a, ctx):
    return Value("time", F.lit(ctx.now.isoformat(sep=" ")).cast("timestamp"))


@register("date", args=(1, 1))
def _date(a, ctx):
    return Value("date", as_date(a[0]))


@register("date-time", args=(1, 1))
def _date_time(a, ctx):
    return Value("time", as_time(a[0]))


_TOKENS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%n": "M", "%b": "MMM", "%d": "dd", "%e": "d", "%a": "E", "%H": "HH", "%h": "H", "%M": "mm", "%S": "ss", "%3": "SSS"}


@register("format-date-time", "format-date", args=(2, 2))
def _format_date_time(a, ctx):
    if not isinstance(a[1].literal, str):
        raise ExpressionError("the format must be a constant")
    t = as_time(a[0])
    parts = [p for p in re.split("(" + "|".join(_TOKENS) + ")", a[1].literal) if p]
    made = [F.date_format(t, _TOKENS[p]) if p in _TOKENS else F.lit(p) for p in parts]
    return text(F.coalesce(F.when(t.isNotNull(), F.concat(*made)), F.lit("")) if made else "")


@register("decimal-date-time", args=(1, 1))
def _decimal_date_time(a, ctx):
    return num(F.unix_micros(as_time(a[0])) / F.lit(86_400e6))


@register("decimal-time", args=(1, 1))
def _decimal_time(a, ctx):
    s = as_text(a[0])
    clock = F.when((a[0].kind == "text") & s.rlike(r"^\d{1,2}:\d{2}"), F.concat(F.lit("1970-01-01 "), F.regexp_extract(s, r"^\d{1,2}:\d{2}(:\d{2})?", 0)).try_cast("timestamp")) if a[0].kind == "text" else F.lit(None).cast("timestamp")
    t = F.coalesce(as_time(a[0]), clock)
    return num((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / F.lit(86_400.0))


@register("duration", args=(0, 0))
def _duration(a, ctx):
    return num(ctx.seconds if ctx.seconds is not None else F.lit(0.0))


@register("if-empty-date", args=(2, 2))
def _if_empty_date(a, ctx):
    return Value("date", F.coalesce(as_date(a[0]), as_date(a[1])))


# conditions


def _common(values: list[Value]) -> str:
    kinds = {v.kind for v in values if not (v.kind == "text" and v.literal == "")}
    return kinds.pop() if len(kinds) == 1 else "text"


def _as(kind: str, v: Value) -> Column:
    if kind == "text":
        return as_text(v)
    if v.kind == "text":  # the empty literal
        return F.lit(None).cast({"num": "double", "bool": "boolean", "date": "date", "time": "timestamp"}[kind])
    return v.col


@register("if", args=(3, 3))
def _if(a, ctx):
    kind = _common(a[1:])
    return Value(kind, F.when(as_bool(a[0]), _as(kind, a[1])).otherwise(_as(kind, a[2])), raw=any(is_blank_literal(v) or v.raw for v in a[1:]))


def is_blank_literal(v: Value) -> bool:
    return v.kind == "text" and v.literal == ""


@register("coalesce", args=(1, None))
def _coalesce(a, ctx):
    kind = _common(a)
    out = _as(kind, a[-1])
    for v in reversed(a[:-1]):
        out = F.when(~is_empty(v), _as(kind, v)).otherwise(out)
    return Value(kind, out, raw=a[-1].raw)


@register("empty", args=(1, 1))
def _empty(a, ctx):
    return boolean(is_empty(a[0]))


@register("relevant", args=(1, 1))
def _relevant(a, ctx):
    return boolean(~is_empty(a[0]))


@register("not", args=(1, 1))
def _not(a, ctx):
    return boolean(~as_bool(a[0]))


@register("true", args=(0, 0))
def _true(a, ctx):
    return boolean(True)


@register("false", args=(0, 0))
def _false(a, ctx):
    return boolean(False)


@register("boolean", args=(1, 1))
def _boolean(a, ctx):
    return boolean(as_bool(a[0]))


@register("boolean-from-string", args=(1, 1))
def _boolean_from_string(a, ctx):
    return boolean(F.lower(F.trim(as_text(a[0]))).isin("1", "true", "yes", "y"))


# identity, chance, surroundings


def drawn(ctx: Context, salt: str) -> Column:
    """A uniform number of the row, the same in every run and partitioning."""
    key = ctx.row_key if ctx.row_key is not None else F.lit(0)
    ctx.draws += 1
    return F.pmod(F.xxhash64(F.lit(ctx.seed), F.lit(salt), F.lit(ctx.draws), key), F.lit(1 << 53)) / F.lit(float(1 << 53))


@register("random", args=(0, 0))
def _random(a, ctx):
    return num(drawn(ctx, "random"))


@register("uuid", args=(0, 0))
def _uuid(a, ctx):
    key = ctx.row_key if ctx.row_key is not None else F.lit(0)
    ctx.draws += 1
    h = F.sha2(F.concat_ws("|", F.lit(str(ctx.seed)), F.lit(str(ctx.draws)), key.cast("string")), 256)
    return text(F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-4"), h.substr(14, 3), F.lit("-a"), h.substr(18, 3), F.lit("-"), h.substr(21, 12)))


@register("once", args=(1, 1))
def _once(a, ctx):
    return a[0]


@register("index", "position", args=(0, 1))
def _index(a, ctx):
    return num(ctx.index.cast("double") if ctx.index is not None else F.lit(1.0))


register("version", "device-info", "enumerator-name", "enumerator-id", "username", args=(0, 0))(lambda a, ctx: text(""))
