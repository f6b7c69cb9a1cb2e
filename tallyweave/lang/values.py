"""Typed values: a Column with its static kind, and the coercions between kinds.

Blank has two spellings. Text is blank when null or ''; a raw number (straight from a column) when null. A computed
number that is null stands for NaN, which is not empty and equals only the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^-?[0-9]+([.][0-9]+)?$"
_CLOCK = "[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?"
_ISO = f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]{_CLOCK})?$"


@dataclass(frozen=True)
class Value:
    kind: str  # text, num, bool, date, time (an instant)
    col: Column
    raw: bool = False
    literal: object = None


def text(col: Column | str) -> Value:
    return Value("text", F.lit(col), literal=col) if isinstance(col, str) else Value("text", col)


def num(col: Column | float) -> Value:
    return Value("num", F.lit(float(col)), literal=float(col)) if isinstance(col, (int, float)) else Value("num", col)


def boolean(col: Column | bool) -> Value:
    return Value("bool", F.lit(col) if isinstance(col, bool) else col)


def of_column(col: Column, kind: T.DataType) -> Value:
    """A column of the data as a value, by its Spark type."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Value("num", F.nanvl(col.cast("double"), F.lit(None).cast("double")), raw=True)
    if isinstance(kind, T.NumericType):
        return Value("num", col.cast("double"), raw=True)
    if isinstance(kind, T.BooleanType):
        return Value("bool", col, raw=True)
    if isinstance(kind, T.DateType):
        return Value("date", col, raw=True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Value("time", col.cast("timestamp"), raw=True)
    if isinstance(kind, T.ArrayType):
        return Value("text", F.coalesce(F.array_join(col, " "), F.lit("")), raw=True)
    return Value("text", F.coalesce(col.cast("string"), F.lit("")), raw=True)


def as_num(v: Value) -> Column:
    """Double, null for what is no number."""
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "date":
        return F.datediff(v.col, F.lit("1970-01-01").cast("date")).cast("double")
    if v.kind == "time":
        return F.unix_micros(v.col) / F.lit(86_400e6)
    t = F.trim(v.col)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def as_text(v: Value) -> Column:
    """Text, never null: whole numbers without a fraction, NaN and blank as ''."""
    if v.kind == "text":
        return F.coalesce(v.col, F.lit(""))
    if v.kind == "bool":
        return F.coalesce(F.when(v.col, "true").otherwise(F.when(~v.col, "false")), F.lit(""))
    if v.kind == "num":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.coalesce(F.when(whole, v.col.cast("decimal(20,0)").cast("string")).otherwise(v.col.cast("string")), F.lit(""))
    if v.kind == "date":
        return F.coalesce(F.date_format(v.col, "yyyy-MM-dd"), F.lit(""))
    return F.coalesce(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def as_bool(v: Value) -> Column:
    """Never null: a non-zero number, any non-empty text ('0' and 'false' included)."""
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "text":
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def as_gate(v: Value) -> Column:
    """Truth of a gate: like as_bool, but the text 'false' in any case is false."""
    return as_bool(v) & (F.lower(F.trim(v.col)) != "false") if v.kind == "text" else as_bool(v)


def is_empty(v: Value) -> Column:
    """Blank; a computed number never is."""
    if v.kind == "text":
        return F.coalesce(v.col, F.lit("")) == ""
    return v.col.isNull() if v.raw or v.kind in ("date", "time") else F.lit(False)


def as_time(v: Value) -> Column:
    """Timestamp, null where there is none: ISO forms and ``Jan 5, 2024 03:04:05 PM``."""
    if v.kind == "time":
        return v.col
    if v.kind == "date":
        return v.col.cast("timestamp")
    t = F.trim(as_text(v))
    us = F.try_to_timestamp(F.when(t.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4} "), t), F.lit("MMM d, yyyy hh:mm:ss a"))
    return F.coalesce(F.when(t.rlike(_ISO), t.try_cast("timestamp")), us)


def as_date(v: Value) -> Column:
    return v.col if v.kind == "date" else as_time(v).cast("date")


def datelike(v: Value) -> Column:
    """The instant of a date, or of a text in ISO form; else null."""
    if v.kind in ("date", "time"):
        return as_time(v)
    if v.kind != "text":
        return F.lit(None).cast("timestamp")
    t = F.trim(v.col)
    return F.when(t.rlike(_ISO), t.try_cast("timestamp"))


def equal(a: Value, b: Value) -> Column:
    """``=``: numbers as numbers, a number and a numeric text too, all else by rendering. Never null."""
    numeric = ("num",)
    if a.kind in numeric and b.kind in numeric:
        if a.raw and b.raw:
            return a.col.eqNullSafe(b.col)
        return F.coalesce(a.col == b.col, F.lit(False))
    if a.kind in numeric and b.kind == "text" or b.kind in numeric and a.kind == "text":
        return F.coalesce(as_num(a) == as_num(b), as_text(a) == as_text(b))
    return as_text(a) == as_text(b)


def ordered(op: str, a: Value, b: Value) -> Column:
    """``< <= > >=``: by time if both look like dates, else as numbers; anything without a number is false."""

    def cmp(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    by_number = F.coalesce(cmp(as_num(a), as_num(b)), F.lit(False))
    could = ("text", "date", "time")
    if a.kind in could and b.kind in could and not (isinstance(a.literal, str) and not _maybe_date(a.literal)) and not (isinstance(b.literal, str) and not _maybe_date(b.literal)):
        x, y = datelike(a), datelike(b)
        return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(cmp(x, y), F.lit(False))).otherwise(by_number)
    return by_number


def _maybe_date(s: str) -> bool:
    return len(s) >= 10 and s[4:5] == "-"


def words(v: Value) -> Column:
    """The codes of a multiple answer."""
    return F.filter(F.split(F.trim(as_text(v)), r"\s+"), lambda t: t != "")
