"""Repeat groups as child tables: aggregates over instances, ranks, picks, and the wide form at the edges."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, compiled, predicate
from tallyweave.lang.syntax import Call, Num, Ref, Text, parse, walk
from tallyweave.lang.values import Value, as_num, as_text, num, of_column, text

ABSENT_RANK = 999


def value_of(df: DataFrame, name: str) -> Value:
    return of_column(F.col(f"`{name}`"), df.schema[name].dataType)


def number(df: DataFrame, name: str) -> Column:
    return as_num(value_of(df, name))


def count_of(v: Column) -> Column:
    """Instances with a non-blank value."""
    return F.count(F.nullif(as_text(text(v.cast("string"))), F.lit("")))


def sum_of(n: Column) -> Column:
    """Sum over instances that have a number; 0 without any."""
    return F.coalesce(F.sum(n), F.lit(0.0))


def joined(index: Column, v: Column, sep: str) -> Column:
    """Non-blank values in instance order."""
    kept = F.when(F.coalesce(v, F.lit("")) != "", F.struct(index.alias("i"), v.alias("v")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["v"]), sep)


def if_family(df: DataFrame, keys: list[str], field: str, when: Column) -> DataFrame:
    """count-if, sum-if, min-if and max-if of a field over the instances that meet a condition.

    count-if counts instances whether or not the field is blank; sum-if is 0 and min-if, max-if null without any.
    """
    n = F.when(when, number(df, field))
    return df.groupBy(*keys).agg(F.count_if(when).alias("count_if"), sum_of(n).alias("sum_if"), F.min(n).alias("min_if"), F.max(n).alias("max_if"))


def ranked(df: DataFrame, keys: list[str], index: str, field: str, when: Column | None = None) -> Column:
    """rank-index(-if): 1 for the largest value, ties by instance, ABSENT_RANK where the instance has no rank."""
    n = number(df, field) if when is None else F.when(when, number(df, field))
    w = Window.partitionBy(*keys).orderBy(n.desc_nulls_last(), index)
    return F.when(n.isNotNull(), F.row_number().over(w)).otherwise(ABSENT_RANK)


def indexed(index: Column, wanted: int, v: Column) -> Column:
    """indexed-repeat: the value at one instance, as an aggregate over instances; null if there is none."""
    return F.max(F.when(index == wanted, v))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with instance numbers from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def grid(df: DataFrame, keys: list[str], index: str, fields: list[str], size: int, more: dict[str, Column] | None = None) -> DataFrame:
    """The rectangular wide form: ``field_1 … field_size`` for each key, by one aggregate, then ``more`` aggregates."""
    cells = [indexed(F.col(index), k, F.col(f)).alias(f"{f}_{k}") for k in range(1, size + 1) for f in fields]
    return df.groupBy(*keys).agg(*cells, *(c.alias(n) for n, c in (more or {}).items()))


def largest_count(df: DataFrame, keys: list[str]) -> int:
    """The most instances of any key; 0 without rows."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def from_wide(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, idx, fields): a child table from columns ``field_N``; instances without any value are left out."""
    found: dict[int, dict[str, str]] = {}
    for c in df.columns:
        for f in fields:
            if m := re.fullmatch(re.escape(f) + r"_(\d+)", c):
                found.setdefault(int(m[1]), {})[f] = c
    kinds = {f: next(df.schema[c[f]].dataType for c in found.values() if f in c) for f in fields if any(f in c for c in found.values())}
    rows = [F.struct(F.lit(k).alias("idx"), *((F.col(c[f]) if f in c else F.lit(None)).cast(kinds[f]).alias(f) for f in kinds)) for k, c in sorted(found.items())]
    long = df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")
    return long.filter(F.coalesce(*(F.col(f).cast("string") for f in kinds)).isNotNull())


def scoped(parents: DataFrame, child: DataFrame, keys: list[str], aggregates: dict[str, Column], absent: dict[str, object] | None = None) -> DataFrame:
    """``parents`` with aggregates over each one's instances. ``absent`` gives values where there are none."""
    made = child.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    out = parents.join(made, keys, "left")
    return out.fillna(absent) if absent else out


def _aggregate(node: Call, child: DataFrame, index: str, group: str | None) -> tuple[Column, Callable[[Column], Value]] | None:
    """The aggregate of a call over instances, and how its joined column is a value; None if the call isn't about them."""
    name, args = node.name, node.args
    refs = [a for a in args if isinstance(a, Ref)]
    if name == "count" and refs and refs[0].name == group:
        return F.count("*"), lambda c: num(F.coalesce(c, F.lit(0)).cast("double"))
    field = next((r.name for r in refs if r.name in child.columns), None)
    if field is None:
        return None
    n, shown, idx = number(child, field), as_text(value_of(child, field)), F.col(index)
    when = predicate(args[-1], Scope(child.schema)) if name.endswith("-if") else None
    masked = n if when is None else F.when(when, n)
    zero, blank = lambda c: num(F.coalesce(c.cast("double"), F.lit(0.0))), lambda c: text(F.coalesce(c, F.lit("")))
    if name in ("count", "count-non-empty"):
        return count_of(shown), zero
    if name == "count-if":
        return F.count_if(when), zero
    if name in ("sum", "sum-if"):
        return sum_of(masked), zero
    if name in ("min", "min-if"):
        return F.min(masked), num
    if name in ("max", "max-if"):
        return F.max(masked), num
    if name in ("join", "join-if") and isinstance(args[0], Text):
        return joined(idx, shown if when is None else F.when(when, shown), args[0].value), blank
    if name == "indexed-repeat" and len(args) == 3 and isinstance(args[2], Num):
        return indexed(idx, int(args[2].value), shown), blank
    if name in ("rank-index", "rank-index-if") and isinstance(args[0], Num):
        order = F.transform(F.array_sort(F.collect_list(F.when(masked.isNotNull(), F.struct((-masked).alias("n"), idx.cast("int").alias("i"))))), lambda s: s["i"])
        at = F.array_position(order, int(args[0].value))
        return F.when(at > 0, at), lambda c: num(F.coalesce(c.cast("double"), F.lit(float(ABSENT_RANK))))
    return None


def evaluated(parents: DataFrame, child: DataFrame, keys: list[str], index: str, sources: dict[str, str], group: str | None = None) -> DataFrame:
    """``parents`` with a column for each expression, in which aggregates over ``child`` may stand anywhere.

    All aggregates of all expressions are one grouped pass over the instances and one join; what they are part of is
    then computed on the parent row. Without instances, counts and sums are 0, joins blank, min and max no number.
    """
    found: dict[Call, tuple[Column, Callable[[Column], Value]]] = {}
    for source in sources.values():
        for node in walk(parse(source)):
            if isinstance(node, Call) and node not in found and (made := _aggregate(node, child, index, group)):
                found[node] = made
    if not found:
        scope = Scope(parents.schema)
        return parents.withColumns({k: compiled(s, scope).col for k, s in sources.items()})
    made = child.groupBy(*keys).agg(*(c.alias(f"_agg{k}") for k, (c, _) in enumerate(found.values())))
    df = parents.join(made, keys, "left")
    scope = Scope(df.schema, related={node: as_value(F.col(f"_agg{k}")) for k, (node, (_, as_value)) in enumerate(found.items())})
    return df.withColumns({k: compiled(s, scope).col for k, s in sources.items()}).drop(*(f"_agg{k}" for k in range(len(found))))
