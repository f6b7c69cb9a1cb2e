"""Choice lists and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.lang.compiler import Scope, predicate
from tallyweave.lang.syntax import COMPARISONS, Call, ExpressionError, Minus, Name, Num, Op, Text, parse, references
from tallyweave.lang.values import of_column

CHOICE = T.StructType([T.StructField("value", T.StringType()), T.StructField("label", T.StringType())])
_STATIC_OPS = ("and", "or", *COMPARISONS)


def choice_lists(choices: DataFrame, order: str = "ord") -> DataFrame:
    """(list_name, choices): each list's options in sheet order, with their filter columns.

    Columns with a ``:`` (translations), ``Unnamed`` ones and the order are no filter columns.
    """
    extra = [c for c in choices.columns if c not in ("list_name", "value", "label", order) and ":" not in c and not c.startswith("Unnamed")]
    fields = [F.col(order), F.col("value"), F.col("label"), *(F.col(f"`{c}`").alias(c) for c in extra)]
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return choices.groupBy("list_name").agg(F.transform(rows, lambda r: F.struct(r["value"].alias("value"), r["label"].alias("label"), *(r[c].alias(c) for c in extra))).alias("choices"))


def is_static(source: str) -> bool:
    """Whether a filter names no variable and uses only what can be settled without data."""
    if not source.strip() or references(source):
        return False
    try:
        return all(_simple(n) for n in _nodes(source))
    except ExpressionError:
        return False


def _nodes(source: str) -> list:
    from tallyweave.lang.syntax import walk

    return list(walk(parse(source)))


def _simple(n: object) -> bool:
    return isinstance(n, (Name, Text, Num, Minus)) or isinstance(n, Op) and n.op in _STATIC_OPS or isinstance(n, Call) and n.name in ("selected", "not")


def filtered(choices: Column, element: T.StructType, source: str, scope: Scope, fallback: bool) -> Column:
    """The choices that pass; bare names are a candidate's fields, ``${}`` the row's columns.

    ``fallback`` gives the whole list where none passes. A filter that can't be compiled keeps the list.
    """
    if not source.strip():
        return choices

    def passes(c: Column) -> Column:
        inner = Scope(scope.schema, scope.choices, scope.lookups, scope.this, {f.name: of_column(c[f.name], f.dataType) for f in element.fields}, scope.related, scope.context)
        return predicate(source, inner)

    try:
        kept = F.filter(choices, passes)
    except ExpressionError:
        return choices
    return F.when(F.size(kept) > 0, kept).otherwise(choices) if fallback else kept


def missing_lists(workbook: DataFrame, external: DataFrame) -> DataFrame:
    """Workbook choices and, of the external ones, the lists that the workbook lacks."""
    more = external.join(workbook.select("list_name").distinct(), "list_name", "left_anti")
    return workbook.unionByName(more, allowMissingColumns=True)


def indicators(answer: Column, codes: list[str], name: str) -> dict[str, Column]:
    """0/1 columns of a multiple answer; a negative code has a double underscore; a blank answer has none."""
    tokens = F.filter(F.split(F.trim(F.coalesce(answer, F.lit(""))), r"\s+"), lambda t: t != "")
    return {f"{name}_{c.replace('-', '_')}": F.when(F.size(tokens) > 0, F.array_contains(tokens, c).cast("int")) for c in codes}
