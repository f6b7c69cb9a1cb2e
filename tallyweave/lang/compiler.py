"""Expression trees to Columns. Everything that can fail does so here, before a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import library
from tallyweave.lang.syntax import ORDERINGS, Call, ExpressionError, Minus, Name, Node, Num, Op, Ref, Self, Text, parse
from tallyweave.lang.values import Value, as_bool, as_gate, as_num, as_text, boolean, equal, num, of_column, ordered, text


@dataclass
class Scope:
    """What names mean.

    ``schema`` has the row's columns; ``choices`` the static options of a variable as (value, label) pairs;
    ``lookups`` the joined column of a ``pulldata`` call by its constant arguments; ``this`` the value of ``.``;
    ``fields`` the columns of a candidate choice; ``related`` the columns that repeat aggregates were joined as.
    """

    schema: T.StructType
    choices: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    lookups: dict[Call, Column] = field(default_factory=dict)
    this: Value | None = None
    fields: dict[str, Value] = field(default_factory=dict)
    related: dict[Node, Value] = field(default_factory=dict)
    context: library.Context = field(default_factory=library.Context)

    def variable(self, name: str) -> Value:
        for f in self.schema.fields:
            if f.name == name:
                return of_column(F.col(f"`{name}`"), f.dataType)
        return text("")


def compiled(source: str | Node, scope: Scope) -> Value:
    return _value(parse(source) if isinstance(source, str) else source, scope)


def _value(node: Node, scope: Scope) -> Value:
    if node in scope.related:
        return scope.related[node]
    if isinstance(node, Num):
        return num(node.value)
    if isinstance(node, Text):
        return text(node.value)
    if isinstance(node, Ref):
        return scope.variable(node.name)
    if isinstance(node, Self):
        if scope.this is None:
            raise ExpressionError("'.' has no value here")
        return scope.this
    if isinstance(node, Name):
        return scope.fields.get(node.name, text(""))
    if isinstance(node, Minus):
        return num(-as_num(_value(node.value, scope)))
    if isinstance(node, Op):
        return _operation(node.op, _value(node.left, scope), _value(node.right, scope))
    return _call(node, scope)


def _operation(op: str, a: Value, b: Value) -> Value:
    if op in ("and", "or"):
        return boolean(as_bool(a) & as_bool(b) if op == "and" else as_bool(a) | as_bool(b))
    if op == "=":
        return boolean(equal(a, b))
    if op == "!=":
        return boolean(~equal(a, b))
    if op in ORDERINGS:
        return boolean(ordered(op, a, b))
    x, y = as_num(a), as_num(b)
    if op == "div":
        return num(F.when(y != 0, x / y))
    if op == "mod":
        return num(F.when(y != 0, x % y))
    return num({"+": x + y, "-": x - y, "*": x * y}[op])


def _call(node: Call, scope: Scope) -> Value:
    if node.name == "pulldata":
        if node not in scope.lookups:
            raise ExpressionError("pulldata() needs its table joined first")
        return text(F.coalesce(scope.lookups[node], F.lit("")))
    if node.name in ("min", "max") and len(node.args) == 1 and not isinstance(node.args[0], Ref):
        return num(as_num(_value(node.args[0], scope)))  # a value by itself; of a variable outside repeats it is no number
    if node.name in ("choice-label", "jr:choice-name"):
        if len(node.args) != 2:
            raise ExpressionError(f"{node.name}() takes two arguments")
        who, value = node.args if node.name == "choice-label" else node.args[::-1]
        name = who.name if isinstance(who, Ref) else who.value.strip().removeprefix("${").removesuffix("}") if isinstance(who, Text) else None
        if name is None:
            raise ExpressionError(f"{node.name}() needs a variable")
        options = dict(reversed(scope.choices.get(name, [])))  # of a repeated value the first counts
        if not options:
            return text("")
        entries = F.create_map(*(F.lit(x) for pair in options.items() for x in pair))
        return text(F.coalesce(F.try_element_at(entries, as_text(_value(value, scope))), F.lit("")))
    return library.call(node.name, [_value(a, scope) for a in node.args], scope.context)


def predicate(source: str | Node, scope: Scope) -> Column:
    """Boolean column, never null."""
    return as_bool(compiled(source, scope))


def gate(source: str | Node, scope: Scope) -> Column:
    """Truth of a relevance condition; a blank one is open."""
    if isinstance(source, str) and not source.strip():
        return F.lit(True)
    return as_gate(compiled(source, scope))


def implied(node: Node, scope: Scope) -> list[Column]:
    """Plain comparisons of a column with a constant that must hold wherever the condition does.

    The condition itself guards against nulls and NaN, which no scan understands; these a scan can use to skip data.
    """
    if isinstance(node, Op) and node.op == "and":
        return implied(node.left, scope) + implied(node.right, scope)
    if not isinstance(node, Op) or node.op not in ("=", *ORDERINGS):
        return []
    left, op, right = node.left, node.op, node.right
    if not isinstance(left, Ref):
        left, op, right = right, dict(zip(ORDERINGS, (">", ">=", "<", "<="))).get(op, op), left
    kind = next((f.dataType for f in scope.schema.fields if isinstance(left, Ref) and f.name == left.name), None)
    if isinstance(kind, T.NumericType) and isinstance(right, Num):
        if isinstance(kind, T.IntegralType):
            if right.value != int(right.value):
                return []
            constant = F.lit(int(right.value)).cast(kind)
        else:
            constant = F.lit(right.value).cast(kind) if isinstance(kind, T.DoubleType) else None
    elif isinstance(kind, T.StringType) and isinstance(right, Text) and right.value and op == "=":
        constant = F.lit(right.value)
    else:
        return []
    if constant is None:
        return []
    column = F.col(f"`{left.name}`")
    return [{"=": column == constant, "<": column < constant, "<=": column <= constant, ">": column > constant, ">=": column >= constant}[op]]


def where(df: DataFrame, source: str, scope: Scope | None = None) -> DataFrame:
    """The rows for which a condition's gate is open, with what of it a scan can use given to the scan."""
    scope = scope or Scope(df.schema)
    for plain in implied(parse(source), scope):
        df = df.filter(plain)
    return df.filter(gate(source, scope))


def safely(source: str, scope: Scope, default: Value) -> tuple[Value, str | None]:
    """The compiled value, or the default with what was wrong."""
    try:
        return compiled(source, scope), None
    except ExpressionError as e:
        return default, str(e)


def with_expression(df: DataFrame, name: str, source: str, as_: str = "value", **scope: object) -> DataFrame:
    """``df`` with a column computed by an expression; ``as_`` is value, text, num or bool."""
    v = compiled(source, Scope(df.schema, **scope))
    return df.withColumn(name, {"value": lambda: v.col, "text": lambda: as_text(v), "num": lambda: as_num(v), "bool": lambda: as_bool(v)}[as_]())
