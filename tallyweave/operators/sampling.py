"""What a constraint allows, and values drawn within it.

Draws are hashes of (seed, variable, row): the same in every run, whatever the partitioning, and independent of the
draws of other variables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.lang.syntax import COMPARISONS, Call, ExpressionError, Minus, Node, Num, Op, Self, Text, parse, walk

_TURNED = dict(zip(COMPARISONS, "= != > >= < <=".split()))


def _constant(node: Node) -> float | None:
    if isinstance(node, Num):
        return node.value
    if isinstance(node, Minus) and isinstance(node.value, Num):
        return -node.value.value
    return None


def _clauses(node: Node) -> list[Node]:
    return _clauses(node.left) + _clauses(node.right) if isinstance(node, Op) and node.op == "and" else [node]


def _comparison(clause: Node, subject: object) -> tuple[str, float] | None:
    """(operator, constant) of a clause about ``subject``, whichever side it stands on."""
    if not isinstance(clause, Op) or clause.op not in _TURNED:
        return None
    if clause.left == subject and (c := _constant(clause.right)) is not None:
        return clause.op, c
    if clause.right == subject and (c := _constant(clause.left)) is not None:
        return _TURNED[clause.op], c
    return None


def _tree(constraint: str) -> Node | None:
    try:
        return parse(constraint) if constraint.strip() else None
    except ExpressionError:
        return None


Range = tuple[float | None, float | None]


def _bounds(constraint: str, subject: object) -> Range:
    tree = _tree(constraint)
    if tree is None or isinstance(tree, Op) and tree.op == "or" or any(isinstance(n, Call) and n.name == "if" for n in walk(tree)):
        return None, None
    low, high = None, None
    for clause in _clauses(tree):
        found = _comparison(clause, subject)
        if not found:
            continue
        op, c = found
        if op in (">", ">=", "="):
            c_low = c + 1 if op == ">" else c
            low = c_low if low is None else max(low, c_low)
        if op in ("<", "<=", "="):
            c_high = c - 1 if op == "<" else c
            high = c_high if high is None else min(high, c_high)
    return low, high


def numeric_bounds(constraint: str) -> Range:
    """Least and greatest value by the clauses about ``.``; a strict bound moves by 1; with ``or`` or ``if`` unknown."""
    return _bounds(constraint, Self())


def select_count_bounds(constraint: str) -> Range:
    """How many options may be chosen, by the clauses about count-selected(.)."""
    return _bounds(constraint, Call("count-selected", (Self(),)))


def text_max_length(constraint: str) -> int | None:
    """The first ``<= N`` or ``= N`` of the constraint."""
    tree = _tree(constraint)
    for n in walk(tree) if tree is not None else ():
        if isinstance(n, Op) and n.op in ("<=", "=") and (c := _constant(n.right)) is not None:
            return int(c)
    return None


def exclusive_codes(constraint: str) -> list[str]:
    """Codes that must stand alone: from ``if(selected(., X), count-selected(.) = 1, …)`` and ``not(selected(., X) and count-selected(.) > 1)``."""
    tree = _tree(constraint)
    out = []
    for n in walk(tree) if tree is not None else ():
        if not isinstance(n, Call) or n.name not in ("if", "not") or not n.args:
            continue
        alone = any(isinstance(x, Op) and _comparison(x, Call("count-selected", (Self(),))) in (("=", 1.0), (">", 1.0), ("<=", 1.0)) for x in walk(n))
        for c in walk(n.args[0]):
            if alone and isinstance(c, Call) and c.name == "selected" and len(c.args) == 2 and c.args[0] == Self() and isinstance(c.args[1], (Text, Num)):
                out.append(c.args[1].value if isinstance(c.args[1], Text) else f"{c.args[1].value:g}")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Draw:
    """A stream of draws for one variable."""

    seed: int
    stream: str
    row: Column

    def uniform(self, salt: object = 0) -> Column:
        """In [0, 1)."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.stream), F.lit(str(salt)), self.row), F.lit(1 << 53)) / F.lit(float(1 << 53))

    def integer(self, low: int, high: int, salt: object = 0) -> Column:
        """From low to high, both included."""
        return (F.floor(self.uniform(salt) * (high - low + 1)) + low).cast("long")

    def decimal(self, low: float, high: float) -> Column:
        return F.round(self.uniform() * (high - low) + low, 4)

    def one_of(self, codes: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, codes)), self.integer(0, len(codes) - 1).cast("int"))

    def several(self, codes: list[str], low: int, high: int, alone: list[str] = ()) -> Column:  # type: ignore[assignment]
        """Space-joined codes without replacement, in list order; a code of ``alone`` comes by itself."""
        free = [c for c in codes if c not in alone] or list(codes)
        n = self.integer(min(low, len(free)), min(high, len(free)), "n")
        shuffled = F.array_sort(F.array(*(F.struct(self.uniform(f"c{k}").alias("u"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(free))))
        taken = F.array_sort(F.transform(F.slice(shuffled, F.lit(1), n.cast("int")), lambda s: F.struct(s["k"].alias("k"), s["c"].alias("c"))))
        many = F.array_join(F.transform(taken, lambda s: s["c"]), " ")
        return F.when(self.uniform("alone") < 0.1, self.one_of(list(alone))).otherwise(many) if alone else many

    def word(self, most: int) -> Column:
        return F.substring(F.sha2(F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.stream), self.row.cast("string")), 256), 1, max(1, min(most, 12)))

    def day(self, last: str, span: int = 365) -> Column:
        return F.date_sub(F.lit(last).cast("date"), self.integer(0, span - 1).cast("int"))

    def clock(self) -> Column:
        s = self.integer(0, 86_399)
        return F.format_string("%02d:%02d:%02d.000+00:00", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int"))

    def point(self, box: tuple[float, float, float, float] = (-1.5, 36.5, -1.0, 37.0)) -> Column:
        south, west, north, east = box
        lat, lon = F.round(self.uniform("lat") * (north - south) + south, 6), F.round(self.uniform("lon") * (east - west) + west, 6)
        return F.concat_ws(" ", lat.cast("string"), lon.cast("string"), F.lit("0"), F.lit("5"))


def sampled(draw: Draw, kind: str, constraint: str = "", codes: list[str] = (), today: str = "2026-01-01") -> Column:  # type: ignore[assignment]
    """A value of a question type within its constraint."""
    low, high = numeric_bounds(constraint)
    if kind == "integer":
        a = int(low if low is not None else min(0, high if high is not None else 0))
        return draw.integer(a, int(high if high is not None else max(100, a)))
    if kind == "decimal":
        a = float(low if low is not None else 0)
        return draw.decimal(a, float(high if high is not None else max(100.0, a)))
    if kind == "select_one":
        return draw.one_of(list(codes)) if codes else F.lit(None).cast("string")
    if kind == "select_multiple":
        a, b = select_count_bounds(constraint)
        return draw.several(list(codes), int(a or 1), int(b or len(codes)), exclusive_codes(constraint)) if codes else F.lit(None).cast("string")
    if kind == "date":
        return draw.day(today)
    if kind == "datetime":
        return draw.day(today).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), draw.integer(0, 86_399, "s").cast("decimal(18,6)"))
    if kind == "time":
        return draw.clock()
    if kind == "geopoint":
        return draw.point()
    return draw.word(text_max_length(constraint) or 12)
