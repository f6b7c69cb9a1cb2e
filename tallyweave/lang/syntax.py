"""Form expressions: text to tokens to a tree.

Precedence from loose to tight: or; and; = !=; < <= > >=; + -; * div mod; unary minus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


class ExpressionError(ValueError):
    """An expression that can't be read or compiled."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Ref:
    """``${name}``"""

    name: str


@dataclass(frozen=True)
class Self:
    """``.``, the value a constraint is about"""


@dataclass(frozen=True)
class Name:
    """A bare identifier: a column of the candidate choice"""

    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    value: object


Node = Num | Text | Ref | Self | Name | Call | Op | Minus

_LEX = re.compile(
    r"""(?P<space>\s+)
      | \$\{(?P<ref>[^}]+)\}
      | (?P<text>'[^']*'|"[^"]*")
      | (?P<num>\d+(?:\.\d*)?|\.\d+)
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[-:](?=[A-Za-z_])[A-Za-z0-9_]+)*)
      | (?P<op><=|>=|!=|[=<>+\-*(),.])""",
    re.X,
)
_WORDS = ("and", "or", "div", "mod")
ORDERINGS = tuple("< <= > >=".split())
COMPARISONS = (*"= !=".split(), *ORDERINGS)
_LEVELS = (("or",), ("and",), COMPARISONS[:2], ORDERINGS, ("+", "-"), ("*", "div", "mod"))


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, value) pairs; kinds are ref, text, num, name, op."""
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected {source[at]!r} at {at} in {source!r}")
        at, kind, value = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "space":
            continue
        if kind == "text":
            value = value[1:-1]
        elif kind == "ref":
            value = value.strip()
        elif kind == "name" and value in _WORDS:
            kind = "op"
        out.append((kind, value))
    return out


class _Reader:
    def __init__(self, source: str) -> None:
        self.source, self.items, self.at = source, tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if op is not None and item != ("op", op):
            raise ExpressionError(f"expected {op!r}, found {item[1]!r} in {self.source!r}")
        self.at += 1
        return item

    def level(self, k: int) -> Node:
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[k]:
            op = self.take()[1]
            left = Op(op, left, self.level(k + 1))
        return left

    def unary(self) -> Node:
        if self.peek() == ("op", "-"):
            self.take()
            return Minus(self.unary())
        return self.atom()

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "num":
            return Num(float(value))
        if kind == "text":
            return Text(value)
        if kind == "ref":
            return Ref(value)
        if kind == "op" and value == ".":
            return Self()
        if kind == "op" and value == "(":
            inner = self.level(0)
            self.take(")")
            return inner
        if kind == "name":
            if self.peek() != ("op", "("):
                return Name(value)
            self.take()
            args: list[Node] = []
            while self.peek() != ("op", ")"):
                args.append(self.level(0))
                if self.peek() == ("op", ","):
                    self.take()
                elif self.peek() != ("op", ")"):
                    raise ExpressionError(f"expected ',' or ')' in {self.source!r}")
            self.take()
            return Call(value, tuple(args))
        raise ExpressionError(f"unexpected {value or 'end'!r} in {self.source!r}")


@lru_cache(maxsize=4096)
def parse(source: str) -> Node:
    """The tree of an expression; a blank one is the empty text."""
    if not source.strip():
        return Text("")
    reader = _Reader(source)
    tree = reader.level(0)
    if reader.peek()[0] != "end":
        raise ExpressionError(f"left over {reader.peek()[1]!r} in {source!r}")
    return tree


def references(*sources: str | None) -> list[str]:
    """The names in ``${}`` over several expressions, each once, in order."""
    return list(dict.fromkeys(name.strip() for s in sources if s for name in re.findall("[$][{]([^{}]+)[}]", s)))


def children(node: Node) -> tuple:
    if isinstance(node, Op):
        return (node.left, node.right)
    if isinstance(node, Minus):
        return (node.value,)
    return node.args if isinstance(node, Call) else ()


def walk(node: Node):  # noqa: ANN201
    yield node
    for child in children(node):
        yield from walk(child)
