"""Expression trees as condition text of a statistics package, the second printer beside the Column one.

Parts that the package can't say are dropped by three-valued rules: a conjunction or disjunction keeps the side that is
left, anything else around an unknown part is unknown, and an unknown is never negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tallyweave.lang.syntax import COMPARISONS, Call, ExpressionError, Minus, Node, Num, Op, Ref, Self, Text, parse

NUMERIC_CODE = re.compile(r"-?[0-9]+(?:[.][0-9]+)?\Z")


@dataclass
class Target:
    """What the printer knows: types of variables, the name of ``.``, and an iteration to suffix repeated ones with."""

    types: dict[str, str] = field(default_factory=dict)
    this: str | None = None
    iteration: int | None = None
    repeated: frozenset[str] = frozenset()
    dropped: list[str] = field(default_factory=list)

    def name(self, ref: str) -> str:
        if self.iteration is not None and ref in self.repeated and self.types.get(ref) != "select_multiple":
            return f"{ref}_{self.iteration}"
        return ref

    def drop(self, why: str) -> None:
        self.dropped.append(why)


def code_suffix(code: str) -> str:
    """``-99`` is ``_99`` in a name, so ``x`` and ``-99`` give ``x__99``."""
    return code.replace("-", "_")


def condition_text(source: str, target: Target | None = None) -> str | None:
    """The condition, or None where it is blank, always false, or nothing of it can be said."""
    t = target if target is not None else Target()
    if not source.strip() or source.strip() == "0":
        return None
    try:
        out = _bool(parse(source), t)
    except ExpressionError as e:
        t.drop(f"unreadable: {e}")
        return None
    return _guarded(out) if out is not None else None


def inherited(groups: list[str], own: str, target: Target | None = None) -> str | None:
    """Group conditions and the own one, joined."""
    parts = [p for p in (condition_text(s, target) for s in [*groups, own]) if p]
    return " & ".join(f"({p})" if "|" in p and len(parts) > 1 else p for p in parts) or None


def _guarded(text: str) -> str:
    """The first ``var op number`` of each variable that isn't an equality also asks that it be there: a missing value counts as the largest number."""
    seen: list[str] = []
    for m in re.finditer(r"(?<![\w\"(])([A-Za-z_]\w*) (>=|>) -?[\d.]+", text):
        if m[1] not in seen:
            seen.append(m[1])
            old = m[0]
            text = text.replace(old, f"{old} & !missing({m[1]})", 1)
    return text


def _quoted(s: str) -> str:
    return f'"{s}"'


def _is_text(node: Node) -> bool:
    return isinstance(node, Text)


def _bool(n: Node, t: Target) -> str | None:
    if isinstance(n, Op) and n.op in ("and", "or"):
        sides = [(_bool(s, t), s) for s in (n.left, n.right)]
        kept = [(p, s) for p, s in sides if p is not None]
        if len(kept) < 2:
            return kept[0][0] if kept else None
        mark = "&" if n.op == "and" else "|"
        return f" {mark} ".join(f"({p})" if isinstance(s, Op) and s.op in ("and", "or") and s.op != n.op else p for p, s in kept)
    if isinstance(n, Op) and n.op in COMPARISONS:
        return _compare(n, t)
    if isinstance(n, Call):
        return _call_bool(n, t)
    out = _value(n, t)
    return None if out is None else f"{out} != 0"


def _compare(n: Op, t: Target) -> str | None:
    op = {"=": "=="}.get(n.op, n.op)
    left, right = n.left, n.right
    if _is_text(left) and not _is_text(right):
        left, right = right, left
        op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    if isinstance(right, Text) and isinstance(left, (Ref, Self)):
        name = _value(left, t)
        if name is None:
            return None
        if right.value == "":
            return {"==": f"missing({name})", "!=": f"!missing({name})"}.get(op)
        kind = t.types.get(left.name if isinstance(left, Ref) else t.this or "", "")
        if kind == "select_multiple" and op in ("==", "!="):
            return f"{name}_{code_suffix(right.value)} {op} 1"
        if NUMERIC_CODE.match(right.value) and kind not in ("text", "string"):
            return f"{name} {op} {right.value}"
        return f"{name} {op} {_quoted(right.value)}"
    a, b = _value(left, t), _value(right, t)
    return None if a is None or b is None else f"{a} {op} {b}"


def _call_bool(n: Call, t: Target) -> str | None:
    name, args = n.name, n.args
    if name == "not" and len(args) == 1:
        before = len(t.dropped)
        inner = _bool(args[0], t)
        if inner is None or len(t.dropped) > before:  # part of it is unknown, so its negation is
            t.drop("not() around a part that was dropped")
            return None
        return f"!({inner})"
    if name in ("true", "false"):
        return "1" if name == "true" else "0"
    if name == "empty" and len(args) == 1:
        v = _value(args[0], t)
        return None if v is None else f"missing({v})"
    if name == "relevant" and len(args) == 1:
        v = _value(args[0], t)
        return None if v is None else f"!missing({v})"
    if name == "selected" and len(args) == 2:
        return _selected(args, t)
    texts = {"contains": lambda a, b: f"strpos({a}, {b}) > 0", "starts-with": lambda a, b: f"substr({a}, 1, strlen({b})) == {b}", "ends-with": lambda a, b: f"substr({a}, -strlen({b}), .) == {b}", "regex": lambda a, b: f"regexm({a}, {b})"}
    if name in texts and len(args) == 2:
        a, b = _value(args[0], t), _value(args[1], t)
        return None if a is None or b is None else texts[name](a, b)
    v = _value(n, t)
    return None if v is None else f"{v} != 0"


def _selected(args: tuple, t: Target) -> str | None:
    who, what = args
    if not isinstance(who, (Ref, Self)):
        t.drop("selected() of a computed list")
        return None
    name = _value(who, t)
    if isinstance(what, (Text, Num)) and name is not None:
        code = what.value if isinstance(what, Text) else f"{what.value:g}"
        kind = t.types.get(who.name if isinstance(who, Ref) else t.this or "", "select_multiple")
        if kind == "select_multiple":
            return f"{name}_{code_suffix(code)} == 1"
        return f"{name} == {code if NUMERIC_CODE.match(code) else _quoted(code)}"
    t.drop("selected() with a computed code")
    return None


_UNARY = {"string-length": "strlen", "lower": "strlower", "upper": "strupper", "int": "int", "abs": "abs", "round": "round", "sqrt": "sqrt", "exp": "exp", "log": "ln", "log10": "log10"}


def _value(n: Node, t: Target) -> str | None:
    if isinstance(n, Num):
        return f"{n.value:g}"
    if isinstance(n, Text):
        return n.value if NUMERIC_CODE.match(n.value) else _quoted(n.value)
    if isinstance(n, Ref):
        return t.name(n.name)
    if isinstance(n, Self):
        if t.this is None:
            t.drop("'.' without a variable")
        return t.this
    if isinstance(n, Minus):
        v = _value(n.value, t)
        return None if v is None else f"-{v}"
    if isinstance(n, Op):
        if n.op in ("and", "or") or n.op in COMPARISONS:
            v = _bool(n, t)
            return None if v is None else f"({v})"
        a, b = _value(n.left, t), _value(n.right, t)
        if a is None or b is None:
            return None
        if n.op == "mod":
            return f"mod({a}, {b})"
        wrap = lambda s, node: f"({s})" if isinstance(node, Op) and node.op in ("+", "-") and n.op in ("*", "div") else s
        return f"{wrap(a, n.left)} {'/' if n.op == 'div' else n.op} {wrap(b, n.right)}"
    if isinstance(n, Call):
        return _call_value(n, t)
    t.drop(f"{type(n).__name__} has no text")
    return None


def _call_value(n: Call, t: Target) -> str | None:
    values = lambda: [_value(a, t) for a in n.args]
    if n.name in ("number", "string", "once") and len(n.args) == 1:
        return _value(n.args[0], t)
    if n.name in _UNARY and len(n.args) == 1:
        v = _value(n.args[0], t)
        return None if v is None else f"{_UNARY[n.name]}({v})"
    if n.name == "if" and len(n.args) == 3:
        c, (a, b) = _bool(n.args[0], t), values()[1:]
        return None if None in (c, a, b) else f"cond({c}, {a}, {b})"
    if n.name == "coalesce" and len(n.args) >= 2:
        v = values()
        if None in v:
            return None
        out = v[-1]
        for x in reversed(v[:-1]):
            out = f"cond(!missing({x}), {x}, {out})"
        return out
    if n.name == "substr" and len(n.args) in (2, 3) and all(isinstance(a, Num) for a in n.args[1:]):
        s, a = _value(n.args[0], t), int(n.args[1].value)
        size = "." if len(n.args) == 2 else str(int(n.args[2].value) - a)
        return None if s is None else f"substr({s}, {a + 1}, {size})"
    if n.name == "count-selected" and len(n.args) == 1 and isinstance(n.args[0], (Ref, Self)):
        return f"rowtotal({_value(n.args[0], t)}_*)"
    if n.name == "indexed-repeat" and len(n.args) == 3 and isinstance(n.args[0], Ref) and isinstance(n.args[2], Num) and n.args[2].value >= 0:
        return f"{n.args[0].name}_{int(n.args[2].value)}"
    if n.name in ("index", "position") and t.iteration is not None:
        return str(t.iteration)
    if n.name in ("selected", "contains", "regex", "starts-with", "ends-with", "not", "empty", "relevant"):
        v = _bool(n, t)
        return None if v is None else f"({v})"
    t.drop(f"{n.name}() has no text")
    return None


def structural_issues(text: str) -> list[str]:
    """What is wrong with a condition text, by its look."""
    bare = re.sub(r'"[^"]*"', '""', text)
    checks = {
        "reference left": "${" in bare,
        "single quote": "'" in bare,
        "stray comma": bool(re.search(r",\s*[,)]|\(\s*,", bare)),
        "parentheses": bare.count("(") != bare.count(")"),
        "dangling operator": bool(re.search(r"(^|\()\s*[&|]|[&|]\s*($|\))|!\s*($|\)|[&|])", bare)),
        "function left": bool(re.search(r"\b(selected|pulldata|jr:choice-name|count-selected|once)\s*\(", bare)),
    }
    return [k for k, bad in checks.items() if bad]


def kept_clauses(text: str, columns: set[str], texts: set[str]) -> str | None:
    """The top-level ``&`` clauses whose variables exist and aren't compared as text; for statistics over an export."""
    out = []
    for clause in _top_level(text):
        names = set(re.findall(r"(?<![\w\"])([A-Za-z_]\w*)(?!\w|\()", re.sub(r'"[^"]*"', "", clause)))
        if names <= columns and not names & texts and clause.strip() not in ("0", "(0)") and not structural_issues(clause):
            out.append(clause.strip())
    return " & ".join(out) or None


def _top_level(text: str) -> list[str]:
    parts, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "&" and depth == 0:
                parts.append(text[at:k])
                at = k + 1
    return [*parts, text[at:]]
