"""Form compilation: the ordered, nested survey sheet to a flat list of question records.

A sheet has as many rows as a form has questions, so this is a fold on the driver; the records then make a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyweave.lang.conditions import Target, condition_text, inherited
from tallyweave.lang.syntax import references

STRUCTURE = tuple(f"{edge} {what}" for what in ("group", "repeat") for edge in ("begin", "end"))
SELECTS = ("select_one", "select_multiple", "rank")
NUMERIC = ("integer", "decimal", "range", "calculate", "calculate_here")
#: Types and name prefixes that are no questions.
SKIPPED_TYPES = ("note", "start", "end", "deviceid", "audit", "text audit", "speed violations count", "phonenumber", "username", "caseid")
SKIPPED_PREFIXES = ("meta_", "sys_")

QUESTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("choice_list", T.StringType()),
        T.StructField("variable_name", T.StringType()),
        T.StructField("question_text", T.StringType()),
        T.StructField("disabled", T.BooleanType()),
        T.StructField("constraint", T.StringType()),
        T.StructField("constraint_text", T.StringType()),
        T.StructField("relevance", T.StringType()),
        T.StructField("group_relevances", T.ArrayType(T.StringType())),
        T.StructField("required", T.BooleanType()),
        T.StructField("calculation", T.StringType()),
        T.StructField("choice_filter", T.StringType()),
        T.StructField("appearance", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("group_path", T.ArrayType(T.StringType())),
        T.StructField("repeat_path", T.ArrayType(T.StringType())),
        T.StructField("repeat", T.StringType()),
        T.StructField("condition_text", T.StringType()),
        T.StructField("question_order", T.IntegerType()),
        T.StructField("repeat_group_name", T.StringType()),
    ]
)


def split_type(source: str) -> tuple[str, str | None]:
    """``select_one yesno or_other`` is ('select_one', 'yesno'); other types have no list."""
    parts = source.strip().split(None, 1)
    if not parts:
        return "", None
    if parts[0] in SELECTS:
        return parts[0], parts[1].split()[0] if len(parts) > 1 else None
    return " ".join(source.split()), None


@dataclass
class Group:
    name: str
    label: str
    relevance: str
    repeat: bool


@dataclass
class Form:
    questions: list[dict] = field(default_factory=list)
    repeats: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    info: dict[str, int] = field(default_factory=dict)
    outline: list[tuple[str, str, int, str]] = field(default_factory=list)  # (kind, name, depth, condition)


def _label(row: dict) -> str:
    for key in ("label", "label:english", "label:English", "label:en"):
        if row.get(key):
            return row[key]
    return next((v for k, v in row.items() if k.startswith("label:") and v), "") or row.get("calculation", "")


def compile_form(sheet: list[dict]) -> Form:
    """Questions in form order. Each repeat is announced by its ``<name>_count`` record, on the level around it.

    Mismatched ends are collected as errors; a stray one is passed over, an open group ends with the sheet.
    """
    form, stack, order = Form(), [], 0
    types = {r.get("name", ""): split_type(r.get("type", ""))[0] for r in sheet}
    counts = dict.fromkeys(("rows", "groups", "repeats", "questions"), 0)
    for line, row in enumerate(sheet, 2):
        row = {k: (v or "").strip() for k, v in row.items()}
        kind, choice_list = split_type(row.get("type", ""))
        kind = kind.replace("_", " ") if kind.replace("_", " ") in STRUCTURE else kind
        name = row.get("name", "")
        counts["rows"] += 1
        if kind in ("begin group", "begin repeat"):
            if kind == "begin repeat":
                counts["repeats"] += 1
                order += 1
                form.questions.append(_record(f"{name}_count", "repeat_count", None, row | {"calculation": row.get("repeat_count", "")}, stack, order, types) | {"repeat_group_name": name})
                form.repeats.append({"name": name, "path": [g.name for g in stack if g.repeat], "count": row.get("repeat_count", "")})
            else:
                counts["groups"] += 1
            form.outline.append((kind.split()[1], name, len(stack), row.get("relevance", "") or row.get("relevant", "")))
            stack.append(Group(name, _label(row), row.get("relevance", "") or row.get("relevant", ""), kind == "begin repeat"))
        elif kind in ("end group", "end repeat"):
            if not stack:
                form.errors.append(f"row {line}: {kind} without a beginning")
            elif stack[-1].repeat != (kind == "end repeat") or name and name != stack[-1].name:
                form.errors.append(f"row {line}: {kind} {name} closes {stack[-1].name}")
                stack.pop()
            else:
                stack.pop()
        elif kind and name and not (kind in SKIPPED_TYPES or name.startswith(SKIPPED_PREFIXES)):
            counts["questions"] += 1
            order += 1
            form.questions.append(_record(name, kind, choice_list, row, stack, order, types))
            form.outline.append((kind, name, len(stack), form.questions[-1]["relevance"]))
    form.errors += [f"{g.name} is never closed" for g in stack]
    form.info = counts
    return form


def _record(name: str, kind: str, choice_list: str | None, row: dict, stack: list[Group], order: int, types: dict[str, str]) -> dict:
    own = row.get("relevance", "") or row.get("relevant", "")
    groups = [g.relevance for g in stack if g.relevance]
    repeats = [g.name for g in stack if g.repeat]
    constraint = row.get("constraint", "")
    return {
        "type": kind,
        "choice_list": choice_list,
        "variable_name": name,
        "question_text": _label(row),
        "disabled": own == "0" or "0" in groups,
        "constraint": constraint,
        "constraint_text": condition_text(constraint, Target(types, this=name)),
        "relevance": own,
        "group_relevances": groups,
        "required": row.get("required", "").lower() in ("yes", "true", "true()", "1"),
        "calculation": row.get("calculation", ""),
        "choice_filter": row.get("choice_filter", ""),
        "appearance": row.get("appearance", ""),
        "references": references(own, constraint, row.get("calculation"), row.get("choice_filter")),
        "group_path": [g.name for g in stack],
        "repeat_path": repeats,
        "repeat": repeats[-1] if repeats else None,
        "condition_text": inherited(groups, own, Target(types)),
        "question_order": order,
        "repeat_group_name": None,
    }


def questions_frame(spark: SparkSession, form: Form) -> DataFrame:
    return spark.createDataFrame([tuple(q[f.name] for f in QUESTION.fields) for q in form.questions], QUESTION)


def repeats_frame(spark: SparkSession, form: Form) -> DataFrame:
    return spark.createDataFrame([(r["name"], r["path"], r["count"]) for r in form.repeats], "name string, path array<string>, count string")


def structure_text(form: Form) -> str:
    """An indented outline: groups and repeats with their conditions, empty ones too, questions under them."""
    lines = []
    for kind, name, depth, condition in form.outline:
        shown = f" if {condition}" if condition else ""
        lines.append("  " * depth + (f"[{kind}] {name}{shown}" if kind in ("group", "repeat") else f"- {name} ({kind}){shown}"))
    return "\n".join(lines) + "\n"


def shown_choices(options: list[tuple[str, str]], most: int = 500) -> str:
    """Choices of a dictionary sheet, cut at ``most`` characters."""
    return " | ".join(f"{v}={t}" for v, t in options)[:most]
