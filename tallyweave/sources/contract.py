"""The compiled form: nodes of an XForm document, and which node an export column belongs to."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSTEM = ("KEY", "PARENT_KEY", "SubmissionDate", "CompletionDate", "formdef_version", "instanceID", "instanceName", "review_status", "starttime", "endtime")
SYSTEM_PREFIXES, SYSTEM_SUFFIXES = ("meta-", "SET-OF-"), ("-Comment",)


@dataclass
class Node:
    path: str
    name: str
    repeats: list[str] = field(default_factory=list)
    is_repeat: bool = False
    kind: str = ""
    control: str = ""
    relevance: str = ""
    constraint: str = ""
    calculation: str = ""
    required: bool = False
    choices: list[str] = field(default_factory=list)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_contract(xml: str) -> list[Node]:
    """Nodes of the instance and of the binds, with their controls, by path."""
    root = ElementTree.fromstring(xml)
    model = next(e for e in root.iter() if _local(e.tag) == "model")
    instance = next((e for e in model if _local(e.tag) == "instance"), None)
    nodes: dict[str, Node] = {}

    def visit(e: ElementTree.Element, path: str, repeats: list[str]) -> None:
        name = _local(e.tag)
        here = f"{path}/{name}"
        repeat = any(_local(k) == "template" for k in e.attrib)
        if here not in nodes or repeat:
            nodes[here] = Node(here, name, list(repeats), repeat)
        for c in e:
            visit(c, here, [*repeats, name] if repeat else repeats)

    for top in instance if instance is not None else ():
        visit(top, "", [])
    for e in root.iter():
        if _local(e.tag) == "repeat" and (at := e.get("nodeset")) in nodes:
            nodes[at].is_repeat = True
    loops = [p for p, n in nodes.items() if n.is_repeat]
    for n in nodes.values():
        n.repeats = [nodes[p].name for p in sorted(loops, key=len) if n.path.startswith(p + "/")]
    for b in model:
        if _local(b.tag) != "bind":
            continue
        at = b.get("nodeset", "")
        n = nodes.setdefault(at, Node(at, at.rpartition("/")[2]))
        n.kind = b.get("type", "").rpartition(":")[2]
        n.relevance, n.constraint, n.calculation = b.get("relevant", ""), b.get("constraint", ""), b.get("calculate", "")
        n.required = b.get("required", "").startswith("true")
    for e in root.iter():
        at = e.get("ref") or e.get("nodeset")
        if _local(e.tag) in ("input", "select", "select1", "upload", "trigger", "range") and at in nodes:
            nodes[at].control = _local(e.tag)
            nodes[at].choices = [v.text or "" for i in e if _local(i.tag) == "item" for v in i if _local(v.tag) == "value"]
    return [nodes[p] for p in sorted(nodes)]


def nodes_frame(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(n).values()) for n in nodes], "path string, name string, repeats array<string>, is_repeat boolean, kind string, control string, relevance string, constraint string, calculation string, required boolean, choices array<string>")


def is_system(column: str) -> bool:
    return column in SYSTEM or column.startswith(SYSTEM_PREFIXES) or column.endswith(SYSTEM_SUFFIXES)


def map_column(column: str, nodes: list[Node]) -> dict:
    """status (system, matched, unmapped), path, choice_code, iterations, ragged, ambiguous of an export column.

    ``_N`` parts are peeled from the right until a name fits; what was peeled is, from the left, a choice code of a
    multiple answer, then iterations. Fewer iterations than repeats around the node are ragged.
    """
    out = {"column_name": column, "status": "unmapped", "path": None, "choice_code": None, "iterations": [], "ragged": False, "ambiguous": False}
    if is_system(column):
        return out | {"status": "system"}
    by_name: dict[str, list[Node]] = {}
    for n in nodes:
        by_name.setdefault(n.name, []).append(n)
    base, peeled = column, []
    while True:
        fits = [n for n in by_name.get(base, ()) if _fits(n, peeled)]
        if fits:
            fits.sort(key=lambda n: n.path)
            n, rest = fits[0], list(peeled)
            code = None
            if n.control == "select" and rest and (len(rest) > len(n.repeats) or rest[0] in n.choices and len(rest) >= len(n.repeats) + 1 or not n.repeats):
                code = rest.pop(0)
            return out | {"status": "matched", "path": n.path, "choice_code": code, "iterations": [int(x) for x in rest], "ragged": len(rest) != len(n.repeats), "ambiguous": len(fits) > 1}
        m = re.match(r"^(.+?)(__?)(\d+)$", base)
        if not m:
            return out
        m = re.match(r"^(.*[^_])(__?)(\d+)$", base)
        if not m:
            return out
        base, peeled = m[1], [("-" if m[2] == "__" else "") + m[3], *peeled]


def _fits(n: Node, peeled: list[str]) -> bool:
    if not peeled:
        return True
    negatives = [p for p in peeled if p.startswith("-")]
    if n.control == "select":
        return len(peeled) <= len(n.repeats) + 1 and negatives in ([], [peeled[0]])
    return not negatives and len(peeled) <= len(n.repeats) and all(p[:1] != "0" for p in peeled)


def overlay(dictionary: DataFrame, mapped: DataFrame) -> DataFrame:
    """A dictionary (column_name, question) with the contract's say: where the contract knows a node, it wins.

    outcome is ``system``, ``matched`` or ``legacy`` (only the dictionary knew it); ``overridden`` tells that they differed.
    """
    m = mapped.select("column_name", "status", F.element_at(F.split("path", "/"), -1).alias("node"), "path")
    j = dictionary.join(m, "column_name", "left")
    outcome = F.when(F.col("status").isin("system", "matched"), F.col("status")).otherwise("legacy")
    return j.select("column_name", F.coalesce("node", "question").alias("question"), "path", outcome.alias("outcome"), F.coalesce((F.col("node") != F.col("question")), F.lit(False)).alias("overridden"))
