"""Form workbooks: XLSX without a spreadsheet library, or one CSV per sheet; all cells are text."""

from __future__ import annotations

import csv
import json
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(row: ElementTree.Element, shared: list[str]) -> dict[int, str]:
    out = {}
    for c in row.findall("m:c", _NS):
        letters = re.match(r"[A-Z]+", c.get("r", "A1"))[0]
        at = 0
        for x in letters:
            at = at * 26 + ord(x) - 64
        value = c.find("m:v", _NS)
        if c.get("t") == "s" and value is not None:
            text = shared[int(value.text)]
        elif c.get("t") == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        else:
            text = value.text or "" if value is not None else ""
            text = text.removesuffix(".0") if re.fullmatch(r"-?\d+\.0", text) else text
        out[at] = text.strip()
    return out


def read_xlsx(path: str) -> dict[str, list[dict]]:
    """Each sheet's rows as dicts by its first row; blank rows are left out, blanks are ''."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
            rows = [_cells(r, shared) for r in ElementTree.fromstring(z.read("xl/" + targets[s.get(_REL)])).iter(f"{{{_NS['m']}}}row")]
            head = rows[0] if rows else {}
            out[s.get("name")] = [{name: r.get(k, "") for k, name in head.items() if name} for r in rows[1:] if any(r.values())]
    return out


def write_xlsx(path: str, sheets: dict[str, tuple[list[str], Iterable[Iterable[object]]]]) -> None:
    """Sheets of (columns, rows) with text cells."""

    def name(k: int) -> str:
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def body(columns: list[str], rows: Iterable[Iterable[object]]) -> str:
        lines = []
        for n, row in enumerate([columns, *rows], 1):
            cells = "".join(f'<c r="{name(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(row, 1) if v is not None and v != "")
            lines.append(f'<row r="{n}">{cells}</row>')
        return f'<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'

    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (columns, rows) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", body(columns, rows))


def read_sheets(path: str) -> dict[str, list[dict]]:
    """The survey, choices and settings of a workbook file, or of a folder with a CSV for each."""
    p = Path(path)
    if p.is_file():
        return read_xlsx(path)
    out = {}
    for name in ("survey", "choices", "settings"):
        if (f := p / f"{name}.csv").exists():
            with f.open(newline="", encoding="utf-8-sig", errors="replace") as h:
                out[name] = [{k: (v or "").strip() for k, v in r.items() if k} for r in csv.DictReader(h)]
    return out


def settings(sheets: dict[str, list[dict]]) -> dict[str, str]:
    """form_id and version of the first settings row."""
    row = (sheets.get("settings") or [{}])[0]
    return {k: row.get(k, "") for k in ("form_id", "version")}


def choices_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Choice rows with their order, blanks kept; rows without a list are left out."""
    rows = [r for r in rows if r.get("list_name")]
    names = list(dict.fromkeys(k for r in rows for k in r)) or ["list_name", "value", "label"]
    data = [(*(r.get(n, "") for n in names), k) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) + ", ord int")


def external_choices(wide: DataFrame) -> DataFrame:
    """(list_name, value, label) from pairs of columns such as town_value or town_id, and town_label; null values are left out."""
    pairs = []
    for c in wide.columns:
        if (m := re.fullmatch(r"(.+)_(value|key|id)", c)) and f"{m[1]}_label" in wide.columns:
            pairs.append(F.struct(F.lit(m[1]).alias("list_name"), F.col(f"`{c}`").cast("string").alias("value"), F.col(f"`{m[1]}_label`").cast("string").alias("label")))
    if not pairs:
        return wide.sparkSession.createDataFrame([], "list_name string, value string, label string")
    rows = wide.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct()


def normalised(df: DataFrame) -> DataFrame:
    """All columns as text, null as '', outer white space and line breaks gone."""
    return df.select(*(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"^\s+|\s+$", "").alias(c) for c in df.columns))


def write_csv(df: DataFrame, columns: list[str], path: str) -> list[str]:
    """Write those of ``columns`` that exist, '' as nothing; the missing ones are returned."""
    there = [c for c in columns if c in df.columns]
    df.select(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in there)).write.mode("overwrite").option("header", True).csv(path)
    return [c for c in columns if c not in df.columns]


def write_json(records: list[dict], path: str) -> None:
    """An array of records; empty values are left out of each."""
    Path(path).write_text(json.dumps([{k: v for k, v in r.items() if v not in (None, "", [])} for r in records], ensure_ascii=False, indent=1), encoding="utf-8")


def read_json(spark: SparkSession, path: str, schema: object) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_sections(questions: DataFrame, path: str, depth: int = 2) -> None:
    """A JSON folder for each prefix of the group paths."""
    from tallyweave.operators.resolve import section_prefixes

    questions.withColumn("section", F.explode(section_prefixes(F.col("group_path"), depth))).write.mode("overwrite").partitionBy("section").json(path)
