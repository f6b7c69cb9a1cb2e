"""Collected data in, dictionaries and graphs out."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.form import shown_choices
from tallyweave.operators.materialize import session_conf
from tallyweave.sources.sheets import write_xlsx

SHEET_COLUMNS = ("variable_order", "variable_name", "question_text", "question_type", "choice_list", "choices", "group_path", "repeat", "iteration", "choice_code", "relevance", "condition_text", "constraint", "calculation", "non_null", "null_count", "missing_rate", "min_value", "max_value", "sentinels", "matched")


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """A .dta file with codes, not labels; missing numbers, tagged or not, are null. Read on the driver."""
    frame = pd.read_stata(path, convert_categoricals=False)
    if any(isinstance(t, pd.CategoricalDtype) for t in frame.dtypes):
        raise TypeError(f"{path} came with categories instead of codes")
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), _schema(frame)) if len(frame) else spark.createDataFrame([], _schema(frame))


def _schema(frame: pd.DataFrame) -> T.StructType:
    kinds = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampType()}
    return T.StructType([T.StructField(c, kinds.get(frame[c].dtype.kind, T.StringType())) for c in frame.columns])


def write_stata(df: DataFrame, ordered: list[str], path: str) -> list[str]:
    """The columns of ``ordered`` that ``df`` has, in that order, as .dta version 118; text that is numeric throughout becomes numbers.

    Written on the driver, as the format asks for one file. Returns the columns written.
    """
    columns = [c for c in ordered if c in df.columns]
    frame = df.select(columns).toPandas()
    for c in columns:
        if frame[c].dtype == object:
            filled = frame[c].replace("", None).dropna()
            numbers = pd.to_numeric(filled, errors="coerce")
            frame[c] = pd.to_numeric(frame[c].replace("", None), errors="coerce") if len(filled) and numbers.notna().all() else frame[c].fillna("").astype(str)
    frame.to_stata(path, write_index=False, version=118)
    return columns


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """(variable, n, non_null, missing_rate, all_missing, min_value, max_value) from Parquet footers, no data pages read.

    Least, greatest and count are pushed into the scan; text columns have no range.
    """
    schema = spark.read.parquet(path).schema
    ranged = [f.name for f in schema.fields if isinstance(f.dataType, (T.NumericType, T.DateType)) and not isinstance(f.dataType, T.DecimalType)]
    plain = [f.name for f in schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    with session_conf(spark, spark__sql__parquet__aggregatePushdown="true", spark__sql__sources__useV1SourceList="avro,csv,json,kafka,orc,text"):
        df = spark.read.parquet(path)
        asked = [F.count("*")] + [F.count(f"`{c}`") for c in plain] + [g(f"`{c}`") for c in ranged for g in (F.min, F.max)]
        got = df.agg(*asked).first()
    n, counts, ranges = got[0], dict(zip(plain, got[1:])), got[1 + len(plain) :]
    low, high = dict(zip(ranged, ranges[::2])), dict(zip(ranged, ranges[1::2]))
    shown = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) else float((v - __import__("datetime").date(1970, 1, 1)).days)
    rows = [(c, n, counts[c], round((n - counts[c]) / n, 6) if n else 0.0, counts[c] == 0, shown(low.get(c)), shown(high.get(c))) for c in plain]
    return spark.createDataFrame(rows, "variable string, n long, non_null long, missing_rate double, all_missing boolean, min_value double, max_value double")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """A JSON array in one file, a record for each variable, in order; what is null is left out. ``Store`` reads it back.

    A dictionary has as many rows as the export has columns, so it is collected.
    """
    rows = [json.loads(r[0]) for r in dictionary.orderBy("variable_order").select(F.to_json(F.struct("*"))).collect()]
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")


def write_sidecar(df: DataFrame, path: str) -> DataFrame:
    """The export as Parquet, read back; its footers give ``footer_profile`` without a scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_coverage(trace: DataFrame, path: str) -> dict[str, list[str]]:
    """A coverage trace (gates.coverage) as Parquet under ``path``/cells and its summary as JSON; the variables never asked."""
    from tallyweave.operators.gates import coverage_summary

    trace.write.mode("overwrite").parquet(f"{path}/cells")
    rows = [r.asDict() for r in coverage_summary(trace.sparkSession.read.parquet(f"{path}/cells")).orderBy("variable").collect()]
    never = [r["variable"] for r in rows if r["never_asked"]]
    Path(path, "coverage.json").write_text(json.dumps({"aggregate": rows, "never_asked": never}, indent=1), encoding="utf-8")
    return {"never_asked": never}


def write_dictionary_sheet(dictionary: DataFrame, path: str) -> None:
    """A workbook of SHEET_COLUMNS; those the dictionary lacks stay blank, choices are cut at 500 characters."""
    rows = []
    for r in dictionary.orderBy("variable_order").collect():
        d = r.asDict(recursive=True)
        if isinstance(d.get("choices"), list):
            d["choices"] = shown_choices([(c["value"], c["label"]) for c in d["choices"]])
        rows.append([" / ".join(v) if isinstance(v := d.get(c), list) else v for c in SHEET_COLUMNS])
    write_xlsx(path, {"dictionary": (list(SHEET_COLUMNS), rows)})


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, repeats: DataFrame | None = None) -> None:
    """Nodes and edges as Parquet under ``path``, and graph.json, a node-link document, beside them."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    document = {
        "directed": True,
        "multigraph": True,
        "nodes": [r.asDict(True) for r in nodes.collect()],
        "links": [{"source": r["src"], "target": r["dst"], "kind": r["kind"]} for r in edges.collect()],
        "repeat_groups": [r.asDict(True) for r in repeats.collect()] if repeats is not None else [],
    }
    Path(path, "graph.json").write_text(json.dumps(document, ensure_ascii=False, default=str), encoding="utf-8")


def answer_sheets(paths: list[str]) -> dict[str, dict]:
    """answers and directives of several JSON sheets; of a key that repeats the later sheet counts."""
    out: dict[str, dict] = {"answers": {}, "directives": {}}
    for p in paths:
        sheet = json.loads(Path(p).read_text(encoding="utf-8"))
        out["answers"] |= sheet.get("answers", {})
        for k, v in sheet.get("directives", {}).items():
            out["directives"][k] = out["directives"].get(k, {}) | v if isinstance(v, dict) else v
    return out


def discovered(folder: str) -> dict[str, tuple[str, str | None]]:
    """Surveys under a folder: name to (dictionary, questions or None)."""
    out = {}
    for d in sorted(Path(folder).rglob("*_variable_dictionary.json")):
        name = d.name.removesuffix("_variable_dictionary.json")
        q = d.with_name(f"{name}_questions.json")
        out[name] = (str(d), str(q) if q.exists() else None)
    return out


def type_catalogue(markdown: str) -> dict[str, dict[str, str]]:
    """Field types of a Markdown table: the first column's code names the type, the other columns describe it."""
    out, head = {}, []
    for line in markdown.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")] if line.strip().startswith("|") else []
        if not cells:
            head = []
        elif not head:
            head = [c.lower() for c in cells]
        elif not all(set(c) <= set("-: ") for c in cells):
            out[cells[0].strip("`")] = dict(zip(head[1:], cells[1:]))
    return out


class Store:
    """A loaded table that reads its file again once the file has changed; a failed reading keeps the old rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.seen: float | None = None
        self.table: DataFrame | None = None
        self.error: str | None = None

    def current(self) -> DataFrame:
        at = Path(self.path).stat().st_mtime if Path(self.path).exists() else None
        if self.table is None or at != self.seen:
            try:
                # metadata is small: its rows are held, so a later fault of the file can't reach them
                rows = self.spark.read.schema(self.schema).option("multiLine", True).option("mode", "FAILFAST").json(self.path).collect()
                self.table, self.error = self.spark.createDataFrame(rows, self.schema), None
            except Exception as e:  # the file may be half written
                if self.table is None:
                    raise
                self.error = str(e)
            self.seen = at
        return self.table
