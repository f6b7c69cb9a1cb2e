"""Preload tables: which ones a form names, and reading them."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.syntax import Call, ExpressionError, Text, parse, walk

_SEARCH = re.compile(r"\bsearch\((.*)\)", re.S)


class MissingTables(FileNotFoundError):
    """Tables that a form names and no folder has."""


def named_tables(expressions: list[str], appearances: list[str] = ()) -> tuple[set[str], bool]:  # type: ignore[assignment]
    """(names of the tables that pulldata and search ask for, whether one is named by an expression)."""
    names, dynamic = set(), False
    sources = [e for e in expressions if e and "pulldata" in e] + [f"search({m[1]})" for a in appearances if a and (m := _SEARCH.search(a))]
    for source in sources:
        try:
            calls = [n for n in walk(parse(source)) if isinstance(n, Call) and n.name in ("pulldata", "search") and n.args]
        except ExpressionError:
            dynamic = True
            continue
        for c in calls:
            if isinstance(c.args[0], Text):
                names.add(c.args[0].value)
            else:
                dynamic = True
    return names, dynamic


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, only '' is null, with ``_ord``, the row's place (rows of one file keep their order)."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "").option("multiLine", True).csv(path)
    return df.withColumn("_ord", F.monotonically_increasing_id())


def load(spark: SparkSession, folders: list[str], names: set[str], dynamic: bool = False) -> dict[str, DataFrame]:
    """The named tables, and all there are if some name is computed. Missing ones are an error that lists them."""
    files: dict[str, Path] = {}
    for folder in folders:
        for f in sorted(Path(folder).glob("*.csv")):
            files.setdefault(f.stem, f)
    missing = sorted(n for n in names if n.removesuffix(".csv") not in files)
    if missing:
        raise MissingTables(f"no CSV for {', '.join(missing)} in {', '.join(folders)}")
    wanted = set(files) if dynamic else {n.removesuffix(".csv") for n in names}
    return {n: read_table(spark, str(files[n])) for n in sorted(wanted)}


def split_arguments(source: str) -> list[str]:
    """The arguments between a call's parentheses, commas in quotes and inner calls aside."""
    out, depth, quote, at = [], 0, "", 0
    for k, c in enumerate(source):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append(source[at:k].strip())
            at = k + 1
    rest = source[at:].strip()
    return [*out, rest] if rest or out else []


def search_arguments(appearance: str) -> dict | None:
    """table and matches [(column, expression)] of a search() appearance in 'matches' mode; without a filter, no matches."""
    m = _SEARCH.search(appearance or "")
    if not m:
        return None
    args = split_arguments(m[1])
    table = args[0].strip("'\"") if args else ""
    if len(args) < 2:
        return {"table": table, "matches": []}
    if args[1].strip("'\"") != "matches":
        return None
    rest = args[2:]
    return {"table": table, "matches": [(rest[k].strip("'\""), rest[k + 1]) for k in range(0, len(rest) - 1, 2)]}


class Attachments:
    """Preload tables by file name, each read once and kept while it is used; a byte that isn't UTF-8 is replaced."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.tables = spark, Path(folder), {}

    def table(self, name: str) -> DataFrame | None:
        """The table of the first file, by name, that is called ``name`` or begins so; None if there is none."""
        stem = name.removesuffix(".csv")
        if stem not in self.tables:
            file = next(iter(sorted(f for f in self.folder.glob("*.csv") if f.stem.startswith(stem))), None)
            self.tables[stem] = read_table(self.spark, str(file)).persist() if file else None
        return self.tables[stem]

    def close(self) -> None:
        for t in self.tables.values():
            if t is not None:
                t.unpersist()
        self.tables.clear()


def static_choices(appearance: str, value: str, label: str, attachments: Attachments) -> DataFrame | None:
    """(value, label) in file order of a search() whose filters are literals; None if it needs a row's answers or a table.

    ``value`` and ``label`` are the columns that the choice sheet names. Filters on columns that aren't there match nothing.
    """
    asked = search_arguments(appearance)
    if asked is None or any("${" in v for _, v in asked["matches"]):
        return None
    t = attachments.table(asked["table"])
    if t is None or value not in t.columns or label not in t.columns:
        return None
    for column, v in asked["matches"]:
        t = t.filter(F.trim(F.coalesce(F.col(f"`{column}`"), F.lit(""))) == v.strip().strip("'\"").strip()) if column in t.columns else t.limit(0)
    return t.orderBy("_ord").select(F.col(f"`{value}`").alias("value"), F.col(f"`{label}`").alias("label"))
