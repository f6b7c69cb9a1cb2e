"""Submissions as they arrive: coverage of gates and version counts, kept up to date.

The survey tools work on finished exports; this is the same evaluation over a stream. State is one row for each
variable or version, so it doesn't grow with the submissions, and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope
from tallyweave.operators import gates


def coverage(stream: DataFrame, key: str, questions: dict[str, tuple[list[str], str]], strict: bool = True) -> DataFrame:
    """Streaming (variable, asked_count, gated_count, never_asked); ``questions`` maps a variable to (group conditions, own condition)."""
    scope = Scope(stream.schema)
    return gates.coverage_summary(gates.coverage(stream, key, {v: gates.relevance(g, own, scope, strict) for v, (g, own) in questions.items()}))


def versions(stream: DataFrame, version: str = "formdef_version") -> DataFrame:
    """Streaming (version, submissions)."""
    return stream.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("submissions"))
