"""Relevance gates: all group conditions from the outside in, then the question's own; the first that fails wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, gate
from tallyweave.lang.syntax import ExpressionError


@dataclass(frozen=True)
class Gate:
    open: Column
    reason: Column  # null when open; else 'group', 'own' or 'unevaluable'
    clause: Column  # the text of the clause that failed
    errors: tuple[str, ...]


def relevance(groups: list[str], own: str, scope: Scope, strict: bool = True) -> Gate:
    """``strict`` closes a gate with a clause that can't be compiled; otherwise such a clause is open."""
    reason, clause, errors = F.lit(None).cast("string"), F.lit(None).cast("string"), []
    for kind, source in reversed([("group", g) for g in groups if g.strip()] + ([("own", own)] if own.strip() else [])):
        try:
            holds = F.lit(False) if source.strip() == "0" else gate(source, scope)
            what = kind
        except ExpressionError as e:
            errors.append(f"{source}: {e}")
            if not strict:
                continue
            holds, what = F.lit(False), "unevaluable"
        reason = F.when(~holds, what).otherwise(reason)
        clause = F.when(~holds, source).otherwise(clause)
    return Gate(reason.isNull(), reason, clause, tuple(errors))


def disabled(relevance_: Column, group_relevances: Column) -> Column:
    """A question is disabled when its own condition or any group's is exactly '0'."""
    return F.coalesce(F.trim(relevance_) == "0", F.lit(False)) | F.coalesce(F.exists(group_relevances, lambda r: F.trim(r) == "0"), F.lit(False))


def coverage(df: DataFrame, key: str, gates: dict[str, Gate]) -> DataFrame:
    """Long fact table (key, variable, asked, reason, clause), one row a cell."""
    cells = [F.struct(F.lit(v).alias("variable"), g.open.alias("asked"), g.reason.alias("reason"), g.clause.alias("clause")) for v, g in gates.items()]
    return df.select(F.col(key).alias("key"), F.explode(F.array(*cells)).alias("c")).select("key", "c.*")


def coverage_summary(trace: DataFrame) -> DataFrame:
    """(variable, asked_count, gated_count, never_asked)."""
    asked = F.count_if("asked")
    return trace.groupBy("variable").agg(asked.alias("asked_count"), F.count_if(~F.col("asked")).alias("gated_count"), (asked == 0).alias("never_asked"))
