"""Scenario checks: planned answers against a form, runs of variations, and what the traces say."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.form import Form
from tallyweave.operators.sampling import numeric_bounds


def validate(form: Form, choices: dict[str, list[tuple[str, str]]], answers: dict[str, object]) -> list[tuple[str, str]]:
    """(variable, what is wrong) of planned answers: unknown variables, codes not offered, numbers out of bounds."""
    known = {q["variable_name"]: q for q in form.questions}
    out = []
    for key, value in answers.items():
        base = key if key in known else key.rstrip("0123456789").rstrip("_")
        q = known.get(base)
        if q is None:
            out.append((key, "unknown variable"))
            continue
        codes = [v for v, _ in choices.get(q["choice_list"] or "", [])]
        given = str(value).split() if q["type"] == "select_multiple" else [str(value)]
        if codes and not set(given) <= set(codes):
            out.append((key, f"{value} is not among its choices"))
        if q["type"] in ("integer", "decimal"):
            low, high = numeric_bounds(q["constraint"])
            try:
                n = float(value)
            except (TypeError, ValueError):
                out.append((key, f"{value} is no number"))
                continue
            if low is not None and n < low or high is not None and n > high:
                out.append((key, f"{value} is out of bounds"))
    return out


def variation_seed(scenario: str, variation: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{scenario}#{variation}".encode()).digest()[:4], "big")


def expand(scenarios: list[dict], variations: int) -> list[dict]:
    """Each scenario under each variation, with a seed of its own."""
    return [s | {"variation": k, "seed": variation_seed(s["id"], k)} for s in scenarios for k in range(variations)]


def report(trace: DataFrame, expected: DataFrame) -> DataFrame:
    """(run, variable, expectation, reached, ok, gates): whether what must be reached was, and what must be blocked wasn't.

    ``trace`` has run, variable, asked, clause; ``expected`` run, variable, expectation ('reach' or 'block').
    """
    seen = trace.groupBy("run", "variable").agg(F.max("asked").alias("reached"), F.array_sort(F.collect_set(F.when(~F.col("asked"), F.col("clause")))).alias("gates"))
    j = expected.join(seen, ["run", "variable"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    return j.select("run", "variable", "expectation", "reached", (F.col("reached") == (F.col("expectation") == "reach")).alias("ok"), F.coalesce("gates", F.array().cast("array<string>")).alias("gates"))


def rejections(trace: DataFrame) -> DataFrame:
    """(run, variable, clause, rows) of gates that couldn't be evaluated."""
    return trace.filter("reason = 'unevaluable'").groupBy("run", "variable", "clause").agg(F.count("*").alias("rows"))
