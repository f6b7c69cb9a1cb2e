"""Queries over generated responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import form, synth
from tallyweave.plans.registry import query, table

_SHEET = [
    {"type": "select_one yesno", "name": "consent", "label": "May we go on?"},
    {"type": "begin group", "name": "main", "relevance": "${consent} = '1'"},
    {"type": "integer", "name": "age", "constraint": ". >= 18 and . <= 90"},
    {"type": "select_multiple colors", "name": "colors", "constraint": "count-selected(.) <= 2"},
    {"type": "calculate", "name": "old", "calculation": "if(${age} > 60, 'old', 'young')"},
    {"type": "begin repeat", "name": "plot", "repeat_count": "${age} mod 3"},
    {"type": "decimal", "name": "area", "constraint": ". > -1 and . <= 5"},
    {"type": "end repeat", "name": "plot"},
    {"type": "end group", "name": "main"},
]
_CHOICES = {"yesno": [("1", "Yes"), ("0", "No")], "colors": [("1", "Red"), ("2", "Green"), ("-99", "Don't know")]}


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    return synth.generate(spark, form.compile_form(_SHEET), _CHOICES, n, seed=7)[0]


@query()
def synth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each order, seeded."""
    return synth.rendered(_responses(spark, sf_dir))


@query()
def synth_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.instances(_responses(spark, sf_dir), form.compile_form(_SHEET), _CHOICES, "plot", seed=7)


@query("SELECT count(*) AS responses, 0::BIGINT AS refused, 0::BIGINT AS leaked, 0::BIGINT AS wrong_counts FROM orders")
def synth_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated responses against their form: none out of bounds, none behind a closed gate, instances as counted."""
    rows = _responses(spark, sf_dir)
    per = synth.instances(rows, form.compile_form(_SHEET), _CHOICES, "plot", seed=7).groupBy("KEY").agg(F.count("*").alias("made"))
    j = rows.join(per, "KEY", "left")
    leaked = (F.col("consent") == "0") & F.coalesce("age", "colors", "old", "plot_count").isNotNull()
    wrong = F.coalesce("made", F.lit(0)) != F.coalesce("plot_count", F.lit(0))
    refused = ~F.col("age").between(18, 90) | (F.size(F.split("colors", " ")) > 2)
    return j.agg(F.count("*").alias("responses"), F.count_if(refused).alias("refused"), F.count_if(leaked).alias("leaked"), F.count_if(wrong).alias("wrong_counts"))
