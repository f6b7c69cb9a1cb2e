"""Summary statistics per relevance condition, executed rather than scripted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, gate
from tallyweave.lang.syntax import ExpressionError
from tallyweave.operators.materialize import written

NUMERIC_TYPES = ("integer", "decimal", "calculate", "calculate_here", "select_one", "count", "select_multiple", "repeat_count")


def numeric_universe(dictionary: DataFrame) -> DataFrame:
    """Variables worth statistics: numeric by type, with values, not disabled."""
    return dictionary.filter(F.col("question_type").isin(*NUMERIC_TYPES) & (F.col("non_null") > 0) & ~F.coalesce("disabled", F.lit(False)))


def relevance_groups(variables: dict[str, str]) -> list[tuple[str, list[str]]]:
    """Variables by equal condition text: the unconditional first, then by falling size, then by text."""
    groups: dict[str, list[str]] = {}
    for name, condition in variables.items():
        groups.setdefault(" ".join(condition.split()), []).append(name)
    return sorted(groups.items(), key=lambda g: (g[0] != "", -len(g[1]), g[0]))


QUARTERS = (0.25, 0.5, 0.75)


def tabstat(df: DataFrame, variables: dict[str, str], relative_error: int | None = None) -> DataFrame:
    """(variable, condition, n, mean, sd, min, p25, p50, p75, max) of each variable within its condition.

    Cells are unpivoted under their conditions and aggregated by variable. Percentiles interpolate between order
    statistics, which are found among the counted values (``order_statistics``); no task holds a variable's values. With
    ``relative_error`` (an accuracy such as 10000) they are approximate, by sketches in the same pass.
    """
    scope = Scope(df.schema)
    cells = []
    for condition, names in relevance_groups(variables):
        holds = gate(condition, scope)
        cells += [F.struct(F.lit(n).alias("variable"), F.lit(condition).alias("condition"), F.when(holds, F.col(n).cast("double")).alias("x")) for n in names]
    x = F.col("x")
    keys = ["variable", "condition"]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    quarters = ("p25", "p50", "p75")
    approximate = [F.percentile_approx(x, p, relative_error).alias(c) for c, p in zip(quarters, QUARTERS)] if relative_error else []
    made = long.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), *approximate)
    if not relative_error:
        # the places, from 0, of the values on both sides of each quarter
        made = written(made, "moments")
        at = F.array(*(f((F.col("n") - 1) * p) for p in QUARTERS for f in (F.floor, F.ceil)))
        found = order_statistics(long.filter(x.isNotNull()), keys, "x", made.filter("n > 0").select(*keys, F.explode(F.array_distinct(at)).alias("place")))
        values = F.map_from_entries(F.collect_list(F.struct("place", "x")))
        made = made.join(F.broadcast(found.groupBy(*keys).agg(values.alias("values"))), keys, "left")
        for c, p in zip(quarters, QUARTERS):
            place = (F.col("n") - 1) * p
            low, high = (F.try_element_at("values", f(place)) for f in (F.floor, F.ceil))
            made = made.withColumn(c, F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return made.select(*keys, "n", "mean", "sd", "min", *quarters, "max")


def order_statistics(long: DataFrame, keys: list[str], x: str, wanted: DataFrame) -> DataFrame:
    """(keys, place, x): the values at the ``wanted`` (keys, place) of each group's values in order, counted from 0.

    Equal values are counted before they shuffle. The counts stand in ranges, one for each task; sums over the ranges
    say which range holds a place, and only those ranges are read again. ``wanted`` is small.
    """
    counts = long.groupBy(*keys, x).agg(F.count("*").alias("c"))
    ranges = written(counts.repartitionByRange(*keys, x).withColumn("range", F.spark_partition_id()), "counts")
    sums = ranges.groupBy(*keys, "range").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    held = sums.join(F.broadcast(wanted), keys).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
    held = written(held.groupBy(*keys, "range", "before").agg(F.collect_list("place").alias("places")), "held")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "range").orderBy(x))
    rows = ranges.join(F.broadcast(held), [*keys, "range"]).withColumn("upto", upto)
    here = F.filter("places", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("c")))
    return rows.select(*keys, x, F.explode(here).alias("place")).select(*keys, "place", x)


def condition_counts(df: DataFrame, conditions: list[str]) -> DataFrame:
    """(condition, rows, zero): the rows each condition holds for, all in one pass; null where it can't be compiled."""
    scope, cells, bad = Scope(df.schema), [], []
    for c in conditions:
        try:
            cells.append(F.struct(F.lit(c).alias("condition"), F.count_if(gate(c, scope)).alias("rows")))
        except ExpressionError:
            bad.append(F.struct(F.lit(c).alias("condition"), F.lit(None).cast("long").alias("rows")))
    out = df.agg(F.array(*cells, *bad).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return out.withColumn("zero", F.coalesce(F.col("rows") == 0, F.lit(False)))


def row_total(names: list[str]) -> Column:
    """Sum over columns, null as 0."""
    return sum((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names), F.lit(0.0))


def with_metadata(stats: DataFrame, metadata: DataFrame) -> DataFrame:
    """Statistics of the variables that have metadata, in dictionary order."""
    return stats.join(metadata, "variable").orderBy("variable_order")
