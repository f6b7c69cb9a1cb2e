"""Preload lookups: first match by normalised key, and choices drawn from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.materialize import written


def normal_key(key: Column) -> Column:
    """A whole number is one key however it is written (7, 7.0, blanks around it, as text or not); null is the empty key."""
    t = F.trim(F.coalesce(key.cast("string"), F.lit("")))
    n = t.try_cast("double")
    whole = t.rlike(r"^-?[0-9]+([.]0*)?$") & (F.abs(n) < 1e15)
    return F.when(whole, n.cast("decimal(20,0)").cast("string")).otherwise(t)


def first_rows(table: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """(key, columns): of the rows with one key the first in ``order``."""
    picked = F.min_by(F.struct(*columns), order).alias("r")
    return table.groupBy(normal_key(F.col(key)).alias("_key")).agg(picked).select("_key", *(F.col(f"r.{c}").alias(c) for c in columns))


def sized(table: DataFrame, name: str = "side") -> DataFrame:
    """``table`` written once, so that its aggregate runs once and the optimizer knows its bytes: it broadcasts the side up
    to spark.sql.autoBroadcastJoinThreshold and shuffles beyond."""
    return written(table, name)


def pulldata(df: DataFrame, table: DataFrame, key: Column, key_column: str, columns: dict[str, str], order: str) -> DataFrame:
    """``df`` with columns of the first table row of its key, as text; a miss is ''.

    ``columns`` maps table column to result column; a column that the table lacks is '' too.
    """
    there = [c for c in columns if c in table.columns]
    hit = first_rows(table, key_column, there, order) if there else None
    out = df.withColumn("_key", normal_key(key))
    if hit is not None:
        renamed = hit.select("_key", *(F.col(c).cast("string").alias(f"_pd_{columns[c]}") for c in there))
        out = out.join(sized(renamed), "_key", "left")
    made = {new: F.coalesce(F.col(f"_pd_{new}"), F.lit("")) if old in there else F.lit("") for old, new in columns.items()}
    return out.withColumns(made).drop("_key", *(f"_pd_{columns[c]}" for c in there))


def search_choices(df: DataFrame, table: DataFrame, value: str, label: str, matches: list[tuple[str, Column]], sentinels: list[tuple[str, str]], order: str, name: str) -> DataFrame:
    """``df`` with the choices that ``search(..., 'matches', column, value)`` draws, the static ones after them.

    ``matches`` compares trimmed text. The table is grouped by its match columns first, so each row meets its list once.
    Without ``matches`` every row gets the one list of the whole table.
    """
    fixed = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(t).alias("label")) for v, t in sentinels)) if sentinels else None
    option = F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("value"), F.col(label).cast("string").alias("label"))
    keys = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_m{k}") for k, (c, _) in enumerate(matches)]
    rows = F.transform(F.array_sort(F.collect_list(option)), lambda s: F.struct(s["value"].alias("value"), s["label"].alias("label")))
    lists = table.groupBy(*keys).agg(rows.alias("_found")) if keys else table.agg(rows.alias("_found"))
    out = df.withColumns({f"_m{k}": F.trim(F.coalesce(v.cast("string"), F.lit(""))) for k, (_, v) in enumerate(matches)})
    out = out.join(sized(lists, "lists"), [f"_m{k}" for k in range(len(matches))], "left") if matches else out.crossJoin(sized(lists, "lists"))
    found = F.coalesce("_found", F.array().cast("array<struct<value:string,label:string>>"))
    return out.withColumn(name, F.concat(found, fixed) if fixed is not None else found).drop("_found", *(f"_m{k}" for k in range(len(matches))))


class EmptyPool(ValueError):
    """No case is left of a pool."""


def case_pool(df: DataFrame, name: str, prefix: str | None, key: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The cases whose name begins with ``prefix``, whatever its case, and whose key is in the one column of ``ids``.

    It is an error if none is left, found by reading one row.
    """
    out = df.filter(F.upper(name).startswith(prefix.upper())) if prefix else df
    if ids is not None:
        wanted = ids.toDF("_id").distinct()
        out = out.join(wanted, F.col(key) == F.col("_id"), "left_semi")
    if out.isEmpty():
        raise EmptyPool(f"no case begins with {prefix!r} and is in the list")
    return out
