"""What the operators share: the id and text columns, and dropping rows by id.

Rules that hold for each operator over documents: a row whose id or text is null yields no result and is never
dropped; ids are whole numbers; an empty table gives an empty result of the same columns; a text may be of any length
and is read whole; extra columns, whatever their names, are neither read nor changed. A column is taken by its exact
name even beside others that differ from it in case only; where none has the exact name, case is disregarded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.materialize import broadcast_if_small

KEY = "_tw_key"


def place(df: DataFrame, name: str) -> int:
    """The position of the column called ``name``."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return alike[0]


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, … by position, so that no name is ambiguous or taken."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def picked(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``df`` under new names; ``wanted`` maps the new name to the old one."""
    rows = positional(df)
    return rows.select(*(F.col(f"c{place(df, old)}").alias(new) for new, old in wanted.items()))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with an id and a text, as (doc_id, text) and nothing else."""
    out = picked(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return out.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(df: DataFrame, gone: DataFrame, gone_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id isn't among the distinct ids of ``gone`` (its one column); null ids stay.

    The ids are broadcast when their counted size allows, else both sides shuffle.
    """
    ids = gone.toDF(KEY)
    rows = positional(df)
    return rows.join(broadcast_if_small(ids, gone_rows), rows[f"c{place(df, id_col)}"].cast("long") == ids[KEY], "left_anti").toDF(*df.columns)
