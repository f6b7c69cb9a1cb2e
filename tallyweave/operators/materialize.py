"""Cutting lineage: tables written in the folder that every executor shares.

A written table survives the loss of an executor, which a local checkpoint does not.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many bytes of counted rows are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + os.path.join(tempfile.gettempdir(), f"tallyweave-{app}")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which ends its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """Hint a broadcast when ``rows`` counted rows fit in BROADCAST_BYTES, else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def broadcast_if_bytes(df: DataFrame, size: Column) -> DataFrame:
    """Hint a broadcast when the bytes of all rows, ``size`` for each, are measured to fit in BROADCAST_BYTES.

    ``df`` is read once for the measure: give it a written table.
    """
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set SQL settings (``__`` stands for ``.``) for a block that runs its jobs inside, then restore them."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
