"""From raw documents to packed training bins.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All stages but the last
return the columns of ``documents``; the last returns a row for each document with its bin. Rows without an id or a
text are kept by every filter and are in no bin. Empty texts are copies of each other, near duplicates of nothing, and an
example of no tokens; texts of any length are read whole; of equal or alike documents (ties and repeated rows too) the least
id stays, once; an empty table goes through as one; columns that clash in case with the ones used are left as they are. ``run`` writes each stage's result as Parquet in the shared folder and
reads it back for the next, so a lost executor costs one stage's tasks at most.

SQL can't express these stages (a fitted classifier, hashing by MinHash, alignment, greedy packing); ORACLE_SQL is None
and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import decontaminate, exact_dedup, odd_sketch, packing, rule_ensemble
from tallyweave.llm.common import table
from tallyweave.operators.materialize import written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensembles don't reject; fitted on the labels of the documents that came in."""
    return rule_ensemble.keep_accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return odd_sketch.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, bin_id, position, tokens, segments, loss_tokens, oversize): every document in a bin."""
    return packing.packed(packing.document_examples(docs)).withColumnRenamed("example_id", "doc_id")


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
