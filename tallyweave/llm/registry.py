"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyweave.llm.chat_events import OP8_SQL, op8_chat_events
from tallyweave.llm.decontaminate import op5_benchmark_alignment
from tallyweave.llm.exact_dedup import OP4_SQL, op4_exact_duplicates
from tallyweave.llm.license_rules import op9_licence_rules, op9_sql
from tallyweave.llm.odd_sketch import op7_near_duplicates
from tallyweave.llm.packing import op1_packing
from tallyweave.llm.pii import op2_pii_spans
from tallyweave.llm.revisits import OP6_SQL, op6_revisits
from tallyweave.llm.rule_ensemble import op10_quality_rules
from tallyweave.llm.substring_dedup import OP3_SQL, op3_repeated_passages


OPERATORS = (
    op1_packing,
    op2_pii_spans,
    op3_repeated_passages,
    op4_exact_duplicates,
    op5_benchmark_alignment,
    op6_revisits,
    op7_near_duplicates,
    op8_chat_events,
    op9_licence_rules,
    op10_quality_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_repeated_passages": OP3_SQL, "op4_exact_duplicates": OP4_SQL, "op6_revisits": OP6_SQL, "op8_chat_events": OP8_SQL, "op9_licence_rules": op9_sql()}
