"""Vector bin packing of instruction examples.

An example has three sizes: tokens, segments and loss-bearing tokens. A bin holds at most MAX_TOKENS, MAX_SEGMENTS and
MAX_LOSS of them. One bin is open at a time; of the examples that fit, the one with the largest dot product between
its sizes and what the bin has left goes in, each dimension scaled by its limit and weighted by the total demand for
it. When none fits, the next bin opens.

Examples are packed in shards of about SHARD examples, by a hash of the id, so the number of tasks follows the data
and the result depends on the data alone.

Defined results: an example that exceeds a limit by itself is whole in a bin of its own, marked ``oversize``; null sizes
are 0, as are those of an empty text; examples without an id are passed over; of equal scores the least id goes first;
repeated rows are examples of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyweave.llm.common import id_text, table

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 16, 3072
SHARD = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "example_id long, bin_id string, position int, tokens long, segments long, loss_tokens long, oversize boolean"


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> "tiktoken.Encoding":  # noqa: F821
    import tiktoken

    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """A vectorised column function: number of tokens of a text, 0 for a null one."""

    @F.pandas_udf(IntegerType())
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for part in texts:
            yield part.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return tokens


def fill(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins as lists of row numbers. ``sizes`` has a row of three sizes for each example, none above ``limits``."""
    share = sizes / limits
    weight = share.sum(axis=0)
    weight = weight / weight.sum() if weight.sum() > 0 else np.ones(len(limits))
    weighted = share * weight
    left = np.arange(len(sizes))
    bins: list[list[int]] = []
    while len(left):
        room = limits.copy()
        mine: list[int] = []
        own, demand = sizes[left], weighted[left]
        open_ = np.ones(len(left), dtype=bool)
        while True:
            fits = open_ & (own <= room).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, demand @ (room / limits), -1.0)
            k = int(score.argmax())
            mine.append(int(left[k]))
            room = room - own[k]
            open_ = fits
            open_[k] = False
        bins.append(mine)
        gone = np.zeros(len(sizes), dtype=bool)
        gone[mine] = True
        left = left[~gone[left]]
    return bins


def packed(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, shard: int = SHARD) -> DataFrame:
    """(example_id, bin_id, position, tokens, segments, loss_tokens, oversize) of each row of ``examples``.

    ``examples`` has example_id, tokens, segments and loss_tokens. Only these numbers are shuffled.
    """
    limits = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)
    size = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    rows = examples.select(F.col("example_id").cast("long").alias("example_id"), size("tokens"), size("segments"), size("loss_tokens")).filter("example_id is not null")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("example_id"), F.lit(shards)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["example_id", "tokens", "segments", "loss_tokens"], kind="stable").reset_index(drop=True)
        sizes = pdf[["tokens", "segments", "loss_tokens"]].to_numpy(dtype=np.int64)
        over = (sizes > limits).any(axis=1)
        small = np.flatnonzero(~over)
        bins = [[int(small[j]) for j in b] for b in fill(sizes[small], limits)] + [[int(j)] for j in np.flatnonzero(over)]
        order = [j for b in bins for j in b]
        out = pdf.iloc[order].reset_index(drop=True)
        name = f"{int(pdf['shard'].iloc[0]):08d}" if len(pdf) else ""
        out["bin_id"] = [f"{name}-{n:06d}" for n, b in enumerate(bins) for _ in b]
        out["position"] = [p for b in bins for p in range(len(b))]
        out["oversize"] = over[order]
        return out[["example_id", "bin_id", "position", "tokens", "segments", "loss_tokens", "oversize"]]

    return rows.groupBy("shard").applyInPandas(pack, PACKED)


def conversation_examples(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One example a conversation: all tokens, a segment a turn, and the assistant's tokens as loss-bearing."""
    count = token_counter(vocabulary)
    t = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "role", count(F.col("text")).alias("n"))
    return t.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("tokens"), F.count("*").alias("segments"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("n"))), F.lit(0)).alias("loss_tokens"))


def document_examples(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One example a document: a segment, whose tokens but the first are predicted."""
    count = token_counter(vocabulary)
    rows = id_text(docs, id_col, text_col).select(F.col("doc_id").alias("example_id"), count(F.col("text")).alias("tokens"))
    return rows.select("example_id", "tokens", F.lit(1).alias("segments"), F.greatest(F.col("tokens") - 1, F.lit(0)).alias("loss_tokens"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(conversation_examples(table(spark, sf_dir, "conversations")))
