"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word SEED-grams of the benchmark items are looked for in every document, and each occurrence is a seed, however many
documents hold the gram: a partial copy may have only grams that leaked widely. Around the seeds of one diagonal lies a
passage; where it has words enough in common with the item to reach LEAST_SCORE at all, it is aligned with the item,
words as letters (match +1, mismatch and gap -1), and the score over the item's length decides. Edited and partly
copied items score in proportion to what was kept. An item of two or three words is one seed, its whole text.

Defined results: a null id or text, on either side, and an item of no word or of one (any text may have that) match
nothing; case and punctuation don't count; texts and items of any length are read whole; repeated rows count once, a
repeated item id is one item per text, of which the best alignment counts; of alignments of one score the one that ends
first; without documents or items the result is empty; extra columns aren't read and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import id_text, table, without_ids
from tallyweave.llm.textgrams import FOLDED, blocks, slices
from tallyweave.operators.materialize import BROADCAST_BYTES, broadcast_if_bytes, broadcast_if_small, written

SEED, LEAST_SCORE = 4, 0.5
#: The least words of an item that is looked for at all.
LEAST_WORDS = 2
#: Bytes of a gram with its item and place, all of fixed size, for the check before a broadcast.
GRAM_BYTES = 32


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, end of that alignment in the passage), the earliest end of equals."""
    n = len(passage)
    ramp = np.arange(n + 1)
    above = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(n + 1, dtype=np.int64)
        np.maximum(above[:-1] + np.where(passage == w, 1, -1), above[1:] - 1, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum(row, np.maximum.accumulate(row + ramp) - ramp)
        top = int(row.argmax())
        if row[top] > best or (row[top] == best and best and top < end):
            best, end = int(row[top]), top
        above = row
    return best, end


def benchmark_grams(items: DataFrame) -> DataFrame:
    """(gram, item_key, item_pos): ``items`` has (item_key, item_id, text)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for b in blocks(batch.column(2).to_pylist(), FOLDED):
                for n in range(LEAST_WORDS, SEED + 1):
                    at, h = b.grams(n)
                    if n < SEED:
                        whole = b.words[b.doc[at]] == n
                        at, h = at[whole], h[whole]
                    keys = batch.column(0).take(pa.array(b.doc[at] + b.first))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys, pa.array(at - b.offset[b.doc[at]])], names=["gram", "item_key", "item_pos"])

    return items.mapInArrow(grams, "gram long, item_key long, item_pos long")


def item_words(items: DataFrame) -> DataFrame:
    """(item_key, item_id, item_words): the hashes of each item's words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for b in blocks(batch.column(2).to_pylist(), FOLDED):
                lists = pa.ListArray.from_arrays(pa.array(b.offset.astype(np.int32)), pa.array(b.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(b.first, b.n) for k in (0, 1)] + [lists], names=["item_key", "item_id", "item_words"])

    return items.mapInArrow(words, "item_key long, item_id long, item_words array<long>")


def gram_hits(docs: DataFrame, grams: DataFrame, n_grams: int, lengths: list[int]) -> DataFrame:
    """(gram, doc_id, pos) of every occurrence of a benchmark gram of one of ``lengths``. ``docs`` has (doc_id, text).

    The grams' hashes go to the executors when their counted size allows; else every gram of the documents is joined.
    """
    wanted = None
    if n_grams * 8 <= BROADCAST_BYTES:
        rows = np.sort(grams.select("gram").distinct().toArrow()["gram"].to_numpy())
        wanted = docs.sparkSession.sparkContext.broadcast(rows)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for b in blocks(batch.column(1).to_pylist(), FOLDED):
                for n in lengths:
                    at, h = b.grams(n)
                    h = h.view(np.int64)
                    if wanted is not None:
                        table_ = wanted.value
                        if not len(table_):
                            continue
                        there = table_[np.minimum(np.searchsorted(table_, h), len(table_) - 1)] == h
                        at, h = at[there], h[there]
                    if len(at):
                        ids = batch.column(0).take(pa.array(b.doc[at] + b.first))
                        yield pa.RecordBatch.from_arrays([pa.array(h), ids, pa.array(at - b.offset[b.doc[at]])], names=["gram", "doc_id", "pos"])

    found = docs.mapInArrow(hits, "gram long, doc_id long, pos long")
    if wanted is None:
        found = found.join(grams.select("gram").distinct(), "gram", "left_semi")
    return found


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, seeds) to the best alignment of each (document, item) that reaches LEAST_SCORE."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "score", "end_word", "item_words")}
    for batch in slices(batches):
        seeds = batch.column(2).to_pylist()
        for b in blocks(batch.column(1).to_pylist(), FOLDED):
            for d in range(b.n):
                words = b.hash[b.offset[d] : b.offset[d + 1]].view(np.int64)
                best: dict[int, tuple[float, int, int]] = {}
                for seed in seeds[b.first + d]:
                    item = np.array(seed["item_words"], dtype=np.int64)
                    m = len(item)
                    begins = sorted(set(seed["begins"]))
                    group = [begins[0]]
                    for x in [*begins[1:], None]:
                        if x is not None and x - group[-1] <= m // 2:
                            group.append(x)
                            continue
                        lo, hi = max(0, group[0] - m // 2), min(len(words), group[-1] + m + m // 2)
                        # each point of the score takes a word of the passage and one of the item that are equal
                        mine = (0.0, 0, 0)
                        if min(np.isin(words[lo:hi], item).sum(), np.isin(item, words[lo:hi]).sum()) >= LEAST_SCORE * m:
                            score, end = align(item, words[lo:hi])
                            mine = (score / m, -(lo + end), m)
                        if mine[0] >= LEAST_SCORE and mine > best.get(seed["item_id"], (0.0, 0, 0)):
                            best[seed["item_id"]] = mine
                        group = [x]
                for item_id, (score, end, m) in best.items():
                    for k, v in zip(out, (batch.column(0)[b.first + d].as_py(), item_id, score, -end, m)):
                        out[k].append(v)
        if out["doc_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=_HITS)
            out = {k: [] for k in out}


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64()), ("item_words", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word, item_words): the documents that hold a copy of a benchmark item.

    score is the alignment's over the item's words, 1.0 for a whole copy; end_word is where the copy ends.
    """
    texts = id_text(docs, id_col, text_col)
    items = id_text(benchmark, "item_id").select(F.xxhash64("doc_id", "text").alias("item_key"), F.col("doc_id").alias("item_id"), "text").distinct()
    grams, words = written(benchmark_grams(items), "grams"), written(item_words(items), "items")
    n_grams = grams.count()
    sizes = words.select(F.least(F.size("item_words"), F.lit(SEED)).alias("n")).filter(F.col("n") >= LEAST_WORDS).distinct()
    hits = written(gram_hits(texts, grams, n_grams, sorted(r["n"] for r in sizes.collect())).distinct(), "seeds")
    seeds = hits.join(broadcast_if_small(grams, n_grams, GRAM_BYTES), "gram")
    per_item = seeds.groupBy("doc_id", "item_key").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("begins"))
    per_item = per_item.join(broadcast_if_bytes(words, F.size("item_words") * 8 + 32), "item_key")
    per_doc = written(per_item.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_words", "begins")).alias("seeds")), "candidates")
    seed_bytes = F.aggregate("seeds", F.lit(32).cast("long"), lambda n, s: n + (F.size(s["item_words"]) + F.size(s["begins"])) * 8 + 64)
    candidates = texts.join(broadcast_if_bytes(per_doc, seed_bytes), "doc_id").select("doc_id", "text", "seeds")
    found = candidates.mapInArrow(_aligned, "doc_id long, item_id long, score double, end_word long, item_words long")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", F.col("end_word"), "item_words")).alias("b")).select("doc_id", "item_id", F.round("b.score", 6).alias("score"), "b.end_word", "b.item_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    gone = written(contaminated(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "contaminated")
    return without_ids(docs, gone, gone.count(), id_col)


def op5_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
