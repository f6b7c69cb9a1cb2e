"""TF-IDF search over texts, and the lookups of a metadata service."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.materialize import BROADCAST_BYTES, written

LEAST_SCORE = 0.01
#: By how much scores may differ that are equal when rounded.
SLACK = 2e-9


def _folds() -> tuple[str, str]:
    """Letters with marks, and what they are without: what NFKD, dropping marks and case folding give, where that is one letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).casefold()
        if len(bare) == 1 and bare != chr(code) and bare.isalpha():
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


_FROM, _TO = _folds()
_MARKS = r"[̀-ͯ]"
_FOLDED = str.maketrans(_FROM, _TO) | dict.fromkeys(range(0x300, 0x370)) | {ord("ß"): "ss"}
_OUTSIDE = r"[^\pL\pN\x{300}-\x{36f}]+"


def folded(text: Column) -> Column:
    """Lower case without accents, by built-ins: Latin letters are mapped, loose marks dropped, sharp s doubled."""
    return F.replace(F.translate(F.lower(F.regexp_replace(text, _MARKS, "")), _FROM, _TO), F.lit("ß"), F.lit("ss"))


def terms(text: Column) -> Column:
    """Runs of at least two letters or digits."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def _bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of texts, by row and term: the terms of ``terms`` as hashes.

    Texts are cut in Arrow; only the different runs of letters, digits and marks are folded, and each is one term.
    """
    runs = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(text, "")), pattern=_OUTSIDE)
    words = runs.flatten().dictionary_encode()
    shown = np.array(words.dictionary.to_pylist(), dtype=object)
    for k in np.flatnonzero(~pc.string_is_ascii(words.dictionary).to_numpy(zero_copy_only=False)):
        shown[k] = shown[k].translate(_FOLDED)
    long = np.fromiter(map(len, shown), np.int64, len(shown)) > 1
    row = np.repeat(np.arange(len(text)), np.diff(runs.offsets.to_numpy()))
    pairs, count = np.unique(row * max(len(shown), 1) + words.indices.to_numpy(), return_counts=True)
    row, at = np.divmod(pairs, max(len(shown), 1))
    row, term, count = row[long[at]], (hash_array(shown, categorize=False).view(np.int64) if len(shown) else np.zeros(0, np.int64))[at[long[at]]], count[long[at]]
    by = np.lexsort((term, row))
    row, term, count = row[by], term[by], count[by]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    start = np.flatnonzero(first)
    return row[start], term[start], np.add.reduceat(count, start) if len(start) else count


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to 1,024 rows at a time, fewer of long texts."""
    for batch in batches:
        size = max(1, min(1024, batch.num_rows * (16 << 20) // max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each part of the texts."""
    for part in _parts(batches):
        term, count = np.unique(_bags(part.column(0))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, term, qtf) of queries."""
    for part in _parts(batches):
        row, term, count = _bags(part.column(1))
        share = count / np.bincount(row, count, part.num_rows)[row]
        yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy(zero_copy_only=False)[row]), pa.array(term), pa.array(share)], names=["query_id", "term", "qtf"])


def search(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc, score, rank): the k best documents of each query by TF-IDF cosine.

    tf is a term's share of its text, idf ln((N+1)/(df+1)) + 1; scores under LEAST_SCORE are left out; ties go to the
    smaller document. ``queries`` has query_id and query, both of whole numbers and text; ``doc`` is a key.

    The texts are read twice; the vocabulary is written and kept documents shuffle, with their rare terms. The first pass
    counts documents by term. In the second each task scores its documents and keeps those that may be among the k best
    of a query; only those shuffle. Of the vocabulary the commonest terms go to the executors, as many as fit
    BROADCAST_BYTES; the others, which bound a document's norm from both sides, travel with the documents that are kept
    and are joined with their counts there. Queries go out in as many blocks as fit BROADCAST_BYTES.
    """
    n = docs.count()
    df = written(docs.select(F.col(text)).mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "df")
    idf = F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1
    qtf = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query")).mapInArrow(_query_terms, "query_id long, term long, qtf double")
    qw = written(qtf.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("qw"), idf.alias("idf")), "qw")
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    least = _least_known(df)
    vocabulary = df.filter(F.col("df") >= least).toArrow()
    order = np.argsort(vocabulary["term"].to_numpy())
    known = (vocabulary["term"].to_numpy()[order], np.log((n + 1) / (vocabulary["df"].to_numpy()[order] + 1)) + 1)
    rest = (np.log((n + 1) / least) + 1, np.log((n + 1) / 2) + 1)  # the idf of the commonest and of the rarest term that isn't known
    shared = rows.sparkSession.sparkContext.broadcast(known)
    blocks = -(-qw.count() * 32 // BROADCAST_BYTES) or 1
    kept = [_candidates(rows, shared, rest, qw.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    if least > 2:
        rare = found.select("query_id", "doc", "dot", "norm2", F.explode_outer("rare").alias("r")).select("query_id", "doc", "dot", "norm2", F.col("r.term").alias("term"), F.col("r.tf").alias("tf"))
        added = F.coalesce(F.sum((F.col("tf") * idf) * (F.col("tf") * idf)), F.lit(0.0))
        found = rare.join(df, "term", "left").groupBy("query_id", "doc", "dot", "norm2").agg(added.alias("added")).withColumn("norm2", F.col("norm2") + F.col("added"))
    scored = found.select("query_id", "doc", (F.col("dot") / F.sqrt("norm2")).alias("score")).filter(F.col("score") >= LEAST_SCORE)
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("doc").alias(doc), F.round("score", 6).alias("score"), "rank")


def _least_known(df: DataFrame) -> int:
    """The document count from which terms are broadcast: a power of two, the least under which they fit. It is 2 at
    least, since a term that isn't known then has one document."""
    sizes = {r["b"]: r["n"] for r in df.groupBy(F.floor(F.log2("df")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    b = 1
    while sum(n for at, n in sizes.items() if at >= b) * 16 > BROADCAST_BYTES:
        b += 1
    return 1 << b


def _best(rows: np.ndarray, k: int, kth: np.ndarray) -> np.ndarray:
    """The candidates that stay; ``kth`` rises to the k-th best sure score of each query.

    A row goes if k others are surely better. Of documents with equal terms only the k smallest stay.
    """
    rows = rows[np.lexsort((rows["doc"], rows["sign"], rows["norm2"], rows["dot"], rows["q"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("q", "dot", "norm2", "sign")])
    rows = rows[np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) < k]
    rows = rows[np.lexsort((rows["doc"], -np.round(rows["low"], 9), rows["q"]))]
    rank = np.arange(len(rows)) - np.searchsorted(rows["q"], rows["q"])
    last = rank == k - 1
    kth[rows["q"][last]] = np.maximum(kth[rows["q"][last]], rows["low"][last])
    # where all scores are sure, the order is the final one
    return rows[rank < k if np.array_equal(rows["up"], rows["low"]) else rows["up"] >= kth[rows["q"]] - SLACK]


def _candidates(rows: DataFrame, shared: Broadcast, rest: tuple[float, float], qw: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, dot, norm2, rare): each task's candidates. ``dot`` has the query's norm in it, ``norm2`` lacks the terms in ``rare``."""
    q = qw.toArrow()
    ids, at = np.unique(q["query_id"].to_numpy(), return_inverse=True)
    norm = np.sqrt(np.bincount(at, q["qw"].to_numpy() ** 2, len(ids)))
    by_term = np.argsort(q["term"].to_numpy(), kind="stable")
    weight = q["qw"].to_numpy()[by_term] / norm[at[by_term]] if len(at) else np.zeros(0)
    asked = rows.sparkSession.sparkContext.broadcast((ids, q["term"].to_numpy()[by_term], at[by_term], weight, q["idf"].to_numpy()[by_term]))
    below, above = rest
    kind = np.dtype([("q", np.int32), ("doc", np.int64), ("dot", float), ("norm2", float), ("up", float), ("low", float), ("sign", np.uint64)])
    width = 1024

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, idf), (ids, q_term, q_at, q_weight, q_idf) = shared.value, asked.value
        kth = np.full(len(ids), LEAST_SCORE)
        held, rare = np.zeros(0, dtype=kind), {}
        waiting: list[np.ndarray] = []

        def settle() -> None:
            nonlocal held, rare
            held = _best(np.concatenate([held, *waiting]), k, kth)
            waiting.clear()
            rare = {d: rare[d] for d in set(held["doc"].tolist()) if d in rare}

        for part in _parts(batches) if len(ids) else ():
            docs = part.column(0).to_numpy()
            owner, term, count = _bags(part.column(1))
            length = np.bincount(owner, count, len(docs))
            tf = count / length[owner]
            place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            found = known[place] == term if len(known) else np.zeros(len(term), dtype=bool)
            unsure = ~found if below < above else np.zeros(len(term), dtype=bool)
            w = tf * (np.where(found, idf[place], above) if len(known) else above)
            norm2 = np.bincount(owner, np.where(unsure, 0.0, w * w), len(docs))
            loose = np.bincount(owner, np.where(unsure, tf * tf, 0.0), len(docs))
            sign = np.zeros(len(docs), dtype=np.uint64)
            np.add.at(sign, owner[unsure], term[unsure].view(np.uint64) * count[unsure].astype(np.uint64))
            sign ^= length.astype(np.uint64)
            lo, hi = np.searchsorted(q_term, term, "left"), np.searchsorted(q_term, term, "right")
            times = hi - lo
            hit = np.repeat(np.arange(len(term)), times)
            post = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            value, cell = tf[hit] * q_idf[post] * q_weight[post], owner[hit]
            lowest, highest = np.sqrt(norm2 + loose * below * below), np.sqrt(norm2 + loose * above * above)
            for block in range(0, len(ids), width):
                m = min(width, len(ids) - block)
                mine = (q_at[post] >= block) & (q_at[post] < block + m) if len(ids) > width else slice(None)
                dot = np.bincount((q_at[post][mine] - block) * len(docs) + cell[mine], value[mine], m * len(docs)).reshape(m, len(docs))
                qs, ds = np.nonzero((dot > 0) & (dot >= (kth[block : block + m, None] - SLACK) * lowest))
                if len(qs):
                    made = np.zeros(len(qs), dtype=kind)
                    for c, v in (("q", qs + block), ("doc", docs[ds]), ("dot", dot[qs, ds]), ("norm2", norm2[ds]), ("sign", sign[ds])):
                        made[c] = v
                    made["up"], made["low"] = made["dot"] / lowest[ds], made["dot"] / highest[ds]
                    waiting.append(made)
                    for d in np.unique(ds[loose[ds] > 0]):
                        mine_too = np.arange(*np.searchsorted(owner, (d, d + 1)))
                        mine_too = mine_too[unsure[mine_too]]
                        rare[int(docs[d])] = (term[mine_too], tf[mine_too])
            if sum(map(len, waiting)) > 4 * k * len(ids) + 10_000:
                settle()
        settle()
        for first in range(0, len(held), 1024):
            some = held[first : first + 1024]
            lists = [[{"term": t, "tf": x} for t, x in zip(*(v.tolist() for v in rare[d]))] if d in rare else [] for d in some["doc"].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some["q"]]), pa.array(some["doc"]), pa.array(some["dot"]), pa.array(some["norm2"]), pa.array(lists, pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.float64())])))], names=["query_id", "doc", "dot", "norm2", "rare"])

    return rows.mapInArrow(scored, "query_id long, doc long, dot double, norm2 double, rare array<struct<term:long,tf:double>>")


def lookup(names: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each wanted name: the first matching row of ``table``, or found = false."""
    first = table.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rn = 1").drop("_rn")
    return names.join(first, key, "left").withColumn("found", F.col(order).isNotNull())


def context(table: DataFrame, names: DataFrame, column: str, order: str, around: int) -> DataFrame:
    """(wanted, rows of ``table``): for each wanted name (the one column of ``names``) its first row and the neighbours in order.

    ``order`` holds whole numbers. Each wanted place is 2 * around + 1 keys of an equi-join, so nothing is compared pairwise.
    """
    at = table.join(names.toDF("wanted").distinct(), F.col(column) == F.col("wanted")).groupBy("wanted").agg(F.min(order).alias("_at"))
    keys = at.select("wanted", F.explode(F.sequence(F.col("_at") - around, F.col("_at") + around)).alias("_key"))
    return table.join(keys, F.col(order) == F.col("_key")).select("wanted", *table.columns)


def suggestions(table: DataFrame, column: str, wanted: DataFrame, most: int = 5) -> DataFrame:
    """(wanted, name, rank): for each wanted name (the one column of ``wanted``) the names that contain it, lie in it or
    begin alike (5 letters), whatever the case, the nearest in length first, then by name; ``most`` of them.

    Names are short: each stands with all its parts, so that containment is an equi-join and not every pair.
    """
    parts = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda a: F.transform(F.sequence(F.lit(1), F.char_length(c) - a + 1), lambda n: F.substring(c, a, n))))
    names = table.select(F.col(column).alias("name"), F.lower(column).alias("low")).filter("low <> ''").distinct()
    asked = wanted.toDF("wanted").select("wanted", F.lower("wanted").alias("low")).filter("low <> ''").distinct()
    head = F.substring("low", 1, 5)
    keyed = lambda df, name, keys: df.select(name, F.explode(F.array_distinct(keys)).alias("key"))
    inside = keyed(names, "name", parts(F.col("low"))).join(asked.withColumnRenamed("low", "key"), "key")
    around = names.withColumnRenamed("low", "key").join(keyed(asked, "wanted", parts(F.col("low"))), "key")
    alike = names.withColumn("key", head).join(asked.select("wanted", head.alias("key")), "key")
    met = inside.select("wanted", "name").unionByName(around.select("wanted", "name")).unionByName(alike.select("wanted", "name")).distinct()
    nearest = Window.partitionBy("wanted").orderBy(F.abs(F.char_length("name") - F.char_length("wanted")), "name")
    return met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= most)


def choice_lists_report(choices: DataFrame, questions: DataFrame, shown: int = 50) -> DataFrame:
    """A row for each list: its options, negative codes and the variables that use it (``shown`` of them, a report's limit)."""
    options = choices.groupBy("list_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value", "label"))), lambda r: F.struct(r["value"].alias("value"), r["label"].alias("label"))).alias("choices"))
    using = questions.groupBy(F.col("choice_list").alias("list_name")).agg(F.count("*").alias("n_variables"), F.slice(F.array_sort(F.collect_list("variable_name")), 1, shown).alias("variables"))
    negative = F.filter(F.transform("choices", lambda c: c["value"]), lambda v: v.startswith("-"))
    return options.join(using, "list_name", "left").select("list_name", "choices", negative.alias("special_codes"), F.coalesce("n_variables", F.lit(0)).alias("n_variables"), "variables")


def choice_list(choices: DataFrame, questions: DataFrame, name: str, shown: int = 50) -> DataFrame:
    """One row: the report of the list called ``name``."""
    return choice_lists_report(choices.filter(F.col("list_name") == name), questions.filter(F.col("choice_list") == name), shown)


def surveys(table: DataFrame, column: str, part: str) -> DataFrame:
    """The rows whose survey key contains ``part``, whatever its case; all of them if it is blank."""
    return table.filter(F.lower(column).contains(part.lower())) if part else table
