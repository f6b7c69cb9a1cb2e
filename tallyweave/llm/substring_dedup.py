"""Repeated passages: matching statistics against suffix automata of reference shards.

A run of at least MIN_WORDS words of a document that also occurs in a document of a smaller id is removed; runs that
touch merge, so what goes are the maximal spans, and the first document with a passage keeps it.

Any such run holds, at the same place in both documents, an anchor: of the K-word grams in a window of MIN_WORDS words
the one with the least hash. Anchors meet by hash, each with the context its runs can lie in (MIN_WORDS - K words
on either side of it). A context equal to one of an earlier document is repeated as a whole. The other contexts of an
anchor that several documents share are its reference shard: an automaton of those read so far, in the order of
document ids, gives each word the length of the longest match ending there (its matching statistic), then takes the
context in. So automata are as small as their shard, no shard is matched against documents that can't match it, and
work grows with the input. (One automaton of a whole shard of the corpus, broadcast against every document, would grow
with its square.)

No anchor is one task's burden. Which anchors are shared, and which document is a context's first, are grouped
aggregates with partial ones before the shuffle; rows then meet those results in joins whose other side has one row a
key, so adaptive execution can split a hot key. An anchor with more than HOT different contexts has no automaton:
its contexts lie one on another at the anchor, so a run of MIN_WORDS words around it is one of MIN_WORDS - K + 1 windows,
and the least document of each window's hash says who had it first, by aggregates again. The spans are the same.

Words are separated by white space; case and punctuation count. Defined results: null ids and texts and texts of fewer
than MIN_WORDS words (empty ones too) lose nothing; long texts are read whole, in time in proportion to their length; a
passage that repeats only inside one document stays, as do repeated rows of one id; of documents with a passage the least
id keeps it; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import id_text, table
from tallyweave.llm.textgrams import SPACES, between, blocks, slices, sliding_argmin
from tallyweave.operators.materialize import broadcast_if_bytes, broadcast_if_small, written

MIN_WORDS, K, HOT = 50, 10, 1024
ANCHOR_BYTES, CONTEXT_BYTES, SPAN_BYTES = 24, 40, 64


class SuffixAutomaton:
    """Automaton of the substrings of several word sequences. A break between them is a return to the initial state."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def restart(self) -> None:
        self.last = 0

    def extend(self, word: str) -> None:
        nexts, link, length, p = self.next, self.link, self.length, self.last
        q = nexts[p].get(word)
        if q is not None:  # a word that this sequence has in common with an earlier one
            if length[q] == length[p] + 1:
                self.last = q
            else:
                self.last = self._clone(p, q, word)
            return
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        self.last = cur

    def _clone(self, p: int, q: int, word: str) -> int:
        nexts, link = self.next, self.link
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = copy
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[str]) -> list[int]:
        """For each word the length of the longest run ending there that occurs in a sequence taken in."""
        nexts, link, length = self.next, self.link, self.length
        out, state, matched = [], 0, 0
        for w in words:
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(w)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def runs(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Word ranges covered by matches of at least ``least`` words, merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= least:
            lo = end - n
            while out and out[-1][1] >= lo:
                lo = min(lo, out.pop()[0])
            out.append((lo, end))
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "context", "doc_id", "lo", "hi"]
    reach, window = MIN_WORDS - K, MIN_WORDS - K + 1
    for batch in slices(batches):
        for b in blocks(batch.column(1).to_pylist(), SPACES):
            at, h = b.grams(K)
            if len(at) < window:
                continue
            best = sliding_argmin(h, window)
            same = b.doc[at[: len(best)]] == b.doc[at[window - 1 :]]
            pick = np.unique(best[same])
            if not len(pick):
                continue
            pos, d = at[pick], b.doc[at[pick]]
            lo, hi = np.maximum(pos - reach, b.offset[d]), np.minimum(pos + MIN_WORDS, b.offset[d + 1])
            # where the anchor lies in its context counts too
            context = between(b.sums(), lo, hi) ^ ((pos - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = batch.column(0).take(pa.array(d + b.first))
            yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(context.view(np.int64)), ids, pa.array((lo - b.offset[d]).astype(np.int32)), pa.array((hi - b.offset[d]).astype(np.int32))], names=names)


_PARTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("los", pa.list_(pa.int32())), ("words", pa.string()), ("gram", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, few, many), both [(anchor, los, n)], to (anchor, doc_id, los, words, gram).

    Of ``few`` come the words of each context, of ``many`` the hashes of the windows of MIN_WORDS words in it.
    """
    for batch in slices(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, few, many in zip(*(c.to_pylist() for c in batch.columns)):
            words = _words(text) if few else []
            for w in few:
                lo = w["los"][0]
                for column, value in zip(out, (w["anchor"], doc, w["los"], " ".join(words[lo : lo + w["n"]]), None)):
                    column.append(value)
            sums = next(blocks([text], SPACES)).sums() if many else None
            for w in many:
                for lo in w["los"]:
                    at = np.arange(lo, lo + w["n"] - MIN_WORDS + 1)
                    for a, gram in zip(at.tolist(), between(sums, at, at + MIN_WORDS).view(np.int64).tolist()):
                        for column, value in zip(out, (w["anchor"], doc, [a], None, gram)):
                            column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARTS)], schema=_PARTS)


_BLANKS = str.maketrans("\t\n\f\r", "    ")


def _words(text: str) -> list[str]:
    """The words as SPACES separates them."""
    return [w for w in text.translate(_BLANKS).split(" ") if w]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, then document, to the spans (doc_id, lo, hi) that an earlier document has."""
    shard, doc, automaton, waiting = None, None, SuffixAutomaton(), []
    for batch in batches:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for anchor, doc_id, los, text in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != shard:
                shard, doc, automaton, waiting = anchor, doc_id, SuffixAutomaton(), []
            if doc_id != doc:
                for words in waiting:
                    automaton.restart()
                    for w in words:
                        automaton.extend(w)
                doc, waiting = doc_id, []
            words = text.split(" ")
            lengths = automaton.statistics(words) if len(automaton.next) > 1 else [0]
            for a, b in runs(lengths, MIN_WORDS):
                for lo in los:
                    for column, value in zip(out, (doc_id, lo + a, lo + b)):
                        column.append(value)
            if lengths[-1] < len(words):  # only one match over all of it adds nothing; touching ones leave out their join
                waiting.append(words)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["doc_id", "lo", "hi"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi): word ranges of each document that a document of a smaller id has too, not yet merged."""
    texts = id_text(docs, id_col, text_col)
    rows = written(texts.mapInArrow(_anchors, "anchor long, context long, doc_id long, lo int, hi int"), "anchors")
    of_anchor = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("context") != F.max("context")).alias("mixed"))
    shared = written(of_anchor.filter("a < b").select("anchor", "mixed"), "shared")
    met = written(rows.join(broadcast_if_small(shared, shared.count(), ANCHOR_BYTES), "anchor"), "met")
    contexts = written(met.groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "contexts")
    placed = met.join(broadcast_if_small(contexts, contexts.count(), CONTEXT_BYTES), ["anchor", "context"])
    whole = placed.filter("doc_id > first").select("doc_id", "lo", "hi")
    open_ = placed.filter("doc_id = first and mixed")
    # a document of one repeated word has the same context at every word: it is matched once
    alike = open_.repartition("doc_id").groupBy("doc_id", "anchor", "context").agg(F.sort_array(F.collect_set("lo")).alias("los"), F.first(F.col("hi") - F.col("lo")).alias("n"))
    hot = written(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    n_hot = hot.count()
    alike = alike.join(broadcast_if_small(hot, n_hot, ANCHOR_BYTES), "anchor", "left")
    wanted = alike.groupBy("doc_id").agg(*(F.collect_list(F.when(F.coalesce("hot", F.lit(False)) == is_hot, F.struct("anchor", "los", "n"))).alias(name) for name, is_hot in (("few", False), ("many", True))))
    parts = texts.join(wanted, "doc_id").select("doc_id", "text", "few", "many").mapInArrow(_cut, "anchor long, doc_id long, los array<int>, words string, gram long")
    parts = written(parts, "parts") if n_hot else parts
    cut = parts.filter("words is not null").select("anchor", "doc_id", "los", "words")
    spans = whole.unionByName(cut.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_matched, "doc_id long, lo int, hi int"))
    if n_hot:
        windows = parts.filter("gram is not null").select("anchor", "gram", "doc_id", F.get("los", F.lit(0)).alias("lo"))
        firsts = windows.groupBy("anchor", "gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
        again = windows.join(firsts, ["anchor", "gram"]).filter("doc_id > first")
        spans = spans.unionByName(again.select("doc_id", "lo", (F.col("lo") + MIN_WORDS).alias("hi")))
    return written(spans.distinct(), "spans")


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): per document its ranges in order, merged where they touch or overlap."""
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    fresh = F.when(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    parts = spans.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(w))
    each = parts.groupBy("doc_id", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the text without the words of the spans, each with the blanks before it."""
    import re

    word = re.compile(r"[^\t\n\f\r ]+")
    schema = pa.schema([("doc_id", pa.int64()), ("n_spans", pa.int32()), ("removed_words", pa.int64()), ("spans", pa.string()), ("clean_text", pa.string())])
    for batch in slices(batches):
        rows = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            ends = [m.end() for m in word.finditer(text)]
            kept, at = [], 0
            for s in spans:
                kept.append(text[at : ends[s["lo"] - 1] if s["lo"] else 0])
                at = ends[s["hi"] - 1]
            rows.append((doc, len(spans), sum(s["hi"] - s["lo"] for s in spans), " ".join(f"{s['lo']}-{s['hi']}" for s in spans), "".join([*kept, text[at:]])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_spans, removed_words, spans, clean_text) of the documents that lose a passage; the others stay as they are.

    spans lists word ranges as ``lo-hi``, hi excluded.
    """
    spans = repeated_spans(docs, id_col, text_col)
    gone = written(merged(spans), "merged")
    texts = id_text(docs, id_col, text_col).join(broadcast_if_bytes(gone, F.size("spans") * 16 + SPAN_BYTES), "doc_id").select("doc_id", "text", "spans")
    return texts.mapInArrow(_removed, "doc_id long, n_spans int, removed_words long, spans string, clean_text string").distinct()


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
     t AS (SELECT doc_id, text, regexp_extract_all(text, '[\t\n\f\r ]*[^\t\n\f\r ]+') AS tokens FROM d),
     w AS (SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM t),
     b AS (SELECT doc_id, pos, token, regexp_replace(token, '^[\t\n\f\r ]+', '') AS word FROM w),
     g AS (SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS gram,
                  count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM b),
     f AS (SELECT gram, min(doc_id) AS first_id FROM g WHERE n = 50 GROUP BY gram),
     hit AS (SELECT g.doc_id, g.pos FROM g JOIN f USING (gram) WHERE g.n = 50 AND g.doc_id > f.first_id),
     cover AS (SELECT b.doc_id, b.pos, b.token, max(h.pos) OVER (PARTITION BY b.doc_id ORDER BY b.pos ROWS UNBOUNDED PRECEDING) AS latest
               FROM b LEFT JOIN hit h ON h.doc_id = b.doc_id AND h.pos = b.pos WHERE b.doc_id IN (SELECT doc_id FROM hit)),
     c AS (SELECT doc_id, pos, token, coalesce(pos < latest + 50, false) AS gone FROM cover),
     i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS island FROM c),
     s AS (SELECT doc_id, min(pos) AS lo, max(pos) + 1 AS hi FROM i WHERE gone GROUP BY doc_id, island),
     l AS (SELECT doc_id, count(*)::INTEGER AS n_spans, sum(hi - lo)::BIGINT AS removed_words, string_agg(lo || '-' || hi, ' ' ORDER BY lo) AS spans FROM s GROUP BY doc_id),
     k AS (SELECT doc_id, coalesce(string_agg(token, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT l.doc_id, n_spans, removed_words, spans, kept || regexp_extract(d.text, '[\t\n\f\r ]*$') AS clean_text FROM l JOIN k USING (doc_id) JOIN d USING (doc_id)
"""
