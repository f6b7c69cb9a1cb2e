"""Near-duplicate groups: MinHash bands find candidates, odd sketches verify them.

Each document's set of word SHINGLE-grams gives K = BANDS * ROWS MinHash samples. A document whose words were edited
by a tenth still has a similarity of two thirds. Bands of ROWS samples are the search keys.
The samples, taken as a set of (index, value) pairs, are folded into a bitmap of BITS parities: adding an element
flips one bit, so the exclusive or of two bitmaps is the bitmap of their symmetric difference. With p the share of
bits set in it, the difference has about -BITS/2 * ln(1 - 2p) elements, and the similarity is one minus that over 2K.

No bucket is one task's burden. Buckets are counted by aggregates with partial ones before the shuffle. A bucket of more
than HOT documents is cut into blocks: all of its documents meet its first one, and those that aren't linked with it meet
every block of the bucket. So each pair in a bucket that the sketches verify is in one component, as if all had met.

Defined results: a row with a null id or text, or a text without words (an empty one), is in no group; fewer than SHINGLE
words are one shingle of them all; long texts are read whole; equal texts always meet; a repeated row counts as one
document; of a group the least id is kept; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from tallyweave.llm.common import id_text, table, without_ids
from tallyweave.llm.textgrams import FOLDED, between, blocks, mixed, slices
from tallyweave.operators.materialize import broadcast_if_small, written

SHINGLE, BANDS, ROWS, BITS, THRESHOLD = 2, 40, 5, 512, 0.6
HOT = 8192
BUCKET_BYTES, LEAD_BYTES = 32, 40 + BITS // 8

_rng = np.random.default_rng(20_240_607)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
SIGNATURE = "doc_id long, sig long, bands array<long>, sketch binary"
_SIGNATURE_ARROW = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def minhashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the texts that have words, one row of samples for each)."""
    which, rows = [], []
    for b in blocks(texts, FOLDED):
        at, h = b.grams(SHINGLE)
        owner = b.doc[at]
        short = np.flatnonzero((b.words > 0) & (b.words < SHINGLE))
        if len(short):
            whole = between(b.sums(), b.offset[short], b.offset[short + 1])
            owner, h = np.concatenate((owner, short)), np.concatenate((h, whole))
            order = np.argsort(owner, kind="stable")
            owner, h = owner[order], h[order]
        if not len(h):
            continue
        docs, first = np.unique(owner, return_index=True)
        least = np.empty((len(docs), BANDS * ROWS), dtype=np.uint64)
        x = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.multiply(h, _MULTIPLY[k], out=x)
            x += _ADD[k]
            least[:, k] = np.minimum.reduceat(x, first)
        which.append(docs + b.first)
        rows.append(least)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, BANDS * ROWS), dtype=np.uint64)
    return np.concatenate(which), np.concatenate(rows)


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches, a row of BITS / 64 words for each row of samples."""
    bit = mixed(samples ^ mixed(_ADD + np.arange(BANDS * ROWS, dtype=np.uint64))) % np.uint64(BITS)
    flat = (np.arange(len(samples), dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(samples) * BITS) & 1).astype(np.uint8).reshape(len(samples), BITS)
    return np.packbits(odd, axis=1).view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' exclusive or; a saturated one counts as 0."""
    left = np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9)
    return np.maximum(0, 1 + BITS * np.log(left) / (4 * BANDS * ROWS))


#: The largest population count that still means THRESHOLD.
MOST_BITS = int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= THRESHOLD)[-1])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in slices(batches):
        which, samples = minhashes(batch.column(1).to_pylist())
        if not len(which):
            continue
        bands = mixed((samples.reshape(-1, BANDS, ROWS) * weight).sum(axis=2, dtype=np.uint64))
        sig = mixed((bands * (mixed(np.arange(7, BANDS + 7, dtype=np.uint64)) | np.uint64(1))).sum(axis=1, dtype=np.uint64))
        bits = sketches(samples)
        ids = batch.column(0).take(pa.array(which))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(which) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sig.view(np.int64)), lists, pa.array([r.tobytes() for r in bits], type=pa.binary())], schema=_SIGNATURE_ARROW)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig, bands, sketch): one pass over the texts, no shuffle."""
    return id_text(docs, id_col, text_col).mapInArrow(_signed, SIGNATURE)


def _linked(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each document of a bucket, sorted by id, the least id that verified pairs link it with.

    A search from the least id outwards: each document found is compared with those not found yet. That settles every
    pair that matters to the links, in one sweep for a group whose members all resemble its first.
    """
    root, waiting = ids.copy(), np.arange(len(ids))
    while len(waiting):
        seed, waiting = waiting[0], waiting[1:]
        front = [seed]
        while front and len(waiting):
            one = front.pop()
            close = np.bitwise_count(bits[waiting] ^ bits[one]).sum(axis=1) <= MOST_BITS
            if close.any():
                found = waiting[close]
                root[found] = ids[seed]
                front.extend(found)
                waiting = waiting[~close]
    return root


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and part, then id, to the edges (doc_id, least linked id); a part may span batches.

    Batches are held until the part changes and are put together once.
    """
    held: list[pa.RecordBatch] = []

    def edges(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(batches).combine_chunks()
        keys = [t[c].to_numpy() for c in ("band", "bh", "part")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        ids = t["doc_id"].to_numpy()
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint64).reshape(len(ids), BITS // 64)
        src, dst = [], []
        for lo, hi in zip([0, *cut], [*cut, len(ids)]):
            if hi - lo == 2:
                if ids[lo] != ids[lo + 1] and int(np.bitwise_count(bits[lo] ^ bits[lo + 1]).sum()) <= MOST_BITS:
                    src.append(ids[lo + 1 : hi])
                    dst.append(ids[lo : lo + 1])
            elif hi - lo > 2:
                root = _linked(ids[lo:hi], bits[lo:hi])
                moved = root != ids[lo:hi]
                src.append(ids[lo:hi][moved])
                dst.append(root[moved])
        if not src:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    def last_key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(k)[at].as_py() for k in range(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        end = last_key(batch, batch.num_rows - 1)
        if last_key(batch, 0) == end:
            start = 0
        else:
            same = np.all([batch.column(k).to_numpy(zero_copy_only=False) == end[k] for k in range(3)], axis=0)
            start = int(np.flatnonzero(~same)[-1]) + 1
        if held and (start or last_key(held[-1], 0) != end):
            out = edges([*held, batch.slice(0, start)])
            held = []
            if out is not None:
                yield out
        elif start:
            out = edges([batch.slice(0, start)])
            if out is not None:
                yield out
        held.append(batch.slice(start))
    if held and (out := edges(held)) is not None:
        yield out


def _blocks_of(n: Column) -> Column:
    return F.ceil(n / HOT).cast("int")


@F.pandas_udf(BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="bool")
    x = np.frombuffer(b"".join(a), dtype=np.uint64) ^ np.frombuffer(b"".join(b), dtype=np.uint64)
    return pd.Series(np.bitwise_count(x).reshape(len(a), -1).sum(axis=1) <= MOST_BITS)


def _compared(members: DataFrame) -> DataFrame:
    """(src, dst) of (band, bh, part, doc_id, sketch), all documents of a part against each other."""
    rows = members.select("band", "bh", "part", "doc_id", "sketch").repartition("band", "bh", "part")
    return rows.sortWithinPartitions("band", "bh", "part", "doc_id").mapInArrow(_bucket_edges, "src long, dst long")


def _hot_edges(members: DataFrame, sketches_: DataFrame) -> DataFrame:
    """The edges of the buckets of more than HOT documents. ``members`` has (band, bh, n, lead, doc_id, sketch)."""
    buckets = members.groupBy("band", "bh").agg(F.first("lead").alias("lead"))
    leads = written(buckets.join(sketches_.select(F.col("doc_id").alias("lead"), F.col("sketch").alias("lead_sketch")), "lead").select("band", "bh", "lead_sketch"), "leads")
    met = members.join(broadcast_if_small(leads, leads.count(), LEAD_BYTES), ["band", "bh"])
    met = written(met.select("band", "bh", "n", "lead", "doc_id", "sketch", _verified("sketch", "lead_sketch").alias("close")), "met")
    star = met.filter("close and doc_id <> lead").select(F.col("doc_id").alias("src"), F.col("lead").alias("dst"))
    far = met.filter("not close").drop("close")
    left = written(far.groupBy("band", "bh").agg(F.count("*").alias("u")), "far")
    n_left = left.count()
    if not n_left:
        return star
    # each document that the first isn't linked with, in its block, beside each block of the whole bucket
    mine = lambda df: df.join(broadcast_if_small(left, n_left, BUCKET_BYTES), ["band", "bh"])
    rows, columns = _blocks_of(F.col("n")), _blocks_of(F.col("u"))
    block = lambda of, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), of).cast("int")
    all_ = mine(met.drop("close")).select("band", "bh", "doc_id", "sketch", block(rows, 1).alias("i"), columns.alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    some = mine(far).select("band", "bh", "doc_id", "sketch", block(columns, 2).alias("j"), columns.alias("k"), rows.alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("i"))
    pairs = all_.select("band", "bh", "doc_id", "sketch", "i", "j", "k").unionByName(some.select("band", "bh", "doc_id", "sketch", "i", "j", "k"))
    return star.unionByName(_compared(pairs.withColumn("part", F.col("i") * F.col("k") + F.col("j"))))


def verified_edges(signed: DataFrame) -> DataFrame:
    """(src, dst), dst < src: spanning edges, inside each band bucket, of the pairs that the sketches verify.

    ``signed`` has one row for each distinct signature. Bucket keys and ids shuffle first; only documents that share
    a bucket bring their sketch along.
    """
    keys = signed.select("doc_id", F.posexplode("bands").alias("band", "bh"))
    buckets = written(keys.groupBy("band", "bh").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).filter("n > 1"), "buckets")
    n_buckets, largest = buckets.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    shared = keys.join(broadcast_if_small(buckets, n_buckets, BUCKET_BYTES), ["band", "bh"])
    members = shared.join(signed.select("doc_id", "sketch"), "doc_id")
    if largest <= HOT:
        return _compared(members.withColumn("part", F.lit(0))).distinct()
    members = written(members, "members")
    few = _compared(members.filter(F.col("n") <= HOT).withColumn("part", F.lit(0)))
    return few.unionByName(_hot_edges(members.filter(F.col("n") > HOT), signed)).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(doc_id, root) for every vertex of ``edges``: root is the least id of its connected component.

    Alternates two star steps (each vertex's larger neighbours, then its smaller ones, move to its least neighbour)
    until nothing changes. Each round is written to the shared folder, so no lineage builds up.
    """
    edges = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        edges = written(small.distinct(), name)
        n, total, high = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.max("dst")).first()
        if (n, total, high) == before:
            return edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("root"))
        before = (n, total, high)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id, similarity) for every document of a group but its first; kept_id is the group's least id.

    Documents with one signature form a class and its least id stands for them, so copies by the thousand cost one
    row in each bucket. similarity is the sketch estimate against kept_id; a document can be in the group through
    others, so it may be below THRESHOLD.
    """
    signed = written(signatures(docs, id_col, text_col), "signatures")
    classes = signed.groupBy("sig").agg(F.min("doc_id").alias("lead"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch"))
    leads = written(classes, "classes")
    edges = verified_edges(leads.select(F.col("lead").alias("doc_id"), "bands", "sketch"))
    roots = components(edges)
    same = signed.select("doc_id", "sig").distinct().join(leads.select("sig", "lead"), "sig").filter("doc_id <> lead").select(F.col("doc_id").alias("src"), F.col("lead").alias("dst"))
    found = roots.select(F.col("doc_id").alias("src"), F.col("root").alias("dst"))
    # a class member goes where its lead goes
    lifted = same.join(found.select(F.col("src").alias("dst"), F.col("dst").alias("up")), "dst", "left").select("src", F.coalesce("up", "dst").alias("dst"))
    groups = written(lifted.unionByName(found).groupBy("src").agg(F.min("dst").alias("dst")), "groups")
    bits = signed.groupBy("doc_id").agg(F.min("sketch").alias("sketch"))
    pairs = groups.join(bits.select(F.col("doc_id").alias("src"), F.col("sketch").alias("a")), "src").join(bits.select(F.col("doc_id").alias("dst"), F.col("sketch").alias("b")), "dst")
    return pairs.select(F.col("src").alias("doc_id"), F.col("dst").alias("kept_id"), _estimate("a", "b").alias("similarity"))


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), dtype=np.uint64) ^ np.frombuffer(b"".join(b), dtype=np.uint64)
    return pd.Series(similarity(np.bitwise_count(x).reshape(len(a), -1).sum(axis=1)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the later documents of each near-duplicate group."""
    gone = written(near_duplicates(docs, id_col, text_col).select("doc_id"), "near")
    return without_ids(docs, gone, gone.count(), id_col)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
