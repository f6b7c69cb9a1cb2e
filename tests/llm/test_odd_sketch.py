import numpy as np

from tallyweave.llm import odd_sketch
from tests.llm.helpers import awkward, docs, edited, prose


def shingles(text):
    w = text.lower().split()
    n = odd_sketch.SHINGLE
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


def test_recall_and_precision_against_all_pairs(spark):
    rows, k = [], 0
    for seed in range(40):
        base = prose(seed, 120)
        rows.append((k, base))
        k += 1
        for j, share in enumerate((0.01, 0.03, 0.08, 0.3)):
            rows.append((k, edited(base, seed * 10 + j, share)))
            k += 1
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= odd_sketch.THRESHOLD + 0.08]
    far = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) < odd_sketch.THRESHOLD - 0.15}
    want = groups(near)
    got = {r["doc_id"]: r["kept_id"] for r in odd_sketch.near_duplicates(docs(spark, rows)).collect()}
    assert sum(got.get(d) == r for d, r in want.items()) >= 0.9 * len(want)
    assert sum((r, d) in far for d, r in got.items()) <= 0.02 * len(got)


def test_sketch_estimates_high_similarities():
    base = prose(3, 400)
    errors = []
    for share in (0.01, 0.02, 0.04, 0.06):
        other = edited(base, 5, share)
        _, samples = odd_sketch.minhashes([base, other])
        bits = odd_sketch.sketches(samples)
        estimate = float(odd_sketch.similarity(np.bitwise_count(bits[0] ^ bits[1]).sum()))
        errors.append(abs(estimate - jaccard(shingles(base), shingles(other))))
    assert max(errors) < 0.15
    assert odd_sketch.similarity(np.array(0)) == 1


def test_awkward(spark):
    d = awkward(spark)
    assert sorted((r["doc_id"], r["kept_id"], round(r["similarity"], 6)) for r in odd_sketch.near_duplicates(d).collect()) == [(5, 4, 1.0)]
    kept = odd_sketch.keep_first(d)
    assert kept.columns == d.columns
    assert kept.filter("doc_id is null").count() == 2 and kept.filter("doc_id = 5").count() == 0


def test_empty_table(spark):
    assert odd_sketch.near_duplicates(docs(spark, [])).count() == 0


def test_large_group_and_chain(spark):
    base = prose(8, 100)
    rows = [(i, edited(base, i, 0.01)) for i in range(300)] + [(1000 + i, prose(100 + i, 80)) for i in range(20)] + [(2000, "one"), (2001, "One.")]
    got = {r["doc_id"]: r["kept_id"] for r in odd_sketch.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {2001: 2000}


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (5, 3), (6, 9), (20, 10), (30, 20), (40, 30), (50, 40)]
    got = {r["doc_id"]: r["root"] for r in odd_sketch.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == groups(edges)


def test_links_are_the_components_of_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ids = np.arange(40)
        bits = rng.integers(0, 1 << 63, (40, odd_sketch.BITS // 64), dtype=np.uint64)
        for k in range(1, 40):  # some differ from an earlier one in about as many bits as are allowed
            if rng.random() < 0.7:
                flips = np.zeros(odd_sketch.BITS, dtype=np.uint8)
                flips[rng.choice(odd_sketch.BITS, odd_sketch.MOST_BITS + rng.integers(-30, 3), replace=False)] = 1
                bits[k] = bits[rng.integers(0, k)] ^ np.packbits(flips).view(np.uint64)
        pairs = [(a, b) for a in range(40) for b in range(a) if np.bitwise_count(bits[a] ^ bits[b]).sum() <= odd_sketch.MOST_BITS]
        want = groups(pairs)
        assert odd_sketch._linked(ids, bits).tolist() == [want.get(i, i) for i in range(40)]


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """One bucket of 160 documents, chains included, cut into blocks of 8, and whole: the components of all pairs."""
    rng = np.random.default_rng(3)
    n = 160
    bits = rng.integers(0, 1 << 63, (n, odd_sketch.BITS // 64), dtype=np.uint64)
    for k in range(1, n):
        if rng.random() < 0.8:
            flips = np.zeros(odd_sketch.BITS, dtype=np.uint8)
            flips[rng.choice(odd_sketch.BITS, odd_sketch.MOST_BITS - rng.integers(0, 40), replace=False)] = 1
            bits[k] = bits[0 if rng.random() < 0.4 else rng.integers(0, k)] ^ np.packbits(flips).view(np.uint64)
    want = groups([(a, b) for a in range(n) for b in range(a) if np.bitwise_count(bits[a] ^ bits[b]).sum() <= odd_sketch.MOST_BITS])
    signed = spark.createDataFrame([(k, [7, k % 5], bytearray(bits[k].tobytes())) for k in range(n)], "doc_id long, bands array<long>, sketch binary")
    assert len(want) > 60
    for hot in (8, 30, 8192):
        monkeypatch.setattr(odd_sketch, "HOT", hot)
        assert {r["doc_id"]: r["root"] for r in odd_sketch.components(odd_sketch.verified_edges(signed)).collect() if r["doc_id"] != r["root"]} == want


def test_a_bucket_over_many_batches(spark, monkeypatch):
    """Batches of two rows give the same edges as one."""
    import pyarrow as pa

    rows = sorted((b, h, 0, d) for d in range(40) for b, h in ((0, d % 3), (1, 5)))
    bits = [bytes([d % 2] * (odd_sketch.BITS // 8)) for *_, d in rows]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] + [pa.array(bits, pa.binary())], names=["band", "bh", "part", "doc_id", "sketch"])
    edges = lambda batches: sorted((s, t) for b in odd_sketch._bucket_edges(iter(batches)) for s, t in zip(*(c.to_pylist() for c in b.columns)))
    assert edges([whole.slice(k, 2) for k in range(0, whole.num_rows, 2)]) == edges([whole]) != []
    assert edges([whole.slice(k, 7) for k in range(0, whole.num_rows, 7)]) == edges([whole])


def test_columns_that_differ_in_case(spark):
    d = docs(spark, [(1, "a b c d e"), (2, "a b c d e")]).withColumnRenamed("lang", "Text")
    kept = odd_sketch.keep_first(d)
    assert kept.columns == d.columns and [r[0] for r in kept.collect()] == [1]
