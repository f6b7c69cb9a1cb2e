import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate
from tests.llm.helpers import awkward, docs, edited, prose


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def items(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, doc_id long")


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(80):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 30))
        assert decontaminate.align(a, b)[0] == smith_waterman(list(a), list(b))


def test_copies_edits_and_clean_documents(spark):
    bench = [(k, prose(k, 40)) for k in range(6)]
    rows = [(100 + k, prose(500 + k, 200)) for k in range(30)]
    rows += [(k, prose(700 + k, 80) + " " + bench[k][1].upper().replace(" ", ", ") + ". " + prose(800 + k, 50)) for k in range(3)]
    rows += [(10 + k, prose(k + 40, 30) + " " + edited(bench[k][1], 3, 0.12) + " tail") for k in range(3, 6)]
    rows += [(20, " ".join(bench[0][1].split()[:26])), (21, " ".join(bench[0][1].split()[:12]))]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (13, 3), (14, 4), (15, 5), (20, 0)}
    assert got[0, 0] == 1.0 and got[20, 0] == 0.65
    for k in range(3, 6):
        text = dict(rows)[10 + k].split()
        assert got[10 + k, k] == round(smith_waterman(bench[k][1].split(), text) / 40, 6)


def test_an_item_that_leaked_everywhere(spark):
    bench = [(1, prose(1, 30))]
    rows = [(k, prose(k + 50, 20) + " " + bench[0][1]) for k in range(40)]
    assert decontaminate.contaminated(docs(spark, rows), items(spark, bench)).count() == 40


def test_heads_of_an_item_beside_one_whole_copy(spark):
    words = prose(1, 40).split()
    head, stray = " ".join(words[:26]), " ".join(words[-4:])
    rows = [(k, prose(k + 50, 20) + " " + head) for k in range(40)] + [(40, " ".join(words))]
    rows += [(50 + k, stray + " " + prose(k + 100, 200) + " " + head) for k in range(3)]  # the rarest gram isn't in the copy
    rows += [(60 + k, prose(k + 150, 90) + " " + stray) for k in range(3)]
    got = {r["doc_id"]: r["score"] for r in decontaminate.contaminated(docs(spark, rows), items(spark, [(1, " ".join(words))])).collect()}
    assert got == {**{k: 0.65 for k in range(40)}, 40: 1.0, 50: 0.65, 51: 0.65, 52: 0.65}


def test_grams_may_shuffle_instead(spark, monkeypatch):
    bench = [(1, prose(1, 30)), (2, prose(2, 30))]
    rows = [(k, prose(k + 50, 20) + " " + bench[k % 2][1]) for k in range(6)]
    want = sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect())) == want and len(want) == 6


def test_awkward(spark):
    bench = items(spark, [(1, None), (None, "a b c d e"), (2, ""), (3, "too short"), (4, prose(1, 30_000).split("w5 ")[0]), (4, "a b c d e")])
    got = decontaminate.contaminated(awkward(spark), bench)
    assert {r["item_id"] for r in got.collect()} <= {4}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark), items(spark, [])).count() == 0
    d = docs(spark, [(1, "x a b c d e y"), (2, "clean"), (None, "a b c d e"), (3, None)])
    assert [str(r["doc_id"]) for r in decontaminate.keep_clean(d, bench).orderBy("doc_id").collect()] == ["None", "2", "3"]


def test_short_items_match_as_a_whole(spark):
    bench = items(spark, [(1, "Blue moon"), (2, "one two three"), (3, "word"), (4, "...")])
    d = docs(spark, [(1, "the blue, MOON rose"), (2, "a word of one two"), (3, "moon blue"), (4, "one two three")])
    assert sorted(tuple(r)[:3] for r in decontaminate.contaminated(d, bench).collect()) == [(1, 1, 1.0), (4, 2, 1.0)]


def test_whole_query_against_every_pair(spark):
    """All documents against all items by the full table, where an item's four words in a row occur at all."""
    bench = [(k, prose(k, 8 + 9 * k, 300)) for k in range(5)] + [(5, "w1 w2 w3")]
    rows = []
    for k in range(60):
        words = prose(900 + k, 40, 300).split()
        item = bench[k % 6][1].split()
        rows.append((k, " ".join(words[:20] + edited(" ".join(item[: 2 + (k * 7) % len(item)]), k, 0.1 * (k % 4)).split() + words[20:])))
    want = {}
    for d, text in rows:
        words = text.split()
        for i, item in bench:
            m = item.split()
            n = min(4, len(m))
            grams = {tuple(words[a : a + n]) for a in range(len(words) - n + 1)}
            if any(tuple(m[a : a + n]) in grams for a in range(len(m) - n + 1)) and (score := smith_waterman(m, words) / len(m)) >= 0.5:
                want[d, i] = round(score, 6)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()}
    assert got == want and len(want) > 10


def test_words_of_a_long_item_are_measured_before_a_broadcast(spark, monkeypatch):
    """Rows are few but not small: what counts is their bytes."""
    from tallyweave.operators import materialize

    long = items(spark, [(1, prose(1, 3000, 10**6))])
    words = materialize.written(decontaminate.item_words(long.select("doc_id", "item_id", "text")), "items")
    sized = lambda: "ResolvedHint" in materialize.broadcast_if_bytes(words, F.size("item_words") * 8 + 32)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(materialize, "BROADCAST_BYTES", 24_000)
    assert not sized()
    monkeypatch.setattr(materialize, "BROADCAST_BYTES", 24_100)
    assert sized()


def test_columns_that_differ_in_case(spark):
    d = docs(spark, [(1, "x a b c d e y"), (2, "clean")]).withColumnRenamed("lang", "Text")
    kept = decontaminate.keep_clean(d, items(spark, [(4, "a b c d e")]))
    assert kept.columns == d.columns and [r[0] for r in kept.collect()] == [2]
