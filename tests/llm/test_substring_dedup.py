import random
import time

from tallyweave.llm import substring_dedup as s
from tests.llm.helpers import awkward, docs, prose, same_as_sql


def brute(rows, least):
    """Covered word positions of each document: every window of ``least`` words seen in a document of a smaller id."""
    first = {}
    words = {}
    for i, t in rows:
        if i is not None and t is not None:
            words[i] = s._words(t)
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            first.setdefault(tuple(words[i][k : k + least]), i)
    out = {}
    for i, w in words.items():
        gone = sorted({p for k in range(len(w) - least + 1) if first[tuple(w[k : k + least])] < i for p in range(k, k + least)})
        spans = []
        for p in gone:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        if spans:
            out[i] = " ".join(f"{a}-{b}" for a, b in spans)
    return out


def spans(df):
    return {r["doc_id"]: r["spans"] for r in df.collect()}


def test_against_brute_force(spark):
    r = random.Random(4)
    passages = [prose(900 + k, r.choice([49, 50, 51, 60, 75, 130, 300])) for k in range(14)]
    rows = []
    for i in range(60):
        parts = []
        for k in range(r.randrange(1, 5)):
            parts.append(prose(i * 31 + k, r.randrange(0, 90)))
            p = r.choice(passages).split()
            a = r.randrange(0, max(1, len(p) - 48))
            parts.append("  ".join(p[a:] if r.random() < 0.5 else p[: a + 55]))
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, "the " * n) for i, n in enumerate((10, 50, 70, 200))] + [(200, rows[3][1]), (201, rows[3][1])]
    assert spans(s.without_repeats(docs(spark, rows))) == brute(rows, s.MIN_WORDS)


def test_hot_anchors_give_the_same_spans(spark, monkeypatch):
    """The windows of an anchor with many contexts, and the automaton, against brute force; with HOT 0 every anchor is hot."""
    r = random.Random(9)
    core = prose(77, 70).split()
    rows = []
    for i in range(300):
        a, b = r.randrange(0, 20), r.randrange(50, 71)
        rows.append((i, " ".join([*prose(i, r.randrange(0, 60)).split(), *core[a:b], *prose(i + 5000, r.randrange(0, 60)).split()])))
    rows += [(400, rows[7][1]), (401, "the " * 90), (402, "the " * 120), (403, "a " * 60 + rows[9][1])]
    want = brute(rows, s.MIN_WORDS)
    assert len(want) > 150
    for hot in (1024, 20, 0):
        monkeypatch.setattr(s, "HOT", hot)
        assert spans(s.without_repeats(docs(spark, rows))) == want


def test_one_anchor_in_very_many_contexts(spark):
    """100,000 documents share ten words and nothing more, but for a few; no task has them all."""
    middle = prose(8, 10, 10**6)
    around = lambda k: (prose(3 * k, 45, 10**6), prose(3 * k + 1, 45, 10**6))
    rows = [(k, f"{around(k)[0]} {middle} {around(k)[1]}") for k in range(100_000)]
    rows += [(200_000 + k, f"x {' '.join(around(k)[0].split()[5:])} {middle} {' '.join(around(k)[1].split()[:3])} y") for k in range(50)]
    assert spans(s.without_repeats(docs(spark, rows))) == {200_000 + k: "1-54" for k in range(50)}


def test_blanks_and_long_texts_take_time_in_proportion(spark):
    shared = prose(2, 60)
    rows = [(1, shared + " " * 1_000_000), (2, "x " + shared + " " * 1_000_000), (3, "\n" * 1_000_000), (4, "w " * 400_000)]
    began = time.perf_counter()
    got = s.without_repeats(docs(spark, rows)).collect()
    assert [(r["doc_id"], len(r["clean_text"])) for r in got] == [(2, 1_000_001)] and time.perf_counter() - began < 60


def test_oracle_sql(spark):
    assert same_as_sql(spark, "op3_repeated_passages")


def test_a_join_of_two_earlier_matches_is_known(spark):
    rows = []
    for seed in range(60):
        w, r = prose(3000 + seed, 200).split(), random.Random(seed)
        a, b, d = r.randrange(80, 116), r.randrange(55, 76), r.randrange(105, 146)
        rows += [(4 * seed + k, " ".join(part)) for k, part in enumerate((w[:a], w[b:], w, w[:d]))]
    assert spans(s.without_repeats(docs(spark, rows))) == brute(rows, s.MIN_WORDS)


def test_text_keeps_its_blanks(spark):
    shared = prose(2, 50)
    rows = [(1, f"head\n\n{shared} tail"), (2, f"  other {shared}\n\n rest\n")]
    got = s.without_repeats(docs(spark, rows)).collect()
    assert [(r["doc_id"], r["clean_text"], r["removed_words"], r["n_spans"]) for r in got] == [(2, "  other\n\n rest\n", 50, 1)]


def test_awkward(spark):
    assert spans(s.without_repeats(awkward(spark))) == {5: "0-30000"}


def test_only_inside_one_document_or_short(spark):
    p = prose(5, 60)
    short = prose(6, 49)
    assert spans(s.without_repeats(docs(spark, [(1, p + " x " + p), (2, short), (3, short), (1, p)]))) == {}
    assert s.without_repeats(docs(spark, [])).count() == 0


def test_matching_statistics():
    r = random.Random(1)
    for _ in range(60):
        texts = [[r.choice("abc") for _ in range(r.randrange(1, 25))] for _ in range(4)]
        a = s.SuffixAutomaton()
        for t in texts[:-1]:
            a.restart()
            for w in t:
                a.extend(w)
        known = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = texts[-1]
        want = [max([n for n in range(e + 1) if tuple(q[e - n : e]) in known or n == 0]) for e in range(1, len(q) + 1)]
        assert a.statistics(q) == want
