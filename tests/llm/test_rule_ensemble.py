import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import rule_ensemble as r
from tests.llm.helpers import awkward, docs, prose

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = r.train(d, labels.filter("doc_id % 3 <> 0"))
    held = model.scored(d).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    right, kept, n_good = held.agg(F.avg(((F.col("_tw_quality") >= r.KEEP_QUALITY) == (F.col("quality") == 1)).cast("int")), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0) & r.accepted()), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))).first()
    assert right >= 0.95 and kept >= 0.98 * n_good
    assert {"idiot", "trash"} <= set(model.terms)


def test_columns_say_what_the_rules_say(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = r.train(d, labels)
    scores = model.scored(d).select("doc_id", "_tw_quality", "_tw_toxicity")
    rows = r.statistics(d.withColumn("_tw_text", F.col("text")), list(model.terms)).select("doc_id", *(f"_tw_{f}" for f in r.FEATURES)).join(scores, "doc_id").toPandas()
    x = rows[[f"_tw_{f}" for f in r.FEATURES]].to_numpy(dtype=float)
    assert np.allclose(model.quality.predict(x), rows["_tw_quality"]) and np.allclose(model.toxicity.predict(x), rows["_tw_toxicity"])


def test_statistics(spark):
    text = "A a a. STOP!! x|y idiot\nsame line\nsame line"
    got = r.statistics(docs(spark, [(1, text)]).withColumnRenamed("text", "_tw_text"), ["idiot"]).first()
    assert [round(got[f"_tw_{f}"], 4) for f in r.FEATURES] == [10.0, 0.8, 0.0, 0.2, len(text) / 10, 0.3, 0.1, round(1 / 3, 4), round(10 / 3, 4), 1.0]
    repeated = r.statistics(docs(spark, [(1, "go go go")]).withColumnRenamed("text", "_tw_text"), []).first()
    assert round(repeated["_tw_repeat_share"], 4) == round(2 / 3, 4) and repeated["_tw_flagged"] == 0


def test_lasso_keeps_the_rule_that_matters():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(r.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    model = r.fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == (y[400:] > 0.5)).mean() > 0.93
    assert len(model.paths) < 150


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_awkward(spark):
    for marks in ([], [(1, 1, 0, "x"), (None, 1, 1, ""), (4, None, None, None), (5, 0, 1, "x"), (5, 1, 0, "x")]):
        got = {str(x["doc_id"]): x["keep"] for x in r.classified(awkward(spark), labels(spark, marks)).collect()}
        assert set(got) == {"2", "3", "4", "5", "6"}
        kept = r.keep_accepted(awkward(spark), labels(spark, marks))
        assert kept.columns == awkward(spark).columns and kept.filter("text is null").count() == 2
    assert r.classified(awkward(spark), labels(spark, [])).filter("not keep").count() == 0
    assert r.classified(docs(spark, []), labels(spark, [])).count() == 0


def test_toxic_words_of_a_small_language(spark):
    other = lambda seed: prose(seed, 26 + seed % 9).replace("w", "palabra")
    rows = [(k, prose(k, 26 + k % 9) if k % 6 else other(k)) for k in range(600)] + [(600 + k, prose(900 + k, 26 + k % 9) + " idiot") for k in range(90)]
    rows += [(700 + k, other(2000 + k) + " basura") for k in range(10)]
    rows += [(720 + k, prose(k + 4000, 26 + k % 9) + f" {'abcdefghij'[k % 10]}oaf") for k in range(100)]
    rows += [(830 + k, prose(7000, 40) + f" onetext {k}") for k in range(30)]
    marks = labels(spark, [(i, 1, int(i >= 600), "") for i, _ in rows])
    rows += [(900, prose(5000, 30) + " basura"), (901, prose(5001, 30) + " coaf"), (902, prose(5002, 30))]
    model = r.train(docs(spark, rows), marks)
    assert set(model.terms) == {"idiot", "basura", *(f"{c}oaf" for c in "abcdefghij")}
    got = {x["doc_id"]: x["_tw_toxicity"] > r.DROP_TOXICITY for x in model.scored(docs(spark, rows)).collect()}
    assert got[900] and got[901] and not got[902] and all(got[700 + k] for k in range(10))


def test_chance_is_the_binomial_tail():
    assert abs(r.chance(2, 3, 0.5) - 0.5) < 1e-12 and abs(r.chance(6, 6, 0.1) - 1e-6) < 1e-15


def test_columns_that_differ_in_case_or_look_like_ours(spark):
    """The exact name counts, and no column is overwritten."""
    names = ["doc_id", "text", "Text", "_tw_text", "_tw_words", "_tw_quality", "c0"]
    d = spark.createDataFrame([(k, "good prose, " * 9, "other", "mine", "w", "q", "z") for k in range(4)], "doc_id long, text string, a string, b string, c string, d string, e string").toDF(*names)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = r.keep_accepted(d, labels)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(map(tuple, d.collect()))
    assert r.classified(d, labels).count() == 4


def test_lasso_paths_by_brute_force():
    """On a table small enough to search all rules of one clause, the best one carries the fit."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (120, len(r.FEATURES))).astype(float)
    y = (x[:, 4] > 1).astype(float)
    rules = r.fit(x, y)
    gain = {}
    for k in range(x.shape[1]):
        for cut in np.unique(x[:, k])[:-1]:
            a, b = y[x[:, k] > cut], y[x[:, k] <= cut]
            gain[k, cut] = len(a) * a.var() + len(b) * b.var()
    k, cut = min(gain, key=gain.get)
    assert (k, cut) == (4, 1.0) and any(p in (((4, True, 1.0),), ((4, False, 1.0),)) for p in rules.paths)
    assert ((rules.predict(x) > 0.5) == (y > 0.5)).all()
    assert {f for p in rules.paths for f, _, _ in p} == {r.FEATURES.index(f) for f in rules.features()}
