from pyspark.sql import functions as F

from tallyweave.llm import exact_dedup
from tests.llm.helpers import awkward, docs, same_as_sql


def rows(df):
    return sorted((r["doc_id"], r["duplicate_of"]) for r in df.collect())


def test_least_id_is_kept(spark):
    d = docs(spark, [(5, "a"), (3, "a"), (9, "b"), (4, "a"), (8, "B")])
    assert rows(exact_dedup.exact_duplicates(d)) == [(4, 3), (5, 3)]


def test_awkward(spark):
    d = awkward(spark)
    assert rows(exact_dedup.exact_duplicates(d)) == [(3, 2), (5, 4)]
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "6", "None", "None"]


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_repeated_row_of_the_kept_document(spark):
    d = docs(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "c")])
    assert rows(exact_dedup.exact_duplicates(d)) == [(1, 1), (2, 1)]
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(d).collect()) == [1, 3]


def test_full_bytes_decide_when_digests_collide(spark):
    weak = lambda text: F.encode(F.substring(text, 1, 1), "utf-8")
    d = docs(spark, [(1, "aa"), (2, "ab"), (3, "aa"), (4, "ab"), (5, "b"), (6, "b"), (7, "ac")])
    assert rows(exact_dedup.exact_duplicates(d, weak)) == [(3, 1), (4, 2), (6, 5)]


def test_state_goes_on_over_runs(spark, tmp_path):
    feed, state, log = (str(tmp_path / x) for x in ("feed", "state", "log"))
    schema = exact_dedup.keyed(docs(spark, [])).schema
    seen = []
    for part in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")], [(5, "c"), (6, "a")]):
        exact_dedup.keyed(docs(spark, part)).coalesce(1).write.mode("append").parquet(feed)
        exact_dedup.run_stream(spark.readStream.schema(schema).parquet(feed), state, log)
        path = spark._jvm.java.io.File(log)
        seen.append(sorted(r["first_id"] for r in exact_dedup.seen_twice(spark, log).collect()) if path.exists() else [])
    assert seen == [[], [1], [1, 4]]


def test_a_reused_id_costs_no_other_text(spark):
    d = docs(spark, [(0, "a"), (1, "a"), (1, "b")])
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(d).collect()) == [(0, "a"), (1, "b")]


def test_oracle_sql(spark):
    assert same_as_sql(spark, "op4_exact_duplicates")


def test_columns_that_differ_in_case(spark):
    d = docs(spark, [(1, "a"), (2, "a"), (3, "b"), (3, "b")]).withColumnRenamed("lang", "Text").withColumnRenamed("keep", "_tw_id")
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
