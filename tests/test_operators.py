"""Survey operators on small tables."""

import pytest
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope
from tallyweave.operators import choices, gates, graph, lookup, profile, repeats, resolve, search, stats


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_gates_close_and_say_why(spark):
    df = spark.createDataFrame([(1, "1", 20), (2, "0", 20), (3, "1", None)], "id int, ok string, age int")
    g = gates.relevance(["${ok} = '1'"], "${age} > 18", Scope(df.schema))
    assert collected(df.select("id", g.open.alias("o"), F.coalesce(g.reason, F.lit("-")).alias("r")), "id", "o", "r") == [(1, True, "-"), (2, False, "group"), (3, False, "own")]
    bad = gates.relevance([], "nope(${age})", Scope(df.schema))
    assert df.filter(bad.open).count() == 0 and len(bad.errors) == 1
    assert df.filter(gates.relevance([], "nope(${age})", Scope(df.schema), strict=False).open).count() == 3
    trace = gates.coverage(df, "id", {"a": g, "never": gates.relevance(["0"], "", Scope(df.schema))})
    assert collected(gates.coverage_summary(trace), "variable", "asked_count", "gated_count", "never_asked") == [("a", 1, 2, False), ("never", 0, 3, True)]


def test_choice_filters(spark):
    sheet = spark.createDataFrame([("l", "1", "One", "x", "Un", 0), ("l", "2", "Two", "y", "Deux", 1), ("l", "-99", "Other", "", "Autre", 2)], "list_name string, value string, label string, zone string, `label:fr` string, ord int")
    lists = choices.choice_lists(sheet)
    element = lists.schema["choices"].dataType.elementType
    assert element.names == ["value", "label", "zone"]
    rows = lists.crossJoin(spark.createDataFrame([("x",), ("z",)], "here string"))
    got = lambda source, fallback: {r["here"]: [c["value"] for c in r["k"]] for r in rows.select("here", choices.filtered(F.col("choices"), element, source, Scope(rows.schema), fallback).alias("k")).collect()}
    assert got("zone = ${here}", True) == {"x": ["1"], "z": ["1", "2", "-99"]}
    assert got("zone = ${here}", False) == {"x": ["1"], "z": []}
    assert got("nope(1)", False) == {"x": ["1", "2", "-99"], "z": ["1", "2", "-99"]}
    assert choices.is_static("value > 1 or selected(zone, 'x')") and not choices.is_static("zone = ${here}") and not choices.is_static("regex(zone, 'x')")


def test_lookup_keys_and_misses(spark):
    t = spark.createDataFrame([("42.0", "first", 0), ("42", "second", 1), ("", "blank", 2), ("x y", None, 3)], "k string, v string, o int")
    df = spark.createDataFrame([(1, " 42 "), (2, "7"), (3, None), (4, "x y"), (5, "42.00")], "id int, key string")
    out = lookup.pulldata(df, t, F.col("key"), "k", {"v": "v"}, "o")
    assert collected(out, "id", "v") == [(1, "first"), (2, ""), (3, "blank"), (4, ""), (5, "first")]
    d = spark.createDataFrame([(42,), (7,)], "n int")
    assert collected(lookup.pulldata(d, t, F.col("n"), "k", {"v": "v"}, "o"), "n", "v") == [(7, ""), (42, "first")]


def test_search_choices_skip_no_rows(spark):
    t = spark.createDataFrame([("n", "b", "B", 1), ("n", "a", "A", 0)], "region string, name string, label string, o int")
    df = spark.createDataFrame([("n ",), ("s",), (None,)], "r string")
    out = lookup.search_choices(df, t, "name", "label", [("region", F.col("r"))], [("-99", "?")], "o", "c")
    assert sorted([c["value"] for c in r["c"]] for r in out.collect()) == [["-99"], ["-99"], ["a", "b", "-99"]]


def test_repeat_aggregates_and_ranks(spark):
    t = spark.createDataFrame([(1, 1, "5"), (1, 2, ""), (1, 3, "9"), (1, 4, "5"), (2, 1, None)], "k int, idx int, v string")
    n = repeats.number(t, "v")
    got = t.groupBy("k").agg(repeats.count_of(F.col("v")).alias("c"), repeats.sum_of(n).alias("s"), F.min(n).alias("m"), repeats.joined(F.col("idx"), F.col("v"), "-").alias("j"))
    assert collected(got, "k", "c", "s", "m", "j") == [(1, 3, 19.0, 5.0, "5-9-5"), (2, 0, 0.0, None, "")]
    assert collected(t.select("k", "idx", repeats.ranked(t, ["k"], "idx", "v").alias("r")), "k", "idx", "r") == [(1, 1, 2), (1, 2, 999), (1, 3, 1), (1, 4, 3), (2, 1, 999)]
    wide = repeats.grid(t, ["k"], "idx", ["v"], 4)
    assert wide.columns == ["k", "v_1", "v_2", "v_3", "v_4"]
    assert collected(repeats.from_wide(wide, ["k"], ["v"]), "k", "idx", "v") == [(1, 1, "5"), (1, 2, ""), (1, 3, "9"), (1, 4, "5")]
    assert repeats.largest_count(t, ["k"]) == 4 and repeats.largest_count(t.limit(0), ["k"]) == 0


def test_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (-99.0, "-99")], "x double, t string")
    got = {r["variable"]: r.asDict() for r in profile.column_profile(df).collect()}
    assert got["x"]["non_null"] == 2 and got["x"]["max_value"] == 1.0 and got["x"]["missing_rate"] == 0.5 and got["t"]["min_value"] is None
    assert collected(profile.sentinel_counts(df, ["x", "t"]), "variable", "code", "hits") == [("t", "-99", 1), ("x", "-99", 1)]
    assert profile.column_profile(df.limit(0)).filter("all_missing and missing_rate = 0").count() == 2


@pytest.mark.parametrize(("values", "letters"), [(["1", "d", "2.5", "r", "d"], {"d": 2, "r": 1}), (["1", "d", "word"], {}), (["d", "r"], {}), (["1", "2"], {}), ([None, ""], {}), (["yes", "d"], {})])
def test_letters_only_in_numeric_columns(spark, values, letters):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert {r["letter"]: r["hits"] for r in profile.extended_missing_counts(df, ["c"]).collect()} == letters


def test_statistics_by_condition(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (0, 99.0), (None, 5.0)], "g int, x double")
    (r,) = stats.tabstat(df, {"x": "${g} = 1"}).collect()
    assert (r["n"], r["mean"], r["p50"], r["p25"]) == (2, 15.0, 15.0, 12.5)
    assert stats.relevance_groups({"a": "c", "b": "", "d": "c ", "e": "z"}) == [("", ["b"]), ("c", ["a", "d"]), ("z", ["e"])]
    assert [tuple(x) for x in stats.condition_counts(df, ["${g} = 7"]).collect()] == [("${g} = 7", 0, True)]


def test_decode_and_defects(spark):
    rows = [("c_2_3", "c", True, True), ("c_2_3", "c", False, True), ("c__99", "c", True, False), ("c_2", "c", True, False), ("c_8", "c", True, False), ("p_4", "p", False, True), ("p_4", "p", False, False), ("f_r1", "f_r", False, True)]
    df = spark.createDataFrame(rows, "col string, q string, m boolean, r boolean")
    d = df.select(resolve.decoded(F.col("col"), F.col("q"), F.col("m"), F.col("r"), F.array(F.lit("2"), F.lit("-99"))).alias("d")).collect()
    assert [tuple(x["d"]) for x in d] == [("2", 3), (None, None), ("-99", None), ("2", None), (None, None), (None, 4), (None, None), (None, 1)]
    bad = spark.createDataFrame([("a_1", "1", ["1"]), ("a_9", "9", ["1", "-9"]), ("a_7", "7", ["1"]), ("b_1", "1", [])], "column_name string, choice_code string, codes array<string>")
    assert collected(resolve.choice_defects(bad), "column_name", "defect") == [("a_7", "unknown"), ("a_9", "demoted"), ("b_1", "fabricated")]


def test_graph_depths_stop_on_a_cycle(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("x", "y"), ("y", "x")], "name string, parent string")
    assert {r["name"]: r["depth"] for r in graph.depths(p).collect()} == {"a": 0, "b": 1, "x": None, "y": None}


def test_search_folds_accents_and_breaks_ties(spark):
    docs = spark.createDataFrame([(1, "Âge de l'enfant"), (2, "age DE enfant"), (3, "straße"), (4, None), (5, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "âge"), (2, "STRASSE"), (3, "nothing")], "query_id int, query string")
    assert collected(search.search(docs, q, 5), "query_id", "doc_id", "rank") == [(1, 1, 1), (1, 2, 2), (2, 3, 1)]
    names = spark.createDataFrame([("income_total",), ("income",), ("outcome",), ("other",)], "n string")
    asked = spark.createDataFrame([("incom",), ("come_tot",), ("Others",)], "w string")
    assert collected(search.suggestions(names, "n", asked), "wanted", "name", "rank") == [("Others", "other", 1), ("come_tot", "income_total", 1), ("incom", "income", 1), ("incom", "income_total", 2)]
