"""The assembled dictionary, written and read back, and the phases around it."""

import json

from pyspark.sql import functions as F

from tallyweave.lang.syntax import references
from tallyweave.operators import dictionary, form, graph, search
from tallyweave.sources import config, contract, exports, phases, preload, sheets

SHEET = [
    {"type": "text", "name": "who", "label": "Name?"},
    {"type": "begin repeat", "name": "out", "repeat_count": "2", "relevance": "${who} != ''"},
    {"type": "select_multiple k", "name": "kinds", "relevance": "${who} = 'x'"},
    {"type": "begin repeat", "name": "inn", "repeat_count": "2"},
    {"type": "integer", "name": "n", "relevance": "${n} > index()"},
    {"type": "end repeat"},
    {"type": "end repeat"},
    {"type": "text", "name": "a_name_that_is_longer_than_an_export_allows"},
]
CHOICES = [("k", "1", "One", 0), ("k", "-99", "Don't know", 1)]


def made(spark, **more):
    f = form.compile_form(SHEET)
    schema = "who string, out_count int, kinds_1_1 int, kinds__99_1 int, kinds_1_2 int, inn_count_1 int, inn_count_2 int, n_1_1 double, n_2_1 double, n_9 double, a_name_that_is_longer_than_an_ex string, KEY string"
    df = spark.createDataFrame([("x", 2, 1, 0, None, 1, 1, -99.0, 3.0, None, "t", "k1"), ("", 2, None, None, None, 1, 1, -99.0, float("nan"), None, None, "k2")], schema)
    sheet = spark.createDataFrame(CHOICES, "list_name string, value string, label string, ord int")
    return dictionary.assembled(df, form.questions_frame(spark, f), sheet, **more), f, df


def test_one_record_a_column(spark):
    d, _, df = made(spark)
    got = {r["variable_name"]: r for r in d.collect()}
    assert list(r["variable_name"] for r in d.orderBy("variable_order").collect()) == ["who", "out_count", "kinds_1_1", "kinds__99_1", "inn_count_1", "kinds_1_2", "inn_count_2", "n_1_1", "n_2_1", "n_9", "a_name_that_is_longer_than_an_ex", "KEY"]
    assert set(got) == set(df.columns) and sorted(r["variable_order"] for r in got.values()) == list(range(1, 13))
    assert (got["kinds_1_2"]["choice_code"], got["kinds_1_2"]["iterations"], got["kinds_1_2"]["choice_label"], got["kinds_1_2"]["choice_index"]) == ("1", [2], "One", 1)
    assert (got["kinds__99_1"]["choice_code"], got["kinds__99_1"]["special_code_meaning"]) == ("-99", "Don't know")
    assert (got["n_2_1"]["iterations"], got["n_2_1"]["iteration"], got["n_9"]["iterations"]) == ([2, 1], 1, [9])
    assert got["inn_count_2"]["iterations"] == [2] and got["out_count"]["iterations"] == [] and got["out_count"]["original_variable_name"] == "out_count"
    assert got["n_1_1"]["sentinels"] == [("-99", 2)] and got["n_2_1"]["non_null"] == 1 and got["n_9"]["all_missing"]
    assert not got["KEY"]["matched"] and got["KEY"]["question_type"] == "unmatched" and got["KEY"]["variable_order"] == 12
    assert got["a_name_that_is_longer_than_an_ex"]["stage"] == 5
    assert got["n_2_1"]["condition_specific"] == "!missing(who) & n_1 > 1 & !missing(n_1)" and got["kinds_1_2"]["condition_specific"] == '!missing(who) & who == "x"'
    assert made(spark, codes={})[0].filter(F.size("sentinels") > 0).count() == 0


def test_written_and_read_back_whole(spark, tmp_path):
    d, _, _ = made(spark)
    path = str(tmp_path / "s_variable_dictionary.json")
    exports.write_dictionary(d, path)
    (found,) = exports.discovered(str(tmp_path)).values()
    back = exports.Store(spark, found[0], d.schema).current()
    assert back.count() == 12 and sorted(map(str, back.select("variable_name", "iterations", "choices", "sentinels", "min_value").collect())) == sorted(map(str, d.select("variable_name", "iterations", "choices", "sentinels", "min_value").collect()))
    assert dictionary.flattened(back).filter("variable_name = 'n_1_1'").first()["relevance"].startswith("!missing(who)")
    total = dictionary.summary(back).first()
    assert (total["total"], total["unmatched"], total["in_repeat"], total["with_choices"]) == (12, 1, 8, 3)
    nodes = [contract.Node("/d/who", "name"), contract.Node("/d/out/kinds", "kinds", ["out"], control="select", choices=["1"])]
    mapped = spark.createDataFrame([(m["column_name"], m["status"], m["path"]) for m in (contract.map_column(c, nodes) for c in ("who", "kinds_1_2", "KEY"))], "column_name string, status string, path string")
    over = contract.overlay(back.select(F.col("variable_name").alias("column_name"), F.col("original_variable_name").alias("question")), mapped)
    assert {r["column_name"]: r["outcome"] for r in over.collect()}["kinds_1_2"] == "matched" and over.count() == 12
    ids = back.select(F.col("variable_order").alias("doc_id"), F.concat_ws(" ", "variable_name", "question_text").alias("text"))
    hits = search.search(ids, spark.createDataFrame([(1, "Name")], "query_id int, query string"), 3)
    assert hits.count() >= 1


def test_repeat_structure(spark):
    d, f, _ = made(spark)
    got = {r["name"]: r for r in graph.repeat_structure(form.questions_frame(spark, f), d).collect()}
    assert (got["out"]["depth"], got["out"]["largest_iteration"], got["out"]["suffix"], got["out"]["n_variables"], got["out"]["parent"]) == (1, 2, "_{iter}", 1, None)
    assert (got["inn"]["depth"], got["inn"]["suffix"], got["inn"]["parent"], got["inn"]["count_variable"]) == (2, "_{p1}_{iter}", "out", "inn_count")


def test_a_chain_of_forty_and_a_circle(spark):
    rows = [("n0", None), *((f"n{k}", f"n{k - 1}") for k in range(1, 40)), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r["name"]: r["depth"] for r in graph.depths(spark.createDataFrame(rows, "name string, parent string")).collect()}
    assert got == {**{f"n{k}": k for k in range(40)}, "x": None, "y": None, "z": None}


def test_phases_write_the_dictionary(spark, tmp_path):
    book, data = str(tmp_path / "f.xlsx"), str(tmp_path / "d.parquet")
    sheets.write_xlsx(book, {"survey": (["type", "name", "label", "repeat_count"], [["integer", "age", "Age?", ""], ["begin repeat", "r", "", "2"], ["text", "m", "M", ""], ["end repeat", "r", "", ""]]), "choices": (["list_name", "name", "label"], [["yn", "1", "Yes"]])})
    spark.createDataFrame([(1, 2, "a", None)], "age int, r_count int, m_1 string, other string").write.parquet(data)
    got = phases.document_all(spark, config.Config("x", {"s": config.Survey("s", book, data)}), str(tmp_path / "out"), rows=5)
    out = tmp_path / "out/s"
    assert got == {"s": None}
    assert [r["variable_name"] for r in json.loads((out / "s_variable_dictionary.json").read_text())] == ["age", "r_count", "m_1", "other"]
    assert json.loads((out / "summary.json").read_text())["total"] == 4 and json.loads((out / "choices.json").read_text())["lists"] == {"yn": 1}
    assert json.loads((out / "graph.json").read_text())["repeat_groups"][0]["largest_iteration"] == 1
    assert exports.footer_profile(spark, str(out / "data.parquet")).count() == 4
    wide = spark.read.option("header", True).csv(str(out / "synthetic"))
    assert {"m_1", "m_2", "KEY", "deviceid"} <= set(wide.columns) and wide.count() == 5
    assert spark.read.option("header", True).csv(str(out / "survey")).count() == 4


def test_static_search_and_attachments(spark, tmp_path):
    (tmp_path / "towns_v2.csv").write_bytes(b"code,name,region\n2,B,1\n1,A\xff,1\n3,C,2\n")
    a = preload.Attachments(spark, str(tmp_path))
    rows = preload.static_choices("search('towns', 'matches', 'region', '1')", "code", "name", a).collect()
    assert [r["value"] for r in rows] == ["2", "1"] and a.table("towns") is a.table("towns.csv")
    assert preload.static_choices("search('towns', 'matches', 'region', ${r})", "code", "name", a) is None
    assert preload.static_choices("search('towns')", "code", "name", a).count() == 3 and preload.static_choices("search('gone')", "code", "name", a) is None
    assert preload.static_choices("search('towns', 'matches', 'nothing', '1')", "code", "name", a).count() == 0
    a.close()


def test_name_runs_and_references():
    assert dictionary.varlists(["aa", "bb", "c" * 9, "d"], 5) == [["aa", "bb"], ["c" * 9], ["d"]]
    assert dictionary.varlists([]) == [] and references("${a} + ${b}") == ["a", "b"]


def test_coverage_sink(spark, tmp_path):
    trace = spark.createDataFrame([("1", "a", True), ("1", "b", False)], "key string, variable string, asked boolean").withColumns({"reason": F.lit(None).cast("string"), "clause": F.lit(None).cast("string")})
    assert exports.write_coverage(trace, str(tmp_path / "t")) == {"never_asked": ["b"]}
    assert json.loads((tmp_path / "t/coverage.json").read_text())["aggregate"][0]["asked_count"] == 1
