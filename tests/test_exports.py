import json
import os

import pytest

from tallyweave.operators import repeats
from tallyweave.sources import config, exports, phases, sheets


def test_stata_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "5", "x", 2.5), (2, "", "y", None), (3, "7", None, 1.0)], "a int, b string, c string, d double")
    path = str(tmp_path / "x.dta")
    assert exports.write_stata(df, ["d", "b", "gone", "a", "c"], path) == ["d", "b", "a", "c"]
    got = exports.read_stata(spark, path)
    assert got.columns == ["d", "b", "a", "c"] and sorted(map(str, got.collect())) == sorted(map(str, [r for r in got.collect()]))
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in got.orderBy("a").collect()] == [(1, 5.0, "x", 2.5), (2, None, "y", None), (3, 7.0, "", 1.0)]


def test_footers(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    got = {r["variable"]: r for r in exports.footer_profile(spark, path).collect()}
    low, high, n = spark.read.parquet(path).selectExpr("min(l_quantity)", "max(l_quantity)", "count(*)").first()
    assert (got["l_quantity"]["min_value"], got["l_quantity"]["max_value"], got["l_quantity"]["n"]) == (low, high, n) and got["l_returnflag"]["min_value"] is None


def test_dictionary_and_graph(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None, [("1", "One")]), (1, "a", "text", None)], "variable_order int, variable_name string, question_type string, choices array<struct<value:string,label:string>>")
    exports.write_dictionary(d, str(tmp_path / "d.json"))
    assert exports.Store(spark, str(tmp_path / "d.json"), d.schema).current().orderBy("variable_order").collect() == d.orderBy("variable_order").collect()
    assert json.loads((tmp_path / "d.json").read_text()) == [{"variable_order": 1, "variable_name": "a", "question_type": "text"}, {"variable_order": 2, "variable_name": "b", "choices": [{"value": "1", "label": "One"}]}]
    exports.write_dictionary_sheet(d, str(tmp_path / "d.xlsx"))
    assert [r["choices"] for r in sheets.read_xlsx(str(tmp_path / "d.xlsx"))["dictionary"]] == ["", "1=One"]
    exports.write_graph(d.select("variable_name"), spark.createDataFrame([("a", "b", "gated_by")], "src string, dst string, kind string"), str(tmp_path / "g"))
    assert json.loads((tmp_path / "g" / "graph.json").read_text())["links"] == [{"source": "a", "target": "b", "kind": "gated_by"}]


def test_sheets_of_answers_discovery_and_types(tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"answers": {"a": 1, "b": 2}, "directives": {"repeat_counts": {"p": 1}}}))
    (tmp_path / "2.json").write_text(json.dumps({"answers": {"b": 3}, "directives": {"repeat_counts": {"q": 2}, "case_pool": ["x"]}}))
    got = exports.answer_sheets([str(tmp_path / "1.json"), str(tmp_path / "2.json")])
    assert got == {"answers": {"a": 1, "b": 3}, "directives": {"repeat_counts": {"p": 1, "q": 2}, "case_pool": ["x"]}}
    (tmp_path / "hh_variable_dictionary.json").write_text("{}")
    assert exports.discovered(str(tmp_path)) == {"hh": (str(tmp_path / "hh_variable_dictionary.json"), None)}
    assert exports.type_catalogue("| Type | Use |\n|---|---|\n| `integer` | whole |\n\ntext\n") == {"integer": {"use": "whole"}}


def test_store_reads_again_and_survives_a_bad_file(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text('[{"a": 1}]')
    store = exports.Store(spark, str(p), spark.createDataFrame([], "a int").schema)
    assert store.current().count() == 1
    p.write_text('[{"a": 1}, {"a": 2}]')
    os.utime(p, (1, 1))
    assert store.current().count() == 2
    p.write_text("[{")
    os.utime(p, (2, 2))
    assert store.current().count() == 2 and store.error


def test_phases_isolate_failures(spark, tmp_path):
    book = str(tmp_path / "f.xlsx")
    sheets.write_xlsx(book, {"survey": (["type", "name", "relevance"], [["select_one yn", "ok", ""], ["integer", "age", "${ok} = '1'"], ["text", "bad", "nope()"]]), "choices": (["list_name", "value", "label"], [["yn", "1", "Yes"], ["yn", "0", "No"]])})
    c = config.Config("x", {"good": config.Survey("good", book), "gone": config.Survey("gone", str(tmp_path / "none.xlsx"))})
    got = phases.document_all(spark, c, str(tmp_path / "out"), rows=10)
    assert got["good"] is None and got["gone"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/good/synthetic")).count() == 10
    assert "bad" in (tmp_path / "out/good/synthetic_errors.txt").read_text()


def test_expressions_over_instances(spark):
    parents = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, base double")
    child = spark.createDataFrame([(1, 1, 3.0, "a"), (1, 2, None, ""), (1, 3, 5.0, "c")], "k int, idx int, v double, s string")
    sources = {"total": "sum(${v}) + ${base}", "n": "count(${plot})", "filled": "count-non-empty(${s})", "big": "count-if(${v}, ${v} > 3)", "low": "min(${v})", "list": "join(',', ${s})", "third": "indexed-repeat(${s}, ${plot}, 3)", "rank": "rank-index(1, ${v})", "some": "join-if('-', ${s}, ${v} > 1)"}
    got = {r["k"]: r.asDict() for r in repeats.evaluated(parents, child, ["k"], "idx", sources, "plot").collect()}
    assert got[1] == {"k": 1, "base": 10.0, "total": 18.0, "n": 3.0, "filled": 2.0, "big": 1.0, "low": 3.0, "list": "a,c", "third": "c", "rank": 2.0, "some": "a-c"}
    assert got[2] == {"k": 2, "base": 20.0, "total": 20.0, "n": 0.0, "filled": 0.0, "big": 0.0, "low": None, "list": "", "third": "", "rank": 999.0, "some": ""}
    assert repeats.evaluated(parents, child, ["k"], "idx", {"x": "${base} * 2"}).filter("x = 20").count() == 1


@pytest.mark.parametrize("n", [0, 3])
def test_empty_inputs(spark, n):
    df = spark.range(n).selectExpr("cast(id as int) k", "1 idx", "cast(id as double) v")
    assert repeats.evaluated(df.select("k"), df, ["k"], "idx", {"s": "sum(${v})"}).count() == n
