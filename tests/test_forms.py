import json

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import form, sampling, scenarios, synth
from tallyweave.sources import config, contract, preload, sheets

SHEET = [
    {"type": "select_one yesno or_other", "name": "consent", "label": "Go on?"},
    {"type": "begin group", "name": "main", "relevance": "${consent} = '1'"},
    {"type": "integer", "name": "age", "constraint": ". >= 18 and . < 90", "label": "", "label:fr": "Âge"},
    {"type": "begin_repeat", "name": "plot", "repeat_count": "${age} mod 3", "relevance": "${age} > 20"},
    {"type": "decimal", "name": "area", "relevance": "${late} != 'x'"},
    {"type": "end repeat", "name": "plot"},
    {"type": "select_multiple colors", "name": "colors", "constraint": "count-selected(.) <= 2"},
    {"type": "end group", "name": "main"},
    {"type": "calculate", "name": "ahead", "calculation": "${late}"},
    {"type": "calculate", "name": "late", "calculation": "if(${age} > 50, 'x', 'y')"},
    {"type": "note", "name": "hello"},
    {"type": "text", "name": "off", "relevance": "0"},
]
CHOICES = {"yesno": [("1", "Yes"), ("0", "No")], "colors": [("1", "Red"), ("2", "Green"), ("-99", "Don't know")]}


def test_fold():
    f = form.compile_form(SHEET)
    q = {x["variable_name"]: x for x in f.questions}
    assert list(q) == ["consent", "age", "plot_count", "area", "colors", "ahead", "late", "off"]
    assert q["consent"]["choice_list"] == "yesno" and q["age"]["question_text"] == "Âge"
    assert q["area"]["repeat_path"] == ["plot"] and q["area"]["group_relevances"] == ["${consent} = '1'", "${age} > 20"] and q["plot_count"]["repeat_path"] == []
    assert q["off"]["disabled"] and not q["age"]["disabled"]
    assert q["age"]["constraint_text"] == "age >= 18 & !missing(age) & age < 90" and q["colors"]["condition_text"] == "consent == 1"
    assert f.errors == [] and f.info == {"rows": 12, "groups": 1, "repeats": 1, "questions": 7}
    assert "  [repeat] plot if ${age} > 20\n    - area (decimal) if ${late} != 'x'\n" in form.structure_text(f) and "[group] main if ${consent} = '1'\n" in form.structure_text(f)
    assert "[group] none" in form.structure_text(form.compile_form([{"type": "begin group", "name": "none"}, {"type": "end group"}]))


def test_fold_reports_mismatches():
    f = form.compile_form([{"type": "end group", "name": "x"}, {"type": "begin group", "name": "a"}, {"type": "end repeat", "name": "a"}, {"type": "begin group", "name": "open"}])
    assert len(f.errors) == 3


def test_frames(spark):
    f = form.compile_form(SHEET)
    assert form.questions_frame(spark, f).filter("repeat = 'plot'").count() == 1
    assert form.repeats_frame(spark, f).first()["count"] == "${age} mod 3"


def test_bounds():
    assert sampling.numeric_bounds("3 <= . and . <= 77") == (3, 77) and sampling.numeric_bounds("5 < . and . < 9") == (6, 8)
    assert sampling.numeric_bounds(". > 4 or . < 2") == (None, None) and sampling.numeric_bounds("if(. > 1, true(), false())") == (None, None) and sampling.numeric_bounds("((") == (None, None)
    assert sampling.select_count_bounds("count-selected(.) <= 5 and count-selected(.) >= 2") == (2, 5)
    assert sampling.text_max_length("string-length(.) <= 12") == 12
    assert sampling.exclusive_codes("if(selected(., '-99'), count-selected(.) = 1, true())") == ["-99"]


def test_generation_keeps_the_form(spark):
    f = form.compile_form(SHEET)
    df, plan = synth.generate(spark, f, CHOICES, 300, seed=1, cases=["c1", "c2", "c3"])
    rows = df.collect()
    assert plan.errors == [] and df.columns == plan.columns and "colors__99" in df.columns
    for r in rows:
        if r["consent"] == "0":
            assert r["age"] is None and r["colors"] is None and r["plot_count"] is None
        else:
            assert 18 <= r["age"] <= 89 and 1 <= len(r["colors"].split()) <= 2 and (r["plot_count"] is None) == (r["age"] <= 20)
            assert r["late"] == ("x" if r["age"] > 50 else "y") == r["ahead"] and r["colors_1"] == int("1" in r["colors"].split())
        assert r["off"] is None
    assert {r["caseid"] for r in rows} == {"c1", "c2", "c3"} and len({r["KEY"] for r in rows}) == 300
    again = synth.generate(spark, f, CHOICES, 300, seed=1, cases=["c1", "c2", "c3"])[0].repartition(9)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    other = synth.generate(spark, f, CHOICES, 300, seed=2)[0]
    assert other.select("age").collect() != df.select("age").collect()
    kids = synth.instances(df, f, CHOICES, "plot", seed=1).groupBy("KEY").count().collect()
    assert {r["KEY"]: r["count"] for r in kids} == {r["KEY"]: r["plot_count"] for r in rows if r["plot_count"]}


def test_scripted_answers_and_circles(spark):
    f = form.compile_form(SHEET)
    df, _ = synth.generate(spark, f, CHOICES, 20, seed=1, provider=synth.scripted({"consent": "1", "age": 60}, synth.stochastic(1)))
    assert {(r["consent"], r["age"], r["late"]) for r in df.collect()} == {("1", 60, "x")}
    with pytest.raises(ValueError):
        synth.generate(spark, f, CHOICES, 5, 1, synth.scripted({"consent": "7"}, synth.stochastic(1), strict=True))
    with pytest.raises(ValueError):
        synth.generate(spark, f, CHOICES, 5, 1, synth.scripted({"age": 5}, synth.stochastic(1), strict=True))
    loop = form.compile_form([{"type": "calculate", "name": "a", "calculation": "${b}"}, {"type": "calculate", "name": "b", "calculation": "${a}"}, {"type": "integer", "name": "c", "relevance": "nope()"}])
    df, plan = synth.generate(spark, loop, {}, 5, 1)
    assert sorted(n for n, _ in plan.errors) == ["a", "b", "c"] and df.filter("a is not null or c is not null").count() == 0


def test_rendering(spark):
    df = spark.sql("SELECT 1.0D AS a, 1/3D AS b, true AS c, date'2024-03-05' AS d, timestamp'2024-03-05 14:00:01' AS e, cast(null as double) AS f, 7 AS g, 123456.7891D AS h")
    assert tuple(synth.rendered(df).first()) == ("1", "0.3333333333", "1", "Mar 05, 2024", "Mar 05, 2024 02:00:01 PM", "", "7", "123456.7891")


def test_scenarios(spark):
    f = form.compile_form(SHEET)
    assert scenarios.validate(f, CHOICES, {"consent": "1", "age": 20, "colors": "1 2"}) == []
    assert [v for v, _ in scenarios.validate(f, CHOICES, {"consent": "x", "age": 5, "nobody": 1, "area_2": "wide"})] == ["consent", "age", "nobody", "area_2"]
    runs = scenarios.expand([{"id": "s"}], 3)
    assert len({r["seed"] for r in runs}) == 3 and scenarios.expand([{"id": "s"}], 3) == runs
    trace = spark.createDataFrame([("r", "a", True, None, None), ("r", "b", False, "${x} = 1", "own"), ("r", "b", False, "${x} = 1", "own"), ("r", "c", False, "bad(", "unevaluable")], "run string, variable string, asked boolean, clause string, reason string")
    want = spark.createDataFrame([("r", "a", "reach"), ("r", "b", "block"), ("r", "c", "reach"), ("r", "z", "block")], "run string, variable string, expectation string")
    assert sorted((r["variable"], r["ok"], r["gates"]) for r in scenarios.report(trace, want).collect()) == [("a", True, []), ("b", True, ["${x} = 1"]), ("c", False, ["bad("]), ("z", True, [])]
    assert [tuple(r) for r in scenarios.rejections(trace).collect()] == [("r", "c", "bad(", 1)]


XML = """<page:html xmlns="http://www.w3.org/2002/xforms" xmlns:page="http://www.w3.org/1999/xhtml" xmlns:jr="http://openrosa.org/javarosa"><page:head><model>
<instance><data><name/><plot jr:template=""><area/><kinds/></plot></data></instance>
<bind nodeset="/data/name" type="string" relevant="1 = 1" required="true()"/><bind nodeset="/data/plot/area" type="decimal"/><bind nodeset="/data/extra" calculate="1"/></model></page:head>
<page:body><input ref="/data/name"/><repeat nodeset="/data/plot"><input ref="/data/plot/area"/><select ref="/data/plot/kinds"><item><value>1</value></item><item><value>-99</value></item></select></repeat></page:body></page:html>"""


def test_contract(spark):
    nodes = contract.parse_contract(XML)
    by = {n.path: n for n in nodes}
    assert by["/data/plot/area"].repeats == ["plot"] and by["/data/plot"].is_repeat and by["/data/name"].required and "/data/extra" in by
    m = lambda c: {k: v for k, v in contract.map_column(c, nodes).items() if k in ("status", "choice_code", "iterations", "ragged")}
    assert m("name") == {"status": "matched", "choice_code": None, "iterations": [], "ragged": False}
    assert m("area_2") == {"status": "matched", "choice_code": None, "iterations": [2], "ragged": False}
    assert m("area") == {"status": "matched", "choice_code": None, "iterations": [], "ragged": True}
    assert m("kinds_1_2") == {"status": "matched", "choice_code": "1", "iterations": [2], "ragged": False}
    assert m("kinds__99_3") == {"status": "matched", "choice_code": "-99", "iterations": [3], "ragged": False}
    assert m("KEY")["status"] == m("name-Comment")["status"] == "system" and m("who")["status"] == m("area_1_2")["status"] == "unmapped"
    assert contract.nodes_frame(spark, nodes).count() == len(nodes)
    mapped = spark.createDataFrame([("area_2", "matched", "/data/plot/area"), ("KEY", "system", None), ("old", "unmapped", None)], "column_name string, status string, path string")
    d = spark.createDataFrame([("area_2", "are"), ("KEY", None), ("old", "old_q")], "column_name string, question string")
    assert sorted((r["column_name"], r["question"], r["outcome"], r["overridden"]) for r in contract.overlay(d, mapped).collect()) == [("KEY", None, "system", False), ("area_2", "area", "matched", True), ("old", "old_q", "legacy", False)]


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "f.xlsx")
    sheets.write_xlsx(path, {"survey": (["type", "name", "label"], [["integer", "age", " Old? "], ["text", "n", ""]]), "choices": (["list_name", "value", "label"], [["l", "1", "One & <two>"]]), "settings": (["form_id", "version"], [["f", "3"]])})
    got = sheets.read_sheets(path)
    assert got["survey"] == [{"type": "integer", "name": "age", "label": "Old?"}, {"type": "text", "name": "n", "label": ""}]
    assert got["choices"][0]["label"] == "One & <two>" and sheets.settings(got) == {"form_id": "f", "version": "3"}
    assert sheets.choices_frame(spark, got["choices"]).columns == ["list_name", "value", "label", "ord"]
    wide = spark.createDataFrame([("1", "A", None, "x"), ("2", "B", "k", "K")], "town_id string, town_label string, zone_value string, zone_label string")
    assert sheets.external_choices(wide).count() == 3
    assert sheets.normalised(spark.createDataFrame([(" a\n", None)], "x string, y int")).first() == ("a", "")
    assert sheets.write_csv(wide, ["town_id", "nothing"], str(tmp_path / "out")) == ["nothing"]
    f = form.compile_form(SHEET)
    sheets.write_json(f.questions, str(tmp_path / "q.json"))
    assert sheets.read_json(spark, str(tmp_path / "q.json"), form.QUESTION).count() == len(f.questions)
    assert all(v not in ("", [], None) for r in json.loads((tmp_path / "q.json").read_text()) for v in r.values())
    sheets.write_sections(form.questions_frame(spark, f), str(tmp_path / "s"))
    assert {r["section"] for r in spark.read.json(str(tmp_path / "s")).select("section").distinct().collect()} == {"ungrouped", "main", "main/plot"}


def test_preload(spark, tmp_path):
    (tmp_path / "places.csv").write_text("region,name\n1,A\n1,B\n,C\n")
    names, dynamic = preload.named_tables(["pulldata('places', 'name', 'region', ${r})", "${a} = 1"], ["quick search('places', 'matches', 'region', ${r})"])
    assert names == {"places"} and not dynamic
    assert preload.named_tables(["pulldata(${t}, 'a', 'b', 'c')"]) == (set(), True)
    t = preload.load(spark, [str(tmp_path)], names)["places"]
    assert [r["name"] for r in t.orderBy("_ord").collect()] == ["A", "B", "C"] and t.filter("region is null").count() == 1
    with pytest.raises(preload.MissingTables, match="gone"):
        preload.load(spark, [str(tmp_path)], {"gone", "places"})
    assert preload.search_arguments("search('places', 'matches', 'region', concat(${a}, ','))") == {"table": "places", "matches": [("region", "concat(${a}, ',')")]}
    assert preload.search_arguments("minimal") is None


def test_config(tmp_path, monkeypatch):
    p = config.start(str(tmp_path))
    c = config.load(p)
    assert c.surveys["example"].workbook == str(tmp_path / "forms/example.xlsx") and c.codes is None
    monkeypatch.delenv(config.VARIABLE, raising=False)
    (tmp_path / "a").mkdir()
    assert config.find(str(tmp_path / "a")) == p
    monkeypatch.setenv(config.VARIABLE, "/elsewhere.toml")
    assert str(config.find()) == "/elsewhere.toml"
    with pytest.raises(FileExistsError):
        config.start(str(tmp_path))
    p.write_text("not toml [")
    with pytest.raises(ValueError):
        config.load(p)


def test_shared_folder_is_the_sessions(spark):
    from tallyweave.operators import materialize

    df = materialize.written(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 5 and materialize.shared_root(spark) in df.inputFiles()[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with materialize.session_conf(spark, spark__sql__shuffle__partitions="3", spark__tallyweave__none="1"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.tallyweave.none", None) is None


def test_the_clock_runs_on(spark):
    f = form.compile_form([{"type": "calculate_here", "name": f"t{k}", "calculation": "once(duration())"} for k in range(3)])
    for r in synth.generate(spark, f, {}, 50, 4)[0].collect():
        t = [int(r[f"t{k}"]) for k in range(3)]
        assert 0.04 * r["duration"] <= t[0] <= 0.21 * r["duration"] and t[0] < t[1] < t[2] < 0.6 * r["duration"]
