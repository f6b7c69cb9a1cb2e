"""Nested repeats, the rectangular export, directives and the run's own columns."""

import pytest

from tallyweave.operators import form, synth

TAGS = {"tags": [("1", "a"), ("2", "b"), ("-99", "none")]}


def sheet(*rows):
    out = []
    for r in rows:
        if r == "end":
            out.append({"type": "end repeat"})
        elif r[0] == "repeat":
            out.append({"type": "begin repeat", "name": r[1], "repeat_count": r[2]} | (r[3] if len(r) > 3 else {}))
        else:
            out.append({"type": r[0], "name": r[1]} | (r[2] if len(r) > 2 else {}))
    return form.compile_form(out)


def made(spark, f, rows=4, seed=3, choices=TAGS, **more):
    top, plan = synth.generate(spark, f, choices, rows, seed, **more)
    wide = synth.exported(top, f, choices, seed, more.get("provider"), more.get("wishes", synth.Wishes()), plan)
    return [c for c in wide.columns if c not in (*synth.RUN, *synth.AFTER)], [r.asDict() for r in wide.collect()], plan


def test_two_levels_are_a_grid_with_the_outer_number_slowest(spark):
    columns, rows, _ = made(spark, sheet(("repeat", "out", "2"), ("text", "o"), ("repeat", "inn", "3"), ("text", "m"), "end", "end"))
    assert columns == ["out_count", "o_1", "o_2", "inn_count_1", "inn_count_2", *(f"m_{a}_{b}" for a in (1, 2) for b in (1, 2, 3))]
    assert all(r[c] is not None for r in rows for c in columns) and len({r["m_1_1"] for r in rows} | {r["m_2_1"] for r in rows}) == 8


def test_three_levels(spark):
    columns, _, _ = made(spark, sheet(("repeat", "a", "2"), ("repeat", "b", "2"), ("repeat", "c", "2"), ("text", "leaf"), "end", "end", "end"), rows=1)
    cells = [f"_{x}_{y}" for x in (1, 2) for y in (1, 2)]
    assert columns == ["a_count", "b_count_1", "b_count_2", *(f"c_count{c}" for c in cells), *(f"leaf{c}_{z}" for c in cells for z in (1, 2))]


def test_a_count_of_none_has_no_columns(spark):
    columns, rows, _ = made(spark, sheet(("repeat", "r", "0"), ("text", "m"), "end"))
    assert columns == ["r_count"] and {r["r_count"] for r in rows} == {0}


def test_each_outer_instance_has_its_own_inner_count(spark):
    f = sheet(("repeat", "hh", "3"), ("integer", "jobs", {"constraint": ". >= 1 and . <= 4"}), ("repeat", "job", "${jobs}"), ("text", "what"), "end", "end")
    columns, rows, _ = made(spark, f, rows=20)
    most = max(r[f"jobs_{o}"] for r in rows for o in (1, 2, 3))
    for r in rows:
        for o in (1, 2, 3):
            assert r[f"job_count_{o}"] == r[f"jobs_{o}"]
            assert [r[f"what_{o}_{k}"] is not None for k in range(1, most + 1)] == [k <= r[f"jobs_{o}"] for k in range(1, most + 1)]
    kids = synth.instances(synth.generate(spark, f, TAGS, 20, 3)[0], f, TAGS, "job", 3)
    assert kids.columns == ["KEY", "idx_1", "idx", "what"] and kids.count() == sum(r[f"jobs_{o}"] for r in rows for o in (1, 2, 3))


def test_indicators_in_repeats_have_the_code_first_and_no_cell_of_their_own(spark):
    f = sheet(("repeat", "a", "2"), ("repeat", "b", "2"), ("select_multiple tags", "t"), "end", "end", ("select_multiple tags", "u"))
    columns, rows, _ = made(spark, f)
    cells = [f"_{x}_{y}" for x in (1, 2) for y in (1, 2)]
    assert [c for c in columns if c.startswith("t")] == [f"t_{code}{c}" for c in cells for code in ("1", "2", "_99")]
    assert columns[-4:] == ["u", "u_1", "u_2", "u__99"] and all(sum(r[f"t_{k}_1_2"] for k in ("1", "2", "_99")) >= 1 for r in rows)


def test_an_inner_name_means_the_innermost_variable(spark):
    f = sheet(("calculate", "x", {"calculation": "'top'"}), ("calculate", "y", {"calculation": "'only'"}), ("repeat", "r", "2"), ("calculate", "x", {"calculation": "concat('in ', index())"}), ("repeat", "q", "1"), ("calculate", "z", {"calculation": "concat(${x}, ' ', ${y})"}), "end", "end")
    _, rows, _ = made(spark, f, rows=1)
    assert rows[0]["z_1_1"] == "in 1 only" and rows[0]["z_2_1"] == "in 2 only"


def test_counts_without_a_number_are_drawn_within_bounds(spark):
    f = sheet(("repeat", "r", "'many'", {"constraint": ". >= 2 and . <= 3"}), ("text", "m"), "end", ("repeat", "s", "-4"), ("text", "n"), "end")
    _, rows, _ = made(spark, f, rows=30)
    assert {r["r_count"] for r in rows} == {2, 3} and {r["s_count"] for r in rows} == {0}


def test_pinned_counts_are_still_gated(spark):
    f = sheet(("repeat", "m", ""), ("text", "n"), "end")
    columns, _, _ = made(spark, f, wishes=synth.Wishes(repeat_counts={"m": 3}))
    assert columns == ["m_count", "n_1", "n_2", "n_3"]
    closed = sheet(("repeat", "m", "", {"relevance": "1 = 2"}), ("text", "n"), "end")
    assert made(spark, closed, wishes=synth.Wishes(repeat_counts={"m": 3}))[0] == ["m_count"]


def test_forced_values_open_their_own_gate_only(spark):
    f = sheet(("text", "a", {"relevance": "1 = 2"}), ("text", "b", {"relevance": "1 = 2"}), ("text", "c", {"relevance": "${a} = 'v'"}))
    _, rows, _ = made(spark, f, wishes=synth.Wishes(force={"a": "v"}))
    assert all(r["a"] == "v" and r["b"] is None and r["c"] is not None for r in rows)


def test_scripted_cells_come_before_variables_and_gates_before_both(spark):
    f = sheet(("select_one tags", "k"), ("integer", "age", {"constraint": ". >= 0 and . <= 5"}), ("text", "hid", {"relevance": "1 = 2"}), ("repeat", "r", "3"), ("text", "n"), "end")
    p = synth.scripted({"k": "99", "age": 999, "hid": "X", "n": "all", "n_2": "two", "n_2_2": "no"}, synth.stochastic(3))
    _, rows, _ = made(spark, f, provider=p)
    assert all(r["k"] in ("1", "2", "-99") and 0 <= r["age"] <= 5 and r["hid"] is None and (r["n_1"], r["n_2"], r["n_3"]) == ("all", "two", "all") for r in rows)
    assert set(p.rejected) == {"k", "age"}
    with pytest.raises(ValueError):
        made(spark, f, provider=synth.scripted({"age": "x"}, synth.stochastic(3), strict=True))


def test_a_circle_settles_and_what_cannot_be_compiled_is_closed(spark):
    f = sheet(("calculate", "a", {"calculation": "if(${b} = '', 'start', 'on')"}), ("calculate", "b", {"calculation": "${a}"}), ("repeat", "r", "1"), ("calculate", "x", {"calculation": "${y}"}), ("calculate", "y", {"calculation": "coalesce(${x}, 'z')"}), ("text", "bad", {"relevance": "nope()"}), "end")
    _, rows, plan = made(spark, f)
    assert {(r["a"], r["b"], r["x_1"], r["y_1"], r["bad_1"]) for r in rows} == {("on", "on", "z", "z", None)}
    assert sorted(n for n, _ in plan.errors) == ["a", "b", "bad", "x", "y"]


def test_run_columns(spark):
    f = sheet(("calculate", "duration", {"calculation": "'mine'"}))
    top, plan = synth.generate(spark, f, {}, 200, 5, settings={"version": "2024.0"})
    rows = top.collect()
    assert top.columns == ["_row", *synth.RUN, *synth.AFTER] and {r["duration"] for r in rows} == {"mine"} and {r["formdef_version"] for r in rows} == {"2024"}
    import re

    for r in rows:
        assert r["starttime"] < r["endtime"] == r["CompletionDate"] <= r["SubmissionDate"]
        assert re.fullmatch(r"uuid:[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r["KEY"])
        assert re.fullmatch(r"collect:\d{6}", r["deviceid"]) and re.fullmatch(r"\d{15}", r["simid"]) and re.fullmatch(r"\+1555\d{7}", r["devicephonenum"]) and re.fullmatch(r"enum\d{3}", r["username"])
    assert len({r["KEY"] for r in rows}) == 200 and rows[0]["caseid"] == "case-0001"
    from pyspark.sql import functions as F

    text = top.select(synth.audit_url("text audit", F.col("KEY"), F.lit(9)).alias("t"), synth.audit_url("audio audit", F.col("KEY"), F.lit(9)).alias("a"), "KEY").first()
    assert text["t"].endswith(f"/submissions/{text['KEY']}/attachments/TA_{text['KEY'][5:]}.csv") and text["a"].endswith("_AFTER_9S.m4a")
