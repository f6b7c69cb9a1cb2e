"""From workbooks to documents of a survey, one survey's failure apart from the others."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from tallyweave.operators import dictionary, form, graph, synth
from tallyweave.operators.materialize import written
from tallyweave.sources import exports, preload, sheets
from tallyweave.sources.config import Config, Survey


def document(spark: SparkSession, survey: Survey, out: str, rows: int = 0, seed: int = 0, codes: dict[int, tuple[str, str]] | None = None, wishes: synth.Wishes = synth.Wishes(), answers: dict[str, object] | None = None, cases: list[str] | None = None) -> form.Form:  # noqa: B008
    """Sheets as CSV, questions as JSON, the outline, sections, the graph; with data its Parquet sidecar and dictionary (JSON,
    sheet, totals); for ``rows``, generated responses as the rectangular export."""
    book = sheets.read_sheets(survey.workbook)
    made = form.compile_form(book["survey"])
    folder = Path(out, survey.name)
    folder.mkdir(parents=True, exist_ok=True)
    choices = sheets.choices_frame(spark, [r | {"value": r.get("value") or r.get("name", "")} for r in book.get("choices", [])])
    columns = [c for c in choices.columns if c != "ord"]
    missing = sheets.write_csv(choices, list(dict.fromkeys(["list_name", "value", "label", *columns])), str(folder / "choices"))
    sizes = {r["list_name"]: r["count"] for r in choices.groupBy("list_name").count().orderBy("list_name").collect()}
    (folder / "choices.json").write_text(json.dumps({"lists": sizes, "missing_columns": missing}, indent=1), encoding="utf-8")
    head = list(dict.fromkeys(k for row in book["survey"] for k in row))
    sheet = spark.createDataFrame([tuple(row.get(c) or None for c in head) for row in book["survey"]], ", ".join(f"`{c}` string" for c in head))
    sheets.write_csv(sheet, head, str(folder / "survey"))
    questions = form.questions_frame(spark, made)
    sheets.write_json(made.questions, str(folder / f"{survey.name}_questions.json"))
    (folder / "structure.txt").write_text(form.structure_text(made), encoding="utf-8")
    sheets.write_sections(questions, str(folder / "sections"))
    edges = graph.reference_edges(questions).unionByName(graph.sibling_edges(questions))
    found = None
    if survey.data:
        export = exports.read_stata(spark, survey.data) if survey.data.endswith(".dta") else spark.read.parquet(survey.data)
        export = exports.write_sidecar(export, str(folder / "data.parquet"))
        named = choices if {"list_name", "value", "label"} <= set(choices.columns) else None
        found = written(dictionary.assembled(export, questions, named, codes), "dictionary")
        exports.write_dictionary(found, str(folder / f"{survey.name}_variable_dictionary.json"))
        exports.write_dictionary_sheet(found, str(folder / f"{survey.name}_dictionary.xlsx"))
        (folder / "summary.json").write_text(json.dumps(dictionary.summary(found).first().asDict()), encoding="utf-8")
    exports.write_graph(questions.select("variable_name", "type", "repeat"), edges, str(folder), graph.repeat_structure(questions, found))
    names, dynamic = preload.named_tables([q[k] for q in made.questions for k in ("relevance", "constraint", "calculation", "choice_filter")], [q["appearance"] for q in made.questions])
    if names or dynamic:
        # fails here, before anything is generated, where a table that the form names is in no folder
        tables = preload.load(spark, list(survey.preload), names, dynamic)
        (folder / "preload.json").write_text(json.dumps({n: [c for c in t.columns if c != "_ord"] for n, t in tables.items()}), encoding="utf-8")
    if rows:
        lists: dict[str, list[tuple[str, str]]] = {}
        for r in book.get("choices", []):
            lists.setdefault(r["list_name"], []).append((r.get("value") or r.get("name", ""), r.get("label", "")))
        provide = synth.scripted(answers, synth.stochastic(seed)) if answers else None
        df, plan = synth.generate(spark, made, lists, rows, seed, provide, cases, sheets.settings(book), wishes)
        wide = synth.exported(df, made, lists, seed, provide, wishes, plan)
        plan.errors += [(n, f"{why}; drawn instead") for n, why in (provide.rejected.items() if provide else ())]
        synth.rendered(wide).write.mode("overwrite").option("header", True).csv(str(folder / "synthetic"))
        strip = folder / "synthetic_errors.txt"
        strip.unlink(missing_ok=True)
        if plan.errors:
            strip.write_text("".join(f"{n}\t{e}\n" for n, e in plan.errors), encoding="utf-8")
    return made


def document_all(spark: SparkSession, config: Config, out: str, rows: int = 0) -> dict[str, str | None]:
    """Each survey's error, or None."""
    results: dict[str, str | None] = {}
    for name, survey in config.surveys.items():
        try:
            document(spark, survey, out, rows, codes=config.codes)
            results[name] = None
        except Exception as e:  # reported, and the next survey goes on
            results[name] = f"{type(e).__name__}: {e}"
    return results
