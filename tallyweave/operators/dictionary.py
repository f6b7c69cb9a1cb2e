"""The variable dictionary: one record for each export column, from columns, questions and the profile of the data.

Columns, questions and choices are metadata: thousands of rows however large the export. They are joined as frames; the
data itself is written once, by columns, and only aggregated (its profile and special codes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.lang.conditions import Target, condition_text, inherited
from tallyweave.operators import profile, resolve
from tallyweave.operators.materialize import written

#: What a question says about each of its columns.
FROM_QUESTION = ("question_text", "choice_list", "relevance", "group_relevances", "condition_text", "constraint", "constraint_text", "calculation", "choice_filter", "references", "group_path", "repeat_path", "repeat", "question_order", "disabled")


def export_columns(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, storage_type) of an export."""
    rows = [(f.name, k, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_name string, ordinal int, storage_type string")


def listed(choices: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(choice_list, choices): the options of each list, in order, with ``ord`` if the sheet has it."""
    if choices is None:
        return spark.createDataFrame([], "choice_list string, choices array<struct<value:string,label:string>>")
    order = F.col("ord") if "ord" in choices.columns else F.lit(0)
    options = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("value").cast("string").alias("value"), F.col("label").cast("string").alias("label"))))
    return choices.groupBy(F.col("list_name").alias("choice_list")).agg(F.transform(options, lambda c: F.struct(c["value"].alias("value"), c["label"].alias("label"))).alias("choices"))


def iterations(column: Column, question: Column, code: Column) -> Column:
    """The instance numbers in a column's suffix, outermost first, without the choice code before them."""
    rest = column.substr(F.char_length(question) + 1, F.lit(1 << 20))
    parts = F.regexp_extract_all(rest, F.lit(r"([0-9]+)"), 1)
    mine = F.when(code.isNotNull(), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    numbers = F.transform(mine, lambda x: x.try_cast("int"))
    return F.when(rest.rlike(r"^(__?[0-9]+)(_[0-9]+)*$|^[0-9]+$"), numbers).otherwise(F.array().cast("array<int>"))


def _code_and_numbers(df: DataFrame) -> DataFrame:
    """With choice_code and iterations: the code is the first number of a multiple answer if its list has it."""
    rest = F.col("column_name").substr(F.char_length("question") + 1, F.lit(1 << 20))
    first = F.regexp_extract(rest, r"^(__?)?([0-9]+)(_[0-9]+)*$", 2)
    signed = F.when(rest.startswith("__"), F.concat(F.lit("-"), first)).otherwise(first)
    known = F.array_contains(F.transform(F.col("choices"), lambda c: c["value"]), signed)
    code = F.when((F.col("question_type") == "select_multiple") & (first != "") & F.coalesce(known, F.lit(False)), signed)
    out = df.withColumn("choice_code", code)
    # a name found by another stage than these has no suffix of its own, and a number outside repeats is no instance
    numbers = iterations(F.col("column_name"), F.col("question"), F.col("choice_code"))
    depth = F.size(F.coalesce("repeat_path", F.array().cast("array<string>")))
    return out.withColumn("iterations", F.when(F.col("question").isNotNull() & (depth > 0), F.slice(numbers, F.lit(1), depth)).otherwise(F.array().cast("array<int>")))


def specific_conditions(spark: SparkSession, questions: list[dict], wanted: list[tuple[str, int]]) -> DataFrame:
    """(question, iteration, condition_specific, group_conditions_specific): conditions as they read in one instance, the
    first with those of the groups around.

    Variables of the question's own repeat are suffixed, ``index()`` is the number. The printing is done on the driver,
    once for each question and instance number that the export has.
    """
    types = {q["variable_name"]: q["type"] for q in questions}
    inside: dict[str, set[str]] = {}
    for q in questions:
        if q["repeat"]:
            inside.setdefault(q["repeat"], set()).add(q["variable_name"])
    by_name = {q["variable_name"]: q for q in questions}
    rows = []
    for name, k in wanted:
        q = by_name.get(name)
        if q is None:
            continue
        target = Target(types, iteration=k, repeated=frozenset(inside.get(q["repeat"], ())))
        rows.append((name, k, inherited(q["group_relevances"], q["relevance"], target), [t for g in q["group_relevances"] if (t := condition_text(g, target))]))
    return spark.createDataFrame(rows, "question string, iteration int, condition_specific string, group_conditions_specific array<string>")


def assembled(df: DataFrame, questions: DataFrame, choices: DataFrame | None = None, codes: dict[int, tuple[str, str]] | None = None, degraded: bool = False) -> DataFrame:
    """The dictionary of an export ``df`` by a form's ``questions`` (form.QUESTION) and ``choices`` (list_name, value, label).

    A column that no question fits has matched = false and stands last. Special codes are those of ``codes``
    (profile.CODES by default; an empty table looks for none). ``variable_order`` is the form's: instances of a repeat
    stand together, in the place of its count.
    """
    spark = df.sparkSession
    columns = written(export_columns(df), "columns")
    # each of the passes below then reads its own columns and doesn't make the export again
    df = written(df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"}), "export")
    q = written(questions, "questions")
    first = Window.partitionBy("variable_name").orderBy("question_order")
    single = q.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(F.col("variable_name").alias("question"), F.col("type").alias("question_type"), *FROM_QUESTION)
    found = resolve.resolve_columns(columns.select("column_name"), q)
    rows = columns.join(found, "column_name").join(single, "question", "left").join(listed(choices, spark), "choice_list", "left")
    rows = _code_and_numbers(rows).withColumn("iteration", F.try_element_at("iterations", F.lit(-1)))
    anchors = q.filter("type = 'repeat_count'").groupBy(F.col("repeat_group_name").alias("repeat")).agg(F.min("question_order").alias("repeat_anchor"))
    rows = rows.join(anchors, "repeat", "left").withColumn("repeat_anchor", F.when(F.col("iteration").isNotNull(), F.col("repeat_anchor")))
    options = F.col("choices")
    place = F.array_position(F.transform(options, lambda c: c["value"]), F.col("choice_code"))
    label = F.get(F.filter(options, lambda c: c["value"] == F.col("choice_code")), F.lit(0))["label"]
    table = profile.CODES if codes is None else codes
    meanings = F.create_map(*(F.lit(x) for code, (why, _) in table.items() for x in (str(code), why))) if table else F.lit(None).cast("map<string,string>")
    rows = rows.withColumns({"choice_index": F.when(F.col("choice_code").isNotNull(), place).cast("int"), "choice_label": label, "special_code_meaning": F.try_element_at(meanings, F.col("choice_code"))})
    facts = profile.column_profile(df).withColumnRenamed("variable", "column_name")
    hits = profile.sentinel_counts(df, df.columns, list(table)) if table else spark.createDataFrame([], "variable string, code string, hits long")
    hits = hits.groupBy(F.col("variable").alias("column_name")).agg(F.array_sort(F.collect_list(F.struct("code", "hits"))).alias("sentinels"))
    related = resolve.related_counts(columns.select(F.col("column_name").alias("variable"))).withColumnRenamed("variable", "column_name")
    rows = rows.join(facts, "column_name", "left").join(hits, "column_name", "left").join(related, "column_name", "left")
    wanted = [(r["question"], r["iteration"]) for r in rows.filter("iteration is not null").select("question", "iteration").distinct().collect()]
    rows = rows.join(specific_conditions(spark, [r.asDict() for r in q.collect()], wanted), ["question", "iteration"], "left")
    rows = resolve.form_order(rows)
    return rows.select(
        "variable_order",
        F.col("column_name").alias("variable_name"),
        "storage_type",
        F.col("question").alias("original_variable_name"),
        F.coalesce("question_type", F.lit("unmatched")).alias("question_type"),
        F.col("question").isNotNull().alias("matched"),
        "stage",
        *(c for c in FROM_QUESTION if c != "repeat_path"),
        (F.size(F.coalesce("repeat_path", F.array().cast("array<string>"))) > 0).alias("is_repeat"),
        (F.col("question_type") == "select_multiple").alias("is_select_multiple"),
        "choices",
        "choice_code",
        "choice_label",
        "choice_index",
        "special_code_meaning",
        "iterations",
        "iteration",
        "condition_specific",
        "group_conditions_specific",
        "n",
        "non_null",
        "null_count",
        "missing_rate",
        "all_missing",
        "min_value",
        "max_value",
        F.coalesce("sentinels", F.array().cast("array<struct<code:string,hits:bigint>>")).alias("sentinels"),
        F.coalesce("related", F.lit(0)).alias("related_columns"),
        F.lit(degraded).alias("degraded"),
    )


def flattened(dictionary: DataFrame) -> DataFrame:
    """What statistics and search need of a dictionary, in order: the condition of an instance goes before the form's."""
    return dictionary.select(
        "variable_name",
        "variable_order",
        "non_null",
        F.col("question_type").alias("type"),
        F.col("question_text").alias("label"),
        F.coalesce("condition_specific", "condition_text").alias("relevance"),
        "storage_type",
        "original_variable_name",
        "disabled",
        "choice_list",
        F.array_join("group_path", "/").alias("group_path"),
        "group_relevances",
    ).orderBy("variable_order")


def summary(dictionary: DataFrame) -> DataFrame:
    """Totals over an assembled dictionary."""
    return profile.dictionary_summary(dictionary.select(F.col("variable_name").alias("variable"), "question_type", "matched", F.col("is_repeat").alias("in_repeat"), (F.size(F.coalesce("choices", F.array().cast("array<struct<value:string,label:string>>"))) > 0).alias("has_choices"), F.coalesce("all_missing", F.lit(False)).alias("all_missing"), F.coalesce("missing_rate", F.lit(0.0)).alias("missing_rate")))


def varlists(names: list[str], most: int = 67_000) -> list[list[str]]:
    """Names in runs whose text, joined by blanks, has at most ``most`` characters; a longer name is a run of its own."""
    out: list[list[str]] = []
    size = 0
    for n in names:
        if out and size + 1 + len(n) <= most:
            out[-1].append(n)
            size += 1 + len(n)
        else:
            out.append([n])
            size = len(n)
    return out
