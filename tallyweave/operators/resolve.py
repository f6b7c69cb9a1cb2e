"""From export columns back to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 32


def _direct_base(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.+?)([0-9]+)$", 1)


def _suffix_base(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.+?)_([0-9]+)$", 1)


def resolve_columns(columns: DataFrame, questions: DataFrame, column: str = "column_name", question: str = "variable_name") -> DataFrame:
    """(column_name, question, stage): the question each export column comes from, null where none or ambiguous.

    Stages, the first that matches wins: 1 the name itself; 2 without ``_N``; 3 without trailing digits; 4 without
    ``_parts`` from the right, longest first; 5 a name of 32 characters that clips just one longer name; 6 to 9 the
    same without regard to case (whole, without _N, without digits, clipped), each only where one question fits.
    """
    names = columns.select(F.col(column).alias("column_name")).distinct()
    c, q = F.col("column_name"), F.col(question)
    parts = F.split(c, "_")
    prefixes = F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct((F.lit(400) + F.size(parts) - k).alias("stage"), F.lit("exact").alias("view"), F.array_join(F.slice(parts, 1, k), "_").alias("key")))
    ).otherwise(F.array())

    def candidate(stage: int, view: str, key: Column) -> Column:
        return F.array(F.struct(F.lit(stage).alias("stage"), F.lit(view).alias("view"), key.alias("key")))

    low = F.lower(c)
    candidates = F.concat(
        candidate(100, "exact", c),
        candidate(200, "exact", _suffix_base(c)),
        candidate(300, "exact", _direct_base(c)),
        prefixes,
        candidate(500, "clip", F.when(F.char_length(c) == CLIP, c)),
        candidate(600, "lower", low),
        candidate(700, "lower", F.lower(_suffix_base(c))),
        candidate(800, "lower", F.lower(_direct_base(c))),
        candidate(900, "lower_clip", F.when(F.char_length(c) == CLIP, low)),
    )
    keys = names.select("column_name", F.explode(candidates).alias("k"))
    keys = keys.select("column_name", "k.*").filter("key is not null and key <> ''")
    views = questions.select(q.alias("q")).distinct().select(
        "q",
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("view"), F.col("q").alias("key")),
                F.struct(F.lit("lower").alias("view"), F.lower("q").alias("key")),
                F.struct(F.lit("clip").alias("view"), F.when(F.char_length("q") > CLIP, F.substring("q", 1, CLIP)).alias("key")),
                F.struct(F.lit("lower_clip").alias("view"), F.when(F.char_length("q") > CLIP, F.lower(F.substring("q", 1, CLIP))).alias("key")),
            )
        ).alias("v"),
    )
    index = views.select("q", "v.*").filter("key is not null").groupBy("view", "key").agg(F.count("*").alias("n"), F.min("q").alias("q")).filter("n = 1")
    hits = keys.join(index.drop("n"), ["view", "key"]).groupBy("column_name").agg(F.min(F.struct("stage", "q")).alias("best"))
    stage = F.floor(F.col("best.stage") / 100).cast("int")
    return names.join(hits, "column_name", "left").select("column_name", F.col("best.q").alias("question"), stage.alias("stage"))


def decoded(column: Column, question: Column, multiple: Column, repeated: Column, codes: Column) -> Column:
    """Struct (choice_code, iteration): what a column's suffix says.

    In a repeated multiple answer the choice comes before the iteration. ``__N`` is a negative code. A code counts only
    if the list has it, an iteration only inside a repeat; nothing is invented.
    """
    rest = column.substr(F.char_length(question) + 1, F.lit(1 << 20))
    two = F.regexp_extract(rest, r"^(__?)([0-9]+)_([0-9]+)$", 2)
    one = F.regexp_extract(rest, r"^(__?)?([0-9]+)$", 2)
    negative = rest.startswith("__")
    signed = lambda n: F.when(negative, F.concat(F.lit("-"), n)).otherwise(n)
    known = lambda n: multiple & (n != "") & F.array_contains(codes, n)
    last = F.regexp_extract(rest, r"^(__?)([0-9]+)_([0-9]+)$", 3)
    both = repeated & (two != "") & known(signed(two))
    code = F.when(both, signed(two)).when((one != "") & known(signed(one)), signed(one))
    turn = F.when(both, last).when(repeated & (one != "") & ~negative & ~known(one), one)
    return F.struct(code.alias("choice_code"), turn.try_cast("int").alias("iteration"))


def form_order(dictionary: DataFrame) -> DataFrame:
    """``dictionary`` with variable_order from 1: by repeat anchor or question order, iteration, order within, choice; unmatched last.

    Needs question_order, repeat_anchor, iteration, choice_index and ordinal (place in the export, the last tie-break).
    """
    key = [F.coalesce("repeat_anchor", "question_order").asc_nulls_last(), F.coalesce("iteration", F.lit(0)), F.col("question_order").asc_nulls_last(), F.coalesce("choice_index", F.lit(0)), F.col("ordinal")]
    return dictionary.withColumn("variable_order", F.row_number().over(Window.orderBy(*key)))


def section_prefixes(path: Column, depth: int) -> Column:
    """Every prefix of a group path up to ``depth``, joined by '/'; a pathless question is in 'ungrouped'."""
    n = F.least(F.size(path), F.lit(depth))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(path, 1, k), "/"))).otherwise(F.array(F.lit("ungrouped")))


def related_counts(dictionary: DataFrame) -> DataFrame:
    """(variable, related): for each ``base_count`` variable the number of ``base…_N`` columns."""
    counts = dictionary.filter(F.col("variable").endswith("_count")).select("variable", F.expr("substring(variable, 1, length(variable) - 6)").alias("base"))
    others = dictionary.filter(F.col("variable").rlike("_[0-9]+$")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("variable", "_")) - 1), lambda k: F.array_join(F.slice(F.split("variable", "_"), 1, k), "_"))).alias("base"), F.col("variable").alias("v"))
    per = others.distinct().groupBy("base").agg(F.count("*").alias("related"))
    return counts.join(per, "base", "left").select("variable", F.coalesce("related", F.lit(0)).alias("related"))


def choice_defects(columns: DataFrame) -> DataFrame:
    """(column_name, defect) over decoded multiple-answer columns (column_name, choice_code, codes array).

    ``fabricated``: no list at all; ``demoted``: the list has the code with a minus; ``unknown``: the list lacks it.
    """
    code, codes = F.col("choice_code"), F.coalesce("codes", F.array().cast("array<string>"))
    defect = F.when(F.size(codes) == 0, "fabricated").when(F.array_contains(codes, F.concat(F.lit("-"), code)), "demoted").when(~F.array_contains(codes, code), "unknown")
    return columns.filter(code.isNotNull()).select("column_name", defect.alias("defect")).filter("defect is not null")
