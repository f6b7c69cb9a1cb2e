"""Profiles of wide exports: ranges, missing shares, special codes, letters for missing, text that is numeric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.lang.values import NUMBER

#: Special answer codes: what they mean and the letter they are recoded to.
CODES = {code: (meaning, f".{meaning[0].lower()}") for code, meaning in zip(range(-99, -65, 11), ("Don't know", "Refused", "Not applicable", "Other"))}
#: Columns handled in one aggregate; wider ones would lose code generation.
BATCH = 40


def _batches(names: list[str], size: int = BATCH) -> list[list[str]]:
    return [names[k : k + size] for k in range(0, len(names), size)] or [[]]


def _plain(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, n, non_null, null_count, missing_rate, all_missing, min_value, max_value); NaN is missing.

    Numbers and times have a range, text has none. One pass for each BATCH of columns.
    """
    parts = []
    for names in _batches(columns or df.columns):
        aggregates = [F.count("*").alias("n")]
        for k, c in enumerate(names):
            x = _plain(df, c)
            ranged = isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
            shown = x.cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.unix_seconds(x.cast("timestamp")).cast("double") if ranged else None
            aggregates += [F.count(x).alias(f"c{k}"), (F.min(shown) if ranged else F.lit(None).cast("double")).alias(f"lo{k}"), (F.max(shown) if ranged else F.lit(None).cast("double")).alias(f"hi{k}")]
        cells = [F.struct(F.lit(c).alias("variable"), F.col("n"), F.col(f"c{k}").alias("non_null"), F.col(f"lo{k}").alias("min_value"), F.col(f"hi{k}").alias("max_value")) for k, c in enumerate(names)]
        parts.append(df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("s")).select("s.*"))
    out = _united(parts, df, "")
    missing = F.col("n") - F.col("non_null")
    rate = F.when(F.col("n") > 0, F.round(missing / F.col("n"), 6)).otherwise(0.0)
    return out.select("variable", "n", "non_null", missing.alias("null_count"), rate.alias("missing_rate"), (F.col("non_null") == 0).alias("all_missing"), "min_value", "max_value")


def sentinel_counts(df: DataFrame, columns: list[str], codes: list[int] | None = None) -> DataFrame:
    """(variable, code, hits) of the special codes found, in numeric and in text columns; codes without hits are left out.

    Conditional counts, one pass for each batch of columns; no cell becomes a row.
    """
    wanted = list(dict.fromkeys(codes if codes is not None else sorted(CODES)))
    parts = []
    for names in _batches(columns, max(1, BATCH // max(1, len(wanted)))):
        counts, cells = [F.count("*").alias("n")], []
        for k, c in enumerate(names):
            x = _plain(df, c)
            numeric = isinstance(df.schema[c].dataType, T.NumericType)
            for j, code in enumerate(wanted):
                counts.append(F.count_if((x == code) if numeric else (x.cast("string") == str(code))).alias(f"h{k}_{j}"))
                cells.append(F.struct(F.lit(c).alias("variable"), F.lit(str(code)).alias("code"), F.col(f"h{k}_{j}").alias("hits")))
        if cells:
            parts.append(df.agg(*counts).select(F.explode(F.array(*cells)).alias("s")).select("s.*"))
    return _united(parts, df, "variable string, code string, hits long").filter("hits > 0")


def _united(parts: list[DataFrame], df: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sentinel_states(df: DataFrame, columns: dict[str, str], codes: list[int] | None = None) -> DataFrame:
    """(variable, state): what the export did with special codes, by the form type of each column.

    ``raw`` still has codes as numbers; ``text`` has them as text; ``letters`` has missing letters; ``numeric_as_text``
    is a numeric question that came as text; ``negative_calculate`` is a calculation with negative results; else ``none``.
    """
    wanted = codes if codes is not None else sorted(CODES)
    flags = []
    for name, form_type in columns.items():
        x, numeric = _plain(df, name), isinstance(df.schema[name].dataType, T.NumericType)
        text = x.cast("string")
        raw = F.count_if(x.isin(wanted)) > 0 if numeric else F.lit(False)
        coded = F.lit(False) if numeric else F.count_if(text.isin([str(c) for c in wanted])) > 0
        lettered = F.lit(False) if numeric else extended_missing_rule(text)
        as_text = F.lit(not numeric and form_type in ("integer", "decimal"))
        negative = F.count_if(x < 0) > 0 if numeric and form_type.startswith("calculate") else F.lit(False)
        state = F.when(raw, "raw").when(coded, "text").when(lettered, "letters").when(as_text, "numeric_as_text").when(negative, "negative_calculate").otherwise("none")
        flags.append(F.struct(F.lit(name).alias("variable"), state.alias("state")))
    return df.agg(F.array(*flags).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def extended_missing_rule(x: Column) -> Column:
    """Aggregate: besides single letters and blanks all values are numbers, and there is at least one number."""
    t = F.trim(F.coalesce(x, F.lit("")))
    letter, numeric = t.rlike("^[a-z]$"), t.rlike(NUMBER)
    return (F.count_if(letter) > 0) & (F.count_if(numeric) > 0) & (F.count_if((t != "") & ~letter & ~numeric) == 0)


def extended_missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, letter, hits) of the columns that hold numbers with single letters for missing answers.

    Which columns those are is one aggregate for each batch of columns, and their names come to the driver; their letters
    are then counted, again by conditional counts.
    """
    good = []
    for names in _batches(columns):
        rule = df.agg(*(extended_missing_rule(F.col(f"`{c}`").cast("string")).alias(f"r{k}") for k, c in enumerate(names))).first() if names else ()
        good += [c for c, holds in zip(names, rule) if holds]
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = []
    for names in _batches(good, max(1, BATCH // 13)) if good else []:
        cells = [(c, x, F.count_if(F.trim(F.col(f"`{c}`").cast("string")) == x).alias(f"l{k}_{x}"), f"l{k}_{x}") for k, c in enumerate(names) for x in letters]
        made = F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(x).alias("letter"), F.col(n).alias("hits")) for c, x, _, n in cells))
        parts.append(df.agg(*(count for _, _, count, _ in cells)).select(F.explode(made).alias("s")).select("s.*"))
    return _united(parts, df, "variable string, letter string, hits long").filter("hits > 0")


def without_letters(x: Column) -> Column:
    """A qualifying column as numbers, its letters null."""
    t = F.trim(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def destringable(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, numeric): whether every non-blank value of a text column is a number and there is one."""
    cells = []
    for c in columns:
        t = F.trim(F.coalesce(F.col(c), F.lit("")))
        cells.append(F.struct(F.lit(c).alias("variable"), ((F.count_if(t.rlike(NUMBER)) > 0) & (F.count_if((t != "") & ~t.rlike(NUMBER)) == 0)).alias("numeric")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def recoded(x: Column, codes: dict[int, tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(value without special codes, the meaning of the code that was there)."""
    table = codes if codes is not None else CODES
    value, why = x, F.lit(None).cast("string")
    for code, (meaning, _) in table.items():
        value = F.when(x == code, None).otherwise(value)
        why = F.when(x == code, meaning).otherwise(why)
    return value, why


def dictionary_summary(dictionary: DataFrame) -> DataFrame:
    """One row of totals over a dictionary (variable, question_type, matched, in_repeat, has_choices, all_missing, missing_rate)."""
    return dictionary.agg(
        F.count("*").alias("total"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.count_if("in_repeat").alias("in_repeat"),
        F.count_if("has_choices").alias("with_choices"),
        F.count_if("all_missing").alias("all_missing"),
        F.count_if(F.col("missing_rate") >= 0.95).alias("sparse"),
    )


def version_drift(df: DataFrame, version: str = "formdef_version") -> DataFrame:
    """(version, submissions, drift): counts by form version, and whether there is more than one."""
    per = df.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("submissions"))
    n = per.agg((F.count_distinct("version") > 1).alias("drift"))
    return per.crossJoin(F.broadcast(n))
