"""Queries that profile a wide export; what it lacks (blanks, special codes, letters) is put in by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope
from tallyweave.operators import gates, profile, stats
from tallyweave.plans.registry import query, table


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ev = table(spark, sf_dir, "events")
    score = F.when(k % 13 == 0, -99.0).when(k % 17 == 0, -88.0).when(k % 7 == 0, None).otherwise(F.col("value"))
    note = F.when(k % 19 == 0, "-77").when(k % 23 == 0, "x").otherwise("ok")
    mixed = F.when(k % 11 == 0, "d").when(k % 29 == 0, "r").when(k % 31 == 0, "").otherwise((k % 40).cast("string"))
    words = F.when(k % 11 == 0, "d").otherwise(F.col("event_type"))
    return ev.withColumns({"score": score, "note": note, "mixed": mixed, "words": words})


_CODED = """coded AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN -99.0 WHEN event_id % 17 = 0 THEN -88.0 WHEN event_id % 7 = 0 THEN NULL ELSE value END AS score,
  CASE WHEN event_id % 19 = 0 THEN '-77' WHEN event_id % 23 = 0 THEN 'x' ELSE 'ok' END AS note,
  CASE WHEN event_id % 11 = 0 THEN 'd' WHEN event_id % 29 = 0 THEN 'r' WHEN event_id % 31 = 0 THEN '' ELSE (event_id % 40)::VARCHAR END AS mixed,
  CASE WHEN event_id % 11 = 0 THEN 'd' ELSE event_type END AS words FROM events)"""


def _profile_sql() -> str:
    one = lambda t, c, lo, hi: f"SELECT '{c}' AS variable, count(*) AS n, count({c}) AS non_null, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate, count({c}) = 0 AS all_missing, {lo}::DOUBLE AS min_value, {hi}::DOUBLE AS max_value FROM {t}"
    whole = [one("lineitem", c, f"min({c})", f"max({c})") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    whole += [one("lineitem", c, "NULL", "NULL") for c in ("l_returnflag", "l_linestatus")] + [one("lineitem", "l_shipdate", "floor(epoch(min(l_shipdate)))", "floor(epoch(max(l_shipdate)))")]
    whole += [one("coded", c, f"min({c})", f"max({c})") for c in ("event_id", "user_id", "value", "score")] + [one("coded", c, "NULL", "NULL") for c in ("event_type", "props", "note", "mixed", "words")]
    whole += [one("coded", "ts", "floor(epoch(min(ts)))", "floor(epoch(max(ts)))")]
    return f"WITH {_CODED} " + " UNION ALL ".join(whole)


@query(_profile_sql())
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the lines and of the coded events."""
    return profile.column_profile(table(spark, sf_dir, "lineitem")).unionByName(profile.column_profile(_coded(spark, sf_dir)))


@query(f"""
WITH {_CODED}, c AS (SELECT 'score' AS variable, CASE WHEN score = floor(score) THEN score::BIGINT::VARCHAR END AS code FROM coded UNION ALL SELECT 'note', note FROM coded)
SELECT variable, code, count(*) AS hits FROM c WHERE code IN ('-99', '-88', '-77', '-66') GROUP BY 1, 2
""")
def sentinel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sentinel_counts(_coded(spark, sf_dir), ["score", "note"])


@query("""SELECT * FROM (VALUES ('score', 'raw'), ('note', 'text'), ('mixed', 'letters'), ('words', 'none'), ('event_id', 'none')) t(variable, state)""")
def sentinel_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sentinel_states(_coded(spark, sf_dir), {"score": "integer", "note": "text", "mixed": "integer", "words": "text", "event_id": "calculate"})


@query(f"WITH {_CODED} SELECT 'mixed' AS variable, mixed AS letter, count(*) AS hits FROM coded WHERE mixed IN ('d', 'r') GROUP BY 2")
def ext_missing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.extended_missing_counts(_coded(spark, sf_dir), ["mixed", "words", "note"])


@query(f"""
WITH {_CODED}, t AS (SELECT 'mixed' AS variable, mixed AS x FROM coded UNION ALL SELECT 'cleaned', CASE WHEN mixed IN ('d', 'r') THEN NULL ELSE mixed END FROM coded UNION ALL SELECT 'words', words FROM coded)
SELECT variable, bool_and(coalesce(trim(x), '') = '' OR regexp_full_match(trim(x), '-?[0-9]+([.][0-9]+)?')) AND bool_or(coalesce(regexp_full_match(trim(x), '-?[0-9]+([.][0-9]+)?'), false)) AS numeric FROM t GROUP BY 1
""")
def destring_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _coded(spark, sf_dir)
    return profile.destringable(coded.withColumn("cleaned", profile.without_letters(F.col("mixed")).cast("int").cast("string")), ["mixed", "cleaned", "words"])


@query(f"""
WITH {_CODED} SELECT event_id, CASE WHEN score IN (-99, -88) THEN NULL ELSE score END AS score, CASE WHEN score = -99 THEN 'Don''t know' WHEN score = -88 THEN 'Refused' END AS reason FROM coded
""")
def sentinel_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, why = profile.recoded(F.col("score"))
    return _coded(spark, sf_dir).select("event_id", value.alias("score"), why.alias("reason"))


def _tabstat_sql() -> str:
    def one(v: str, condition: str, where: str) -> str:
        c = condition.replace("'", "''")
        q = ", ".join(f"round(quantile_cont({v}::DOUBLE, {p}), 6) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
        return f"SELECT '{v}' AS variable, '{c}' AS condition, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, min({v})::DOUBLE AS min, {q}, max({v})::DOUBLE AS max FROM lineitem WHERE {where}"

    return " UNION ALL ".join([one("l_quantity", "", "true"), one("l_tax", "", "true"), one("l_extendedprice", "${l_returnflag} = 'R'", "l_returnflag = 'R'"), one("l_discount", "${l_quantity} > 25", "l_quantity > 25")])


@query(_tabstat_sql())
def relevance_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.tabstat(table(spark, sf_dir, "lineitem"), {"l_quantity": "", "l_tax": "", "l_extendedprice": "${l_returnflag} = 'R'", "l_discount": "${l_quantity} > 25"})
    rounded = {c: F.round(c, 6) for c in ("mean", "sd", "p25", "p50", "p75")}
    return made.withColumns(rounded)


@query("""
SELECT '${l_quantity} > 10' AS condition, count(*) FILTER (WHERE l_quantity > 10) AS rows, count(*) FILTER (WHERE l_quantity > 10) = 0 AS zero FROM lineitem
UNION ALL SELECT '${l_quantity} > 1000', count(*) FILTER (WHERE l_quantity > 1000), count(*) FILTER (WHERE l_quantity > 1000) = 0 FROM lineitem
UNION ALL SELECT 'no-such-function(1)', NULL, false
""")
def zero_obs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.condition_counts(table(spark, sf_dir, "lineitem"), ["${l_quantity} > 10", "${l_quantity} > 1000", "no-such-function(1)"])


@query("""
WITH t AS (SELECT o_orderstatus = 'O' AS a, o_totalprice > 100000 AS b FROM orders)
SELECT 'delivery' AS variable, count(*) FILTER (WHERE a) AS asked_count, count(*) FILTER (WHERE NOT a) AS gated_count, count(*) FILTER (WHERE a) = 0 AS never_asked FROM t
UNION ALL SELECT 'discount', count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE NOT (a AND b)), count(*) FILTER (WHERE a AND b) = 0 FROM t
UNION ALL SELECT 'retired', 0, count(*), true FROM t
UNION ALL SELECT 'start', count(*), 0, false FROM t
""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    scope = Scope(o.schema)
    opened = {
        "start": gates.relevance([], "", scope),
        "delivery": gates.relevance([], "${o_orderstatus} = 'O'", scope),
        "discount": gates.relevance(["${o_orderstatus} = 'O'"], "${o_totalprice} > 100000", scope),
        "retired": gates.relevance(["0"], "", scope),
    }
    return gates.coverage_summary(gates.coverage(o, "o_orderkey", opened))


@query("SELECT o_orderpriority AS version, count(*) AS submissions, true AS drift FROM orders GROUP BY 1")
def version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.version_drift(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT l_orderkey, round(sum(l_quantity + l_tax + coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, 0)), 6) AS total FROM lineitem GROUP BY 1")
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("big", F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    return li.groupBy("l_orderkey").agg(F.round(F.sum(stats.row_total(["l_quantity", "l_tax", "big"])), 6).alias("total"))
