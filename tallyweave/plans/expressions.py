"""Queries over form expressions: gates, arithmetic, text, dates, multiple answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, compiled, predicate, where
from tallyweave.lang.values import as_num, as_text
from tallyweave.operators import choices, gates
from tallyweave.plans.registry import query, table


@query("""
SELECT year(l_shipdate)::INTEGER AS ship_year, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R' GROUP BY 1
""")
def gate_filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("flags", F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    open_ = where(li, "${l_quantity} >= 10 and selected(${flags}, 'R')")
    return open_.groupBy(F.year("l_shipdate").alias("ship_year")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, count(*) FILTER (WHERE coalesce(v < 50, false)) AS below, count(*) FILTER (WHERE NOT coalesce(v < 50, false)) AS not_below,
       count(*) FILTER (WHERE v IS NULL) AS blank, count(*) FILTER (WHERE coalesce(v > 0, false) OR coalesce(v <= 0, false)) AS comparable
FROM e GROUP BY event_type
""")
def gate_null_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    n = lambda source: F.count_if(predicate(source, Scope(ev.schema)))
    return ev.groupBy("event_type").agg(n("${v} < 50").alias("below"), n("not(${v} < 50)").alias("not_below"), n("${v} = ''").alias("blank"), n("${v} > 0 or ${v} <= 0").alias("comparable"))


@query("""
SELECT coalesce(CASE WHEN NOT o_totalprice > 50000 THEN 'group' WHEN NOT o_orderstatus <> 'F' THEN 'group' WHEN NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') THEN 'own' END, 'open') AS reason,
       coalesce(CASE WHEN NOT o_totalprice > 50000 THEN '${o_totalprice} > 50000' WHEN NOT o_orderstatus <> 'F' THEN '${o_orderstatus} != ''F'''
            WHEN NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') THEN 'starts-with(${o_orderpriority}, ''1'') or starts-with(${o_orderpriority}, ''2'')' END, '') AS clause, count(*) AS n
FROM orders GROUP BY 1, 2
""")
def gate_first_failing_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    g = gates.relevance(["${o_totalprice} > 50000", "${o_orderstatus} != 'F'"], "starts-with(${o_orderpriority}, '1') or starts-with(${o_orderpriority}, '2')", Scope(o.schema))
    return o.groupBy(F.coalesce(g.reason, F.lit("open")).alias("reason"), F.coalesce(g.clause, F.lit("")).alias("clause")).agg(F.count("*").alias("n"))


@query("""
SELECT l_linenumber, round(sum(l_extendedprice / nullif(l_discount, 0)), 2) AS per_discount, count(nullif(l_discount, 0)) AS divisible,
       round(sum((-l_quantity) % 7), 4) AS remainder, round(sum(-l_quantity * 2 + l_tax - 1), 4) AS mixed
FROM lineitem GROUP BY l_linenumber
""")
def expr_arith_div_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    v = lambda s: as_num(compiled(s, Scope(li.schema)))
    share = v("${l_extendedprice} div ${l_discount}")
    return li.groupBy("l_linenumber").agg(
        F.round(F.sum(share), 2).alias("per_discount"), F.count(share).alias("divisible"), F.round(F.sum(v("-${l_quantity} mod 7")), 4).alias("remainder"), F.round(F.sum(v("-${l_quantity} * 2 + ${l_tax} - 1")), 4).alias("mixed")
    )


@query("SELECT c_custkey, floor(c_acctbal + 0.5) AS whole, floor(c_acctbal * 10 + 0.5) / 10 AS tenth, trunc(c_acctbal) AS cut FROM customer")
def expr_round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    v = lambda s: as_num(compiled(s, Scope(c.schema)))
    return c.select("c_custkey", v("round(${c_acctbal})").alias("whole"), v("round(${c_acctbal}, 1)").alias("tenth"), v("int(${c_acctbal})").alias("cut"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size > 25 THEN ln(p_size - 25) END, 9) AS log_size, round(CASE WHEN p_size >= 25 THEN sqrt(p_size - 25) END, 9) AS root,
       CASE WHEN p_size <> 25 THEN round(pow(p_size - 25, -1), 9) END AS inverse, round(atan2(p_size, 25), 9) AS angle, round(CASE WHEN abs(p_size - 25) <= 1 THEN asin(p_size - 25) END, 9) AS arc
FROM part
""")
def expr_math_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = lambda s: F.round(as_num(compiled(s, Scope(p.schema))), 9)
    return p.select("p_partkey", v("log(${p_size} - 25)").alias("log_size"), v("sqrt(${p_size} - 25)").alias("root"), v("pow(${p_size} - 25, -1)").alias("inverse"), v("atan2(${p_size}, 25)").alias("angle"), v("asin(${p_size} - 25)").alias("arc"))


@query("""
SELECT p_partkey, upper(p_name) AS upper_name, length(p_name)::DOUBLE AS n, contains(p_type, 'STEEL') AS steel, ends_with(p_type, 'TIN') AS tin, starts_with(p_brand, 'Brand#1') AS first_brand,
       translate(p_brand, 'B#', 'b') AS renamed, p_brand || ':' || p_size AS joined, regexp_matches(p_type, '^[A-Z]+ [A-Z]+') AS two_words,
       trim(format('{:,}', p_size * 1000)) AS thousands
FROM part
""")
def expr_string_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = lambda s: compiled(s, Scope(p.schema)).col
    return p.select(
        "p_partkey", v("upper(${p_name})").alias("upper_name"), v("string-length(${p_name})").alias("n"), v("contains(${p_type}, 'STEEL')").alias("steel"), v("ends-with(${p_type}, 'TIN')").alias("tin"),
        v("starts-with(${p_brand}, 'Brand#1')").alias("first_brand"), v("translate(${p_brand}, 'B#', 'b')").alias("renamed"), v("concat(${p_brand}, ':', ${p_size})").alias("joined"),
        v("regex(${p_type}, '^[A-Z]+ [A-Z]+')").alias("two_words"), v("format-number(${p_size} * 1000)").alias("thousands"),
    )


@query("""
SELECT p_partkey, substr(p_name, 3, 4) AS middle, CASE WHEN length(p_name) <= 3 THEN p_name ELSE right(p_name, 3) END AS tail, substr(p_name, 1, greatest(length(p_name) - 2, 0)) AS head,
       substr(p_name, p_size + 1) AS rest
FROM part
""")
def expr_substr_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = lambda s: as_text(compiled(s, Scope(p.schema)))
    return p.select("p_partkey", v("substr(${p_name}, 2, 6)").alias("middle"), v("substr(${p_name}, -3)").alias("tail"), v("substr(${p_name}, 0, -2)").alias("head"), v("substr(${p_name}, ${p_size})").alias("rest"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '/' || day(o_orderdate) AS stamp, round(epoch(o_orderdate) / 86400.0, 6) AS days,
       trunc((DATE '2026-01-01' - o_orderdate::DATE) / 365.25)::DOUBLE AS age, round((hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + trunc(second(o_orderdate))) / 86400.0, 9) AS clock,
       o_orderdate >= TIMESTAMP '1995-01-01' AS recent
FROM orders
""")
def expr_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = lambda s: compiled(s, Scope(o.schema)).col
    return o.select(
        "o_orderkey", v("format-date-time(${o_orderdate}, '%Y-%m/%e')").alias("stamp"), F.round(v("decimal-date-time(${o_orderdate})"), 6).alias("days"), v("int((today() - date(${o_orderdate})) div 365.25)").alias("age"),
        F.round(v("decimal-time(${o_orderdate})"), 9).alias("clock"), v("${o_orderdate} >= '1995-01-01'").alias("recent"),
    )


@query("SELECT n_nationkey, sha256(n_name || '|' || n_regionkey || '|') AS digest FROM nation")
def expr_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", compiled("hash(${n_name}, ${n_regionkey}, '')", Scope(n.schema)).col.alias("digest"))


@query("""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w)::DOUBLE AS n, coalesce(w[3], '') AS third, list_contains(w, 'the') AS has_the FROM d
""")
def select_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    v = lambda s: compiled(s, Scope(d.schema)).col
    return d.select("doc_id", v("count-selected(${text})").alias("n"), v("selected-at(${text}, 2)").alias("third"), v("selected(${text}, 'the')").alias("has_the"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)
SELECT p_partkey, len(w)::DOUBLE AS n, coalesce(w[2], '') AS second, (coalesce(list_position(w, 'BRASS'), 0) - 1)::DOUBLE AS brass, list_contains(w, 'TIN') AS tin, array_to_string(list_filter(w || w, lambda x, i: list_position(w || w, x) = i), ' ') AS once
FROM p
""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = lambda s: compiled(s, Scope(p.schema)).col
    return p.select(
        "p_partkey", v("count-items(' ', ${p_type})").alias("n"), v("item-at(' ', ${p_type}, 1)").alias("second"), v("item-index(' ', ${p_type}, 'BRASS')").alias("brass"), v("item-present(' ', ${p_type}, 'TIN')").alias("tin"),
        v("de-duplicate(' ', concat(${p_type}, ' ', ${p_type}))").alias("once"),
    )


@query("""
SELECT r_regionkey::VARCHAR AS list_name, coalesce(string_agg(n_nationkey::VARCHAR, ' ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey >= 5 AND n_name <> 'NATION_9'), '') AS kept
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def choice_filter_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sheet = n.select(F.col("n_regionkey").cast("string").alias("list_name"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    lists = choices.choice_lists(sheet)
    kept = choices.filtered(F.col("choices"), lists.schema["choices"].dataType.elementType, "value >= 5 and label != 'NATION_9'", Scope(lists.schema), fallback=False)
    return lists.select("list_name", F.array_join(F.transform(kept, lambda c: c["value"]), " ").alias("kept"))


@query("""
WITH n AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS own FROM nation GROUP BY n_regionkey),
     h AS (SELECT c_custkey, c_nationkey, own, list_filter(own, lambda x: x > c_nationkey) AS later FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN n USING (n_regionkey))
SELECT c_custkey, array_to_string(list_transform(CASE WHEN len(later) > 0 THEN later ELSE own END, lambda x: x::VARCHAR), ' ') AS offered FROM h
""")
def choice_filter_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    sheet = nation.select(F.col("n_regionkey").cast("string").alias("list_name"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    lists = choices.choice_lists(sheet)
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("list_name"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(home), "c_nationkey").join(F.broadcast(lists), "list_name")
    kept = choices.filtered(F.col("choices"), lists.schema["choices"].dataType.elementType, "value > ${c_nationkey}", Scope(rows.schema), fallback=True)
    return rows.select("c_custkey", F.array_join(F.transform(kept, lambda c: c["value"]), " ").alias("offered"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_type IN ('click', 'view'))::INTEGER END AS parent_seen,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_type = 'click')::INTEGER END AS kind_click, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 3 = 0)::INTEGER END AS kind__99
FROM events
""")
def sm_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 5 != 0, F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 3 == 0, "-99")))
    made = choices.indicators(F.col("kind"), ["click", "-99"], "kind")
    rows = ev.withColumn("kind", answer)
    seen = F.when(F.coalesce("kind", F.lit("")) != "", predicate("selected(${kind}, 'click') or selected(${kind}, 'view')", Scope(rows.schema)).cast("int"))
    return rows.select("event_id", seen.alias("parent_seen"), *(c.alias(n) for n, c in made.items()))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE c_mktsegment END AS band,
       coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS shown, c_mktsegment IN ('BUILDING', 'MACHINERY') AS wanted
FROM customer
""")
def expr_conditionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("nick", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    v = lambda s: compiled(s, Scope(c.schema)).col
    return c.select(
        "c_custkey", v("if(${c_acctbal} < 0, 'debt', if(${c_acctbal} < 1000, 'low', ${c_mktsegment}))").alias("band"), v("coalesce(${nick}, ${c_mktsegment})").alias("shown"), v("${c_mktsegment} = 'BUILDING' or ${c_mktsegment} = 'MACHINERY'").alias("wanted")
    )


@query("""
SELECT event_id, len(list_filter([20.0, 50.0, 80.0], lambda x: x > floor(value)))::DOUBLE + 1 AS place FROM events
""")
def expr_rank_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("whole", F.floor("value"))
    return ev.select("event_id", as_num(compiled("rank-value(${whole}, concat('20 50 ', ${whole}, ' 80'))", Scope(ev.schema))).alias("place"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Choice four' WHEN c_custkey % 4 = 1 THEN 'One' ELSE '' END AS label FROM customer")
def choice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("code", F.col("c_custkey") % 4)
    scope = Scope(c.schema, choices={"code": [("0", "Choice four"), ("1", "One"), ("1", "Never")]})
    return c.select("c_custkey", compiled("choice-label(${code}, ${code})", scope).col.alias("label"))


def constraint_holds(df: DataFrame, column: str, constraint: str) -> DataFrame:
    """``df`` with ``valid``: whether a column meets its constraint, in which ``.`` is the column."""
    scope = Scope(df.schema)
    scope.this = scope.variable(column)
    return df.withColumn("valid", predicate(constraint, scope))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 1 AND l_quantity <= 40) AS valid, count(*) FILTER (WHERE NOT (l_quantity >= 1 AND l_quantity <= 40)) AS refused FROM lineitem GROUP BY 1")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = constraint_holds(table(spark, sf_dir, "lineitem"), "l_quantity", ". >= 1 and . <= 40")
    return li.groupBy("l_returnflag").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("refused"))
