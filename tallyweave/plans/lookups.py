"""Queries over preload tables and drawn choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, compiled
from tallyweave.lang.syntax import parse
from tallyweave.operators import choices, lookup, search
from tallyweave.plans.registry import query, table


@query("""
WITH t AS (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey)
SELECT c_custkey, coalesce(first_name, '') AS first_name, '' AS no_such_column FROM customer LEFT JOIN t ON c_nationkey = n_regionkey
""")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    out = lookup.pulldata(table(spark, sf_dir, "customer"), nation, F.col("c_nationkey"), "n_regionkey", {"n_name": "first_name", "n_missing": "no_such_column"}, "n_nationkey")
    return out.select("c_custkey", "first_name", "no_such_column")


@query("""
SELECT c_custkey, n_name AS nation, concat('from ', n_name) AS said FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def lookup_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keys as ' 7.0 ' on one side and '7' on the other
    c = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".0 ")))
    nation = table(spark, sf_dir, "nation").withColumn("code", F.col("n_nationkey").cast("string"))
    out = lookup.pulldata(c, nation, F.col("key"), "code", {"n_name": "nation"}, "n_nationkey")
    call = parse("pulldata('nation', 'n_name', 'code', ${key})")
    said = compiled("concat('from ', pulldata('nation', 'n_name', 'code', ${key}))", Scope(out.schema, lookups={call: F.col("nation")}))
    return out.select("c_custkey", "nation", said.col.alias("said"))


@query("""
SELECT r_regionkey, (count(n_nationkey) + 1)::INTEGER AS n_choices, coalesce(string_agg(n_nationkey::VARCHAR || '=' || n_name, ';' ORDER BY n_nationkey) || ';', '') || '-99=Don''t know' AS offered
FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1
""")
def search_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    out = lookup.search_choices(table(spark, sf_dir, "region"), nation, "n_nationkey", "n_name", [("n_regionkey", F.col("r_regionkey"))], [("-99", "Don't know")], "n_nationkey", "offered")
    shown = F.array_join(F.transform("offered", lambda c: F.concat(c["value"], F.lit("="), c["label"])), ";")
    return out.select("r_regionkey", F.size("offered").alias("n_choices"), shown.alias("offered"))


@query("""
WITH w AS (SELECT n_regionkey::VARCHAR AS list_name, n_name AS label FROM nation WHERE n_regionkey < 3), e AS (SELECT n_regionkey::VARCHAR AS list_name, 'ext ' || n_name AS label FROM nation)
SELECT list_name, count(*) AS n, min(label) AS first_label FROM (SELECT * FROM w UNION ALL SELECT * FROM e WHERE list_name NOT IN (SELECT list_name FROM w)) t GROUP BY 1
""")
def choices_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = F.col("n_regionkey").cast("string").alias("list_name")
    both = choices.missing_lists(n.filter("n_regionkey < 3").select(name, F.col("n_name").alias("label")), n.select(name, F.concat(F.lit("ext "), "n_name").alias("label")))
    return both.groupBy("list_name").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))


@query("""
WITH names(c_name) AS (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)
SELECT n.c_name, c.c_custkey, c.c_mktsegment, c.c_custkey IS NOT NULL AS found FROM names n LEFT JOIN customer c USING (c_name)
""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is found by name, no supplier is."""
    c = table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    wanted = c.select("c_name").unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("c_name")))
    return search.lookup(wanted, c, "c_name", "c_custkey")


@query("""
SELECT c_custkey, c_name FROM customer WHERE starts_with(upper(c_name), 'CUSTOMER') AND c_custkey IN (SELECT s_suppkey FROM supplier)
""")
def case_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by prefix, whatever its case, and by a list of ids."""
    cases = lookup.case_pool(table(spark, sf_dir, "customer"), "c_name", "customer", "c_custkey", table(spark, sf_dir, "supplier").select("s_suppkey"))
    return cases.select("c_custkey", "c_name")


@query("""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]{2,}')) AS term FROM documents),
     len AS (SELECT doc_id, count(*) AS len FROM terms GROUP BY 1),
     tf AS (SELECT doc_id, term, count(*)::DOUBLE / any_value(len) AS tf FROM terms JOIN len USING (doc_id) GROUP BY 1, 2),
     df AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1),
     w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)),
     norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
     qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]{2,}')) AS term FROM benchmark),
     q AS (SELECT query_id, term, count(*)::DOUBLE / any_value(n) AS qtf FROM qt JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY 1) c USING (query_id) GROUP BY 1, 2),
     qw AS (SELECT query_id, term, qtf * idf AS qw FROM q JOIN df USING (term)),
     qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
     s AS (SELECT query_id, doc_id, sum(w * qw) / any_value(norm) / any_value(qnorm) AS score FROM w JOIN qw USING (term) JOIN norms USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score >= 0.01)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10
""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query, against all documents; the best ten are the report."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(table(spark, sf_dir, "documents"), asked, 10)
