"""Queries over repeat groups: an order as respondent, its lines as instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, predicate
from tallyweave.operators import repeats
from tallyweave.plans.registry import query, table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_IDX = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER)


@query("""
SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(sum(l_quantity), 0) AS quantity, min(l_quantity) AS least, max(l_quantity) AS most, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS flagged
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def repeat_count_sum_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")).withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(""))
    q = repeats.number(li, "l_quantity")
    made = {"lines": F.count("*"), "quantity": repeats.sum_of(q), "least": F.min(q), "most": F.max(q), "flagged": repeats.count_of(F.col("flag"))}
    return repeats.scoped(table(spark, sf_dir, "orders").select("o_orderkey"), li, ["o_orderkey"], made, {"lines": 0, "quantity": 0.0, "flagged": 0})


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0.05) AS count_if, coalesce(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 0) AS sum_if,
       min(l_extendedprice) FILTER (WHERE l_discount > 0.05) AS min_if, max(l_extendedprice) FILTER (WHERE l_discount > 0.05) AS max_if
FROM lineitem GROUP BY 1
""")
def repeat_if_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return repeats.if_family(li, ["l_orderkey"], "l_extendedprice", predicate("${l_discount} > 0.05", Scope(li.schema)))


@query("""
SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS roles, coalesce(string_agg(length(text)::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS user_lengths FROM conversations GROUP BY 1
""")
def repeat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    size = F.when(predicate("${role} = 'user'", Scope(c.schema)), F.char_length("text").cast("string"))
    return c.groupBy("conv_id").agg(repeats.joined(F.col("turn"), F.col("role"), " > ").alias("roles"), repeats.joined(F.col("turn"), size, ",").alias("user_lengths"))


@query(f"""
WITH l AS (SELECT *, {_IDX} AS idx FROM lineitem)
SELECT l_orderkey, idx::INTEGER AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, idx)::INTEGER AS rank,
       CASE WHEN l_discount > 0.05 THEN row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_discount > 0.05 THEN l_quantity END DESC NULLS LAST, idx) ELSE 999 END::INTEGER AS rank_if
FROM l
""")
def repeat_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    when = predicate("${l_discount} > 0.05", Scope(li.schema))
    return li.select("l_orderkey", "idx", repeats.ranked(li, ["l_orderkey"], "idx", "l_quantity").alias("rank"), repeats.ranked(li, ["l_orderkey"], "idx", "l_quantity", when).alias("rank_if"))


@query(f"""
WITH l AS (SELECT *, {_IDX} AS idx FROM lineitem)
SELECT l_orderkey, max(CASE WHEN idx = 2 THEN l_quantity END) AS second, coalesce(max(CASE WHEN idx = 5 THEN l_returnflag END), '') AS fifth_flag FROM l GROUP BY 1
""")
def repeat_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    return li.groupBy("l_orderkey").agg(repeats.indexed(F.col("idx"), 2, F.col("l_quantity")).alias("second"), F.coalesce(repeats.indexed(F.col("idx"), 5, F.col("l_returnflag")), F.lit("")).alias("fifth_flag"))


@query("""
SELECT n_nationkey, c.c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent,
       round(any_value(t.total), 2) AS nation_total, any_value(t.n) AS nation_orders
FROM nation JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
JOIN (SELECT c_nationkey, coalesce(sum(o_totalprice), 0) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) t ON t.c_nationkey = n_nationkey
GROUP BY 1, 2
""")
def nested_repeat_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: aggregates of the inner instances by the whole chain, then by the outer prefix from those."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    inner = people.join(orders, "c_custkey", "left").fillna({"orders": 0, "spent": 0.0})
    outer = inner.groupBy("n_nationkey").agg(F.round(F.sum("spent"), 2).alias("nation_total"), F.sum("orders").alias("nation_orders"))
    return inner.join(outer, "n_nationkey").select("n_nationkey", "c_custkey", "orders", F.round("spent", 2).alias("spent"), "nation_total", "nation_orders")


def _grid_sql(field: str) -> str:
    return f"(PIVOT (SELECT l_orderkey, '{field}_' || idx AS place, {field} FROM l) ON place USING first({field}) GROUP BY l_orderkey)"


@query(f"WITH l AS (SELECT *, {_IDX} AS idx FROM lineitem) SELECT * FROM {_grid_sql('l_quantity')} q JOIN {_grid_sql('l_returnflag')} f USING (l_orderkey)")
def wide_grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of all instances, as wide as the order with the most lines."""
    li = _lines(spark, sf_dir)
    return repeats.grid(li, ["l_orderkey"], "idx", ["l_quantity", "l_returnflag"], repeats.largest_count(li, ["l_orderkey"]))


@query(f"""
WITH l AS (SELECT *, {_IDX} AS idx FROM lineitem) SELECT l_orderkey, idx::INTEGER AS idx, l_quantity, l_returnflag FROM l
""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.from_wide(wide_grid_pivot(spark, sf_dir), ["l_orderkey"], ["l_quantity", "l_returnflag"])


@query("SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def repeat_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(repeats.largest_count(table(spark, sf_dir, "lineitem"), ["l_orderkey"]),)], "largest long")


@query(f"""
WITH l AS (SELECT *, {_IDX} AS idx FROM lineitem),
     a AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, sum(l_extendedprice) FILTER (WHERE l_discount > 0.05) AS cheap, max(l_tax) AS tax, string_agg(l_returnflag, '' ORDER BY idx) AS flags,
                  max(CASE WHEN idx = 2 THEN l_linestatus END) AS second FROM l GROUP BY 1),
     r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, idx) AS rank, idx FROM l)
SELECT o_orderkey, round(coalesce(q, 0) / nullif(n, 0), 6) AS mean_quantity, coalesce(n, 0) > 3 AND coalesce(cheap, 0) > 0.5 * o_totalprice AS mostly_cheap, coalesce(flags, '') AS flags, coalesce(second, '') AS second,
       coalesce(rank, 999)::DOUBLE AS first_rank, round(tax * 100, 6) AS top_tax
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey AND r.idx = 1
""")
def repeat_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that mix aggregates over instances with the parent's own columns."""
    li = _lines(spark, sf_dir)
    child = li.select(F.col("l_orderkey").alias("o_orderkey"), "idx", *(c for c in li.columns if c not in ("l_orderkey", "idx")))
    sources = {
        "mean_quantity": "sum(${l_quantity}) div count(${line})",
        "mostly_cheap": "count(${line}) > 3 and sum-if(${l_extendedprice}, ${l_discount} > 0.05) > 0.5 * ${o_totalprice}",
        "flags": "join('', ${l_returnflag})",
        "second": "indexed-repeat(${l_linestatus}, ${line}, 2)",
        "first_rank": "rank-index(1, ${l_quantity})",
        "top_tax": "max(${l_tax}) * 100",
    }
    out = repeats.evaluated(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), child, ["o_orderkey"], "idx", sources, group="line")
    return out.select("o_orderkey", F.round("mean_quantity", 6).alias("mean_quantity"), "mostly_cheap", "flags", "second", "first_rank", F.round("top_tax", 6).alias("top_tax"))
