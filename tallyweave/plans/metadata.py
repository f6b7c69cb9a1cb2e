"""Queries over names, paths and references: resolution, order, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.conditions import Target, condition_text
from tallyweave.operators import graph, profile, resolve, search
from tallyweave.plans.registry import query, table
from tallyweave.sources import contract, sheets

_LONG = "a_question_whose_name_goes_on_and_on"  # 36 characters, clipped to 32 in an export
_QUESTIONS = ["plot_area", "income", "colors", "Mixed_Case", "mixed_case", "OnlyUpper", _LONG, "nested"]
_COLUMNS = {
    "plot_area": ("plot_area", 1), "plot_area_2": ("plot_area", 2), "income2": ("income", 3), "plot_area_2_3": ("plot_area", 4), "colors__99": ("colors", 4),
    _LONG[:32]: (_LONG, 5), "onlyupper": ("OnlyUpper", 6), "onlyupper_4": ("OnlyUpper", 7), "MIXED_CASE": (None, None), "unknown_thing": (None, None), "nested_a_b_1": ("nested", 4),
}


def _resolve_sql() -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'"
    fixed = ", ".join(f"({q(c)}, {q(v)}, {'NULL' if s is None else s})" for c, (v, s) in _COLUMNS.items())
    return f"""
WITH fixed(column_name, question, stage) AS (VALUES {fixed})
SELECT column_name, question, stage::INTEGER AS stage FROM fixed
UNION ALL SELECT n_name || '_' || n_regionkey, n_name, 2 FROM nation
UNION ALL SELECT lower(n_name), n_name, 6 FROM nation
"""


@query(_resolve_sql())
def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    questions = spark.createDataFrame([(x,) for x in _QUESTIONS], "variable_name string").unionByName(n.select(F.col("n_name").alias("variable_name")))
    columns = spark.createDataFrame([(x,) for x in _COLUMNS], "column_name string")
    columns = columns.unionByName(n.select(F.concat_ws("_", "n_name", "n_regionkey").alias("column_name"))).unionByName(n.select(F.lower("n_name").alias("column_name")))
    return resolve.resolve_columns(columns, questions)


@query("""
WITH c AS (SELECT *, n_nationkey % 3 = 0 AS multiple, n_nationkey % 2 = 0 AS repeated FROM nation),
     d AS (SELECT n_nationkey, multiple, repeated, CASE n_nationkey % 4 WHEN 0 THEN '_2_3' WHEN 1 THEN '__99' WHEN 2 THEN '_2' ELSE '_7' END AS suffix FROM c)
SELECT n_nationkey, CASE WHEN NOT multiple THEN NULL WHEN suffix = '_2_3' THEN CASE WHEN repeated THEN '2' END WHEN suffix = '__99' THEN '-99' WHEN suffix = '_2' THEN '2' END AS choice_code,
       (CASE WHEN NOT repeated THEN NULL WHEN suffix = '_2_3' THEN CASE WHEN multiple THEN 3 END WHEN suffix = '_2' THEN CASE WHEN NOT multiple THEN 2 END WHEN suffix = '_7' THEN 7 END)::INTEGER AS iteration
FROM d
""")
def decode_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    suffix = F.when(k % 4 == 0, "_2_3").when(k % 4 == 1, "__99").when(k % 4 == 2, "_2").otherwise("_7")
    n = table(spark, sf_dir, "nation").withColumn("column", F.concat("n_name", suffix))
    d = resolve.decoded(F.col("column"), F.col("n_name"), k % 3 == 0, k % 2 == 0, F.array(F.lit("1"), F.lit("2"), F.lit("-99")))
    return n.select("n_nationkey", d.alias("d")).select("n_nationkey", "d.choice_code", "d.iteration")


@query("""
WITH d AS (SELECT n_nationkey AS ordinal, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_regionkey END AS question_order, CASE WHEN n_regionkey IN (1, 2) AND n_nationkey % 6 <> 5 THEN 1 END AS repeat_anchor, n_nationkey % 3 AS iteration, n_nationkey % 2 AS choice_index FROM nation)
SELECT ordinal, row_number() OVER (ORDER BY coalesce(repeat_anchor, question_order) NULLS LAST, iteration, question_order NULLS LAST, choice_index, ordinal)::INTEGER AS variable_order FROM d
""")
def dictionary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    d = table(spark, sf_dir, "nation").select(k.alias("ordinal"), F.when(k % 6 != 5, r).alias("question_order"), F.when(r.isin(1, 2) & (k % 6 != 5), 1).alias("repeat_anchor"), (k % 3).alias("iteration"), (k % 2).alias("choice_index"))
    return resolve.form_order(d).select("ordinal", "variable_order")


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(.*)$', 1), '/'), lambda x: x <> '') AS path FROM pages),
     s AS (SELECT page_id, unnest(CASE WHEN len(path) = 0 THEN ['ungrouped'] ELSE list_transform(range(1, least(len(path), 2) + 1), lambda k: array_to_string(path[1:k], '/')) END) AS section FROM p)
SELECT section, count(*) AS questions FROM s GROUP BY 1
""")
def section_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.filter(F.split(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^https?://[^/]+/(.*)$", 1), "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select(F.explode(resolve.section_prefixes(path, 2)).alias("section")).groupBy("section").agg(F.count("*").alias("questions"))


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of keys: nations gated by their region, suppliers calculated from their nation."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    r = table(spark, sf_dir, "region")
    blank = F.lit("")
    roots = r.select(F.concat(F.lit("r"), "r_regionkey").alias("variable_name"), blank.alias("relevance"), blank.alias("calculation"), F.lit(None).cast("string").alias("repeat"))
    gated = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("${r"), "n_regionkey", F.lit("} = 1 and ${gone} = 2")), blank, F.concat(F.lit("r"), "n_regionkey")).toDF(*roots.columns)
    made = s.select(F.concat(F.lit("s"), "s_suppkey"), blank, F.concat(F.lit("${n"), "s_nationkey", F.lit("} + ${n"), "s_nationkey", F.lit("}")), F.lit(None).cast("string")).toDF(*roots.columns)
    return roots.unionByName(gated).unionByName(made)


_EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'gated_by' AS kind FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'calculates_from' FROM supplier)"""


@query(f"""
WITH {_EDGES}, s AS (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst, 'repeat_sibling' AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT * FROM e UNION ALL SELECT * FROM s
""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _form(spark, sf_dir)
    return graph.reference_edges(form).unionByName(graph.sibling_edges(form))


@query(f"""
WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
     walk(start, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT start, u.dst, hops + 1 FROM walk JOIN u ON u.src = walk.node WHERE hops < 2)
SELECT start, node, min(hops)::INTEGER AS hops FROM walk GROUP BY 1, 2
""")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.neighbourhood(graph.reference_edges(_form(spark, sf_dir)), starts, 2)


@query("""
WITH RECURSIVE p AS (SELECT 'r' || r_regionkey AS name, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
     d(name, depth) AS (SELECT name, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.name, depth + 1 FROM p JOIN d ON p.parent = d.name)
SELECT name, depth::INTEGER AS depth FROM d
""")
def repeat_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = lambda t, a, k, b, f: table(spark, sf_dir, t).select(F.concat(F.lit(a), k).alias("name"), (F.concat(F.lit(b), f) if b else F.lit(None).cast("string")).alias("parent"))
    parents = up("region", "r", "r_regionkey", "", "").unionByName(up("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(up("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return graph.depths(parents)


@query("""
SELECT 'n' || n_nationkey AS variable_name, 0 AS position, '${r' || n_regionkey || '} = 1 and ${gone} = 2' AS clause, unnest(['r' || n_regionkey, 'gone']) AS reference, unnest(['', NULL]) AS reference_relevance FROM nation
""")
def gate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _form(spark, sf_dir).withColumn("group_relevances", F.array().cast("array<string>"))
    return graph.gate_chain(form, form.filter(F.col("variable_name").startswith("n")).select("variable_name"))


@query("""
WITH e AS (SELECT event_type || '_' || (event_id % 4) AS variable FROM events UNION SELECT event_type || '_count' FROM events)
SELECT variable, (SELECT count(*) FROM e f WHERE f.variable <> e.variable AND starts_with(f.variable, replace(e.variable, '_count', '_')) AND regexp_matches(f.variable, '_[0-9]+$')) AS related FROM e WHERE ends_with(variable, '_count')
""")
def count_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    d = ev.select(F.concat_ws("_", "event_type", (F.col("event_id") % 4).cast("string")).alias("variable")).unionByName(ev.select(F.concat("event_type", F.lit("_count")).alias("variable"))).distinct()
    return resolve.related_counts(d)


@query("""
SELECT w.c_name AS wanted, c.c_custkey, c.c_name FROM (SELECT c_name, min(c_custkey) AS mid FROM customer GROUP BY 1) w JOIN customer c ON c.c_custkey BETWEEN mid - 3 AND mid + 3
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rows before and after each customer."""
    c = table(spark, sf_dir, "customer")
    return search.context(c.select("c_custkey", "c_name"), c.select("c_name"), "c_name", "c_custkey", 3)


@query("""
SELECT doc_id, length(text) AS chars, len(list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]{2,}'), lambda x: true)) AS terms FROM documents
""".replace("SELECT doc_id, length(text) AS chars, len(", "SELECT doc_id, len(").replace(" AS terms", "::INTEGER AS terms"))
def tokenise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(search.terms(F.col("text"))).alias("terms"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 10) AS matched, count(*) FILTER (WHERE p_size <= 10) AS unmatched, count(*) FILTER (WHERE p_type LIKE '%BRASS') AS in_repeat,
       count(*) FILTER (WHERE p_brand = 'Brand#11') AS with_choices, count(*) FILTER (WHERE p_size = 1) AS all_missing, count(*) FILTER (WHERE p_size / 50.0 >= 0.95) AS sparse
FROM part
""")
def dictionary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    d = p.select((F.col("p_size") > 10).alias("matched"), F.col("p_type").endswith("BRASS").alias("in_repeat"), (F.col("p_brand") == "Brand#11").alias("has_choices"), (F.col("p_size") == 1).alias("all_missing"), (F.col("p_size") / 50).alias("missing_rate"))
    return profile.dictionary_summary(d)


@query("""
SELECT 'l' || n_regionkey AS list_name, count(*)::INTEGER AS n_choices, (SELECT count(*) FROM supplier JOIN nation b ON s_nationkey = b.n_nationkey WHERE b.n_regionkey = n.n_regionkey) AS n_variables FROM nation n GROUP BY n_regionkey
""")
def choice_list_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    sheet = n.select(F.concat(F.lit("l"), "n_regionkey").alias("list_name"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    users = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("l"), "n_regionkey").alias("choice_list"), F.col("s_name").alias("variable_name"))
    return search.choice_lists_report(sheet, users).select("list_name", F.size("choices").alias("n_choices"), "n_variables")


@query("""
WITH n AS (SELECT DISTINCT n_name AS name, lower(n_name) AS low FROM nation), w AS (SELECT name AS wanted, low AS wl FROM n UNION SELECT s_name, lower(s_name) FROM supplier),
     m AS (SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY abs(length(name) - length(wanted)), name) AS rank FROM w, n WHERE contains(low, wl) OR contains(wl, low) OR substr(low, 1, 5) = substr(wl, 1, 5))
SELECT wanted, name, rank::INTEGER AS rank FROM m WHERE rank <= 5
""")
def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names like each nation's and each supplier's; five of them are the report."""
    n = table(spark, sf_dir, "nation").select("n_name")
    return search.suggestions(n, "n_name", n.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("n_name"))))


@query("""
SELECT n_nationkey, 'n_' || n_nationkey || ' > ' || n_regionkey || ' & !missing(n_' || n_nationkey || ') & (colors_' || n_nationkey || ' == 1 | missing(name))' AS condition FROM nation
""")
def condition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip logic of each nation's question as condition text; the metadata is small and printed on the driver."""
    rows = []
    for k, r in sorted(tuple(x) for x in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()):
        source = f"${{n_{k}}} > {r} and (selected(${{colors}}, '{k}') or ${{name}} = '')"
        rows.append((k, condition_text(source, Target({"colors": "select_multiple", "name": "text"}))))
    return spark.createDataFrame(rows, "n_nationkey int, condition string")


@query("""
SELECT 'f' || n_nationkey || '_' || n_regionkey AS column_name, 'matched' AS status, '/data/g/f' || n_nationkey AS path, n_regionkey = 0 AS odd FROM nation WHERE n_regionkey > 0
UNION ALL SELECT 'f' || n_nationkey || '_' || n_regionkey, 'unmapped', NULL, true FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'meta-' || r_name, 'system', NULL, false FROM region
""")
def contract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a compiled form in which each nation is a field of one repeat; instances count from 1."""
    n = sorted(tuple(x) for x in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())
    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    nodes = [contract.Node("/data/g", "g", [], True), *(contract.Node(f"/data/g/f{k}", f"f{k}", ["g"]) for k, _ in n)]
    mapped = [contract.map_column(c, nodes) for c in [*(f"f{k}_{r}" for k, r in n), *(f"meta-{x}" for x in names)]]
    return spark.createDataFrame([(m["column_name"], m["status"], m["path"], m["status"] == "unmapped") for m in mapped], "column_name string, status string, path string, odd boolean")


@query("""
SELECT 'town' AS list_name, s_suppkey::VARCHAR AS value, s_name AS label FROM supplier UNION SELECT 'zone', s_nationkey::VARCHAR, 'zone ' || s_nationkey FROM supplier WHERE s_nationkey > 3
""")
def external_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    zone = F.when(F.col("s_nationkey") > 3, F.col("s_nationkey"))
    return sheets.external_choices(s.select(F.col("s_suppkey").alias("town_id"), F.col("s_name").alias("town_label"), zone.alias("zone_value"), F.concat(F.lit("zone "), "s_nationkey").alias("zone_label")))
