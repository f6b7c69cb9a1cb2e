"""Queries over whole surveys: the dictionary of an export, repeats, generated responses, traces, defects, expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.lang.compiler import Scope, compiled
from tallyweave.lang.conditions import Target, condition_text, kept_clauses, structural_issues
from tallyweave.lang.values import as_bool, as_num, as_text
from tallyweave.operators import choices, dictionary, form, gates, graph, repeats, resolve, scenarios, search, stats, synth
from tallyweave.plans.registry import query, table
from tallyweave.plans.repeats import _IDX, _lines
from tallyweave.sources import contract

_ORDER_SHEET = [
    {"type": "integer", "name": "l_orderkey", "label": "Order"},
    {"type": "begin repeat", "name": "line", "repeat_count": "${lines}", "relevance": "${l_orderkey} > 0"},
    {"type": "decimal", "name": "l_quantity", "label": "How many?"},
    {"type": "select_one flags", "name": "l_returnflag", "label": "Returned?", "relevance": "${l_quantity} > 1"},
    {"type": "end repeat"},
    {"type": "select_multiple flags", "name": "seen", "label": "Flags seen", "relevance": "selected(${seen}, 'N') or ${l_orderkey} = 1"},
]
_FLAGS = [("flags", "N", "no"), ("flags", "R", "returned"), ("flags", "1", "one"), ("flags", "-99", "unknown")]


def _order_form() -> form.Form:
    return form.compile_form(_ORDER_SHEET)


def _order_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of orders: the grid of all lines, a multiple answer's indicators and a column no question knows."""
    li = _lines(spark, sf_dir)
    size = repeats.largest_count(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    wide = repeats.grid(li, ["l_orderkey"], "idx", ["l_quantity", "l_returnflag"], size, {"line_count": F.count("*")})
    coded = F.when(F.col("l_orderkey") % 10 == 0, -99).otherwise((F.col("l_orderkey") % 2).cast("int"))
    return wide.withColumns({"seen_1": coded, "seen__99": F.when(F.col("l_orderkey") % 3 > 0, 0), "stray": F.lit(None).cast("string")})


def _order_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = spark.createDataFrame([(*r, k) for k, r in enumerate(_FLAGS)], "list_name string, value string, label string, ord int")
    return dictionary.assembled(_order_export(spark, sf_dir), form.questions_frame(spark, _order_form()), sheet)


_DICTIONARY = f"""l AS (SELECT *, {_IDX} AS idx FROM lineitem), o AS (SELECT l_orderkey, count(*) AS line_count FROM l GROUP BY 1), n AS (SELECT count(*) AS n FROM o), m AS (SELECT max(line_count)::INTEGER AS most FROM o),
d AS (
  SELECT 1 AS variable_order, 'l_orderkey' AS variable_name, 'l_orderkey' AS original_variable_name, 'integer' AS question_type, NULL AS choice_code, NULL::INTEGER AS iteration, count(*) AS non_null, min(l_orderkey)::DOUBLE AS min_value, max(l_orderkey)::DOUBLE AS max_value, NULL AS relevance, NULL AS sentinels FROM o
  UNION ALL SELECT 2, 'line_count', 'line_count', 'repeat_count', NULL, NULL, count(*), min(line_count), max(line_count), 'l_orderkey > 0 & !missing(l_orderkey)', NULL FROM o
  UNION ALL SELECT 1 + 2 * idx, 'l_quantity_' || idx, 'l_quantity', 'decimal', NULL, idx, count(l_quantity), min(l_quantity), max(l_quantity), 'l_orderkey > 0 & !missing(l_orderkey)', NULL FROM l GROUP BY idx
  UNION ALL SELECT 2 + 2 * idx, 'l_returnflag_' || idx, 'l_returnflag', 'select_one', NULL, idx, count(l_returnflag), NULL, NULL, 'l_orderkey > 0 & !missing(l_orderkey) & l_quantity_' || idx || ' > 1 & !missing(l_quantity_' || idx || ')', NULL FROM l GROUP BY idx
  UNION ALL SELECT 3 + 2 * most, 'seen_1', 'seen', 'select_multiple', '1', NULL, count(*), CASE WHEN bool_or(l_orderkey % 10 = 0) THEN -99 ELSE min(l_orderkey % 2) END, max(CASE WHEN l_orderkey % 10 = 0 THEN -99 ELSE l_orderkey % 2 END), 'seen_N == 1 | l_orderkey == 1', '-99=' || count(*) FILTER (WHERE l_orderkey % 10 = 0) FROM o, m GROUP BY most
  UNION ALL SELECT 4 + 2 * most, 'seen__99', 'seen', 'select_multiple', '-99', NULL, count(*) FILTER (WHERE l_orderkey % 3 > 0), 0, 0, 'seen_N == 1 | l_orderkey == 1', NULL FROM o, m GROUP BY most
  UNION ALL SELECT 5 + 2 * most, 'stray', NULL, 'unmatched', NULL, NULL, 0, NULL, NULL, NULL, NULL FROM m
)"""


@query(f"""
WITH {_DICTIONARY}
SELECT variable_order::INTEGER AS variable_order, variable_name, original_variable_name, question_type, choice_code, iteration::INTEGER AS iteration, non_null, n AS n, round((n - non_null) / n::DOUBLE, 6) AS missing_rate, min_value, max_value, coalesce(sentinels, '') AS sentinels,
       CASE WHEN question_type = 'repeat_count' THEN (SELECT 2 * most FROM m) * 0 ELSE 0 END::BIGINT AS related_columns FROM d, n
""")
def variable_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each column of the orders' export: its question, place, instance, profile and special codes."""
    shown = F.array_join(F.transform("sentinels", lambda s: F.concat(s["code"], F.lit("="), s["hits"].cast("string"))), ";")
    return _order_dictionary(spark, sf_dir).withColumn("sentinels", shown).select(
        "variable_order", "variable_name", "original_variable_name", "question_type", "choice_code", "iteration", "non_null", "n", "missing_rate", "min_value", "max_value", "sentinels", "related_columns"
    )


@query(f"WITH {_DICTIONARY} SELECT variable_name, variable_order::INTEGER AS variable_order, question_type AS type, relevance FROM d")
def dictionary_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened dictionary: conditions as they read in each instance."""
    return dictionary.flattened(_order_dictionary(spark, sf_dir)).select("variable_name", "variable_order", "type", "relevance")


@query(f"WITH {_DICTIONARY} SELECT count(*) AS total, count(original_variable_name) AS matched, 1::BIGINT AS unmatched, (SELECT 2 * most FROM m)::BIGINT AS in_repeat, ((SELECT most FROM m) + 2)::BIGINT AS with_choices, count(*) FILTER (WHERE non_null = 0) AS all_missing, count(*) FILTER (WHERE round((n - non_null) / n::DOUBLE, 6) >= 0.95) AS sparse FROM d, n")
def dictionary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.summary(_order_dictionary(spark, sf_dir))


@query(f"WITH {_DICTIONARY} SELECT variable_name AS column_name, coalesce(original_variable_name, '') AS question, CASE WHEN variable_name = 'stray' THEN 'legacy' ELSE 'matched' END AS outcome, false AS overridden FROM d")
def contract_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary with the say of the compiled form, which agrees with it."""
    d = _order_dictionary(spark, sf_dir)
    nodes = [contract.Node("/data/l_orderkey", "l_orderkey"), contract.Node("/data/line_count", "line_count"), contract.Node("/data/line", "line", is_repeat=True), contract.Node("/data/line/l_quantity", "l_quantity", ["line"]), contract.Node("/data/line/l_returnflag", "l_returnflag", ["line"], control="select1"), contract.Node("/data/seen", "seen", control="select", choices=["N", "R", "1", "-99"])]
    named = [r[0] for r in d.select("variable_name").collect()]
    mapped = spark.createDataFrame([(m["column_name"], m["status"], m["path"]) for m in (contract.map_column(c, nodes) for c in named)], "column_name string, status string, path string")
    out = contract.overlay(d.select(F.col("variable_name").alias("column_name"), F.col("original_variable_name").alias("question")), mapped)
    return out.select("column_name", F.coalesce("question", F.lit("")).alias("question"), "outcome", "overridden")


@query("SELECT 'line' AS name, NULL AS parent, 1 AS depth, 'line_count' AS count_variable, '${lines}' AS count_expression, 2::BIGINT AS n_variables, max(n)::INTEGER AS largest_iteration, '_{iter}' AS suffix FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def repeat_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.repeat_structure(form.questions_frame(spark, _order_form()), _order_dictionary(spark, sf_dir)).drop("relevance")


@query("""
WITH s AS (SELECT 'r' || r_regionkey AS start FROM region), n AS (SELECT 'r' || n_regionkey AS start, 'n' || n_nationkey AS node, n_nationkey FROM nation)
SELECT start, start AS node, 0 AS hops, NULL AS direction, NULL AS kind FROM s UNION ALL SELECT start, node, 1, 'out', 'gated_by' FROM n
UNION ALL SELECT start, 's' || s_suppkey, 2, 'out', 'gated_by' FROM supplier JOIN n ON s_nationkey = n_nationkey
""")
def graph_first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two edges of each region, with the first step's direction and kind."""
    from tallyweave.plans.metadata import _form

    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.described_neighbourhood(graph.reference_edges(_form(spark, sf_dir)), starts, 2)


@query("SELECT unnest(range(1, 41)) AS name, unnest(range(0, 40))::INTEGER AS depth")
def deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of forty repeats, each in the one before: a tree may be as deep as it likes."""
    chain = spark.range(1, 41).select(F.col("id").alias("name"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    return graph.depths(chain)


_NESTED = form.compile_form([
    {"type": "integer", "name": "size", "constraint": ". >= 1 and . <= 3"},
    {"type": "begin repeat", "name": "outer", "repeat_count": "2"},
    {"type": "integer", "name": "jobs", "constraint": ". >= 0 and . <= 4"},
    {"type": "begin repeat", "name": "inner", "repeat_count": "3"},
    {"type": "decimal", "name": "pay", "constraint": ". >= 10 and . <= 20"},
    {"type": "calculate", "name": "both", "calculation": "concat(${size}, '-', ${jobs}, '-', index())"},
    {"type": "select_multiple flags", "name": "tags", "constraint": "count-selected(.) <= 2"},
    {"type": "end repeat"}, {"type": "end repeat"},
])
_NESTED_CHOICES = {"flags": [(v, t) for _, v, t in _FLAGS]}


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.generate(spark, _NESTED, _NESTED_CHOICES, table(spark, sf_dir, "customer").count(), seed=5)[0]


@query("SELECT a.i::INTEGER AS idx_1, b.i::INTEGER AS idx, (SELECT count(*) FROM customer) AS made, 0::BIGINT AS refused, 0::BIGINT AS misread FROM (SELECT unnest([1, 2]) AS i) a, (SELECT unnest([1, 2, 3]) AS i) b")
def synth_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of a repeat in a repeat: as many as counted, within bounds, inner expressions read the levels around."""
    top = _nested(spark, sf_dir)
    inner = synth.instances(top, _NESTED, _NESTED_CHOICES, "inner", seed=5)
    outer = synth.instances(top, _NESTED, _NESTED_CHOICES, "outer", seed=5).select("KEY", F.col("idx").alias("idx_1"), "jobs")
    j = inner.join(outer, ["KEY", "idx_1"]).join(top.select("KEY", "size"), "KEY")
    refused = ~F.col("pay").between(10, 20) | ~F.col("jobs").between(0, 4) | (F.size(F.split("tags", " ")) > 2)
    misread = F.col("both") != F.concat_ws("-", F.col("size").cast("string"), F.col("jobs").cast("string"), F.col("idx").cast("string"))
    return j.groupBy("idx_1", "idx").agg(F.count("*").alias("made"), F.count_if(refused).alias("refused"), F.count_if(misread).alias("misread"))


_CELLS = [f"_{a}_{b}" for a in (1, 2) for b in (1, 2, 3)]
_EXPORTED = [*synth.RUN, "size", "outer_count", "jobs_1", "jobs_2", "inner_count_1", "inner_count_2", *(f"pay{c}" for c in _CELLS), *(f"both{c}" for c in _CELLS), *(f"tags_{v.replace('-', '_')}{c}" for c in _CELLS for _, v, _ in _FLAGS), *synth.AFTER]


@query("SELECT unnest([" + ", ".join(f"'{c}'" for c in _EXPORTED) + f"]) AS column_name, unnest(range({len(_EXPORTED)}))::INTEGER AS place, (SELECT count(*) FROM customer) AS filled")
def synth_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the rectangular export, in order, and how many responses fill each."""
    wide = synth.exported(_nested(spark, sf_dir), _NESTED, _NESTED_CHOICES, seed=5)
    counted = wide.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(wide.columns)))
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("place"), F.col(f"c{k}").alias("filled")) for k, c in enumerate(wide.columns)]
    return counted.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


@query("""
SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 9) AS t, round(acos(p_size / 100.0), 9) AS ac, round(atan(p_size), 9) AS at, round(pi() * p_size, 9) AS p, abs(p_size - 25)::DOUBLE AS a,
       round(exp(p_size / 10.0), 6) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, p_size::DOUBLE ** 2 AS sq, round(sqrt(p_size), 9) AS r, p_size / 2.0 AS n FROM part
""")
def expr_math_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = lambda s, d=9: F.round(as_num(compiled(s, Scope(p.schema))), d)
    x = "${p_size}"
    return p.select("p_partkey", v(f"sin({x})").alias("s"), v(f"cos({x})").alias("c"), v(f"tan({x})").alias("t"), v(f"acos({x} div 100)").alias("ac"), v(f"atan({x})").alias("at"), v(f"pi() * {x}").alias("p"), v(f"abs({x} - 25)").alias("a"), v(f"exp({x} div 10)", 6).alias("e"), v(f"log({x})").alias("l"), v(f"log10({x})").alias("l10"), v(f"pow({x}, 2)").alias("sq"), v(f"sqrt({x})").alias("r"), v(f"number(string({x})) div 2").alias("n"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE event_type END AS t FROM events)
SELECT event_id, coalesce(t, '') = '' AS blank, coalesce(t, '') <> '' AS there, value > 50 AS big, event_id % 2 = 1 AS odd, true AS yes, false AS no, CASE WHEN event_id % 3 = 0 THEN '2024-02-29' ELSE strftime(ts, '%Y-%m-%d') END AS fallback,
       coalesce(t, '') || chr(10) || event_id::VARCHAR AS two_lines, greatest(event_id % 3, event_id % 7)::DOUBLE AS top, least(event_id % 3, event_id % 7)::DOUBLE AS low FROM e
""")
def expr_truth_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ev = table(spark, sf_dir, "events").withColumns({"t": F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("event_type")), "odd": (k % 2).cast("string"), "a": k % 3, "b": k % 7, "day": F.when(k % 3 > 0, F.date_format("ts", "yyyy-MM-dd"))})
    scope = Scope(ev.schema)
    b, s, n = (lambda f: lambda source: f(compiled(source, scope)))(as_bool), (lambda f: lambda source: f(compiled(source, scope)))(as_text), (lambda f: lambda source: f(compiled(source, scope)))(as_num)
    return ev.select("event_id", b("empty(${t})").alias("blank"), b("relevant(${t})").alias("there"), b("boolean(${value} > 50)").alias("big"), b("boolean-from-string(${odd})").alias("odd"), b("true()").alias("yes"), b("false()").alias("no"), s("if-empty-date(${day}, '2024-02-29')").alias("fallback"), s("concat(${t}, linebreak(), ${event_id})").alias("two_lines"), n("max(${a}, ${b})").alias("top"), n("min(${a}, ${b})").alias("low"))


@query("""
WITH c AS (SELECT 'c' || s_suppkey AS column_name, (s_suppkey % 5)::VARCHAR AS code, CASE WHEN s_suppkey % 7 = 0 THEN []::VARCHAR[] WHEN s_suppkey % 2 = 0 THEN ['-' || (s_suppkey % 5)] ELSE ['1', '3'] END AS codes FROM supplier)
SELECT column_name, CASE WHEN len(codes) = 0 THEN 'fabricated' WHEN list_contains(codes, '-' || code) THEN 'demoted' WHEN NOT list_contains(codes, code) THEN 'unknown' END AS defect FROM c WHERE len(codes) = 0 OR NOT list_contains(codes, code)
""")
def choice_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = (k % 5).cast("string")
    codes = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.concat(F.lit("-"), code))).otherwise(F.array(F.lit("1"), F.lit("3")))
    return resolve.choice_defects(table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("column_name"), code.alias("choice_code"), codes.alias("codes")))


#: Sources with {k} for a nation's key, and the condition texts they must give.
_TEXTS = [
    ("${{x{k}}} != ''", "!missing(x{k})"),
    ("'' = ${{x{k}}}", "missing(x{k})"),
    ("string-length(${{x{k}}}) = {k}", "strlen(x{k}) == {k}"),
    ("regex(${{x{k}}}, ''^A{k}'')", 'regexm(x{k}, "^A{k}")'),
    ("substr(${{x{k}}}, 0, 2) = ''A{k}''", 'substr(x{k}, 1, 2) == "A{k}"'),
    ("if(${{y}} = {k}, 2, 3) = 2", "cond(y == {k}, 2, 3) == 2"),
    ("coalesce(${{a{k}}}, ${{y}}, 0) = {k}", "cond(!missing(a{k}), a{k}, cond(!missing(y), y, 0)) == {k}"),
    ("count-selected(${{m}}) >= {k}", "rowtotal(m_*) >= {k}"),
    ("selected(${{m}}, ''-{k}'') and not(selected(${{m}}, ''{k}''))", "m__{k} == 1 & !(m_{k} == 1)"),
    ("indexed-repeat(${{a{k}}}, ${{r}}, 2) = {k}", "a{k}_2 == {k}"),
    ("(${{y}} + {k}) div 2 = 3 or ${{y}} mod 2 = 0", "(y + {k}) / 2 == 3 | mod(y, 2) == 0"),
    ("pulldata(''t'', ''a'', ''b'', ${{y}}) = ''x'' and ${{y}} = {k}", "y == {k}"),
]


@query(" UNION ALL ".join(f"SELECT n_nationkey, {k} AS form, replace('{text}', '{{k}}', n_nationkey::VARCHAR) AS condition, true AS sound FROM nation" for k, (_, text) in enumerate(_TEXTS)))
def condition_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function that conditions can say, for each nation's key; printed on the driver, as conditions are metadata."""
    rows = []
    for (n,) in sorted(tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()):
        target = Target({"m": "select_multiple", f"x{n}": "text", "y": "select_one", f"a{n}": "integer"})
        for k, (source, _) in enumerate(_TEXTS):
            said = condition_text(source.format(k=n).replace("''", "'") if k > 1 else source.format(k=n), target)
            rows.append((n, k, said, not structural_issues(said or "")))
    return spark.createDataFrame(rows, "n_nationkey int, form int, condition string, sound boolean")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'n_name == 1 & n_regionkey > ' || n_regionkey ELSE NULL END AS kept FROM nation")
def condition_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each condition the clauses that statistics over an export can use."""
    rows = [(k, kept_clauses(f"n_name == 1 & gone == 2 & n_regionkey > {r}" if k % 2 == 0 else "gone == 1 & (0)", {"n_name", "n_regionkey"}, set())) for k, r in sorted(tuple(x) for x in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())]
    return spark.createDataFrame(rows, "n_nationkey int, kept string")


@query("""
WITH t AS (SELECT o_orderpriority AS run, o_orderstatus = 'O' AS delivery, o_totalprice > 1e9 AS rich FROM orders)
SELECT run, 'delivery' AS variable, 'reach' AS expectation, bool_or(delivery) AS reached, bool_or(delivery) AS ok FROM t GROUP BY run
UNION ALL SELECT run, 'rich', 'block', bool_or(rich), NOT bool_or(rich) FROM t GROUP BY run UNION ALL SELECT run, 'unknown', 'reach', false, false FROM t GROUP BY run
""")
def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what each run must reach was reached, and what it must block wasn't."""
    o = table(spark, sf_dir, "orders")
    scope = Scope(o.schema)
    trace = gates.coverage(o.withColumn("run", F.col("o_orderpriority")), "run", {"delivery": gates.relevance([], "${o_orderstatus} = 'O'", scope), "rich": gates.relevance([], "${o_totalprice} > 1000000000", scope)}).withColumnRenamed("key", "run")
    runs = o.select(F.col("o_orderpriority").alias("run")).distinct()
    want = spark.createDataFrame([("delivery", "reach"), ("rich", "block"), ("unknown", "reach")], "variable string, expectation string")
    return scenarios.report(trace, runs.crossJoin(F.broadcast(want))).drop("gates")


@query("SELECT o_orderpriority AS run, 'broken' AS variable, 'nope()' AS clause, count(*) AS rows FROM orders GROUP BY 1")
def scenario_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("run", F.col("o_orderpriority"))
    trace = gates.coverage(o, "run", {"broken": gates.relevance([], "nope()", Scope(o.schema)), "fine": gates.relevance([], "${o_totalprice} > 0", Scope(o.schema))}).withColumnRenamed("key", "run")
    return scenarios.rejections(trace)


@query("""
WITH s AS (SELECT 'l_quantity' AS variable, count(l_quantity) AS n, avg(l_quantity) AS mean FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), avg(l_tax) FROM lineitem)
SELECT variable, n, round(mean, 6) AS mean, 'label of ' || variable AS label FROM s
""")
def stats_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics joined one to one with metadata; a variable without metadata is left out."""
    made = stats.tabstat(table(spark, sf_dir, "lineitem"), {"l_quantity": "", "l_tax": "", "l_discount": ""})
    names = spark.createDataFrame([("l_quantity", 1), ("l_tax", 2), ("l_gone", 3)], "variable string, variable_order int").withColumn("label", F.concat(F.lit("label of "), "variable"))
    return stats.with_metadata(made, names).select("variable", "n", F.round("mean", 6).alias("mean"), "label")


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_type LIKE '%BRASS' AND p_partkey % 3 > 0")
def numeric_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a dictionary's variables: numeric by type, with values, not disabled."""
    kind = F.when(F.col("p_type").endswith("BRASS"), "integer").otherwise("text")
    d = table(spark, sf_dir, "part").select("p_partkey", kind.alias("question_type"), F.greatest(F.col("p_size") - 5, F.lit(0)).alias("non_null"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 3 == 0).otherwise(F.when(F.col("p_partkey") % 3 == 0, True)).alias("disabled"))
    return stats.numeric_universe(d).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def survey_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.surveys(table(spark, sf_dir, "customer"), "c_mktsegment", "BuilD").select("c_custkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 4 = 1)::INTEGER END AS a_1, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 4 IN (1, 2))::INTEGER END AS a__99 FROM supplier")
def answer_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    answer = F.when(k == 0, " ").when(k == 1, "1  -99").when(k == 2, " -99 ").otherwise("7")
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(c.alias(n) for n, c in choices.indicators(answer, ["1", "-99"], "a").items()))
