"""The dependency graph of a form as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.materialize import written

REFERENCE = r"\$[{]([^}]+)[}]"
KINDS = {"calculation": "calculates_from", "relevance": "gated_by", "group_relevances": "group_gated_by", "constraint": "constrained_by"}


def reference_edges(questions: DataFrame) -> DataFrame:
    """(src, dst, kind): an edge from each known variable that an expression names to the question it belongs to.

    ``questions`` has variable_name and any of calculation, relevance, constraint (text), group_relevances (array).
    """
    parts = []
    for column, kind in KINDS.items():
        if column not in questions.columns:
            continue
        source = F.array_join(F.col(column), " ") if column == "group_relevances" else F.col(column)
        names = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(REFERENCE), 1), lambda x: F.trim(x)))
        parts.append(questions.select(F.explode(names).alias("src"), F.col("variable_name").alias("dst"), F.lit(kind).alias("kind")))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges.join(questions.select(F.col("variable_name").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "kind")


def sibling_edges(questions: DataFrame) -> DataFrame:
    """(src, dst, kind): both ways between all questions of one innermost repeat."""
    inside = questions.filter("repeat is not null").select("repeat", "variable_name")
    other = inside.select("repeat", F.col("variable_name").alias("dst"))
    return inside.join(other, "repeat").filter("variable_name <> dst").select(F.col("variable_name").alias("src"), "dst", F.lit("repeat_sibling").alias("kind"))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): what lies within so many edges of each start, whatever their direction, at its least distance.

    Breadth first; each round is written in the shared folder and only the new nodes go on.
    """
    return described_neighbourhood(edges, starts, hops).select("start", "node", "hops")


def described_neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops, direction, kind): with the first step towards each node, the least one of the shortest ways.

    ``direction`` is ``out`` where the start is named by the neighbour, ``in`` where it names it; ``kind`` is the edge's.
    The start itself has neither.
    """
    both = edges.select("src", "dst", F.lit("out").alias("direction"), "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("direction"), "kind")).distinct()
    seen = starts.select(F.col("node").alias("start"), "node").distinct().select("*", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("kind"))
    front = seen
    for k in range(1, hops + 1):
        first = F.struct(F.coalesce(front["direction"], both["direction"]).alias("direction"), F.coalesce(front["kind"], both["kind"]).alias("kind"))
        step = front.join(both, front["node"] == both["src"]).select("start", F.col("dst").alias("node"), first.alias("first")).groupBy("start", "node").agg(F.min("first").alias("first"))
        front = written(step.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("hops"), "first.direction", "first.kind"), "hop")
        seen = seen.unionByName(front)
    return seen


def repeat_tree(repeats: DataFrame) -> DataFrame:
    """(name, parent, depth) of repeats with a ``path`` array of the repeats around each, outermost first."""
    n = F.size(F.coalesce("path", F.array().cast("array<string>")))
    return repeats.select("name", F.when(n > 0, F.element_at("path", -1)).alias("parent"), n.alias("depth")).orderBy("depth", "name")


def repeat_structure(questions: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(name, parent, depth, count_variable, count_expression, relevance, n_variables, largest_iteration, suffix) of each repeat.

    ``questions`` has form.QUESTION's columns; n_variables are those of the repeat itself, not of repeats in it. The
    largest iteration is what the columns of a ``dictionary`` (repeat, iteration) have, 0 without any. ``suffix`` is how
    a column of the repeat ends, the numbers of the repeats around it first.
    """
    counts = questions.filter("type = 'repeat_count' and repeat_group_name is not null")
    around = F.coalesce("repeat_path", F.array().cast("array<string>"))
    named = counts.select(F.col("repeat_group_name").alias("name"), F.try_element_at(around, F.lit(-1)).alias("parent"), (F.size(around) + 1).alias("depth"), F.col("variable_name").alias("count_variable"), F.col("calculation").alias("count_expression"), "relevance")
    inside = questions.filter("type <> 'repeat_count' and repeat is not null").groupBy(F.col("repeat").alias("name")).agg(F.count("*").alias("n_variables"))
    most = (dictionary if dictionary is not None else questions.select("repeat", F.lit(None).cast("int").alias("iteration"))).filter("repeat is not null").groupBy(F.col("repeat").alias("name")).agg(F.max("iteration").alias("largest_iteration"))
    suffix = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.when(k == F.col("depth"), "_{iter}").otherwise(F.concat(F.lit("_{p"), k.cast("string"), F.lit("}")))), ""))
    out = named.join(inside, "name", "left").join(most, "name", "left")
    return out.select("name", "parent", "depth", "count_variable", "count_expression", "relevance", F.coalesce("n_variables", F.lit(0)).alias("n_variables"), F.coalesce("largest_iteration", F.lit(0)).alias("largest_iteration"), suffix.alias("suffix"))


def depths(parents: DataFrame) -> DataFrame:
    """(name, depth) from (name, parent): roots are 0, at any depth. What hangs in a circle, or on a name that isn't there,
    is reached from no root and has null: levels are taken until one is empty, and a circle can't be entered from a root,
    as a name has one parent (of several rows of a name the least parent counts)."""
    parents = written(parents.groupBy("name").agg(F.min("parent").alias("parent")), "parents")
    found = parents.filter("parent is null").select("name", F.lit(0).alias("depth"))
    level, k = found, 0
    while True:
        k += 1
        level = written(parents.join(level.select(F.col("name").alias("parent")), "parent", "left_semi").select("name", F.lit(k).alias("depth")), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return parents.select("name").join(found, "name", "left")


def gate_chain(questions: DataFrame, variables: DataFrame) -> DataFrame:
    """(variable_name, position, clause, reference, reference_relevance): conditions around a question, outermost first,
    its own last, and for each variable named there its own condition, one hop away."""
    q = questions.join(variables, "variable_name", "left_semi")
    clauses = F.concat(F.coalesce("group_relevances", F.array().cast("array<string>")), F.array(F.coalesce("relevance", F.lit(""))))
    each = q.select("variable_name", F.posexplode(F.filter(clauses, lambda c: c != "")).alias("position", "clause"))
    refs = each.withColumn("reference", F.explode_outer(F.array_distinct(F.regexp_extract_all("clause", F.lit(REFERENCE), 1))))
    gates = questions.select(F.col("variable_name").alias("reference"), F.col("relevance").alias("reference_relevance"))
    return refs.join(gates, "reference", "left").select("variable_name", "position", "clause", "reference", "reference_relevance")
