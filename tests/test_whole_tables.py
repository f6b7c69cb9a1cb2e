"""Queries that cover all rows of their tables, by brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pandas.util import hash_array
from pyspark.sql import functions as F

from tallyweave.operators import dictionary, form, materialize, search, stats
from tallyweave.plans.registry import queries

SF = "/root/testdata/sf0.001"


def test_wide_grid_holds_every_instance(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        lines[r["l_orderkey"]].append((*(r[c] for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")), r["l_quantity"], r["l_returnflag"]))
    size = max(map(len, lines.values()))
    want = {k: [x for v in sorted(rows) for x in v[-2:]] + [None] * 2 * (size - len(rows)) for k, rows in lines.items()}
    got = queries()["wide_grid_pivot"](spark, SF)
    assert got.columns == ["l_orderkey", *(f"{f}_{k}" for k in range(1, size + 1) for f in ("l_quantity", "l_returnflag"))]
    assert {r[0]: list(r[1:]) for r in got.collect()} == want and size > 3
    assert queries()["wide_to_long"](spark, SF).count() == sum(map(len, lines.values()))


def test_search_gives_the_same_whatever_fits(spark, monkeypatch):
    """Rare terms that aren't broadcast, queries in several blocks: the same rows as with all terms known."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = lambda: sorted(tuple(r) for r in search.search(docs, asked, 4).collect())
    want = found()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 4_000)
    written = []
    monkeypatch.setattr(search, "written", lambda df, name: written.append(name) or materialize.written(df, name))
    assert found() == want and len(want) > 100 and written == ["df", "qw"]


def test_search_terms_are_those_of_the_column(spark):
    """Marks, letters that fold to two, digits, underscores, nulls and blanks: as many terms as ``terms`` gives, equal where it has equal ones."""
    texts = ["Âge de l'enfant", "âge DE_enfant", "straße STRASSE ß", "x1 e\u0301 12_3", "Ωmega Ωmega", "", None, "ſo SO", "é b"]
    row, term, count = search._bags(pa.array(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", search.terms(F.col("t"))).collect()
    want = {(k, t): c for k, terms in rows for t, c in Counter(terms).items()}
    hashes = dict(zip((t for _, t in sorted(want)), hash_array(np.array([t for _, t in sorted(want)], dtype=object), categorize=False).view(np.int64).tolist()))
    assert dict(zip(zip(row.tolist(), term.tolist()), count.tolist())) == {(k, hashes[t]): c for (k, t), c in want.items()} and len(want) > 10


def test_quarters_are_found_in_ranges(spark):
    """Values in many ranges, with ties, nulls, NaN and a group without values: as by sorting; no task holds all values of a variable."""
    rows = [(k % 3, float(k * 7919 % 1009) / 8, -5.0 if k % 4 else float(k)) for k in range(4_000)] + [(1, None, float("nan")), (2, -0.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    with materialize.session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        made = stats.tabstat(df, {"x": "${g} > 0", "y": "", "g": "${g} > 7"})
        got = {r["variable"]: r for r in made.collect()}
    assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
    for name, values in (("x", [r[1] for r in rows if r[0] > 0 and r[1] is not None]), ("y", [r[2] for r in rows if r[2] is not None])):
        v, at = np.sort(values), [(len(values) - 1) * p for p in (0.25, 0.5, 0.75)]  # NaN is last
        assert got[name]["n"] == len(values) and [got[name][c] for c in ("p25", "p50", "p75")] == pytest.approx([v[int(a)] + (a - int(a)) * (v[int(np.ceil(a))] - v[int(a)]) for a in at])
    assert (got["g"]["n"], got["g"]["p25"], got["g"]["p50"], got["g"]["max"]) == (0, None, None, None)


def test_dictionary_makes_the_export_once(spark, tmp_path):
    """Each pass reads the written export, not its source; a column without a type is missing throughout."""
    spark.createDataFrame([(1, -99), (2, 7)], "age int, size int").write.parquet(str(tmp_path / "source"))
    export = spark.read.parquet(str(tmp_path / "source")).withColumn("nothing", F.lit(None))
    made = dictionary.assembled(export, form.questions_frame(spark, form.compile_form([{"type": "integer", "name": "age"}, {"type": "integer", "name": "size"}])))
    got = {r["variable_name"]: r for r in made.collect()}
    assert not any("/source/" in f for f in made.inputFiles())
    assert [tuple(x) for x in got["size"]["sentinels"]] == [("-99", 1)] and (got["age"]["max_value"], got["age"]["non_null"]) == (2.0, 2)
    assert (got["nothing"]["all_missing"], got["nothing"]["storage_type"], got["nothing"]["min_value"]) == (True, "void", None)
