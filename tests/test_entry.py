import importlib
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _cell(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(n for n in importlib.import_module("tallyweave.plans.registry").oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    key = lambda row: [(v is None, str(v)) for v in row]
    want = sorted((tuple(_cell(v) for _, v in sorted(zip(columns, r))) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(_cell(r[c]) for c in sorted(columns)) for r in df.collect()), key=key)
    assert sorted(df.columns) == sorted(columns) and got == want


def test_entry_without_the_optional_subpackage(monkeypatch):
    """With the subpackage gone the entry still imports; another missing module is an error."""

    class Gone:
        def __init__(self, missing):
            self.missing = missing

        def find_spec(self, name, path=None, target=None):
            if name == "tallyweave.llm" or name.startswith("tallyweave.llm."):
                raise ModuleNotFoundError(f"No module named {self.missing!r}", name=self.missing)
            return None

    for k in [m for m in sys.modules if m.startswith("tallyweave.llm") or m in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(sys, "meta_path", [Gone("tallyweave.llm"), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm_registry is None and "gate_filter_agg" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    monkeypatch.setattr(sys, "meta_path", [Gone("numpy_gone"), *sys.meta_path[1:]])
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
