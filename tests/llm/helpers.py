"""Small fixtures for the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, keep boolean, first_id long, `a.b` string, shard int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, 7, "x", 3) for i, t in rows], SCHEMA)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows."""
    long = prose(1, 30_000)
    return docs(spark, [(None, "no id"), (1, None), (2, ""), (3, ""), (4, long), (5, long), (5, long), (6, " \n "), (None, None)])


def same_as_sql(spark, name, folder="/root/testdata/sf0.001"):
    """Whether a registered query gives the rows of its SQL."""
    import duckdb

    from tallyweave.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr([v for _, v in sorted(zip(columns, r))]) for r in cursor.fetchall())
    got = registry.queries()[name](spark, folder)
    return sorted(got.columns) == sorted(columns) and sorted(repr([r[c] for c in sorted(columns)]) for r in got.collect()) == want
