import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import revisits
from tests.llm.helpers import prose, same_as_sql

SCHEMA = "capture_id long, kind string, url string, ts long, headers map<string,string>, source string, lane string, status string"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("span", [revisits.SPAN, 7, 1])
def test_as_of_join_against_a_loop(spark, monkeypatch, span):
    """However short the stretches that a URL is cut into."""
    monkeypatch.setattr(revisits, "SPAN", span)
    r = random.Random(2)
    rows = []
    for k in range(400):
        kind = r.choice(["response", "revisit", "revisit"])
        headers = {r.choice(["ETag", "etag", "x-other"]): r.choice(['"1"', 'W/"1"', '"2"'])} | ({"Last-Modified": r.choice("ab")} if r.random() < 0.6 else {})
        rows.append((k, kind, f"http{r.choice(['', 's'])}://{r.choice(['www.', '', 'WWW.'])}h{r.randrange(6)}.org/p?b=2&a=1&utm_x=3#f", r.randrange(50), headers))
    key = lambda u: u.split("://")[1].lower().replace("www.", "").split("/")[0]
    low = lambda h: {k.lower(): v for k, v in h.items()}
    tag = lambda h: h.get("etag", "").removeprefix("W/") or None
    want = {}
    for i, kind, url, ts, headers in rows:
        if kind != "revisit":
            continue
        earlier = [x for x in rows if x[1] == "response" and key(x[2]) == key(url) and x[3] <= ts]
        if not earlier:
            want[i] = ("orphan", None)
            continue
        source = max(earlier, key=lambda x: (x[3], x[0]))
        mine, theirs = low(headers), low(source[4])
        if tag(mine) and tag(theirs):
            ok = tag(mine) == tag(theirs)
        elif "last-modified" in mine and "last-modified" in theirs:
            ok = mine["last-modified"] == theirs["last-modified"]
        else:
            want[i] = ("unproven", None)
            continue
        want[i] = ("resolved", source[0]) if ok else ("stale", None)
    got = {x["capture_id"]: (x["status"], x["source_id"]) for x in revisits.resolved(captures(spark, rows)).collect()}
    assert got == want and {s for s, _ in got.values()} == {"orphan", "resolved", "stale", "unproven"}


def test_headers_merge_as_permitted(spark):
    rows = [
        (1, "response", "http://a.org/", 1, {"ETag": '"x"', "Content-Length": "9", "Date": "d1", "X-Keep": "k"}),
        (2, "revisit", "https://www.A.org", 2, {"etag": 'W/"x"', "content-length": "0", "date": "d2", "x-keep": "no", "cache-control": None}),
    ]
    (r,) = revisits.resolved(captures(spark, rows)).collect()
    assert r["headers"] == {"etag": 'W/"x"', "content-length": "9", "date": "d2", "x-keep": "k"} and r["source_id"] == 1


def test_awkward(spark):
    rows = [
        (1, "revisit", None, 1, None), (2, "revisit", "http://a.org", None, {}), (3, "response", None, 0, {"etag": "x"}), (None, "revisit", "", 1, {"etag": "x"}), (4, None, "http://a.org", 0, {"etag": "x"}),
        (5, "response", "http://b.org/" + prose(1, 5000), 1, {"ETAG": "1", "etag": "2"}), (6, "revisit", "http://b.org/" + prose(1, 5000), 1, {"etag": "2"}), (6, "revisit", "http://b.org/" + prose(1, 5000), 1, {"etag": "2"}),
    ]
    got = revisits.resolved(captures(spark, rows)).orderBy(F.col("capture_id").asc_nulls_first()).collect()
    assert [(r["capture_id"], r["status"]) for r in got] == [(None, "orphan"), (1, "orphan"), (2, "orphan"), (6, "resolved"), (6, "resolved")]
    assert revisits.resolved(captures(spark, [])).count() == 0


def test_canonical_urls(spark):
    urls = {"HTTPS://WWW.Example.org:443/A/?b=1&a=2&utm_source=x#y": "example.org/A?a=2&b=1", "http://example.org": "example.org", "example.org/?": "example.org", "http://m.example.org/x.html?ref=z": "m.example.org/x.html", "": ""}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == urls


def test_oracle_sql(spark):
    assert same_as_sql(spark, "op6_revisits")
