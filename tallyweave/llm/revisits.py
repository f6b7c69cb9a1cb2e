"""Not-modified revisits of web captures, resolved to the full response they stand for.

Captures are ordered by time within a canonical URL. A revisit belongs to the latest earlier full response: an as-of
join, done as a running last value within the URL and a stretch of SPAN seconds, and, where that stretch has none before
it, as the last response of the stretches before. So a URL that holds a third of all captures is many tasks' work. A
revisit is resolved when its validators agree: an ETag, compared weakly,
decides if both sides have one; else Last-Modified must be equal; without a common validator there is no proof.
The resolved record has the response's headers, overwritten by those that a 304 may change.

Defined results: captures without URL or time stay unresolved and can't serve a revisit; at one instant responses come
before revisits, and of several responses the one of the greatest id counts; header names are compared in lower case,
and of names equal then, the last in map order wins; a null header map is empty; repeated rows give repeated results;
an empty table gives no rows; headers and URLs of any length are read whole; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import table

#: What a 304 response may carry over to the stored one; content-* describes a body that it doesn't have.
PERMITTED = ("age", "cache-control", "date", "etag", "expires", "last-modified", "server", "set-cookie", "vary", "via", "warning", "x-cache")
SPAN = 30 * 86_400
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and trailing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header map with lower-case names; the last of equal names wins."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.try_element_at(headers, F.lit("etag"))), '^W/', "")


def resolved(captures: DataFrame) -> DataFrame:
    """A row for each revisit of ``captures`` (capture_id, kind, url, ts, headers).

    (capture_id, url_key, status, source_id, headers): status is ``resolved``, ``stale`` (validators differ),
    ``unproven`` (no validator in common) or ``orphan`` (no earlier response); source_id and headers go with the
    response if it is resolved. Bodies don't move: source_id says where the body is.
    """
    rows = captures.select("capture_id", "kind", canonical_url(F.col("url")).alias("url_key"), "ts", _lowered(F.col("headers")).alias("headers"))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("kind") == "response") & known
    # rows without a key can't meet: each is its own partition
    lane = F.when(known, F.concat(F.lit("u"), "url_key")).otherwise(F.concat(F.lit("x"), F.coalesce(F.col("capture_id").cast("string"), F.lit(""))))
    stretch = F.floor(F.col("ts").cast("double") / SPAN)
    rows = rows.withColumns({"lane": lane, "stretch": F.when(known, stretch), "full": full})
    response = F.struct(F.col("capture_id").alias("id"), F.col("headers").alias("headers"))
    order = Window.partitionBy("lane", "stretch").orderBy("ts", F.when(F.col("full"), 0).otherwise(1), "capture_id").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("near", F.last(F.when(F.col("full"), response), ignorenulls=True).over(order)).filter("kind = 'revisit'").drop("full")
    # of each stretch its last response, then of each the last one before it
    ends = rows.filter("stretch is not null").groupBy("lane", "stretch").agg(F.max_by(F.when(F.col("full"), response), F.when(F.col("full"), F.struct("ts", "capture_id"))).alias("end"))
    before = Window.partitionBy("lane").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("lane", "stretch", F.last("end", ignorenulls=True).over(before).alias("far")).filter("far is not null")
    met = met.join(carried, ["lane", "stretch"], "left").withColumn("source", F.coalesce("near", "far"))
    mine, theirs = _tag(F.col("headers")), _tag(F.col("source.headers"))
    modified, before = F.try_element_at("headers", F.lit("last-modified")), F.try_element_at("source.headers", F.lit("last-modified"))
    status = (
        F.when(F.col("source").isNull(), "orphan")
        .when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("stale"))
        .when(modified.isNotNull() & before.isNotNull(), F.when(modified == before, "resolved").otherwise("stale"))
        .otherwise("unproven")
    )
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("source.headers", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    out = met.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return out.select("capture_id", "url_key", "status", F.when(ok, F.col("source.id")).alias("source_id"), F.when(ok, merged).alias("headers"))


def header_text(headers: Column) -> Column:
    """``name: value`` lines, sorted."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made of pages: each page as a full response, and each as a revisit of one of four sorts.

    The revisit of page p is an hour later under a variant of its URL; by p % 4 it repeats the ETag, repeats only
    Last-Modified, brings another ETag, or comes an hour before the response.
    """
    p = pages.filter(F.col("page_id").isNotNull())
    html = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    at = F.col("page_id") * 86_400
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    response = F.array(entry("ETag", etag), entry("Last-Modified", day), entry("Content-Type", F.lit("text/html")), entry("Content-Length", F.octet_length(html).cast("string")), entry("Date", at.cast("string")))
    later = (at + F.when(F.col("page_id") % 4 == 3, -3600).otherwise(3600))
    sort = F.col("page_id") % 4
    revisit = F.filter(
        F.array(
            F.when(sort.isin(0, 3), entry("etag", F.concat(F.lit("W/"), etag))).when(sort == 2, entry("etag", F.lit('"other"'))),
            F.when(sort == 1, entry("last-modified", day)),
            entry("date", later.cast("string")),
            entry("Cache-Control", F.lit("max-age=60")),
            entry("Content-Length", F.lit("0")),
        ),
        lambda e: e.isNotNull(),
    )
    variant = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://", "HTTP://"), F.when(F.col("url").contains("?"), "&utm_medium=x#again").otherwise("?utm_medium=x#again"))
    full = p.select(F.col("page_id").alias("capture_id"), F.lit("response").alias("kind"), "url", at.alias("ts"), F.map_from_entries(response).alias("headers"))
    again = p.select((F.col("page_id") + 1_000_000_000_000).alias("capture_id"), F.lit("revisit").alias("kind"), variant.alias("url"), later.alias("ts"), F.map_from_entries(revisit).alias("headers"))
    return full.unionByName(again)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolved(page_captures(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", header_text(F.col("headers")))


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, page_id * 86400 AS t0,
                  '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, 'day ' || (page_id % 365) AS day FROM pages WHERE page_id IS NOT NULL),
     b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM p),
     q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS kept FROM b),
     k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
                  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
                  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM q),
     v AS (SELECT page_id + 1000000000000 AS capture_id, page_id, url_key, t0 + CASE WHEN page_id % 4 = 3 THEN -3600 ELSE 3600 END AS ts,
                  CASE WHEN page_id % 4 IN (0, 3) THEN etag WHEN page_id % 4 = 2 THEN '"other"' END AS tag,
                  CASE WHEN page_id % 4 = 1 THEN day END AS modified FROM k),
     j AS (SELECT v.*, s.page_id AS sid, s.etag AS stag, s.day AS sday, strlen(s.html) AS size FROM v ASOF LEFT JOIN k s ON v.url_key = s.url_key AND v.ts >= s.t0),
     d AS (SELECT *, CASE WHEN sid IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN tag = stag THEN 'resolved' ELSE 'stale' END
                          WHEN modified = sday THEN 'resolved' ELSE 'stale' END AS status FROM j)
SELECT capture_id, url_key, status, CASE WHEN status = 'resolved' THEN sid END AS source_id,
       CASE WHEN status = 'resolved' THEN array_to_string(list_sort(['cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'date: ' || ts,
            'etag: ' || CASE WHEN tag IS NULL THEN stag ELSE 'W/' || tag END, 'last-modified: ' || coalesce(modified, sday)]), chr(10)) END AS headers
FROM d
"""
