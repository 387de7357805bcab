"""WARC revisits: "not modified" captures and the responses that they point to.

A capture is (url, at, kind, headers, payload): a full ``response``, or a
``revisit`` that a server answered with "not modified" and so has no payload of
its own.  Each revisit is joined with the latest earlier full response of the
same canonical URL; its validators must agree with the response's, and headers
that a "not modified" answer may update replace the response's own.

The as-of join goes in two steps, so that no URL lands in one task, however
often it was captured: captures of a URL are grouped by span of time; within a
span a window carries the last response forward; the last response of each
earlier span comes from a table with one row for each URL and span.

Null URLs have no canonical URL: their revisits stay unresolved ("orphan").
Null times come first; responses of the same time as a revisit are not earlier.
Among responses of one URL and time the one with the largest id counts.  Rows
that repeat an id are captures with one resolution; each revisit row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a "not modified" answer may carry and update.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parameters that track visits and do not change what is served.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)"

#: The time that captures without one are given: before all others.
FIRST = -(1 << 62)


def canonical(url: Column) -> Column:
    """Scheme and host small, without default port, fragment, tracking parameters and the last slash."""
    parts = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\??[^#]*)"
    g = lambda i: F.regexp_extract(url, parts, i)
    host = F.regexp_replace(F.lower(g(2)), r":(?:80|443)$", "")
    query = F.regexp_replace(g(4), rf"(?<=[?&]){TRACKING}=[^&]*(?:&|$)", "")
    path = F.regexp_replace(g(3), r"/+$", "")
    whole = F.concat(F.lower(g(1)), F.lit("://"), host, path, F.regexp_replace(query, r"[?&]$", ""))
    return F.when(F.nullif(g(1), F.lit("")).isNotNull(), whole).otherwise(F.nullif(F.trim(url), F.lit("")))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those that the revisit may set."""
    new = F.map_filter(F.coalesce(revisit, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*UPDATES) & v.isNotNull())
    old = F.map_filter(F.coalesce(response, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def agrees(response: Column, revisit: Column) -> Column:
    """Whether the validators agree: entity tags if both have one, else times of last change, else null.

    Weak and strong forms of a tag count as the same.
    """
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return F.coalesce(tag(response) == tag(revisit), response["last-modified"] == revisit["last-modified"])


def resolve(captures: DataFrame, span: int = 1 << 12) -> DataFrame:
    """Every revisit: id, uri, response_id, status, headers, payload.

    ``captures`` has id, url, at (a whole number), kind, headers (a map, names
    small) and payload.  status is ``matched`` or ``mismatch`` by the
    validators, ``unchecked`` if the two sides have none in common, ``orphan``
    without an earlier response.  Only matched and unchecked revisits get the
    payload and merged headers; the others keep their own headers.
    """
    rows = captures.select("id", F.coalesce(F.col("at").cast("long"), F.lit(FIRST)).alias("at"), "kind", "headers", "payload", canonical(F.col("url")).alias("uri"))
    keyed = rows.where("uri is not null").select("id", "at", "kind", "uri", F.floor(F.col("at") / span).alias("span"))
    full = F.when(F.col("kind") == "response", F.struct("at", "id"))
    cells = keyed.groupBy("uri", "span").agg(F.max(full).alias("last"))
    before = Window.partitionBy("uri").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("uri", "span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    earlier = Window.partitionBy("uri", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    asked = keyed.withColumn("here", F.max(full).over(earlier)).where("kind = 'revisit'")
    found = asked.join(cells, ["uri", "span"]).groupBy("id").agg(F.max(F.coalesce("here", "carried")["id"]).alias("response_id"))
    responses = rows.where("kind = 'response'").select(F.col("id").alias("response_id"), F.col("headers").alias("full_headers"), F.col("payload").alias("body")).dropDuplicates(["response_id"])
    joined = rows.where("kind = 'revisit'").drop("payload", "kind", "at").join(found, "id", "left").join(responses, "response_id", "left")
    same = agrees(F.col("full_headers"), F.col("headers"))
    status = F.when(F.col("response_id").isNull(), "orphan").when(same, "matched").when(~same, "mismatch").otherwise("unchecked")
    use = F.col("status").isin("matched", "unchecked")
    return joined.withColumn("status", status).select(
        "id", "uri", "response_id", "status",
        F.when(use, merged(F.col("full_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(use, F.col("body")).alias("payload"),
    )


def captures_of(pages: DataFrame, lag: int = 1000) -> DataFrame:
    """Captures made of a table of pages: each page as a full response at time 2 * page_id, and a revisit ``lag`` pages later.

    The revisit asks for the same URL as a feed reader would, and carries the
    entity tag of the page as it was.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    first = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("etag"), tag, F.lit("date"), F.col("page_id").cast("string"))
    again = F.create_map(F.lit("etag"), tag, F.lit("date"), (F.col("page_id") + lag).cast("string"), F.lit("content-length"), F.lit("0"))
    response = pages.select((2 * F.col("page_id")).alias("id"), "url", (2 * F.col("page_id")).alias("at"), F.lit("response").alias("kind"), first.alias("headers"), F.col("html").alias("payload"))
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_medium=rss"))
    revisit = pages.select((2 * F.col("page_id") + 1).alias("id"), url.alias("url"), (2 * (F.col("page_id") + lag) + 1).alias("at"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)
