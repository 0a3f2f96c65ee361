"""Not-modified revisit resolution for web archive records.

A revisit record says that a server answered "not modified": it has validators
and a few headers but no body.  `resolve_revisits` finds, for each, the latest
earlier full response of the same canonical URL, checks the validators and
merges the headers that such an answer may update.

The as-of join is one pass of windows over (URL, time bucket), and the last full
response of each bucket is carried into the following ones, so that a URL with
very many captures is spread over its time buckets.  Bodies are not shuffled:
the result names the record whose body holds.

Defined cases: a null URL never resolves; records at the same time are ordered by
record id, and a response counts as earlier when its (time, id) is smaller; a null
time sorts first; with neither an etag nor a last-modified date in common there is
nothing to check and the revisit is `unvalidated`; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a stored response keeps when it is revalidated
# (RFC 9111, section 3.2, and the connection fields of RFC 9110, section 7.6.1).
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]

# Query parameters that only track visitors.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, tracking parameters, default port and last slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), ":(80|443)$", ""))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored map with the fields of `update` that may change it."""
    allowed = F.map_filter(update, lambda name, _: ~name.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda name, _: ~F.array_contains(F.map_keys(allowed), name)), allowed)


def resolve_revisits(records: DataFrame, bucket_width: int) -> DataFrame:
    """One row for each of `records` (record_id, url, ts long, kind, etag, last_modified, headers map).

    Added: canonical_url, origin_id, status (`response`, `resolved`,
    `unvalidated`, `etag_mismatch`, `date_mismatch`, `no_origin`) and the headers as merged.
    origin_id is null unless the revisit is resolved or unvalidated.
    """
    rows = records.select("record_id", "ts", "kind", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    rows = rows.withColumn("_bucket", F.floor(F.col("ts") / bucket_width)).withColumn("_time", F.struct("ts", "record_id"))
    full = F.when(F.col("kind") == "response", F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers"))
    here = Window.partitionBy("canonical_url", "_bucket").orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full", full)
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(here))
    # the last full response of each bucket, carried to the next bucket with records
    ends = rows.groupBy("canonical_url", "_bucket").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.col("_time"))).alias("_end"))
    past = Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(past)).filter("_far is not null").select("canonical_url", "_bucket", "_far")
    joined = rows.join(carried, ["canonical_url", "_bucket"], "left").withColumn("_origin", F.when(F.col("canonical_url").isNotNull(), F.coalesce("_near", "_far")))
    origin = F.col("_origin")
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(origin.isNull(), "no_origin")
        .when(F.col("etag").isNotNull() & origin["etag"].isNotNull(), F.when(F.col("etag") == origin["etag"], "resolved").otherwise("etag_mismatch"))
        .when(F.col("last_modified").isNotNull() & origin["last_modified"].isNotNull(), F.when(F.col("last_modified") == origin["last_modified"], "resolved").otherwise("date_mismatch"))
        .otherwise("unvalidated")
    )
    found = F.col("status").isin("resolved", "unvalidated")
    return joined.withColumn("status", status).select(
        "record_id", "ts", "kind", "canonical_url", "status",
        F.when(found, origin["id"]).alias("origin_id"),
        F.when(found, merged_headers(F.coalesce(origin["headers"], F.create_map().cast("map<string,string>")), F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")))).otherwise(F.col("headers")).alias("headers"),
    )


def page_records(pages: DataFrame, delay: int) -> DataFrame:
    """Two captures of every page: its full response at time 2 * page_id, and a not-modified answer `delay` (odd) later."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id"), F.col("url"), F.md5(body).alias("digest"),
        F.length(body).cast("string").alias("chars"),
    )
    day = (F.floor(F.col("page_id") / 100)).cast("string")
    full = F.struct(
        (F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("content-length"), F.col("chars"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("server"), F.lit("origin")).alias("headers"),
    )
    again = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") * 2 + delay).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.floor(F.col("page_id") / 100) + 1).cast("string"), F.lit("expires"), F.lit("never")).alias("headers"),
    )
    both = base.select("page_id", "url", "digest", F.explode(F.array(full, again)).alias("r"))
    # the site gives no etag for a sixteenth of its pages, chosen by their content
    no_etag = F.substring("digest", 1, 1) == "0"
    return both.select("r.record_id", "r.ts", "r.kind", "url", F.when(~no_etag, F.col("digest")).alias("etag"), F.when(no_etag, F.substring("digest", 2, 8)).alias("last_modified"), "r.headers")
