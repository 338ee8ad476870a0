"""WARC: not-modified revisits resolved by an as-of join.

A revisit (status 304) stands for the latest full response (status 200) of the same
canonical URL before it. The join finds that response, compares validators, and merges
the headers that a 304 may renew into those of the response.

As-of join in two levels, so that a URL with a third of all captures is no single
group: captures of a URL fall into ranges of time; within a range a window carries the
latest response forward; the last response of each earlier range comes from a window
over one row for each (URL, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may renew (RFC 9110, 15.4.5, and RFC 9111, 4.3.4).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that track a visit.
TRACKING = r"^(?:utm_[a-z]+|ref|gclid|fbclid)$"
#: Length of a range of time in the unit of ts, meant for seconds.
RANGE = 4096


def canonical_url(url: Column) -> Column:
    """scheme and www. dropped, host in lower case, no default port, no fragment, no tracking parameters, sorted query, no slash at the end."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve(captures: DataFrame, span: int = RANGE) -> DataFrame:
    """captures (record_id long, url, ts long, status int, headers map<string,string>, payload_id)
    -> one row for each revisit: record_id, canonical, refers_to, verdict, headers, payload_id.

    Order within a URL is ts, then record_id. Rows alike in record_id, canonical URL, ts
    and status stand for one: the one with the smallest payload_id, then the smallest
    headers as sorted text, nulls first. span: length of a range in the unit of ts; it
    changes the speed only, and suits seconds (for milliseconds give a thousand times more). verdict: resolved (a validator agrees and none differs), unverified (no
    validator on both sides), mismatch (a validator differs; nothing is taken over), or
    orphan (no earlier response). Strong and weak forms of an ETag compare alike. A
    revisit with a null url or ts is an orphan; a response with one is not found. No
    revisits give no rows. Other columns are ignored; header names compare in lower case.
    """
    c = captures.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "payload_id", _lowered(F.col("headers")).alias("headers"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.to_json(F.struct(e["key"], e["value"])))), ",")
    one = c.withColumn("order", F.struct("payload_id", shown)).groupBy("record_id", "canonical", "ts", "status")
    c = one.agg(F.min_by(F.struct("payload_id", F.map_entries("headers").alias("headers")), "order").alias("kept"))
    c = c.select("record_id", "canonical", "ts", "status", "kept.payload_id", F.map_from_entries("kept.headers").alias("headers"), F.floor(F.col("ts") / span).alias("range"))
    full = F.when((F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical").isNotNull(), F.struct("ts", "record_id", "payload_id", "headers"))
    c = c.withColumn("full", full)
    within = Window.partitionBy("canonical", "range").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = c.withColumn("found", F.last("full", ignorenulls=True).over(within)).filter("status = 304")
    order = F.struct("ts", "record_id")
    ends = c.filter("full is not null").groupBy("canonical", "range").agg(F.max_by("full", order).alias("end"))
    # Ranges of the revisits too, so that each has a row that carries what came before.
    ends = ends.unionByName(here.select("canonical", "range").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)))
    ends = ends.groupBy("canonical", "range").agg(F.first("end", ignorenulls=True).alias("end"))
    earlier = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("canonical", "range", "carried")
    r = here.join(ends, ["canonical", "range"], "left").withColumn("found", F.coalesce("found", "carried"))
    checks = [_agrees(F.col("headers")[h], F.col("found.headers")[h], h == "etag") for h in ("etag", "last-modified")]
    differs = F.coalesce(~checks[0], F.lit(False)) | F.coalesce(~checks[1], F.lit(False))
    agrees = F.coalesce(checks[0], F.lit(False)) | F.coalesce(checks[1], F.lit(False))
    verdict = F.when(F.col("found").isNull(), "orphan").when(differs, "mismatch").when(agrees, "resolved").otherwise("unverified")
    taken = verdict.isin("resolved", "unverified")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("found.headers"), lambda k, v: ~F.map_contains_key(renewed, k))
    merged = F.when(taken, F.map_concat(kept, renewed)).otherwise(F.col("headers"))
    return r.select(
        "record_id",
        "canonical",
        F.when(taken, F.col("found.record_id")).alias("refers_to"),
        verdict.alias("verdict"),
        merged.alias("headers"),
        F.when(taken, F.col("found.payload_id")).alias("payload_id"),
    )


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that are then alike the last value by name counts. Null is empty."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))
    values = lambda n: F.element_at(F.transform(F.filter(pairs, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), -1)
    return F.map_from_arrays(names, F.transform(names, values))


def _agrees(a: Column, b: Column, etag: bool) -> Column:
    """Whether two validators agree; null if either is missing."""
    plain = (lambda x: F.regexp_replace(x, "^W/", "")) if etag else (lambda x: x)
    return plain(a) == plain(b)
