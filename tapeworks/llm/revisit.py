"""Resolution of not-modified web captures.

A capture of status 304 stands for the latest earlier full response of the same canonical URL, if the validators agree:
the entity tags where both have one, else the modification dates where both have one, else nothing speaks against it.
The resolved capture has that response's payload and headers, updated by the few that a 304 may change.

The as-of join is a window over captures in order of time. One URL may hold a third of all captures, so captures are
range-partitioned by URL and time into buckets of about equal counts: the window runs within (URL, bucket), and a capture
without an earlier response in its bucket takes the last of the earlier buckets, carried over by a window over one row
per (URL, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.llm.common import ascii_lower, discard, materialize

#: Headers that a 304 response may update (fixed values).
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """Lower-case host without user, default port or leading ``www.``, the path without a trailing slash, and the query in order of its parameters; no scheme, no fragment."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    out = F.concat(host, F.regexp_replace(rest, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(out)


def resolve(captures: DataFrame, bucket_rows: int = 500_000) -> DataFrame:
    """``captures`` with outcome, source_id, payload and headers resolved; one row per row.

    Columns: id, url, ts (of any type with an order; ties in order of id, null times first), status, headers (map, lower-case names)
    and payload. A full response has status 200. outcome is ``full``, ``resolved``, ``mismatch``, ``orphan`` (a 304
    without an earlier full response) or ``other``. Null urls are one URL, the empty one. Rows of one id are told apart
    by their other columns; rows equal in all are resolved alike. Other columns stay, but those of the input named
    outcome or source_id give way to the results. An empty table gives an empty result.
    """
    content = [F.array_sort(F.map_entries(c)) if c == "headers" else F.col(c) for c in ("id", "url", "ts", "status", "headers", "payload")]
    rows = captures.select(
        F.struct(*captures.columns).alias("row"),
        F.coalesce(canonical(F.col("url")), F.lit("")).alias("key"), "ts", "id", "status",
        F.xxhash64(*content).alias("u"), F.xxhash64(F.lit(1), *content).alias("v"),
    )
    full, again = F.col("status") == 200, F.col("status") == 304
    # only what the join needs moves through it; the payload is fetched afterwards, once per different row
    slim = rows.select("key", "ts", "id", "status", "u", "v")
    buckets = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // bucket_rows))
    # a table, so that a bucket is what it was when a task runs again
    slim = materialize(slim.repartitionByRange(buckets, "key", "ts", "id", "u", "v").withColumn("bucket", F.spark_partition_id()), "revisit-order")
    mark = F.when(full, F.struct("ts", "id", "u", "v"))
    inner = Window.partitionBy("key", "bucket").orderBy("ts", "id", "u", "v").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("near", F.last(mark, ignorenulls=True).over(inner))
    lasts = slim.filter(full).groupBy("key", "bucket").agg(F.max(F.struct("ts", "id", "u", "v")).alias("last"))
    need = slim.filter(again & F.col("near").isNull()).select("key", "bucket").distinct()
    steps = lasts.withColumn("asks", F.lit(False)).union(need.select("key", "bucket", F.lit(None).cast(lasts.schema["last"].dataType), F.lit(True)))
    earlier = Window.partitionBy("key").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("before", F.max("last").over(earlier)).filter("asks").select("key", "bucket", "before")
    found = slim.filter(again).join(carried, ["key", "bucket"], "left")
    # rows equal in all columns are one here, so that none is multiplied below
    found = found.groupBy("u", "v").agg(F.max(F.coalesce("near", "before")).alias("source")).filter("source is not null")
    found = materialize(found, "revisit-sources")
    discard(slim)
    asked = found.select(F.col("source.u").alias("su"), F.col("source.v").alias("sv"))
    source = rows.filter(full).select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("row.headers").alias("headers"), F.col("row.payload").alias("payload"))
    source = source.join(asked.distinct(), ["su", "sv"], "left_semi").groupBy("su", "sv").agg(F.first(F.struct("headers", "payload")).alias("of"))
    with_source = found.select("u", "v", F.col("source.id").alias("source_id"), F.col("source.u").alias("su"), F.col("source.v").alias("sv"))
    out = rows.join(with_source.join(source, ["su", "sv"]), ["u", "v"], "left")
    mine, theirs = (lambda k: F.col("row.headers")[k]), (lambda k: F.col("of.headers")[k])
    both = lambda k: mine(k).isNotNull() & theirs(k).isNotNull()
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.when(both("etag"), strong(mine("etag")) == strong(theirs("etag"))).when(both("last-modified"), mine("last-modified") == theirs("last-modified")).otherwise(True)
    outcome = F.when(full, "full").when(~F.coalesce(again, F.lit(False)), "other").when(F.col("source_id").isNull() & F.col("of").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    allowed = F.map_filter("row.headers", lambda k, v: k.isin(*UPDATES))
    kept = F.map_filter("of.headers", lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False)))
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce(kept, none), F.coalesce(allowed, none))
    out = out.withColumn("result", outcome)
    done = F.col("result") == "resolved"
    new = {"headers": F.when(done, merged).otherwise(F.col("row.headers")), "payload": F.when(done, F.col("of.payload")).otherwise(F.col("row.payload"))}
    same = [new.get(c, F.col("row")[c]).alias(c) for c in captures.columns if c not in ("outcome", "source_id")]
    return out.select(*same, F.col("source_id"), F.col("result").alias("outcome"))
