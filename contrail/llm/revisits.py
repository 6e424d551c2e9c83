"""Resolution of not-modified revisit records of a web archive.

A revisit names a page by its URL and says that the server answered 304: its
content is that of the latest earlier full response of the same canonical URL.
That response is found by an as-of join, the validators of both are checked, and
the headers that a 304 may update (RFC 9110, section 15.4.5) replace the stored ones.

As-of join without one task per URL: records are dealt out by ranges of (URL,
time), so a URL with a third of all records is spread over many parts; inside
a part a window carries the last response along, and where a URL goes on from
part to part the last response of the earlier ones is handed over, a table of
at most one row per part and spread URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import documents, stored

#: Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid)(=|$)"
_URL = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"


def canonical(url: Column) -> Column:
    """Host in lower case without www. or m., other than default port, path without a
    last slash, and the sorted query without tracking parameters; no scheme, no fragment."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(1)), r"^(www|m)\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), "/+$", "")
    keep = F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    query = F.array_join(F.array_sort(keep), "&")
    return F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """What each revisit of ``records`` refers to.

    ``records``: record_id, url, ts, kind (response or revisit), etag,
    last_modified, headers (map of lower-case names).  Returns record_id,
    canonical_url, ts, response_id, response_ts, status and headers.  Status:
    ``resolved`` if the entity tags match weakly or, without a pair of them, the
    modification times are equal; ``mismatch`` if they differ; ``unverified``
    without a common validator; ``no_response`` without an earlier response.
    Headers are the response's with permitted ones of the revisit over them where
    resolved, else null.  A response at a revisit's own time is not earlier; of
    several at one time the largest record_id counts.  Records with a null URL,
    time or id are left out; repeated revisits come as often as they are; null
    headers are none.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical(F.col("url")).alias("key"), "ts", (F.col("kind") == "response").alias("full"), "etag", "last_modified",
                          F.coalesce("headers", none).alias("headers"))
    rows = rows.where("record_id IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL AND full IS NOT NULL")
    order = ["ts", "full", "record_id"]  # at one time revisits come first
    dealt = stored(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "records")

    response = F.when(F.col("full"), F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    before = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(response, ignorenulls=True).over(before)).where("NOT full")

    spread = dealt.select("key", "part").distinct().groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    at = F.struct("ts", "record_id")
    last = dealt.join(spread, "key", "left_semi").groupBy("key", "part").agg(F.max_by(response, F.when(F.col("full"), at)).alias("own"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    handed = last.withColumn("handed", F.last("own", ignorenulls=True).over(earlier)).where("handed IS NOT NULL").select("key", "part", "handed")
    found = near.join(handed, ["key", "part"], "left").withColumn("r", F.coalesce("near", "handed"))

    tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("r.etag"))).when(times, F.col("last_modified") == F.col("r.last_modified"))
    status = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(F.col("r.headers"), none), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return found.select("record_id", F.col("key").alias("canonical_url"), "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"),
                        status.alias("status"), F.when(status == "resolved", F.map_concat(kept, fresh)).alias("headers"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def capture_records(pages: DataFrame) -> DataFrame:
    """An archive's records derived from ``pages`` (page_id, url, html): page p is a
    full response at time 10 p, and a later visit of the same page under another
    spelling of its URL is a revisit (sometimes with a changed tag, without a tag
    or without any validator, and sometimes of a page that had not been fetched yet)."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    changed = F.concat(F.lit("day "), (p % 365).cast("string"))
    text = lambda c: c.cast("string")
    first = pages.select(
        (2 * p).alias("record_id"), "url", (10 * p).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.length(F.coalesce("html", F.lit("")))), F.lit("date"), text(10 * p),
                     F.lit("etag"), tag, F.lit("last-modified"), changed).alias("headers"))
    later = F.when(p % 13 == 0, -5).otherwise(10 * (p % 7) + 5)
    spelling = F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=feed#part"))
    sent = F.when(p % 5 == 0, F.lit('"old"')).when((p % 7 != 0) & (p % 11 != 0), F.concat(F.lit("W/"), tag))
    again = pages.select(
        (2 * p + 1).alias("record_id"), spelling.alias("url"), (10 * p + later).alias("ts"), F.lit("revisit").alias("kind"), sent.alias("etag"),
        F.when(p % 11 != 0, changed).alias("last_modified"),
        F.create_map(F.lit("date"), text(10 * p + later), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"),
                     F.lit("set-cookie"), F.lit("visit=1")).alias("headers"))
    return first.unionByName(again)


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(capture_records(documents(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_text(F.col("headers")))


SQL = r"""
WITH spelled AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS ts, true AS is_full, page_id AS p, html FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed#part',
         10 * page_id + CASE WHEN page_id % 13 = 0 THEN -5 ELSE 10 * (page_id % 7) + 5 END, false, page_id, html FROM pages),
parts AS (
  SELECT *, regexp_extract(url, '{URL}', 1) AS host, regexp_extract(url, '{URL}', 2) AS port, regexp_extract(url, '{URL}', 3) AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '{URL}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))) AS params
  FROM spelled WHERE url IS NOT NULL AND p IS NOT NULL),
records AS (
  SELECT record_id, ts, is_full, p,
         regexp_replace(lower(host), '^(www|m)\.', '') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END AS canonical_url,
         '"' || substring(md5(coalesce(html, '')), 1, 12) || '"' AS tag, 'day ' || (p % 365) AS changed, length(coalesce(html, '')) AS size
  FROM parts),
seen AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'record_id': record_id, 'ts': ts, 'tag': tag, 'changed': changed, 'size': size} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM records),
checked AS (
  SELECT *, CASE WHEN p % 5 = 0 THEN '"old"' WHEN p % 7 <> 0 AND p % 11 <> 0 THEN tag END AS sent, CASE WHEN p % 11 <> 0 THEN changed END AS since
  FROM seen WHERE NOT is_full),
judged AS (
  SELECT *, CASE WHEN r IS NULL THEN 'no_response'
                 WHEN sent IS NOT NULL THEN CASE WHEN sent = r.tag THEN 'resolved' ELSE 'mismatch' END
                 WHEN since IS NOT NULL THEN CASE WHEN since = r.changed THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unverified' END AS status FROM checked)
SELECT record_id, canonical_url, ts, r.record_id AS response_id, r.ts AS response_ts, status,
       CASE WHEN status = 'resolved' THEN array_to_string(list_sort(['content-type: text/html', 'content-length: ' || r.size, 'etag: ' || r.tag,
         'last-modified: ' || r.changed, 'date: ' || ts, 'cache-control: max-age=60']), chr(10)) END AS headers
FROM judged
""".replace("{URL}", _URL).replace("{TRACKING}", TRACKING)
