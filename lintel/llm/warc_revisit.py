"""Not-modified revisits of web captures, resolved to the full responses that they stand for.

A revisit is joined as of its time to the latest earlier full response under the same canonical url. Its validators are
checked against that response's, and headers that a not-modified answer may update are merged.

The as-of join runs in two levels, so that a url with very many captures does not fall to one task: within a url and a
span of time by a window over its captures, and across spans by a window over one row for each url and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Headers that a 304 answer may update, in lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

#: Time units of a span.
SPAN = 10_000


def canonical_url(url: Column) -> Column:
    """Host in lower case, without scheme, default port, fragment, utm_ parameters and trailing slash; parameters sorted.

    Null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.array_join(F.array_sort(query), "&")
    return F.concat(F.regexp_replace(host, ":(80|443)$", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(captures: DataFrame, span: int = SPAN) -> DataFrame:
    """(record_id, url_key, ts, response_id, response_ts, outcome, status, headers) for each revisit in `captures`.

    `captures`: record_id, url, ts (long), kind (response or revisit), status, digest, headers (map, names in lower
    case). A response counts for later revisits if its status is 200; "earlier" is strictly so, and of responses at one
    time the largest record_id counts. outcome: `none` without an earlier response, else by the first validator that both
    have (etag, last-modified, digest) `match` or `mismatch`, and `unchecked` if they share none. At a match or
    unchecked, status is the response's and headers are its with the permitted ones of the revisit in place; otherwise
    they are the revisit's own. Rows with a null url, ts or kind are left out; null headers count as empty; other columns
    are ignored; repeated revisits are resolved each.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = captures.dropna(subset=["url", "ts", "kind"]).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "revisit").alias("revisit"),
        F.col("status").cast("int").alias("status"), "digest", F.coalesce("headers", none).alias("headers"), F.floor(F.col("ts") / span).alias("span"),
    )
    full = F.when(~F.col("revisit") & (F.col("status") == 200), F.struct("ts", "record_id", "status", "digest", "headers"))
    rows = rows.withColumn("full", full).where("revisit or full is not null")
    within = Window.partitionBy("url_key", "span").orderBy("ts", F.desc("revisit"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("revisit")
    across = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("url_key", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("full"))
    ends = ends.withColumn("far", F.last("full", ignorenulls=True).over(across)).select("url_key", "span", "far")
    found = near.join(ends, ["url_key", "span"], "left").withColumn("from", F.coalesce("near", "far"))

    outcome = F.when(F.col("from").isNull(), "none")
    for ours, theirs in [(F.col("headers")[k], F.col("from.headers")[k]) for k in ("etag", "last-modified")] + [(F.col("digest"), F.col("from.digest"))]:
        outcome = outcome.when(ours.isNotNull() & theirs.isNotNull(), F.when(ours == theirs, "match").otherwise("mismatch"))
    found = found.withColumn("outcome", outcome.otherwise("unchecked"))
    taken = F.col("outcome").isin("match", "unchecked")
    allowed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("from.headers", lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    return found.select(
        "record_id", "url_key", "ts", F.col("from.record_id").alias("response_id"), F.col("from.ts").alias("response_ts"), "outcome",
        F.when(taken, F.col("from.status")).otherwise(F.col("status")).alias("status"), F.when(taken, merged).otherwise(F.col("headers")).alias("headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made from `pages`: each page's response, a revisit of every second page, and of every tenth before all.

    Every sixth page's revisit has a stale etag.
    """
    etag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 8)
    page, seen = F.col("page_id"), F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string"))
    again = F.create_map(F.lit("etag"), F.when(page % 6 == 0, "stale").otherwise(etag), F.lit("server"), F.lit("x"), F.lit("date"), (page + 1).cast("string"))
    made = lambda n, ts, kind, status, headers: F.struct((page * 3 + n).alias("record_id"), F.lit(ts).alias("ts") if isinstance(ts, int) else ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), headers.alias("headers"))
    records = F.array(made(0, page * 10, "response", 200, seen), made(1, page * 10 + 5, "revisit", 304, again), made(2, page * 0 - 1, "revisit", 304, again))
    rows = pages.select("url", "page_id", F.explode(records).alias("r"))
    rows = rows.where((F.col("r.kind") == "response") | ((F.col("r.ts") >= 0) & (page % 2 == 0)) | ((F.col("r.ts") < 0) & (page % 10 == 0)))
    return rows.select("r.*", "url", F.lit(None).cast("string").alias("digest"))


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.withColumn("headers", headers)


OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, substr(md5(coalesce(html, '')), 1, 8) AS etag,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
keyed AS (
  SELECT page_id, etag,
         regexp_replace(translate(regexp_extract(rest, '^([^/?]*)', 1), '{UPPER}', '{LOWER}'), ':(80|443)$', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS q
  FROM cut),
page AS (SELECT page_id, etag, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM keyed),
response AS (SELECT page_id * 3 AS record_id, page_id * 10 AS ts, * FROM page),
revisit AS (
  SELECT page_id * 3 + 1 AS record_id, page_id * 10 + 5 AS ts, * FROM page WHERE page_id % 2 = 0
  UNION ALL SELECT page_id * 3 + 2, -1, * FROM page WHERE page_id % 10 = 0),
asof_ AS (
  SELECT v.*, r.record_id AS response_id, r.ts AS response_ts, r.etag AS old, r.page_id AS old_page,
         CASE WHEN v.page_id % 6 = 0 THEN 'stale' ELSE v.etag END AS new
  FROM revisit v ASOF LEFT JOIN response r ON v.url_key = r.url_key AND v.ts > r.ts),
judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'none' WHEN old = new THEN 'match' ELSE 'mismatch' END AS outcome FROM asof_)
SELECT record_id, url_key, ts, response_id, response_ts, outcome,
       CAST(CASE WHEN outcome = 'match' THEN 200 ELSE 304 END AS INTEGER) AS status,
       CASE WHEN outcome = 'match' THEN 'content-type=text/html;date=' || (page_id + 1) || ';etag=' || new
            ELSE 'date=' || (page_id + 1) || ';etag=' || new || ';server=x' END AS headers
FROM judged
"""
