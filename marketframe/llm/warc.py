"""WARC: resolve not-modified revisits to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import written

#: Headers that a 304 response may bring up to date (RFC 9111: all but those that describe the stored body).
NOT_MERGED = ["content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that do not change what is fetched.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host lower-cased without ``www.`` and default port, tracking parameters dropped, others sorted, no
    trailing slash.  Null stays null; without ``://`` the text is taken from the start."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(head), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, brought up to date by those of the revisit that may be merged.  Names are lower case."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def by_lower_name(headers: Column) -> Column:
    """Header names in lower case, which HTTP does not tell apart: values of one name are joined by ``, ``, in order of the names as they
    were written; a name whose values are all null has null."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def joined(name: Column) -> Column:
        values = F.array_compact(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"]))
        return F.struct(name.alias("key"), F.when(F.size(values) > 0, F.array_join(values, ", ")).alias("value"))

    return F.map_from_entries(F.transform(names, joined))


def resolve_revisits(captures: DataFrame, *, span_rows: int = 20_000) -> DataFrame:
    """As-of join of revisits with earlier full responses.

    ``captures``: record_id long, url string, at long (time), kind string ('response' or 'revisit'), etag, last_modified, digest
    strings, headers map.  Returns for every capture record_id, canonical_url, kind, source_id (the response that gives the body: its
    own id for a response), verdict and headers (merged for a resolved revisit, else its own).

    A revisit's source is the latest response of its canonical URL that is strictly earlier in (at, record_id); captures with the same
    (at, record_id) are ordered by a hash of all that is in them, so the result is the same each time.  verdict: 'response'; 'resolved'
    if each validator that both records state (etag without ``W/``, last_modified, digest) agrees and at least one is stated by both;
    'mismatch' if one differs; 'unvalidated' if none is stated by both; 'missing' if there is no earlier response.  Only 'resolved' has
    source_id and merged headers.

    A URL may hold any share of the rows: captures in order of (URL, at, record_id) are dealt into ranges of about ``span_rows`` rows
    each, whatever their times, a window runs within (URL, range), and only each range's last response is carried on to the later
    ranges of its URL.  Null URLs never match; null times sort first; null kinds are kept with the verdict 'missing'.  Rows repeated
    with one id are separate captures.  Header names that differ in case only are one (``by_lower_name``); null headers are none.  An
    empty table gives no rows.  Payloads are not read; join them by source_id.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", "kind", "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rows = rows.withColumn("headers", by_lower_name(F.col("headers")))
    entries = F.map_entries("headers")
    rows = rows.withColumn("tie", F.xxhash64("canonical_url", "kind", "etag", "last_modified", "digest", entries))
    ranges = max(1, -(-captures.count() // span_rows))
    # Written once, so that a range is the same for whoever reads it.
    rows = written(rows.repartitionByRange(ranges, "canonical_url", "at", "record_id", "tie").withColumn("span", F.spark_partition_id()), "captures")
    full = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull(), F.struct("at", "record_id", "tie", "etag", "last_modified", "digest", "headers"))
    rows = rows.withColumn("full", full)
    within = Window.partitionBy("canonical_url", "span").orderBy(*(F.col(c).asc_nulls_first() for c in ("at", "record_id", "tie"))).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.last("full", ignorenulls=True).over(within))
    # a row for each URL and range at most; what a range inherits is the last response of the ranges before it
    order = F.struct(F.coalesce("at", F.lit(-(1 << 62))), F.coalesce("record_id", F.lit(-(1 << 62))), "tie")
    lasts = rows.where("canonical_url is not null").groupBy("canonical_url", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("canonical_url").alias("u"), F.col("span").alias("s"), F.last("last", ignorenulls=True).over(earlier).alias("inherited"))
    met = placed.join(carried, (F.col("canonical_url") == F.col("u")) & (F.col("span") == F.col("s")), "left")
    met = met.withColumn("source", F.coalesce("before", "inherited"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    checks = [weak(F.col("etag")) == weak(F.col("source.etag")), F.col("last_modified") == F.col("source.last_modified"), F.col("digest") == F.col("source.digest")]
    stated, agree = F.greatest(*(c.isNotNull().cast("int") for c in checks)), F.least(*(F.coalesce(c, F.lit(True)).cast("int") for c in checks))
    verdict = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("source").isNull() | F.col("kind").isNull() | F.col("canonical_url").isNull(), "missing")
        .when(agree == 0, "mismatch")
        .when(stated == 0, "unvalidated")
        .otherwise("resolved")
    )
    met = met.withColumn("verdict", verdict)
    resolved = F.col("verdict") == "resolved"
    return met.select(
        "record_id", "canonical_url", "kind", F.when(F.col("verdict") == "response", F.col("record_id")).when(resolved, F.col("source.record_id")).alias("source_id"), "verdict",
        F.when(resolved, merged_headers(F.col("source.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as a crawl in page_id order, with the headers that their servers would send.

    A page stands for its section's front page (the number in its path is dropped), so that a URL is captured again and again.  Two of three pages are full responses, the third a revisit.  A URL's content changes every 4,096 pages, so a revisit may come after
    a change (mismatch); every fifth capture states a date instead of an entity tag, and every fourth a digest of the version's body, which
    servers that lag behind by 64 pages state late.  Every seventh states its date twice, under two spellings of the name.
    """
    n = F.col("page_id").cast("long")
    front = F.regexp_replace("url", r"/[0-9]+(\.html)?/?", "/")
    canonical = canonical_url(front)
    version = F.concat(canonical, F.lit("|"), F.floor(n / 4096).cast("string"))
    dated = F.pmod(n, F.lit(5)) == 0
    kind = F.when(F.pmod(n, F.lit(3)) == 2, "revisit").otherwise("response")
    etag = F.when(~dated, F.concat(F.when(kind == "revisit", "W/").otherwise(""), F.lit('"'), F.substring(F.md5(version.cast("binary")), 1, 16), F.lit('"')))
    day = F.when(dated | (kind == "response"), F.concat(F.lit("day "), F.floor(n / 4096).cast("string")))
    digest = F.when(F.pmod(n, F.lit(4)) == 1, F.sha2(F.concat(canonical, F.lit("|body|"), F.floor((n - F.when(kind == "revisit", 64).otherwise(0)) / 4096).cast("string")), 256))
    headers = F.map_filter(
        F.create_map(F.lit("Date"), F.concat(F.lit("t"), n.cast("string")), F.lit("date"), F.when(F.pmod(n, F.lit(7)) == 0, F.concat(F.lit("again t"), n.cast("string"))), F.lit("ETag"), etag, F.lit("Content-Length"), F.when(kind == "response", F.length("html").cast("string")).otherwise("0")),
        lambda _, v: v.isNotNull(),
    )
    return pages.select(n.alias("record_id"), front.alias("url"), n.alias("at"), kind.alias("kind"), etag.alias("etag"), day.alias("last_modified"), digest.alias("digest"), headers.alias("headers"))


def digest(resolved: DataFrame) -> DataFrame:
    """The result with headers as one text, name by name."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(F.col("record_id").alias("page_id"), "canonical_url", "kind", "source_id", "verdict", F.array_join(lines, "; ").alias("headers"))


#: The same over the pages table, for DuckDB.
SQL = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '/[0-9]+(\.html)?/?', '/', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS b FROM pages
), parts AS (
  SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&]*|ref|fbclid|gclid)(?:=|$)'))) AS kept
  FROM bare
), named AS (
  SELECT page_id, html, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url,
         CASE WHEN page_id % 3 = 2 THEN 'revisit' ELSE 'response' END AS kind, page_id // 4096 AS era, page_id % 5 = 0 AS dated
  FROM parts
), captures AS (
  SELECT page_id, canonical_url, kind,
         CASE WHEN NOT dated THEN '"' || substring(md5(canonical_url || '|' || era), 1, 16) || '"' END AS tag,
         CASE WHEN dated OR kind = 'response' THEN era END AS day,
         CASE WHEN page_id % 4 = 1 THEN sha256(canonical_url || '|body|' || CAST(floor((page_id - CASE WHEN kind = 'revisit' THEN 64 ELSE 0 END) / 4096) AS BIGINT)) END AS body,
         't' || page_id || CASE WHEN page_id % 7 = 0 THEN ', again t' || page_id ELSE '' END AS date, CASE WHEN kind = 'response' THEN CAST(length(html) AS VARCHAR) ELSE '0' END AS size
  FROM named
), sources AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': page_id, 'tag': tag, 'day': day, 'body': body, 'size': size} END IGNORE NULLS)
            OVER (PARTITION BY canonical_url ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
  FROM captures
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN s IS NULL THEN 'missing'
                 WHEN coalesce(tag <> s.tag, false) OR coalesce(day <> s.day, false) OR coalesce(body <> s.body, false) THEN 'mismatch'
                 WHEN (tag = s.tag) IS NULL AND (day = s.day) IS NULL AND (body = s.body) IS NULL THEN 'unvalidated' ELSE 'resolved' END AS verdict
  FROM sources
)
SELECT page_id, canonical_url, kind, CASE verdict WHEN 'response' THEN page_id WHEN 'resolved' THEN s.id END AS source_id, verdict,
       'content-length: ' || CASE WHEN verdict = 'resolved' THEN s.size ELSE size END || '; date: ' || date ||
       coalesce('; etag: ' || CASE WHEN kind = 'revisit' THEN 'W/' ELSE '' END || tag,
                CASE WHEN verdict = 'resolved' AND s.tag IS NOT NULL THEN '; etag: ' || s.tag END, '') AS headers
FROM judged
"""
