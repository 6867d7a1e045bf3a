"""Not-modified revisits: each is resolved to the latest earlier full response of the same canonical URL.

The as-of join works on narrow rows and in time buckets: within a bucket a window finds the latest response, and a
window over the at most `buckets` bucket ends of a URL gives the one to carry over. So a URL with a third of all records
is spread over its buckets. Headers and payload are joined by record id at the end, for resolved revisits only.

Defined cases: records without URL or time take no part; a response at the very time of the revisit isn't earlier; of
responses at one time the largest id counts; a revisit without earlier response has status `missing`, with another
validator `mismatch`, and neither gets headers or payload; one without validators is `unchecked` and resolved; repeated
rows are resolved alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A not-modified answer describes no body and one connection: these of its fields don't replace stored ones.
FORBIDDEN = ["connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
             "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
_STEPS = [(r"#.*$", ""), (r"^https?://", ""), (r"^(www|m)\.", ""), (r"^([^/?]*):(80|443)([/?]|$)", r"\1\3"),
          (r"([?&])(utm_[a-z]+|ref|sessionid)=[^&]*", r"\1"), (r"&&+", "&"), (r"\?&+", "?"), (r"[?&]+$", ""), (r"/+(\?|$)", r"\1")]


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, `www.`/`m.`, default port, fragment, tracking parameters and closing slash."""
    host = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)
    url = F.concat(F.lower(host), F.substring(url, F.length(host) + 1, F.length(url)))
    for pattern, by in _STEPS:
        url = F.regexp_replace(url, pattern, by.replace("\\", "$"))
    return url


def canonical_url_sql(url: str) -> str:
    host = f"regexp_extract({url}, '^([A-Za-z]+://[^/?#]*)', 1)"
    text = f"lower({host}) || substr({url}, len({host}) + 1)"
    for pattern, by in _STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored headers, replaced or extended by the permitted ones of the update."""
    update = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(FORBIDDEN))
    return F.map_zip_with(stored, update, lambda k, a, b: F.coalesce(b, a))


def latest_before(records: DataFrame, buckets: int = 1024) -> DataFrame:
    """`(record_id, ts, key, source_id)` of every revisit; `records` holds `(record_id, key, ts, full)`."""
    span = records.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    width = ((span["b"] - span["a"]) // buckets + 1) if span["a"] is not None else 1
    rows = records.withColumn("bucket", F.floor((F.col("ts") - F.lit(span["a"] or 0)) / F.lit(width)))
    mark = F.when(F.col("full"), F.struct("ts", "record_id"))
    inside = Window.partitionBy("key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(mark).over(inside))
    ends = rows.filter("full").groupBy("key", "bucket").agg(F.max(F.struct("ts", "record_id")).alias("end"))
    asked = rows.filter("not full").select("key", "bucket").distinct()
    carry = asked.join(ends, ["key", "bucket"], "full").withColumn(
        "far", F.max("end").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter("not full").join(carry.select("key", "bucket", "far"), ["key", "bucket"], "left").select(
        "record_id", "key", "ts", F.coalesce(F.col("near.record_id"), F.col("far.record_id")).alias("source_id"))


def resolve_revisits(captures: DataFrame, payload: str = "payload", buckets: int = 1024) -> DataFrame:
    """`(record_id, source_id, outcome, headers, <payload>)` of every not-modified record.

    `captures`: `record_id long, url string, ts long, status int, headers map<string,string> (lower-case names), <payload>`.
    """
    known = captures.filter(F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(200, 304))
    narrow = known.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", (F.col("status") == 200).alias("full"))
    placed = latest_before(narrow, buckets).filter("source_id is not null").select("record_id", "source_id").distinct()
    revisits = captures.filter("status = 304").select("record_id", F.col("headers").alias("update"))
    full = captures.filter("status = 200").select(F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), payload)
    joined = revisits.join(placed, "record_id", "left").join(full, "source_id", "left")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    new, old = F.col("update"), F.col("stored")
    agrees = F.when(new["etag"].isNotNull(), F.coalesce(tag(new) == tag(old), F.lit(False))).when(
        new["last-modified"].isNotNull(), F.coalesce(new["last-modified"] == old["last-modified"], F.lit(False)))
    outcome = F.when(F.col("source_id").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    rows = joined.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unchecked")
    return rows.select("record_id", "source_id", "outcome", F.when(good, merge_headers(old, new)).alias("headers"),
                       F.when(good, F.col(payload)).alias(payload))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures that stand in for an archive: each page as a full response, and a later revisit of it by a longer URL.

    The revisit repeats the page's entity tag, unless its id leaves 1 modulo 5 (changed) or 2 (no validator).
    """
    page = F.col("page_id")
    stored = F.create_map(F.lit("etag"), F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.lit("content-type"), F.lit("text/html"),
                          F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), (page * 10).cast("string"))
    tag = F.when(page % 5 == 1, F.lit('"changed"')).when(page % 5 != 2, F.concat(F.lit('W/"'), F.md5("html"), F.lit('"')))
    update = F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.lit("0"), F.lit("date"), (page * 10 + 7).cast("string"),
                          F.lit("cache-control"), F.lit("max-age=60"))
    full = pages.select((page * 2).alias("record_id"), "url", (page * 10).alias("ts"), F.lit(200).alias("status"),
                        stored.alias("headers"), F.col("html").alias("payload"))
    again = pages.select((page * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (page * 10 + 7).alias("ts"),
                         F.lit(304).alias("status"), F.map_filter(update, lambda k, v: v.isNotNull()).alias("headers"),
                         F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def as_rows(resolved: DataFrame) -> DataFrame:
    """Headers as sorted text, payload as digest, for results that are compared."""
    listed = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), ";")
    return resolved.select("record_id", "source_id", "outcome", listed.alias("headers"), F.md5("payload").alias("payload_md5"),
                           F.length("payload").cast("long").alias("payload_chars"))


SQL = f"""
WITH captures AS (
  SELECT page_id * 2 AS record_id, {canonical_url_sql('url')} AS key, page_id * 10 AS ts, page_id, true AS is_full FROM pages
  UNION ALL SELECT page_id * 2 + 1, {canonical_url_sql("(url || '#again')")}, page_id * 10 + 7, page_id, false FROM pages),
placed AS (
  SELECT *, last_value(CASE WHEN is_full THEN page_id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM captures WHERE key IS NOT NULL),
joined AS (
  SELECT p.record_id, p.page_id, s.page_id AS source, s.html AS body, r.html AS own,
         CASE WHEN s.page_id IS NULL THEN 'missing' WHEN p.page_id % 5 = 2 THEN 'unchecked'
              WHEN p.page_id % 5 <> 1 AND r.html = s.html THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM placed p JOIN pages r USING (page_id) LEFT JOIN pages s ON s.page_id = p.source WHERE NOT p.is_full)
SELECT record_id, source * 2 AS source_id, outcome,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'cache-control=max-age=60;content-length=' || strlen(body) || ';content-type=text/html;date='
         || (page_id * 10 + 7) || ';etag=' || CASE WHEN page_id % 5 = 2 THEN '"' ELSE 'W/"' END || md5(body) || '"' END AS headers,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN md5(body) END AS payload_md5,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN CAST(len(body) AS BIGINT) END AS payload_chars
FROM joined
"""
