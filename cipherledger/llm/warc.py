"""Resolution of not-modified revisit records.

A revisit says that a resource had not changed, and holds no body. It is joined as-of to the
latest full response of its canonical URL that is strictly earlier; the validators of both
are compared, and the headers a not-modified answer may update are merged into those of the
response.

The as-of join works in buckets of time: windows see one URL in one bucket, and the last
response of earlier buckets is carried over a table with one row per URL and bucket. A hot
URL is thus cut into as many tasks as it has buckets. Bodies are never read.

Statuses: ``resolved``; ``no_earlier_response``; ``validator_mismatch``; ``no_validator``
where no kind of validator is on both sides. Only resolved rows have merged headers. Defined
cases: null headers count as none; header names are compared in lower case, the last of
equal names wins; records with a null URL or date are unresolved (``no_earlier_response``);
of responses at one time the one with the greatest id counts; repeated revisits keep one row
each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 86_400

# Fields a not-modified answer must not update (framing, connection, coding).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment, tracking parameters,
    empty query or a final slash of the path; parameters sorted."""
    head = F.lower(F.regexp_extract(url, r"(?s)^([^/?#]*//[^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^/?#]*//[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header map with names in lower case; the last of names that then are equal wins."""
    entries = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    step = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e)))
    return F.aggregate(low, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), step)


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the update in their place."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)


def validity(stored: Column, update: Column) -> Column:
    """Whether the validators of both sides agree; null if no kind is on both. Entity tags
    are compared weakly and take precedence over dates."""
    def tag(h: Column) -> Column:
        return F.regexp_replace(h["etag"], "^W/", "")
    return F.coalesce(tag(stored) == tag(update), stored["last-modified"] == update["last-modified"])


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(record_id, url, at, status, response_id, headers) for the revisits of records
    (record_id, kind, url, at, headers): kind is ``response`` or ``revisit``, at is a number
    of seconds, headers a map."""
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", (F.col("kind") == "response").alias("full"), canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"),
        F.floor(F.col("at") / bucket_seconds).alias("bucket"), lower_names(F.col("headers")).alias("headers"))
    known = rows.where("url IS NOT NULL AND at IS NOT NULL")
    response = F.when(F.col("full"), F.struct("record_id", "headers"))
    order = F.when(F.col("full"), F.struct("at", "record_id"))
    earlier = Window.partitionBy("url", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = known.withColumn("found", F.max_by(response, order).over(earlier)).where("NOT full")
    last = known.where("full").groupBy("url", "bucket").agg(F.max_by(F.struct("record_id", "headers"), F.struct("at", "record_id")).alias("last"))
    wanted = known.where("NOT full").select("url", "bucket").distinct()
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(wanted, ["url", "bucket"], "full").withColumn("carried", F.last("last", True).over(before)).select("url", "bucket", "carried").where("carried IS NOT NULL")
    joined = here.join(carried, ["url", "bucket"], "left").withColumn("response", F.coalesce("found", "carried"))
    lost = rows.where("NOT full AND (url IS NULL OR at IS NULL)").withColumn("response", F.lit(None).cast(joined.schema["response"].dataType))
    out = joined.select("record_id", "url", "at", "headers", "response").unionByName(lost.select("record_id", "url", "at", "headers", "response"))
    valid = validity(F.col("response.headers"), F.col("headers"))
    status = (F.when(F.col("response").isNull(), "no_earlier_response").when(valid, "resolved")
              .when(valid.isNull(), "no_validator").otherwise("validator_mismatch"))
    return out.withColumn("status", status).select(
        "record_id", "url", "at", "status", F.col("response.record_id").alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("response.headers"), F.col("headers"))).alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two records for each page: its response, and a later revisit whose validators depend
    on the page: strong or weak tag, another tag, a date alone, or none."""
    kind, tag = F.substring(F.md5(F.col("url").cast("binary")), 1, 1), F.substring(F.md5(F.col("html").cast("binary")), 1, 12)
    quoted, at = F.concat(F.lit('"'), tag, F.lit('"')), F.col("page_id") * 60
    modified = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    response = F.create_map(F.lit("ETag"), quoted, F.lit("Last-Modified"), modified, F.lit("Content-Length"), F.octet_length("html").cast("string"),
                            F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"))
    sent = (F.when(kind.isin("0", "1"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), quoted)))
            .when(kind == "2", F.create_map(F.lit("etag"), F.lit('"other"')))
            .when(kind == "3", F.create_map(F.lit("last-modified"), modified))
            .when(kind == "4", F.create_map(F.lit("x-cache"), F.lit("hit"))).otherwise(F.create_map(F.lit("ETag"), quoted)))
    update = F.map_concat(sent, F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Age"), (F.col("page_id") % 100).cast("string")))
    later = at + 30 + 3600 * F.ascii(kind)
    both = F.array(F.struct(F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), at.alias("at"), response.alias("headers")),
                   F.struct(F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), F.lit("revisit").alias("kind"), later.alias("at"), update.alias("headers")))
    return pages.select("url", F.explode(both).alias("r")).select("r.record_id", "r.kind", "url", "r.at", "r.headers")


#: The resolution of ``crawl_records(pages)``, one row per page.
SQL = r"""
WITH p AS (
  SELECT page_id, html, substr(md5(url), 1, 1) AS kind, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || (page_id % 28) AS modified, page_id * 60 AS t0,
    lower(regexp_extract(url, '^([^/?#]*//[^/?#]*)', 1)) AS head,
    regexp_replace(regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort([x FOR x IN string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)=')]) AS q
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url,
    t0 + 30 + 3600 * ascii(kind) AS seen FROM p),
j AS (
  SELECT v.*, r.page_id AS r_id, r.tag AS r_tag, r.modified AS r_modified, r.html AS r_html,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.t0 DESC, 'r' || r.page_id DESC) AS k
  FROM c v LEFT JOIN c r ON r.url = v.url AND r.t0 < v.seen),
s AS (
  SELECT *, CASE WHEN r_id IS NULL THEN 'no_earlier_response' WHEN kind = '4' THEN 'no_validator' WHEN kind = '2' THEN 'validator_mismatch'
    WHEN kind = '3' THEN CASE WHEN modified = r_modified THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN tag = r_tag THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM j WHERE k = 1)
SELECT 'v' || page_id AS record_id, url, seen AS "at", status, 'r' || r_id AS response_id,
  CASE WHEN status = 'resolved' THEN 'age: ' || (page_id % 100) || chr(10) || 'cache-control: max-age=600' || chr(10) || 'content-length: ' || strlen(r_html) || chr(10)
    || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN kind = '3' THEN r_tag WHEN kind IN ('0', '1') THEN 'W/' || tag ELSE tag END || chr(10) || 'last-modified: ' || r_modified END AS header_lines
FROM s
"""
