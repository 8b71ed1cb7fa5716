"""Not-modified revisits of web archives: as-of join to the full response (operator 3).

A revisit record says that a page had not changed; its body is that of the
latest earlier full response of the same canonical URL. The as-of join works on
keys only and in two levels, so that a URL with any share of all records is
spread out: inside one (URL, day) by a window, and between days by the last
response of each earlier day. Bodies are joined once, by record id, to the
revisits that resolved; those of popular responses are dealt over SALTS copies
of the body.

Validators decide whether the response found is the one meant: entity tags by
weak comparison where both records have one, else Last-Modified, else payload
digests. A revisit may update only the headers that a not-modified answer is
permitted to carry; all others come from the stored response.

Defined results: a null URL or date never resolves (``no_key``); no earlier
response: ``no_response``; nothing to compare: ``no_validator``; different:
``changed``; else ``resolved``. Equal dates stand in the order of record ids.
Revisit rows that repeat a record id are resolved each by itself; of response
rows that repeat one, that with the least (date, etag, digest, payload) gives the
body, and one without an id gives none. Null headers are empty. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graphs import hot_keys
from . import common

#: Copies of the body of a popular response.
SALTS = 32
#: Fields that a 304 answer updates in a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
TRACKING = "^(utm_[a-z]+|gclid|fbclid)(=|$)"
#: Span within which one window orders the records of a URL.
DAY = 86400


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, no scheme, fragment or tracking parameters, parameters sorted, no final slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "(:80|:443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_response(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every revisit of (record_id, url, date, type, etag, last_modified, digest) with the key fields of its as-of response.

    ``base`` is a struct (date, record_id, etag, last_modified, digest) or null;
    ``keep`` names more columns that stay with a revisit.
    """
    keyed = records.select(
        "record_id", "date", "etag", "last_modified", "digest", *keep, canonical_url(F.col("url")).alias("canonical_url"), (F.col("type") == "revisit").alias("is_revisit"),
        F.floor(F.unix_timestamp("date") / DAY).alias("day"),
    )
    full = F.when(~F.col("is_revisit"), F.struct("date", "record_id", "etag", "last_modified", "digest"))
    known = F.col("canonical_url").isNotNull() & F.col("date").isNotNull()
    rows = keyed.filter(known).withColumn("full", full)
    order = Window.partitionBy("canonical_url", "day").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("base", F.last("full", ignorenulls=True).over(order)).filter("is_revisit")
    days = Window.partitionBy("canonical_url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("canonical_url", "day").agg(F.max("full").alias("full")).select("canonical_url", "day", F.last("full", ignorenulls=True).over(days).alias("before"))
    found = inside.join(last, ["canonical_url", "day"], "left").withColumn("base", F.coalesce("base", "before"))
    columns = ["record_id", "date", "etag", "last_modified", "digest", "canonical_url", *keep]
    none = keyed.filter(~known & F.col("is_revisit")).select(*columns, F.lit(None).cast(found.schema["base"].dataType).alias("base"))
    return found.select(*columns, "base").unionByName(none)


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, canonical_url, base_id, status, headers (merged), payload of the response.

    records: record_id long, url string, date timestamp, type ('response' or
    'revisit'), etag, last_modified, digest strings, headers map, payload.
    """
    base = F.col("base")
    same = (
        F.when(F.col("etag").isNotNull() & base["etag"].isNotNull(), _strong(F.col("etag")) == _strong(base["etag"]))
        .when(F.col("last_modified").isNotNull() & base["last_modified"].isNotNull(), F.col("last_modified") == base["last_modified"])
        .when(F.col("digest").isNotNull() & base["digest"].isNotNull(), F.col("digest") == base["digest"])
    )
    status = F.when(F.col("canonical_url").isNull() | F.col("date").isNull(), "no_key").when(base.isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    empty = F.create_map().cast("map<string,string>")
    permitted = F.map_filter(F.coalesce("headers", empty), lambda k, _: F.lower(k).isin(*PERMITTED))
    asked = records.select("record_id", "url", "date", "type", "etag", "last_modified", "digest", F.when(F.col("type") == "revisit", permitted).alias("fresh"))
    found = latest_response(asked, ("fresh",)).withColumn("status", status).withColumn("base_id", F.when(F.col("status") == "resolved", base["record_id"]))
    found = common.materialize(found.select("record_id", "canonical_url", "base_id", "status", "fresh"), "revisits")
    least = F.min_by(F.struct(F.coalesce("headers", empty).alias("stored"), "payload"), F.struct("date", "etag", "digest", "payload")).alias("body")
    bodies = records.filter((F.col("type") == "response") & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("base_id")).agg(least)
    met = found.filter("base_id IS NOT NULL")
    if popular := hot_keys(met, "base_id"):
        often = F.col("base_id").isin(popular)
        salted = met.filter(often).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
        copies = bodies.filter(often).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        out = met.filter(~often).join(bodies, "base_id").unionByName(salted.join(copies, ["base_id", "salt"]).drop("salt"))
    else:
        out = met.join(bodies, "base_id")
    names = F.transform(F.map_keys("fresh"), lambda k: F.lower(k))
    kept = F.map_filter("body.stored", lambda k, _: ~F.array_contains(names, F.lower(k)))
    resolved = out.select("record_id", "canonical_url", "base_id", "status", F.map_concat(kept, F.col("fresh")).alias("headers"), F.col("body.payload").alias("payload"))
    rest = found.filter("base_id IS NULL").select("record_id", "canonical_url", "base_id", "status", F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(resolved.schema["payload"].dataType).alias("payload"))
    return resolved.unionByName(rest)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages: its responses, and revisits of three kinds.

    Page p is fetched at minute p. Even pages are met again a day later under
    another form of the URL with the same validator (every eleventh page without
    any); every fifth two days later with another one; every seventh has a
    revisit before its response. Validators are entity tags, dates of change and
    digests in turn.
    """
    p = F.col("page_id").cast("long")
    mark = F.md5("html")
    validators = [("etag", F.concat(F.lit('"'), mark, F.lit('"')), '"other"'), ("last_modified", F.concat(F.lit("modified "), p.cast("string")), "modified never"), ("digest", F.concat(F.lit("sha1:"), mark), "sha1:other")]
    own = [F.when(p % 3 == n, v).alias(c) for n, (c, v, _) in enumerate(validators)]
    page = pages.select(p.alias("p"), "url", F.col("html").alias("payload"), *own)
    minute = F.col("p") * 60
    length = F.length("payload").cast("string")
    none = F.lit(None).cast("string")

    def record(k: int, kind: str, url: Column, seconds: Column, headers: dict[str, Column | str], **other: Column) -> Column:
        pairs = [x if isinstance(x, Column) else F.lit(x) for item in headers.items() for x in item]
        fields = [other.get(c, F.col(c)).alias(c) for c, _, _ in validators]
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), url.alias("u"), seconds.alias("s"), *fields, F.create_map(*pairs).alias("headers"))

    weak = {c: F.when(F.col("p") % 11 != 0, F.concat(F.lit("W/"), F.col(c)) if c == "etag" else F.col(c)) for c, _, _ in validators}
    changed = {c: F.when(F.col(c).isNotNull(), F.lit(o)).otherwise(none) for c, _, o in validators}
    kinds = F.array(
        record(0, "response", F.col("url"), minute, {"Content-Type": "text/html", "Content-Length": length, "Cache-Control": "max-age=60"}),
        record(1, "revisit", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")), minute + DAY, {"cache-control": "max-age=120", "Content-Length": "0"}, **weak),
        record(2, "revisit", F.col("url"), minute + 2 * DAY, {"Expires": "0"}, **changed),
        record(3, "revisit", F.col("url"), minute - 30, {"Expires": "0"}),
    )
    wanted = F.filter(kinds, lambda r: (r["k"] == 0) | ((r["k"] == 1) & (F.col("p") % 2 == 0)) | ((r["k"] == 2) & (F.col("p") % 5 == 0)) | ((r["k"] == 3) & (F.col("p") % 7 == 0)))
    rows = page.select("p", "payload", F.explode(wanted).alias("r"))
    return rows.select(
        (F.col("p") * 4 + F.col("r.k")).alias("record_id"), F.col("r.u").alias("url"), F.timestamp_seconds("r.s").alias("date"), F.col("r.type").alias("type"),
        "r.etag", "r.last_modified", "r.digest", F.col("r.headers").alias("headers"), F.when(F.col("r.type") == "response", F.col("payload")).alias("payload"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 over all pages."""
    found = resolve(records_of_pages(common.read_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "base_id", "status", listed.alias("merged_headers"), F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


SQL = r"""
WITH page AS (
  SELECT page_id AS p, url, html, CASE WHEN page_id % 3 = 0 THEN '"' || md5(html) || '"' END AS tag,
    CASE WHEN page_id % 3 = 1 THEN 'modified ' || page_id END AS lm, CASE WHEN page_id % 3 = 2 THEN 'sha1:' || md5(html) END AS dig FROM pages
), records AS (
  SELECT p*4 AS record_id, url, p*60 AS s, true AS is_full, tag AS etag, lm, dig, html FROM page
  UNION ALL SELECT p*4+1, regexp_replace(url, '#.*$', '') || '#again', p*60+86400, false, CASE WHEN p % 11 <> 0 THEN 'W/' || tag END, CASE WHEN p % 11 <> 0 THEN lm END, CASE WHEN p % 11 <> 0 THEN dig END, NULL FROM page WHERE p % 2 = 0
  UNION ALL SELECT p*4+2, url, p*60+172800, false, CASE WHEN tag IS NOT NULL THEN '"other"' END, CASE WHEN lm IS NOT NULL THEN 'modified never' END, CASE WHEN dig IS NOT NULL THEN 'sha1:other' END, NULL FROM page WHERE p % 5 = 0
  UNION ALL SELECT p*4+3, url, p*60-30, false, tag, lm, dig, NULL FROM page WHERE p % 7 = 0
), bare AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM records
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '(:80|:443)$', ''), '^www[.]', '') AS host,
    regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) AS asked
  FROM bare
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical_url FROM parts
), seen AS (
  SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM keyed
), judged AS (
  SELECT r.record_id, r.canonical_url, f.record_id AS base_id0, f.html,
    CASE WHEN r.canonical_url IS NULL THEN 'no_key' WHEN f.record_id IS NULL THEN 'no_response'
         WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN replace(r.etag, 'W/', '') = f.etag THEN 'resolved' ELSE 'changed' END
         WHEN r.lm IS NOT NULL AND f.lm IS NOT NULL THEN CASE WHEN r.lm = f.lm THEN 'resolved' ELSE 'changed' END
         WHEN r.dig IS NOT NULL AND f.dig IS NOT NULL THEN CASE WHEN r.dig = f.dig THEN 'resolved' ELSE 'changed' END ELSE 'no_validator' END AS status
  FROM seen r LEFT JOIN keyed f ON f.record_id = r.found AND f.is_full WHERE NOT r.is_full
)
SELECT record_id, canonical_url, CASE WHEN status = 'resolved' THEN base_id0 END AS base_id, status,
  CASE WHEN status = 'resolved' THEN
    CASE WHEN record_id % 4 = 1 THEN 'cache-control=max-age=120;content-length=' || length(html) || ';content-type=text/html'
         ELSE 'cache-control=max-age=60;content-length=' || length(html) || ';content-type=text/html;expires=0' END END AS merged_headers,
  CASE WHEN status = 'resolved' THEN CAST(length(html) AS BIGINT) END AS payload_chars,
  CASE WHEN status = 'resolved' THEN md5(html) END AS payload_md5
FROM judged
"""
