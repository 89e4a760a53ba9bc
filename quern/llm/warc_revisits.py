"""Resolution of not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit record says that a page had not changed since an earlier capture. It is resolved to the
latest full response of the same canonical URL at or before its time (a response of the very time of the
revisit counts as earlier), provided that the validators agree; the stored headers are then updated by those that a 304 response may bring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table

#: Headers of a 304 response that replace stored ones (RFC 9110, section 15.4.5, and those of RFC 9111).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "warning")
#: Query parameters that don't change the page.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref|sessionid"
#: Time is cut into slices of about so many records of all URLs, but no fewer and no more slices than these bounds.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 1_000_000, 64, 1_024
#: Characters that mean the same whether they are percent-encoded or not (RFC 3986, section 2.3).
UNRESERVED = "[A-Za-z0-9._~-]"


def canonical_url(url: Column) -> Column:
    """Scheme and port dropped, host in lower case without www, no fragment, no tracking parameters,
    parameters in order, dot segments resolved, no slash at the end; percent-encoding in upper case, and gone
    where it is needless. Null stays null."""
    bare = F.regexp_replace(F.btrim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(_without_dots(_decoded(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1))), "/+$", "")
    query = _decoded(F.regexp_extract(bare, "[?](.*)$", 1))
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _decoded(text: Column) -> Column:
    """text with %xx as the character it stands for, if that is unreserved, else in upper case."""

    def one(part: Column, i: Column) -> Column:
        code, rest = F.upper(F.substring(part, 1, 2)), F.substr(part, F.lit(3))
        char = F.char(F.conv(code, 16, 10).cast("int"))
        coded = F.when(char.rlike(f"^{UNRESERVED}$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(i == 0, part).when(part.rlike("^[0-9A-Fa-f]{2}"), coded).otherwise(F.concat(F.lit("%"), part))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%"), one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """path with its . and .. segments resolved; none leads above the root."""
    root = F.array(F.lit(""))
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s)))
    segments = F.split(path, "/")
    found = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), root, step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(found, "/")).otherwise(path)


def latest_before(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """events with `latest`: the largest value of the same key up to this row, ties included.

    value is null or a struct that begins with the time, so that the largest is the latest.

    An as-of join without a window over a whole key. Rows of one key and time are pooled first; times are cut into
    slices that hold about equally many rows of all keys, so that no key has more than that in one; the last value
    of each slice is carried into the key's later slices, and times look back within their own.
    """
    rows = events.count()
    slices = min(MOST_SLICES, max(LEAST_SLICES, rows // SLICE_ROWS))
    cuts = events.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10 * slices)).first()[0] if rows else []
    cuts = sorted(set(cuts or []))
    of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(at))) if cuts else F.lit(0)
    times = events.groupBy(key, at).agg(F.max(value).alias("__own")).withColumn("__slice", of)
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    last = times.groupBy(key, "__slice").agg(F.max("__own").alias("__last"))
    carried = last.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).select(F.col(key).alias("__key"), F.col("__slice").alias("__in"), "__carried")
    own = Window.partitionBy(key, "__slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    seen = times.withColumn("__own", F.max("__own").over(own))
    seen = seen.join(carried, seen[key].eqNullSafe(carried["__key"]) & (seen["__slice"] == carried["__in"]), "left")
    seen = seen.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.coalesce("__own", "__carried").alias("latest"))
    return events.join(seen, events[key].eqNullSafe(seen["__key"]) & events[at].eqNullSafe(seen["__at"]), "left").drop("__key", "__at")


def resolved(records: DataFrame) -> DataFrame:
    """Every revisit of records (record_id, url, at, kind, headers, digest) with what it resolves to.

    kind is response or revisit; headers maps names in lower case to values; digest is the payload's.
    status is resolved, mismatch (the validators disagree) or missing (no earlier response). A revisit
    agrees if each of etag, last-modified and digest that both sides give is equal, and one is given
    by both. Responses at the same time as each other: that with the larger record_id counts as later.
    Null or empty URLs, and records without a time, resolve to nothing. A row that comes twice comes back
    twice; a record_id names one record. An empty table gives an empty one; further columns play no part.
    """
    known = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", "kind", "headers", "digest")
    # A URL or time that is missing is no key: such revisits keep status missing.
    usable = F.col("canonical_url").isNotNull() & (F.col("canonical_url") != "") & F.col("at").isNotNull()
    events = known.select("record_id", F.when(usable, F.col("canonical_url")).alias("__url"), "at", "kind", F.when((F.col("kind") == "response") & usable, F.struct("at", "record_id")).alias("__pick"))
    # The headers stay where they are: what goes through the join in time is one id per record.
    found = latest_before(events.where("__url IS NOT NULL"), "__url", "at", "__pick")
    found = found.where("kind = 'revisit'").groupBy(F.col("record_id").alias("__revisit")).agg(F.max("latest")["record_id"].alias("resolved_id"))
    revisits = known.where("kind = 'revisit'").join(found, known["record_id"] == F.col("__revisit"), "left").drop("__revisit", "kind")
    full_ones = known.where("kind = 'response' AND record_id IS NOT NULL").select(F.col("record_id").alias("__full"), F.col("headers").alias("__stored"), F.col("digest").alias("__digest")).dropDuplicates(["__full"])
    # Revisits that resolve to nothing have no key to meet by: they are dealt out by their own id.
    revisits = revisits.withColumn("__alone", F.when(F.col("resolved_id").isNull(), F.col("record_id")))
    full_ones = full_ones.withColumn("__none", F.lit(None).cast(records.schema["record_id"].dataType))
    return merged(revisits.join(full_ones, F.col("resolved_id").eqNullSafe(F.col("__full")) & F.col("__alone").eqNullSafe(F.col("__none")), "left"))


def merged(both: DataFrame) -> DataFrame:
    """status and merged headers of revisits beside their responses."""
    old, new = F.col("__stored"), F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    said = [(F.element_at(old, h), F.element_at(new, h)) for h in ("etag", "last-modified")] + [(F.col("__digest"), F.col("digest"))]
    agree = F.lit(True)
    shared = F.lit(False)
    for a, b in said:
        agree = agree & F.coalesce(a == b, F.lit(True))
        shared = shared | (a.isNotNull() & b.isNotNull())
    status = F.when(F.col("__full").isNull(), "missing").when(agree & shared, "resolved").otherwise("mismatch")
    allowed = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(allowed, k))
    out = both.withColumn("status", status).withColumn("headers", F.when(F.col("status") == "resolved", F.map_concat(kept, allowed)))
    return out.select("record_id", "canonical_url", "at", "status", "resolved_id", F.when(F.col("status") == "resolved", F.col("__digest")).alias("digest"), "headers")


def records_of(pages: DataFrame) -> DataFrame:
    """The records of a crawl of pages: each page is a full response at time 10 * page_id, and is revisited later.

    The revisit comes 10 * (page_id mod 7) * 1000 + 5 after, by which time another capture of the same
    canonical URL may lie between; it carries the validators of its own page's response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    etag = F.concat(F.lit('"'), F.substring(F.md5(html.cast("binary")), 1, 16), F.lit('"'))
    at, later = F.col("page_id") * 10, F.col("page_id") * 10 + (F.col("page_id") % 7) * 10_000 + 5
    base = pages.select("page_id", "url", at.alias("at"), later.alias("later"), etag.alias("etag"), F.octet_length(html).cast("string").alias("size"), F.sha1(html.cast("binary")).alias("sha1"))
    pairs = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    response = F.struct((F.col("page_id") * 2).alias("record_id"), F.col("at").alias("at"), F.lit("response").alias("kind"), pairs("content-type", F.lit("text/html"), "content-length", F.col("size"), "etag", F.col("etag"), "date", F.col("at").cast("string")).alias("headers"), F.col("sha1").alias("digest"))
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.col("later").alias("at"), F.lit("revisit").alias("kind"), pairs("content-length", F.lit("0"), "etag", F.col("etag"), "date", F.col("later").cast("string"), "cache-control", F.lit("max-age=60")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return base.select("url", F.inline(F.array(response, revisit)))


def digest(pages: DataFrame) -> DataFrame:
    """The revisits of a crawl of pages. Null pages, URLs and texts go as resolved() says."""
    out = resolved(records_of(pages))
    said = F.array_join(F.transform(F.sort_array(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return out.select((F.floor(F.col("record_id") / 2)).cast("long").alias("page_id"), "record_id", "canonical_url", "status", "resolved_id", "digest", said.alias("headers"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a crawl of all pages, resolved."""
    return digest(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, page_id * 10 AS at_full, page_id * 10 + (page_id % 7) * 10000 + 5 AS at_later,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS kept FROM p
), u AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM q
), j AS (
  SELECT r.page_id, r.canonical_url, r.etag AS r_etag, r.at_later, f.page_id AS f_id, f.etag AS f_etag, f.digest, f.size
  FROM u r ASOF LEFT JOIN u f ON r.canonical_url = f.canonical_url AND r.at_later >= f.at_full
)
SELECT page_id, page_id * 2 + 1 AS record_id, canonical_url, CASE WHEN f_id IS NULL THEN 'missing' WHEN r_etag = f_etag THEN 'resolved' ELSE 'mismatch' END AS status, f_id * 2 AS resolved_id,
  CASE WHEN r_etag = f_etag THEN digest END AS digest,
  CASE WHEN r_etag = f_etag THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=' || at_later || ';etag=' || r_etag END AS headers
FROM j"""
