"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed; its body is that of the latest earlier full response for the same canonical URL.
resolve() finds it with an as-of join, compares validators (entity tag, else last-modified time), and merges headers: a 304
answer may replace only the fields that such an answer carries; all others, and the body, come from the full response.

The as-of join carries the latest response forward within (URL, span of time), and across spans through one row a span, so a URL with very
many captures is many small groups. Ties in time go to the record with the larger id; a response at the very time of a revisit is not
earlier. Null URLs, unknown validators and revisits without an earlier response are kept, with a status that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a not-modified answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: Column) -> Column:
    """Scheme, `www.`, `m.`, default port, fragment, tracking parameters and a final slash go; host in lower case; parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^(?:www\\.|m\\.)", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve(records: DataFrame, span: int = 3600) -> DataFrame:
    """Revisits of records(id, uri, time long, kind 'response' | 'revisit', headers map, digest) with what they stand for.

    Result: id, url, time, response_id, response_time, status (`resolved`, `mismatch`, `orphan`), headers, digest. Validators: a
    revisit's etag must equal the response's; without one on either side last-modified decides; without any, the digest;
    with nothing to compare, the latest response stands. `span` is the length of a stretch of time.
    """
    r = records.select("id", canonical(F.col("uri")).alias("url"), "time", "kind", "headers", "digest").withColumn("stretch", F.floor(F.col("time") / span))
    full = F.col("kind") == "response"
    what = F.when(full, F.struct("id", "time", "headers", "digest"))
    # before its own stretch: the last response of each stretch, carried forward over one row a stretch
    last = r.where("url is not null").groupBy("url", "stretch").agg(F.max_by(what, F.when(full, F.struct("time", "id"))).alias("end"))
    ahead = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url", "stretch", F.last("end", ignorenulls=True).over(ahead).alias("carried"))
    inside = Window.partitionBy("url", "stretch").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("own", F.max_by(what, F.when(full, F.struct("time", "id"))).over(inside)).where("kind = 'revisit'")
    both = seen.join(carried, ["url", "stretch"], "left").withColumn("f", F.when(F.col("url").isNotNull(), F.coalesce("own", "carried")))
    mine, theirs = F.col("headers"), F.col("f.headers")

    def field(m: Column, name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    def agree(name: str) -> Column:
        return field(mine, name) == field(theirs, name)

    same = F.coalesce(agree("etag"), agree("last-modified"), F.col("digest") == F.col("f.digest"), F.lit(True))
    status = F.when(F.col("f").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    allowed = F.map_filter(F.coalesce(mine, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    ok = F.col("status") == "resolved"
    out = both.withColumn("status", status)
    return out.select("id", "url", "time", F.col("f.id").alias("response_id"), F.col("f.time").alias("response_time"), "status", F.when(ok, merged).otherwise(mine).alias("headers"), F.when(ok, F.col("f.digest")).otherwise(F.col("digest")).alias("digest"))


def captures(pages: DataFrame) -> DataFrame:
    """Records from the pages table: every page is a full response at time 2 * page_id and is asked for again later.

    The second capture is a revisit with the page's entity tag and a new date, up to 10,000 steps later, so that captures of other
    pages with the same canonical URL come between.
    """
    again = 2 * F.col("page_id") + 1 + 2 * (F.col("page_id") * 7919 % 5000)
    tag = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), (2 * F.col("page_id")).alias("time"), tag.alias("digest"))
    day = lambda x: F.concat(F.lit("t"), x.cast("string"))
    one = base.select("id", "uri", "time", F.lit("response").alias("kind"), F.create_map(F.lit("etag"), F.col("digest"), F.lit("date"), day(F.col("time")), F.lit("content-type"), F.lit("text/html")).alias("headers"), "digest")
    two = base.withColumnRenamed("id", "page_id").withColumn("time", again).select(F.col("page_id").alias("id"), "uri", "time", F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), F.col("digest"), F.lit("date"), day(F.col("time")), F.lit("content-type"), F.lit("none")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return one.unionByName(two)
