"""Not-modified revisits of a web archive, resolved against earlier full responses.

A revisit record (HTTP status 304) has no body. It is resolved by an as-of join: the latest full response (status 200) of
the same canonical address at an earlier time. The validators are then checked: the revisit's ETag (compared weakly) has to
match that of the response, or, without an ETag on both sides, its Last-Modified must not be later. A valid revisit takes the
response's payload and headers, in which those that a 304 may update replace the stored ones. Where neither validator is
on both sides, nothing vouches for the response, so nothing is taken from it.

The as-of join is a pair of windows over range partitions of (address, time, kind, record): the last response of an address inside
a partition comes from a window over that part of the address, that of earlier partitions from a window over one row for each part.
So an address with a third of all records is spread over a third of the partitions, whatever its times, and no record is collected or dropped.
Headers and payload of a response then go to the parts that refer to it, once to each, and meet their revisits there.

Records: record_id, url, at (long, seconds), status, headers (array of name, value), payload columns of any kind.

Defined cases: null urls or times are never resolved, and their responses never used; of equal times a response counts as
earlier than a revisit, and of responses the larger record_id as later, then the larger hash of url and headers; repeated
records stay and each is resolved by itself, null ids too; null headers are none; an empty table gives none; payloads of any
length stay out of sorts and windows; HTTP dates are UTC whatever the session's time zone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Headers of a 304 response that update the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change a page.
IGNORED = r"(?:utm_[a-z]+|gclid|fbclid|ref|sessionid)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """An address without scheme, user, "www.", default port, fragment, ignored parameters and final slash, its host in lower case."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_replace(F.regexp_extract(url, parts, 3), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{IGNORED}(?:=|$)")))
    return F.when(url.isNotNull() & (host != ""), F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """Headers of a stored response, with the permitted ones of a revisit in place of its own; sorted by name."""
    permitted = F.array(*[F.lit(x) for x in PERMITTED])
    low = lambda hs: F.transform(hs, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    updates = F.filter(low(fresh), lambda h: F.array_contains(permitted, h["name"]))
    names = F.transform(updates, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(low(stored), lambda h: ~F.array_contains(names, h["name"])), updates))


def weak(tag: Column) -> Column:
    """An ETag without the mark of weak ones."""
    return F.regexp_replace(tag, r"^\s*W/", "")


def http_time(value: Column) -> Column:
    """Seconds of an HTTP date, which is in UTC; null if it isn't one."""
    day = F.regexp_extract(value, r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z")))


def latest_response(records: DataFrame) -> DataFrame:
    """_row, part and source (the _row of the latest earlier full response of the key) of every revisit.

    ``records``: _row (different for each), key, at, status, record_id, tie. ``part`` is the range partition that a revisit came to.
    """
    full = F.col("status") == 200
    order = ["at", F.when(full, 0).otherwise(1), "record_id", "tie", "_row"]
    rows = records.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("status").isin(200, 304))
    rows = written(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "warc_parts")
    here = F.when(full, F.col("_row"))
    inside = Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.last(here, ignorenulls=True).over(inside)).where("status = 304")
    # an address has one row for each of its parts; a part takes the end of the last part before it with a response
    place = F.when(full, F.struct("at", F.lit(0), "record_id", "tie", "_row"))
    ends = rows.groupBy("key", "part").agg(F.max(place)["_row"].alias("end"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("key", "part", "carried")
    return own.join(carry, ["key", "part"]).select("_row", "part", F.coalesce("own", "carried").alias("source"))


def resolve(records: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Every record: record_id, key, at, status, source (record_id of a resolved revisit's response), verdict, headers as resolved, and ``payload``.

    verdict: "response" (status 200), "other" (neither 200 nor 304), and of revisits "resolved", "no earlier response",
    "validators differ" or "no validators" (none that both sides have). A response has its own payload, a resolved revisit
    that of its source, other revisits none.
    """
    kept = ["record_id", "url", "at", "status", F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), canonical(F.col("url")).alias("key"), *payload]
    log = written(records.select(*kept).withColumns({"_row": F.monotonically_increasing_id(), "tie": F.xxhash64("url", "headers")}), "warc")
    revisits = written(latest_response(log.select("_row", "record_id", "key", "at", "status", "tie")).where("source IS NOT NULL"), "warc_revisits")
    stored = log.select(F.col("_row").alias("source"), F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), *[F.col(c).alias(f"stored_{c}") for c in payload])
    # once to each part that refers to it, so that the revisits of a frequent source meet it in as many tasks
    carried = revisits.select("source", "part").distinct().join(stored, "source")
    found = log.where("status = 304").drop(*payload).join(revisits.join(carried, ["source", "part"]), "_row", "left")
    tags = weak(header(F.col("headers"), "etag")), weak(header(F.col("stored"), "etag"))
    dates = http_time(header(F.col("headers"), "last-modified")), http_time(header(F.col("stored"), "last-modified"))
    valid = F.coalesce(tags[0] == tags[1], dates[0] <= dates[1])  # null where no validator is on both sides
    verdict = F.when(F.col("source").isNull(), "no earlier response").when(valid.isNull(), "no validators").when(valid, "resolved").otherwise("validators differ")
    found = found.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    common = ["record_id", "key", "at", "status"]
    revisited = found.select(*common, F.when(ok, F.col("source_id")).alias("source"), "verdict", F.when(ok, merged(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), *[F.when(ok, F.col(f"stored_{c}")).alias(c) for c in payload])
    kind = F.when(F.col("status") == 200, "response").otherwise("other")
    rest = log.where("NOT status <=> 304").select(*common, F.lit(None).cast(log.schema["record_id"].dataType).alias("source"), kind.alias("verdict"), "headers", *payload)
    return revisited.unionByName(rest)


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl log with two visits to each page of ``pages`` (page_id, url, html), as records.

    The first visit is a full response, with ETag and Last-Modified by its page_id. The second, at a later time, is a
    not-modified response to the address with another scheme or fragment; one in five has the ETag of another page.
    """
    page, day = F.col("page_id"), 86_400
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = lambda s: F.concat_ws(":", two(F.floor(F.pmod(s, F.lit(day)) / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))
    date = lambda s: F.concat_ws(" ", F.date_format(F.date_from_unix_date(F.floor(s / day).cast("int")), "dd MMM yyyy"), clock(s))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    first = pages.select(
        (2 * page).alias("record_id"), "url", (page * 60).alias("at"), F.lit(200).alias("status"),
        F.array(pair("ETag", tag), pair("Last-Modified", date(page * 60 - day)), pair("Content-Type", F.lit("text/html")), pair("Cache-Control", F.lit("max-age=60"))).cast(HEADERS).alias("headers"), "html",
    )
    other = F.when(page % 5 == 0, F.lit('"0"')).when(page % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    with_tag = F.array(pair("ETag", other), pair("Cache-Control", F.lit("max-age=90")), pair("Content-Type", F.lit("text/plain")))
    without = F.array(pair("Last-Modified", date(page * 60 - day)), pair("Cache-Control", F.lit("max-age=90")))
    second = pages.select(
        (2 * page + 1).alias("record_id"), F.regexp_replace("url", r"^http:", "https:").alias("url"), (page * 60 + day).alias("at"), F.lit(304).alias("status"),
        F.when(page % 3 == 0, without).otherwise(with_tag).cast(HEADERS).alias("headers"), F.lit(None).cast("string").alias("html"),
    )
    return first.unionByName(second)
