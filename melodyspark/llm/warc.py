"""Not-modified revisits resolved to the responses they stand for.

A revisit record says that a URL was fetched and had not changed. It is joined, as of its time, to
the latest earlier full response of the same canonical URL; if validators agree (ETag, else
Last-Modified) it takes that response's payload and its headers, with those headers replaced that
a 304 answer may update.

The as-of join is bucketed: inside a bucket of time a window finds the latest response, and one
row per URL and bucket carries the latest response of all buckets before. Buckets end at quantiles
of all times, so each holds about ``bucket_rows`` captures whatever single dates say, and a URL with
a third of all captures is spread over them.

Header names are compared without case. A replaced header keeps the stored name's spelling; of
names in one record that differ only in case, the first in sorted order counts.

Defined results: captures without a URL or a time are not resolved (status no-response). Of
responses of one time, the one of the larger record_id is later; of one record_id, that whose
payload and validators have the larger hash. A response of the revisit's own time is not earlier.
Records that repeat a record_id are records of their own: every revisit record gives one row. Without
a validator on both sides the status is no-validator. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.scratch import materialize

#: headers that a 304 answer may update in a stored response (fixed values)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: query parameters that do not change the page, as a pattern
TRACKING = r"utm_[a-z]+|ref"


def canonical_url(url: Column) -> Column:
    """Without scheme, www. or m., tracking parameters, fragment, and trailing slash or .html; host in lower case."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, rf"([?&])({TRACKING})=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"\?&+", "?"), r"[?&]+$", "")
    u = F.regexp_replace(u, r"^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    rest = F.substr(u, F.length(host) + 1)
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(rest, r"(/|\.html)$", ""))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records from ``pages``: a response of every page and, later, a revisit that claims it unchanged.

    Header names are spelt as servers spell them. Times and validators follow from page_id: some revisits have no ETag, some carry one that no
    response has, some a Last-Modified that has moved on.
    """
    p = F.col("page_id")
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    text = lambda c: c.cast("string")
    response = pages.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), "url", p.alias("t"), tag.alias("etag"), (10 * p).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text(p), F.lit("ETag"), tag, F.lit("Server"), F.lit("origin")).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_sha256"),
    )
    etag = F.when(p % 5 == 0, F.lit(None)).when(p % 7 == 0, F.lit("changed")).otherwise(F.concat(F.lit("W/"), tag))
    later = p + 1 + p % 97
    revisit = pages.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("t"), etag.alias("etag"),
        F.when(p % 11 == 0, 10 * p + 1).otherwise(10 * p).alias("last_modified"),
        F.create_map(F.lit("date"), text(later), F.lit("Expires"), text(later + 60), F.lit("Content-Length"), F.lit("0"), F.lit("x-cache"), F.lit("hit")).alias("headers"),
        F.lit(None).cast("string").alias("payload_sha256"),
    )
    return response.unionByName(revisit)


def time_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with column bucket: in order of t, about equally many rows in each; equal times share one."""
    timed = rows.withColumn("_t", F.col("t").cast("double"))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(timed.approxQuantile("_t", shares, 1 / (4 * buckets)))) if shares else []
    if not cuts:
        return rows.withColumn("bucket", F.lit(0.0))
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_t", outputCol="bucket", handleInvalid="keep")
    return split.transform(timed).drop("_t")


def merged_headers(stored: Column, update: Column) -> Column:
    """Sorted "name: value" lines of the stored headers, with those that a 304 answer may update replaced or added."""
    none = F.create_map().cast("map<string,string>")
    entries = lambda m: F.array_sort(F.filter(F.map_entries(F.coalesce(m, none)), lambda e: e["value"].isNotNull()))
    # one entry a name: the first of those that differ only in case
    names = lambda es: F.transform(es, lambda e: F.lower(e["key"]))
    once = lambda es: F.filter(es, lambda e, i: F.array_position(names(es), F.lower(e["key"])) == i + 1)
    old = once(entries(stored))
    new = once(F.filter(entries(update), lambda e: F.lower(e["key"]).isin(*PERMITTED)))
    now = lambda e: F.get(F.filter(new, lambda u: F.lower(u["key"]) == F.lower(e["key"])), F.lit(0))["value"]
    line = lambda name, value: F.concat(name, F.lit(": "), value)
    kept = F.transform(old, lambda e: line(e["key"], F.coalesce(now(e), e["value"])))
    added = F.transform(F.filter(new, lambda u: ~F.array_contains(names(old), F.lower(u["key"]))), lambda u: line(u["key"], u["value"]))
    return F.array_join(F.array_sort(F.concat(kept, added)), "\n")


def resolve_revisits(records: DataFrame, bucket_rows: int = 500_000) -> DataFrame:
    """Per revisit: record_id, canonical, response_id, status, payload_sha256, headers (sorted "name: value" lines)."""
    fields = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "t", "etag", "last_modified", "headers", "payload_sha256")
    tie = F.xxhash64(F.coalesce("payload_sha256", F.lit("")), F.coalesce("etag", F.lit("")), F.coalesce(F.col("last_modified").cast("string"), F.lit("")))
    rows = materialize(fields.withColumn("id", F.struct("record_id", tie.alias("tie"), F.monotonically_increasing_id().alias("row"))), "captures")
    known = F.col("canonical").isNotNull() & F.col("t").isNotNull()
    full = (F.col("kind") == "response") & known
    keyed = time_buckets(rows.where(known), max(1, -(-rows.count() // bucket_rows)))
    # what is sorted in windows is ids and times; headers are joined afterwards
    narrow = keyed.select("canonical", "bucket", "t", "id", full.cast("int").alias("is_response"), F.when(full, F.struct("t", "id")).alias("seen"))
    order = Window.partitionBy("canonical", "bucket").orderBy("t", "is_response", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = narrow.withColumn("found", F.last("seen", ignorenulls=True).over(order)).where(F.col("is_response") == 0)
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = narrow.groupBy("canonical", "bucket").agg(F.max("seen").alias("seen")).select("canonical", "bucket", F.last("seen", ignorenulls=True).over(before).alias("carried"))
    matched = inside.join(carried, ["canonical", "bucket"], "left").select(F.col("id.row").alias("row"), F.coalesce("found", "carried")["id"]["row"].alias("response_row"))
    stored = rows.where(full).select(F.col("id.row").alias("response_row"), F.col("record_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers"), F.col("payload_sha256").alias("r_payload"))
    asked = rows.where(F.col("kind") == "revisit").withColumn("row", F.col("id.row")).drop("payload_sha256", "kind", "id")
    out = asked.join(matched, "row", "left").join(stored, "response_row", "left")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("r_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull()
    same = F.when(tags, weak("etag") == weak("r_etag")).when(dates, F.col("last_modified") == F.col("r_modified"))
    status = F.when(F.col("response_row").isNull(), "no-response").when(same.isNull(), "no-validator").when(same, "resolved").otherwise("validator-mismatch")
    good = status == "resolved"
    return out.select("record_id", "canonical", "response_id", status.alias("status"), F.when(good, F.col("r_payload")).alias("payload_sha256"), F.when(good, merged_headers(F.col("r_headers"), F.col("headers"))).alias("headers"))
