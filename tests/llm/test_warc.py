"""Header names in any case, false dates, clashing columns and the as-of join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from melodyspark.llm import warc

RECORDS = "record_id long, kind string, url string, t long, etag string, last_modified long, headers map<string,string>, payload_sha256 string"


def test_header_names_are_compared_without_case(spark):
    stored = {"Content-Type": "text/html", "Date": "d0", "ETag": "t", "Server": "s", "vary": "a", "VARY": "b", "x-null": None}
    answer = {"date": "d1", "Expires": "e1", "expires": "e2", "Content-Length": "0", "Vary": "c", "SERVER": "no", "etag": None}
    rows = [(1, "response", "http://a.org/", 1, "t", None, stored, "p"), (2, "revisit", "http://a.org/", 2, "t", None, answer, None), (3, "revisit", "http://a.org/", 3, "t", None, {}, None)]
    got = {r["record_id"]: r["headers"].split("\n") for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got[2] == ["Content-Type: text/html", "Date: d1", "ETag: t", "Expires: e1", "Server: s", "VARY: c"]
    assert got[3] == ["Content-Type: text/html", "Date: d0", "ETag: t", "Server: s", "VARY: b"]


@pytest.mark.parametrize("bucket_rows", [7, 50, 10**6])
def test_one_false_date_and_a_hot_url(spark, bucket_rows):
    rnd = random.Random(1)
    rows = [(n, rnd.choice(["response", "revisit"]), f"http://a.org/{0 if rnd.random() < 0.6 else n % 5}", rnd.randrange(1000), "t", None, None, f"p{n}") for n in range(300)]
    rows += [(1000, "response", "http://a.org/0", 10**12, "t", None, None, "far"), (1001, "response", "http://a.org/0", -(10**12), "t", None, None, "early")]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], RECORDS + ", bucket string, _t double, row long").repartition(3)
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(df, bucket_rows=bucket_rows).collect()}
    for i, kind, url, t, *_ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[2] == url and r[3] < t]
            assert got[i] == (max(earlier)[1] if earlier else None)


def test_buckets_hold_about_equally_many(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("t")).unionByName(spark.createDataFrame([(10**15,)], "t long"))
    sizes = [r["count"] for r in warc.time_buckets(df, 10).groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 200
