"""Revisits: every validator, repeated record ids, popular responses, records without a URL."""

from collections import Counter

from pyspark.sql import functions as F

from hyperpanel.llm import warc

SCHEMA = "record_id long, url string, s long, type string, etag string, last_modified string, digest string, headers map<string,string>, payload string"


def resolved(spark, rows):
    return warc.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("date", F.timestamp_seconds("s")))


def test_validators_by_rank(spark):
    url = "http://a.org/x"
    rows = [(1, url, 10, "response", None, "m1", "d1", None, "one")]
    rows += [(2, url, 20, "revisit", '"e"', "m1", "d2", None, None), (3, url, 21, "revisit", None, "m2", "d1", None, None), (4, url, 22, "revisit", None, None, "d1", None, None), (5, url, 23, "revisit", '"e"', None, None, None, None)]
    got = {r.record_id: (r.status, r.base_id, r.payload) for r in resolved(spark, rows).collect()}
    assert got == {2: ("resolved", 1, "one"), 3: ("changed", None, None), 4: ("resolved", 1, "one"), 5: ("no_validator", None, None)}


def test_repeated_record_ids(spark):
    url = "http://a.org/x"
    rows = [(1, url, 10, "response", '"e"', None, None, {"A": "1"}, "b"), (1, url, 10, "response", '"e"', None, None, {"A": "2"}, "a"), (None, "http://b.org", 1, "response", '"e"', None, None, None, "c")]
    rows += [(7, url, 20, "revisit", '"e"', None, None, {"Expires": "0"}, None), (7, url, 21, "revisit", 'W/"e"', None, None, {"Expires": "9"}, None), (7, url, 22, "revisit", '"f"', None, None, None, None), (8, "http://b.org", 5, "revisit", '"e"', None, None, None, None)]
    got = sorted((r.record_id, r.status, r.payload, (r.headers or {}).get("Expires", "")) for r in resolved(spark, rows).collect() if r.record_id == 7)
    assert got == [(7, "changed", None, ""), (7, "resolved", "a", "0"), (7, "resolved", "a", "9")]


def test_popular_response_and_records_without_key(spark):
    rows = [(1, "http://a.org/x", 0, "response", '"e"', None, None, {"A": "1"}, "body"), (2, "http://a.org/y", 0, "response", '"g"', None, None, None, "other")]
    rows += [(10 + k, "http://a.org/x", 10 + k, "revisit", '"e"', None, None, None, None) for k in range(400)]
    rows += [(1000 + k, None, 10, "revisit", '"e"', None, None, None, None) for k in range(300)] + [(5000, "http://a.org/y", 9, "revisit", '"g"', None, None, None, None)]
    got = resolved(spark, rows).collect()
    assert Counter((r.status, r.base_id, r.payload) for r in got) == {("resolved", 1, "body"): 400, ("no_key", None, None): 300, ("resolved", 2, "other"): 1}
