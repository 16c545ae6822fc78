"""Operator 4: not-modified revisits resolved to the latest earlier full response of their URL.

An as-of join that no hot URL can unbalance. Rows are first reduced to one per (URL, second),
by an aggregation that combines before the shuffle; those are put into time buckets of
``bucket`` seconds, so a window over (URL, bucket) has at most ``bucket`` rows. The latest
response of each bucket is carried over to later buckets by a second window over
(URL), which has a row per bucket. Revisits find the answer for their URL and second,
and the response's own record, by equi-joins that adaptive execution can split.

A revisit is resolved when at least one validator that both sides have (entity tag by weak
comparison, modification date, payload digest) is equal and none differs. Its headers are the
response's with those of the revisit put over them that a not-modified answer may
update. Payloads are not moved; the result refers to the response's record.

Defined results: equal seconds are not earlier; of several responses in one second the one
with the largest record id counts, and of several with one record id the one with the
largest content (validators, then headers); a null or empty url, or a null time, has no earlier
response; a capture that doesn't say whether it is a revisit (null) counts as a response; a revisit's null record id
stays null, and a response without a record id isn't one, as nothing could refer to it: the latest with an id
before it answers; repeated rows are resolved alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update (fixed values, RFC 9110 section 15.4.5 and RFC 9111 section 4.3.4).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track visitors (fixed values).
TRACKING = ("fbclid", "gclid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
BUCKET = 3600

ANSWER = ("etag", "last_modified", "payload_digest", "headers")
#: The columns of captures that are read.
CAPTURES = "record_id long, url string, captured_at long, is_revisit boolean, etag string, last_modified string, payload_digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without a final slash, other parameters sorted.

    Scheme and fragment are left out; null and empty urls are null.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))
    return F.when(whole != "", whole)


def latest_earlier(captures: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each (canonical, captured_at) the id of the latest response before it, where there is one."""
    known = captures.where("canonical is not null and captured_at is not null")
    # One row for each URL and second.
    seconds = known.groupBy("canonical", "captured_at").agg(F.max(F.when(~F.col("is_revisit"), F.col("record_id"))).alias("response_id"), F.max("is_revisit").alias("asked"))
    seconds = seconds.withColumn("bucket", F.floor(F.col("captured_at") / bucket))
    response = F.when(F.col("response_id").isNotNull(), F.struct("captured_at", "response_id"))
    within = Window.partitionBy("canonical", "bucket").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("canonical", "bucket")
    rows = seconds.withColumn("response", response).withColumn("before", F.last("response", ignorenulls=True).over(within)).withColumn("newest", F.max("response").over(whole)).withColumn("nth", F.row_number().over(whole.orderBy("captured_at")))
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where("nth = 1").select("canonical", "bucket", F.last("newest", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    found = rows.where("asked").join(carried, ["canonical", "bucket"], "left").select("canonical", "captured_at", F.coalesce("before", "carried").getField("response_id").alias("response_id"))
    return found.where("response_id is not null")


def _headers(headers: Column) -> Column:
    """Names in lower case; of names that differ in case alone the last in order counts."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(response: Column, revisit: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    own, new = _headers(response), F.map_filter(_headers(revisit), lambda k, v: k.isin(*permitted))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve_revisits(captures: DataFrame, bucket: int = BUCKET, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """record_id, canonical, response_id, outcome, headers and payload_digest of every revisit."""
    rows = captures.select("record_id", "captured_at", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "etag", "last_modified", "payload_digest", "headers", canonical_url(F.col("url")).alias("canonical"))
    asked = rows.where("is_revisit").join(latest_earlier(rows, bucket), ["canonical", "captured_at"], "left")
    answers = rows.where("not is_revisit and record_id is not null").select(F.col("record_id").alias("response_id"), F.struct(*[F.col(c).alias(f"their_{c}") for c in ANSWER]).alias("answer"), F.struct(*ANSWER[:3], F.array_sort(F.map_entries("headers"))).alias("order"))
    answers = answers.groupBy("response_id").agg(F.max_by("answer", "order").alias("answer")).select("response_id", "answer.*")
    # Revisits without an answer would all meet at the null key; a salt deals them out. Zero
    # is written so that the optimiser does not take it for a constant and the key away.
    asked = asked.withColumn("salt", F.when(F.col("response_id").isNull(), F.pmod(F.xxhash64("record_id", "captured_at"), F.lit(4096))).otherwise(F.lit(0)))
    both = asked.join(answers.withColumn("salt", F.pmod("response_id", F.lit(1))), ["response_id", "salt"], "left")

    def weak(tag: str) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    tag = weak("etag") == weak("their_etag")
    date, digest = F.col("last_modified") == F.col("their_last_modified"), F.col("payload_digest") == F.col("their_payload_digest")
    outcome = F.when(F.col("response_id").isNull(), "no earlier response").when(~tag, "other entity tag").when(~date, "other modification date").when(~digest, "other payload").when(F.coalesce(tag, date, digest).isNull(), "no common validator").otherwise("resolved")
    both = both.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return both.select("record_id", "canonical", F.when(resolved, F.col("response_id")).alias("response_id"), "outcome", F.when(resolved, merged_headers(F.col("their_headers"), F.col("headers"), permitted)).alias("headers"), F.when(resolved, F.col("their_payload_digest")).alias("payload_digest"))
