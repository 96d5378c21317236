"""Not-modified revisits of a web archive, resolved to the full response they confirm.

An as-of join by canonical URL finds, for every revisit, the latest earlier full
response. Captures are range-partitioned by URL, time and record, so a hot URL is
cut into slices of the size of a partition: inside a slice a window carries the last response forward,
and between slices only the last response of each slice is carried (a URL has as
many of these as there are partitions, at most). Validators are compared (entity
tags weakly, then dates), and the headers that a not-modified answer may update
are merged into those of the stored response.

Defined results: outcome is `confirmed`, `changed` (validators differ),
`unchecked` (no validator on both sides) or `missing` (no earlier response); a
null URL or time never matches; captures at equal times come in the order of
record_id; of repeated responses any one is taken, as they are equal; repeated revisits each get a
row; a long URL is one key like any other; an empty table gives an empty result; other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hash_of

#: Headers that describe the body or one connection; a not-modified answer does not update them.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameters, query sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^utm_")))
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, with those that the update may change taken from it; sorted by name."""
    low = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    new = F.filter(low(update), lambda e: ~e["key"].isin(NOT_MERGED))
    old = F.filter(low(stored), lambda e: ~F.exists(new, lambda n: n["key"] == e["key"]))
    return F.array_sort(F.concat(old, new))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit (status 304) of records(record_id, url, ts, status, etag,
    last_modified, headers) with: canonical_url, response_id, outcome, merged headers."""
    rows = records.select("record_id", "ts", "status", "etag", "last_modified", "headers", canonical(records["url"]).alias("canonical_url"))
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    known = rows.filter("canonical_url is not null and ts is not null and status in (200, 304)")
    known = cut(known.repartitionByRange("canonical_url", "ts", "record_id").withColumn("slice", F.spark_partition_id()), "records").withColumn("full", full)
    last = known.filter("full is not null").groupBy("canonical_url", "slice").agg(F.max(F.struct("full.ts", "full.record_id", "full.etag", "full.last_modified")).alias("f"), F.max_by("full.headers", F.struct("full.ts", "full.record_id")).alias("h"))
    revisited = known.filter("status = 304").select("canonical_url", "slice").distinct()
    ends = last.select("canonical_url", "slice", F.struct("f.ts", "f.record_id", "f.etag", "f.last_modified", F.col("h").alias("headers")).alias("end"))
    steps = ends.join(revisited, ["canonical_url", "slice"], "full")
    before = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    found = known.withColumn("near", F.last("full", ignorenulls=True).over(inside)).filter("status = 304").drop("full")
    found = found.join(carried, ["canonical_url", "slice"], "left").withColumn("r", F.coalesce("near", "carried")).drop("slice", "near", "carried")
    lost = rows.filter("status = 304 and (canonical_url is null or ts is null)").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    found = found.unionByName(lost.select(found.columns))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(tag(F.col("etag")) == tag(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"))
    outcome = F.when(F.col("r").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "confirmed").otherwise("changed")
    headers = F.when(F.col("r").isNotNull() & F.coalesce(same, F.lit(True)), merged(F.col("r.headers"), F.col("headers")))
    return found.select("record_id", "canonical_url", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), outcome.alias("outcome"), headers.alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of pages: each page's full response, in the order of page_id, and a
    later revisit that carries the validators of that page. Some servers send no entity
    tag, some no date; a revisit comes after a delay that its URL decides."""
    h = F.coalesce(hash_of("url"), F.lit(0)) % 1000
    etag = F.when(h % 7 != 0, F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"')))
    modified = F.when(h % 3 != 0, F.concat(F.lit("day "), F.length("html").cast("string")))
    base = pages.select("page_id", "url", etag.alias("etag"), modified.alias("last_modified"), F.length("html").cast("string").alias("n"), h.alias("h"))
    response = base.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), "etag", "last_modified", F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), "n", F.lit("Age"), F.lit("0")).alias("headers"))
    weak = F.when(F.col("h") % 2 == 0, F.concat(F.lit("W/"), "etag")).otherwise(F.col("etag"))
    revisit = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + F.col("h") * 100).alias("ts"), F.lit(304).alias("status"), weak.alias("etag"), "last_modified", F.create_map(F.lit("content-length"), F.lit("0"), F.lit("age"), F.col("h").cast("string"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"))
    return response.unionByName(revisit)
