"""URL filters by a temporal list join, in DataFrame expressions only.

List entries are dated: an entry adds or removes a key (a host, a domain that
covers its subdomains, or a host with a first path segment) under a category.
``validity`` turns the dated entries into intervals, and ``filter_captures``
finds for each capture the entries that were active when it was fetched.

An entry is active from its date (included) to the next entry of the same key,
kind and category (excluded). Of entries with the same key, kind, category and
date, "remove" wins.

The lookup is an as-of join that never expands a capture: the intervals of all
keys that concern a site (host and first path segment) are gathered once, for
distinct sites, and each capture picks the active ones from its site's array. A
hot host is a skewed join key with one small row on the other side, which
adaptive execution splits.

Defined cases: a null or unparsable url, or a null fetch time, matches nothing
and is kept; repeated captures each get a row; hosts are compared in lower case
without port, user and trailing dot; empty tables work; extra columns of either
table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host of an http(s) url in lower case; null if there is none."""
    host = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """The first segment of the path; empty if there is none."""
    return F.regexp_extract(url, r"^(?i)https?://[^/?#]+/([^/?#]+)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (kind, key, category, valid_from, valid_to) of dated entries.

    ``entries`` has kind ("host", "domain" or "path"), key, category, action
    ("add" or "remove") and listed_at. valid_to is null while an entry stands.
    """
    one = entries.groupBy("kind", "key", "category", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "key", "category").orderBy("listed_at")
    return (
        one.withColumn("valid_to", F.lead("listed_at").over(w))
        .where((F.col("action") == "add") & F.col("key").isNotNull() & F.col("listed_at").isNotNull())
        .select("kind", "key", "category", F.col("listed_at").alias("valid_from"), "valid_to")
    )


def keys_of(host: Column, segment: Column) -> Column:
    """All (kind, key) that concern a site."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.lit("domain").alias("kind"),
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"),
        ),
    )
    own = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("key")),
        F.struct(F.lit("path").alias("kind"), F.concat_ws("/", host, segment).alias("key")),
    )
    return F.concat(own, domains)


def filter_captures(
    captures: DataFrame,
    intervals: DataFrame,
    capture_id: str = "page_id",
    url: str = "url",
    fetched_at: str = "fetched_at",
) -> DataFrame:
    """One row for each capture: capture_id, url, fetched_at, host, n_active, categories, blocked."""
    seen = captures.select(
        F.col(capture_id).alias("capture_id"),
        F.col(url).alias("url"),
        F.col(fetched_at).alias("fetched_at"),
        host_of(F.col(url)).alias("host"),
        segment_of(F.col(url)).alias("segment"),
    )
    # only intervals that some capture can be in: a site's list doesn't grow with the years before
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = seen.agg(F.min(micros("fetched_at")), F.max(micros("fetched_at"))).first()
    intervals = intervals.where((micros("valid_from") <= F.lit(last).cast("long")) & (F.col("valid_to").isNull() | (micros("valid_to") > F.lit(first).cast("long"))))
    sites = seen.where(F.col("host").isNotNull()).select("host", "segment").distinct()
    per_site = (
        sites.select("host", "segment", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("k"))
        .select("host", "segment", "k.kind", "k.key")
        .join(intervals, ["kind", "key"])
        .groupBy("host", "segment")
        .agg(F.collect_list(F.struct("category", "valid_from", "valid_to")).alias("listed"))
    )
    active = F.filter(
        F.coalesce(F.col("listed"), F.array().cast("array<struct<category:string,valid_from:timestamp,valid_to:timestamp>>")),
        lambda x: (x["valid_from"] <= F.col("fetched_at"))
        & (x["valid_to"].isNull() | (F.col("fetched_at") < x["valid_to"])),
    )
    # a capture without a host gets a key of its own, so that they don't all meet in one task
    site = F.coalesce("host", F.concat(F.lit("\0"), F.xxhash64("capture_id", "url", "fetched_at").cast("string")))
    per_site = per_site.select(F.col("host").alias("site_"), F.col("segment").alias("part"), "listed")
    out = seen.withColumn("site", site).join(per_site, (F.col("site") == F.col("site_")) & (F.col("segment") == F.col("part")), "left").withColumn("active", active)
    return out.select(
        "capture_id",
        "url",
        "fetched_at",
        "host",
        F.size("active").cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda x: x["category"]))), ",").alias("categories"),
        (F.size("active") > 0).alias("blocked"),
    )
