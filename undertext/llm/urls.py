"""URL filters by lists as they stood when a page was fetched.

A list is a log of dated entries: a domain is added to or removed from a category on a day. The log becomes
validity intervals, each from its own day up to the day of the domain's next entry in that category, and every
capture is held against the intervals that hold on its own day (an as-of join). An entry covers its domain and all
below it.

Captures are first brought down to their distinct hosts and days, so a host with a third of all captures costs no
more rows than it has days. Intervals are cut at bucket borders and joined by domain and bucket, which spreads such
a host over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertext.llm.common import table

BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """The lower-cased host of a url: no user, port or closing dot. Null where there is none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(bare != "", F.lower(bare))


def domains_above(host: Column) -> Column:
    """The host and all domains above it that have at least two labels; a single label stands for itself."""
    labels = F.split(host, r"\.")
    cut = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), cut))


def intervals(log: DataFrame) -> DataFrame:
    """(domain, category, since, until) from a log (domain, category, action add or remove, day).

    until is the day of the next entry of that domain and category, null while none follows. Of entries of one day,
    removal counts. Rows with a null, and actions of other names, say nothing and are left out.
    """
    clean = log.where("domain is not null and category is not null and day is not null and action in ('add', 'remove')")
    daily = clean.groupBy(F.lower("domain").alias("domain"), "category", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("domain", "category").orderBy("day"))
    return daily.withColumn("until", following).where("action = 'add'").select("domain", "category", F.col("day").alias("since"), "until")


def evaluated(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (all its columns, with url and fetched_day) and host, blocked, n_entries, categories, entry.

    n_entries counts the intervals that hold; categories are theirs, distinct, sorted and comma-joined (else empty);
    entry is the longest of their domains, the least of equals (else null). A null or hostless url and a null day
    are never blocked. Repeated captures are each returned; empty captures or lists give empty rows or no blocks.
    Columns of captures that are named like a result are carried as in_host and so on; other names don't matter.
    """
    results = ("host", "blocked", "n_entries", "categories", "entry")
    hosted = captures.select(F.struct("*").alias("row"), host_of(F.col("url")).alias("host"), F.col("fetched_day").alias("day"))
    asked = hosted.where("host is not null and day is not null").select("host", "day").distinct()
    asked = asked.withColumn("domain", F.explode(domains_above(F.col("host")))).withColumn("bucket", F.floor(F.col("day") / BUCKET_DAYS))
    end = F.lit(asked.agg(F.max("day")).first()[0]).cast("long") + 1  # of all that is asked
    held = intervals(log).where(F.col("since") < end)
    until = F.least(F.coalesce(F.col("until"), end), end)
    spans = held.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / BUCKET_DAYS), F.floor((until - 1) / BUCKET_DAYS)))).select("domain", "bucket", "category", "since", "until")
    valid = (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    met = asked.join(spans, ["domain", "bucket"]).where(valid)
    found = met.groupBy(F.col("host").alias("f_host"), F.col("day").alias("f_day")).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.min_by("domain", F.struct(-F.length("domain"), "domain")).alias("entry"),
    )
    own = [F.col("row").getField(c).alias(f"in_{c}" if c in results else c) for c in captures.columns]
    return hosted.join(found, (F.col("host") == F.col("f_host")) & (F.col("day") == F.col("f_day")), "left").select(
        *own, "host", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories"), "entry"
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch dates: each page gets one of 730 days by its id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(730)).alias("fetched_day"))


def log_of_hosts(pages: DataFrame) -> DataFrame:
    """Nor are there lists: a third of the domains met in the pages get entries, on days and in categories by MD5."""
    domains = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().select(F.explode(domains_above(F.col("host"))).alias("domain")).distinct()
    v = domains.withColumn("v", F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")).where("v % 3 = 0")
    category = F.element_at(F.array(F.lit("ads"), F.lit("malware"), F.lit("adult")), (F.expr("v div 3") % 3 + 1).cast("int"))
    day = F.col("v") % 365
    gone = day + 30 + F.expr("v div 9") % 200
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.lit("remove").alias("action"), gone.alias("day")),
        F.struct(F.when(F.col("v") % 2 == 0, "add").otherwise("remove").alias("action"), (gone + 60).alias("day")),
    )
    return v.select("domain", category.alias("category"), F.explode(rows).alias("e")).select("domain", "category", "e.action", "e.day")


def op8_url_filters(spark, sf_dir) -> DataFrame:
    """The whole pages table against the derived lists, as evaluated gives it; see there for nulls, repeated rows and empty tables."""
    pages = table(spark, sf_dir, "pages")
    return evaluated(dated_captures(pages), log_of_hosts(pages))


SQL = r"""
WITH hosted AS (
  SELECT page_id, url, (((page_id * 37) % 730) + 730) % 730 AS fetched_day,
    nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') AS host
  FROM pages),
above AS (
  SELECT host, unnest(CASE WHEN len(string_split(host, '.')) < 2 THEN [host]
    ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS domain
  FROM (SELECT DISTINCT host FROM hosted WHERE host IS NOT NULL)),
v AS (
  SELECT domain, v FROM (SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS v FROM (SELECT DISTINCT domain FROM above)) WHERE v % 3 = 0),
log AS (
  SELECT domain, (['ads', 'malware', 'adult'])[(v // 3) % 3 + 1] AS category, e.action AS action, e.day AS day
  FROM (SELECT domain, v, unnest([
    {'action': 'add', 'day': v % 365},
    {'action': 'remove', 'day': v % 365 + 30 + (v // 9) % 200},
    {'action': CASE WHEN v % 2 = 0 THEN 'add' ELSE 'remove' END, 'day': v % 365 + 90 + (v // 9) % 200}]) AS e FROM v)),
spans AS (
  SELECT * FROM (SELECT domain, category, action, day AS since, lead(day) OVER (PARTITION BY domain, category ORDER BY day) AS until FROM log) WHERE action = 'add'),
met AS (
  SELECT h.host, h.fetched_day, s.category, s.domain
  FROM (SELECT DISTINCT host, fetched_day FROM hosted WHERE host IS NOT NULL) h JOIN above a ON a.host = h.host
  JOIN spans s ON s.domain = a.domain AND s.since <= h.fetched_day AND (s.until IS NULL OR h.fetched_day < s.until)),
found AS (
  SELECT host, fetched_day, count(*) AS n_entries, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
    arg_min(domain, (10000 - length(domain)) || domain) AS entry
  FROM met GROUP BY host, fetched_day)
SELECT h.page_id, h.url, h.fetched_day, h.host, f.host IS NOT NULL AS blocked, coalesce(f.n_entries, 0) AS n_entries, coalesce(f.categories, '') AS categories, f.entry
FROM hosted h LEFT JOIN found f ON f.host = h.host AND f.fetched_day = h.fetched_day
"""
