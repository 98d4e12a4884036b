"""Observed traffic: rollups by host, budgets, rings, vitals, technologies, stylesheets (AGG2-6, WIN7, WIN9, NUM6, JN4, TOP1-5).

``events`` stands in for recorded requests in the queries: user as host, type as resource type, value as
size.  It exercises the operators; it has no URLs, statuses or bodies of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import urls

API_TYPES = ("xhr", "fetch", "eventsource", "websocket")
SKIP_REASONS = ("binary-type", "unreadable", "over-cap", "evicted")
BODY_CAP, SESSION_CAP, RING = 256 * 1024, 2 * 1024 * 1024, 500
# Thresholds of web vitals (good up to, needs improvement up to).
VITALS = {"lcp": (2500, 4000), "inp": (200, 500), "cls": (0.1, 0.25), "fcp": (1800, 3000), "ttfb": (800, 1800)}
# What in a page's source gives a technology away.
SIGNATURES = {"google-analytics": "google-analytics.com", "tag-manager": "googletagmanager.com", "jquery": "jquery", "wordpress": "wp-content", "shopify": "cdn.shopify.com", "react": "react", "no-js-fallback": 'class="no-js"', "noscript-notice": "<noscript"}


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("none")


def host_rollup(requests: DataFrame) -> DataFrame:
    """Requests, bytes and calls of an interface a host (``host, resource_type, size, status``); null sizes are 0."""
    return requests.groupBy("host").agg(
        F.count("*").alias("n_requests"),
        F.round(F.sum(F.coalesce("size", F.lit(0.0))), 4).alias("bytes"),
        F.sum(F.col("resource_type").isin(*API_TYPES).cast("long")).alias("n_api"),
        F.array_join(F.sort_array(F.collect_set(status_class(F.col("status")))), ",").alias("classes"),
    )


def zero_filled(counts: DataFrame, key: str, values) -> DataFrame:
    """Counts with a row for each of the values, 0 where there is none."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def body_budget(bodies: DataFrame, key: str, order: str, size: str, cap: float) -> DataFrame:
    """``kept``: what stays when the oldest go until the sum of the newest is within the cap."""
    newest_first = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return bodies.withColumn("kept", F.sum(F.coalesce(size, F.lit(0.0))).over(newest_first) <= cap)


def ring(entries: DataFrame, key: str, order: str, size: int = RING) -> DataFrame:
    """The last ``size`` entries of each key; the window's filter is pushed into a group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size)


def rating(name: str, value: Column) -> Column:
    good, fair = VITALS[name]
    return F.when(value.isNull(), None).when(value <= good, "good").when(value <= fair, "needs-improvement").otherwise("poor")


def technologies(pages: DataFrame) -> DataFrame:
    """``page_id, technology``: the signatures found in the source of each page; one scan of it, no join."""
    found = F.filter(F.array(*[F.when(F.contains(F.lower("html"), F.lit(needle)), F.lit(name)) for name, needle in SIGNATURES.items()]), lambda x: x.isNotNull())
    return pages.select("page_id", F.explode(found).alias("technology"))


def third_party_hosts(pages: DataFrame) -> DataFrame:
    """Hosts other than the page's site that its source names in full URLs, and on how many pages."""
    named = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"https?://([A-Za-z0-9.-]+)"), F.lit(1)), lambda h: F.lower(h)))
    rows = pages.select("page_id", urls.site(urls.host(F.col("url"))).alias("own"), F.explode(named).alias("host"))
    return rows.where(urls.site(F.col("host")) != F.col("own")).groupBy("host").agg(F.count("*").alias("n_pages"))


def css_declarations(pages: DataFrame) -> DataFrame:
    """``property, value, n``: declarations of the pages' own stylesheets."""
    sheets = F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    bodies = pages.select(F.explode(sheets).alias("css")).select(F.explode(F.regexp_extract_all(F.regexp_replace("css", r"(?s)/\*.*?\*/", ""), F.lit(r"\{([^{}]*)\}"), F.lit(1))).alias("body"))
    parts = bodies.select(F.explode(F.split("body", ";")).alias("d")).where(F.contains("d", F.lit(":")))
    return parts.select(F.lower(F.trim(F.split_part("d", F.lit(":"), F.lit(1)))).alias("property"), F.lower(F.trim(F.regexp_extract("d", r"^[^:]*:(.*)$", 1))).alias("value")).groupBy("property", "value").agg(F.count("*").alias("n"))


def top_tokens(declarations: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """The commonest values a property: count descending, value ascending."""
    w = Window.partitionBy("property").orderBy(F.col("n").desc(), "value")
    return declarations.where(F.col("n") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
