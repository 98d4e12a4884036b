"""Links of pages, from the element table: resolved targets, zones, relations, and their counts (JN1, AGG1, AGG19, SET5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import urls

# The zone a landmark role gives.
ZONES = {"navigation": "nav", "banner": "nav", "contentinfo": "footer", "main": "content", "article": "content", "complementary": "aside"}


def zone(roles: Column) -> Column:
    """The zone of the innermost landmark above an element: an array lookup, no join up the tree."""
    table = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    inner = F.try_element_at(F.filter(roles, lambda r: r.isin(*ZONES)), F.lit(-1))
    return F.coalesce(F.try_element_at(table, inner), F.lit("unknown"))


def ordered_distinct(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, pos, href, url, internal, zone, text, rel`` of every anchor with an href, in document order.

    Internal means the same scheme and host as the page.  Text falls back to aria-label, then title.
    An anchor whose href cannot be resolved keeps it as written.
    """
    w = Window.partitionBy("page_id").orderBy("node_id")
    a = nodes.where((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
    a = a.select("page_id", "node_id", F.col("attrs")["href"].alias("href"), "roles", "text", "attrs").withColumn("pos", F.row_number().over(w) - 1)
    a = a.join(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("page_url")), "page_id")
    url = F.coalesce(urls.resolve(F.col("href"), F.col("page_url")), F.col("href"))
    label = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (F.col("text"), F.col("attrs")["aria-label"], F.col("attrs")["title"])], F.lit(""))
    return a.select(
        "page_id", "pos", "href", url.alias("url"),
        (F.concat_ws("://", urls.scheme(url), urls.host(url)) == F.concat_ws("://", urls.scheme(F.col("page_url")), urls.host(F.col("page_url")))).alias("internal"),
        zone(F.col("roles")).alias("zone"),
        F.when(F.length(label) > 200, F.concat(F.substring(label, 1, 199), F.lit("…"))).otherwise(label).alias("text"),
        ordered_distinct(F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+")).alias("rel"),
    )


def links_by_host(found: DataFrame) -> DataFrame:
    """External links a host, and the pages that hold them."""
    return found.where(~F.col("internal")).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def link_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.sum(F.col("internal").cast("long")).alias("n_internal"), F.sum((~F.col("internal")).cast("long")).alias("n_external"))


def zone_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("zone").agg(F.count("*").alias("n_links"))
