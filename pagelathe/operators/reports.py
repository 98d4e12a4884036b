"""Reports as rows and text: capped rows, summaries of crawls and pages, inventories of media and resources.

SNK12-15, TOP3, TOP11, AGG8, AGG15, AGG20, SRC4-5, SET1, SET8, NUM5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import text as T

# Domains in the order they are extracted, and those a crawl needs to find its way.
DOMAINS = ("structured", "entities", "content", "design", "links", "network", "stack", "vitals")
DISCOVERY = ("links", "entities")
MOST_ROWS = 6
#: A page with less text and fewer regions than these has been sent without its content.
SHELL_CHARS, SHELL_REGIONS = 200, 5


def domains_of(requested: list[str]) -> list[str]:
    """The domains a crawl extracts: those requested and those of discovery, in their order; unknown names are an error."""
    if unknown := set(requested) - set(DOMAINS):
        raise ValueError(f"unknown domains: {', '.join(sorted(unknown))}")
    return [d for d in DOMAINS if d in requested or d in DISCOVERY]


def rounded(value: Column) -> Column:
    """A number rounded half up; null for null and for what is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(value + 0.5).cast("long"))


def capped(rows: DataFrame, key: str, order: list[Column], line: Column, most: int = MOST_ROWS) -> DataFrame:
    """``key, pos, line``: the first ``most`` lines of each key; where there are more, a last line says how many.

    Only counts and the lines kept are held for a key.
    """
    w = Window.partitionBy(key)
    ranked = rows.select(key, line.alias("line"), F.row_number().over(w.orderBy(*order)).alias("pos"), F.count("*").over(w).alias("n"))
    kept = ranked.where(F.col("pos") <= most + 1)
    return kept.select(key, F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") <= most, F.col("line")).otherwise(F.concat(F.lit("… "), (F.col("n") - most).cast("string"), F.lit(" more"))).alias("line"))


def blocks(lines: DataFrame, key: str, title: Column) -> DataFrame:
    """``key, text``: a heading and the lines of each key below it."""
    held = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return held.select(key, F.concat(title, F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("  "), x["line"])), "\n")).alias("text"))


def reason_lines(records: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``crawl_name, pos, line``: the commonest reasons of a crawl, by count, then by reason."""
    counts = records.where(F.col("outcome.reason").isNotNull()).groupBy("crawl_name", F.col("outcome.reason").alias("reason")).agg(F.count("*").alias("n"))
    return capped(counts, "crawl_name", [F.col("n").desc(), F.col("reason")], F.concat(F.col("n").cast("string"), F.lit(" "), T.elided(F.col("reason"), 60)), most)


def crawl_texts(records: DataFrame) -> DataFrame:
    """``crawl_name, text``: what a crawl did, with its commonest reasons."""
    kinds = records.groupBy("crawl_name").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome.kind") == k).alias(k) for k in ("fetched", "error", "skipped")])
    head = F.concat(F.col("crawl_name"), F.lit(": "), T.plural(F.col("n"), "record"), F.lit(", "), *[x for k in ("fetched", "error", "skipped") for x in (F.col(k).cast("string"), F.lit(f" {k}"), F.lit(", " if k != "skipped" else ""))])
    below = blocks(reason_lines(records), "crawl_name", F.lit("reasons")).withColumnRenamed("text", "below")
    return kinds.join(below, "crawl_name", "left").select("crawl_name", F.concat_ws("\n", head, "below").alias("text"))


def declared_types(records: DataFrame, most: int = 2) -> DataFrame:
    """``record_id, pos, type, n``: the commonest types of the top nodes of a record's JSON-LD, ties by name; schema prefixes are cut."""
    nodes = F.try_variant_get(F.try_parse_json("data"), "$.structured.jsonLd", "array<variant>")
    named = records.select("record_id", F.explode(nodes).alias("node"))
    one, several = F.try_variant_get("node", "$['@type']", "string"), F.try_variant_get("node", "$['@type']", "array<string>")
    types = F.when(several.isNotNull(), several).when(one.isNotNull(), F.array(one))
    counted = named.select("record_id", F.explode(types).alias("raw")).select("record_id", T.short_type(F.col("raw")).alias("type")).where(F.col("type") != "").groupBy("record_id", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("record_id").orderBy(F.col("n").desc(), "type")
    return counted.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("record_id", "pos", "type", "n")


def page_lines(types: DataFrame, facts: DataFrame, key: str = "record_id") -> DataFrame:
    """``key, line``: a page in one line, its commonest types, its first price, its first author."""
    named = types.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "n", F.lower("type").alias("type")))).alias("t"))
    first = lambda field: F.min_by(F.when(F.col("field") == field, F.struct("value", "number", "unit")), F.when(F.col("field") == field, F.col("pos")))
    stated = facts.groupBy(key).agg(first("price").alias("price"), first("author").alias("author"))
    price = F.concat(F.lit("price "), F.concat_ws(" ", F.format_string("%.2f", F.col("price.number")), F.col("price.unit")))
    parts = [F.array_join(F.transform("t", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["type"])), ", "), F.when(F.col("price").isNotNull(), price), F.when(F.col("author").isNotNull(), F.concat(F.lit("by "), F.col("author.value")))]
    return named.join(stated, key, "full").select(key, F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("nothing declared")).alias("line"))


def media_inventory(media: DataFrame) -> DataFrame:
    """``page_id, n, alt_share, lazy_share, formats`` of media rows; shares have four decimals, formats are counts by name."""
    counts = media.groupBy("page_id", F.coalesce("format", F.lit("unknown")).alias("format")).agg(F.count("*").alias("n"), F.count_if(F.trim("alt") != "").alias("alt"), F.count_if("lazy").alias("lazy"))
    return counts.groupBy("page_id").agg(
        F.sum("n").alias("n"), F.round(F.sum("alt") / F.sum("n"), 4).alias("alt_share"), F.round(F.sum("lazy") / F.sum("n"), 4).alias("lazy_share"),
        F.array_sort(F.collect_list(F.concat_ws(":", "format", F.col("n").cast("string")))).alias("formats"),
    )


def resource_rollup(entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, kind, n, bytes`` of resource entries (``kind, bytes``): no kind is other, bytes are null where none is measurable."""
    size = F.when(~F.isnan("bytes") & (F.col("bytes") >= 0) & (F.col("bytes") < float("inf")), F.col("bytes"))
    return entries.groupBy(key, F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def host_order(requests: DataFrame) -> DataFrame:
    """``pos, host, n_api, n`` of requests (``host, resource_type``): hosts with most calls of an interface first, then most requests, then by name."""
    counts = requests.groupBy("host").agg(F.count_if(F.col("resource_type").isin("xhr", "fetch")).alias("n_api"), F.count("*").alias("n"))
    return counts.select(F.row_number().over(Window.orderBy(F.col("n_api").desc(), F.col("n").desc(), "host")).alias("pos"), "host", "n_api", "n")  # a row a host


def shells(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, n_regions, chars, is_shell, driver`` of every page: whether it came without its content, and by what it is to be read."""
    sums = regions.groupBy("page_id").agg(F.count("*").alias("n_regions"), F.sum(F.when(F.col("depth") == 1, F.col("text_length"))).alias("chars"))
    each = pages.select(F.col("page_id").cast("long").alias("page_id")).join(sums, "page_id", "left")
    n, chars = F.coalesce("n_regions", F.lit(0)), F.coalesce("chars", F.lit(0))
    shell = (chars < SHELL_CHARS) & (n < SHELL_REGIONS)
    return each.select("page_id", n.alias("n_regions"), chars.alias("chars"), shell.alias("is_shell"), F.when(shell, "browser").otherwise("static").alias("driver"))
