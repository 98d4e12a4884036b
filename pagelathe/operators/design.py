"""Stylesheets of pages: breakpoints, grids, fonts, colours in use (AGG7, AGG10-12, TOP5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import design
from pagelathe.operators.network import css_declarations

# Family names that are no fonts of their own.
GENERIC = "serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace ui-rounded math emoji fangsong inherit initial unset revert -apple-system blinkmacsystemfont".split()


def sheets(pages: DataFrame) -> DataFrame:
    """``page_id, css`` of each style element, comments removed."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("css")).select("page_id", F.regexp_replace("css", r"(?s)/\*.*?\*/", "").alias("css"))


def breakpoints(pages: DataFrame) -> DataFrame:
    """``pos, query, first_written, n, n_rules, px``: media queries, one whatever its spaces and case, with the rules in them.

    Those bounded by a width come first, the narrowest at the head; a query is shown as the first of its spellings by name.
    """
    block = r"(?i)@media([^{]+)\{((?:[^{}]*\{[^{}]*\})*)"
    found = sheets(pages).select(F.explode(F.arrays_zip(*[F.regexp_extract_all("css", F.lit(block), F.lit(i)).alias(n) for i, n in ((1, "written"), (2, "rules"))])).alias("m"))
    media = found.select(F.trim("m.written").alias("written"), F.regexp_count("m.rules", F.lit(r"\{")).alias("rules"))
    key = F.lower(F.regexp_replace("written", r"\s+", ""))
    counts = media.groupBy(key.alias("query")).agg(F.min("written").alias("first_written"), F.count("*").alias("n"), F.sum("rules").alias("n_rules"))
    px = design.pixels(F.nullif(F.regexp_extract("query", r"(?:min|max)-width:(\d+(?:\.\d+)?(?:px|rem|em))", 1), F.lit("")))
    each = counts.withColumn("px", px)
    return each.select(F.row_number().over(Window.orderBy(F.col("px").asc_nulls_last(), "query")).alias("pos"), "query", "first_written", "n", "n_rules", "px")  # a row a query


def fonts(pages: DataFrame) -> DataFrame:
    """``family, n``: font families named in declarations, generic ones left out."""
    named = css_declarations(pages).where(F.col("property") == "font-family")
    family = F.trim(F.regexp_replace("f", "[\"']", ""))
    rows = named.select(F.explode(F.split("value", ",")).alias("f"), "n").select(family.alias("family"), "n")
    return rows.where(~F.col("family").isin(*GENERIC) & (F.col("family") != "")).groupBy("family").agg(F.sum("n").alias("n"))


def grids(pages: DataFrame) -> DataFrame:
    """``property, value, n`` of grid templates, gaps and container widths."""
    d = css_declarations(pages)
    return d.where(F.col("property").isin("grid-template-columns", "gap", "column-gap", "row-gap", "grid-gap", "max-width"))


def colors(pages: DataFrame) -> DataFrame:
    """``color, n``: colours declared, in one spelling each."""
    d = css_declarations(pages).where(F.col("property").rlike("color$|^background$"))
    return d.select(design.normal_color(F.col("value")).alias("color"), "n").where(F.col("color").isNotNull()).groupBy("color").agg(F.sum("n").alias("n"))
