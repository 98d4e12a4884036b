"""Facts with their provenance: best tier per role, first-wins dedupe, fallbacks; scans of prose (WIN1-4, WIN6, JSN17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import text as T

# Tiers of confidence, best first.
RANKS = {"high": 0, "medium": 1, "low": 2}


def rank(confidence) -> F.Column:
    out = F.lit(None).cast("int")
    for k, v in RANKS.items():
        out = F.when(confidence == k, v).otherwise(out)
    return out


def best_tier(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of the best tier among those of their keys, in their order; unknown tiers have none.

    One window over the keys; the tier is a partial aggregate, so no key is sorted.
    """
    ranked = candidates.withColumn("tier", rank(F.col("confidence"))).where(F.col("tier").isNotNull())
    return ranked.withColumn("best", F.min("tier").over(Window.partitionBy(*keys))).where(F.col("tier") == F.col("best")).drop("best")


def first_wins(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each key in order; ties of the order count once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def first_of_best(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(best_tier(candidates, keys), keys, order)


def date_fallback(dates: DataFrame) -> DataFrame:
    """``page_id, value, field``: a page's first published date, else its first modified one."""
    known = dates.where(F.col("field").isin("published", "modified") & F.col("value").isNotNull())
    known = known.withColumn("turn", F.when(F.col("field") == "published", 0).otherwise(1))
    return first_wins(known, ["page_id"], ["turn", "pos", "date_id"]).select("page_id", "value", "field")


def price_roles(prices: DataFrame) -> DataFrame:
    """Prices without a role become current where any price of the page has one."""
    any_role = F.max(F.col("role").isNotNull().cast("int")).over(Window.partitionBy("page_id"))
    return prices.withColumn("role", F.when(F.col("role").isNull() & (any_role == 1), "current").otherwise(F.col("role")))


def document_facts(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, pos, value``: e-mail addresses, phone numbers and prices of texts, in order of appearance."""
    t = F.coalesce(F.col("text"), F.lit(""))
    arrays = {"email": T.emails(t), "phone": T.phones(t), "price": F.transform(T.prices(t), lambda p: p["matched"])}
    structs = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("found")) for k, a in arrays.items()])
    return documents.select("doc_id", F.explode(structs).alias("f")).select("doc_id", F.col("f.kind").alias("kind"), F.posexplode("f.found").alias("pos", "value"))
