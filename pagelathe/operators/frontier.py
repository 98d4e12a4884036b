"""The frontier of a crawl: what discovered links become, in which order they are taken, and how long each host waits.

Rounds are DataFrames: a round's discoveries are expanded against what is seen and queued by reason, ties in the
order of discovery.  TOP9-10, JN8-9, AGG14, SET1, SET7, WIN12, STR10, STR13, HLP15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.operators.crawls import INTERVAL_MS

# Reasons in the order their links are taken, the reason a link's zone gives, and why a link is left out.
RANKS = ("seed", "pagination-next", "pagination-numbered", "content-link", "other-link", "nav-link", "footer-link")
BY_ZONE = {"content": "content-link", "nav": "nav-link", "footer": "footer-link", "aside": "other-link", "unknown": "other-link"}
SKIPS = ("non-document-scheme", "external-host", "already-seen", "depth-cap")
MOST_DEPTH, MOST_PAGES = 3, 25


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def discoveries(links: DataFrame, pagination: DataFrame | None = None) -> DataFrame:
    """``page_id, seq, href, url, reason`` of links (``page_id, pos, href, url, zone``) and of links to further pages; those to the page before are none."""
    out = links.select("page_id", F.col("pos").cast("long").alias("seq"), "href", "url", _lookup(BY_ZONE, F.col("zone"), "other-link").alias("reason"))
    if pagination is not None:
        more = pagination.where(F.col("href").isNotNull() & F.col("kind").isin("next", "numbered", "load-more"))
        kind = F.when(F.col("kind") == "numbered", "pagination-numbered").otherwise("pagination-next")
        out = out.unionByName(more.select("page_id", (F.col("pos") - (1 << 30)).cast("long").alias("seq"), "href", F.col("href").alias("url"), kind.alias("reason")))
    return out


def expanded(found: DataFrame, seen: DataFrame, hosts: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """``page_id, seq, href, url, depth, reason, rank, skip``: what each discovery (with ``depth`` of its page) becomes.

    ``url`` is normalized.  ``skip`` is null for what is queued: a page of one of ``hosts`` (``host``), not in ``seen``
    (``url``), no deeper than ``most_depth``; of several discoveries of one page the first in order of (page_id, seq).
    """
    key = urls.normalize(F.col("url"))
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("reason")) - 1
    each = found.select("page_id", "seq", "href", key.alias("url"), (F.col("depth") + 1).alias("depth"), "reason", rank.alias("rank"))
    each = each.withColumn("host", urls.host(F.col("url")))
    known = hosts.select(F.lower("host").alias("host")).distinct().withColumn("known", F.lit(True))
    old = seen.select("url").distinct().withColumn("old", F.lit(True))
    first = each.where(F.col("url").isNotNull() & (F.col("depth") <= most_depth)).groupBy("url").agg(F.min(F.struct("page_id", "seq")).alias("first"))
    joined = each.join(known, "host", "left").join(old, "url", "left").join(first, "url", "left")
    skip = (
        F.when(F.col("url").isNull(), "non-document-scheme").when(F.col("known").isNull(), "external-host").when(F.col("old").isNotNull(), "already-seen")
        .when(F.col("depth") > most_depth, "depth-cap").when((F.col("first.page_id") != F.col("page_id")) | (F.col("first.seq") != F.col("seq")), "already-seen")
    )
    return joined.select("page_id", "seq", "href", "url", "depth", "reason", "rank", skip.alias("skip"))


def skip_tally(expansion: DataFrame) -> DataFrame:
    """``reason, n`` of what was left out, every reason present."""
    counts = expansion.where(F.col("skip").isNotNull()).groupBy(F.col("skip").alias("reason")).agg(F.count("*").alias("n"))
    every = expansion.sparkSession.createDataFrame([(s,) for s in SKIPS], "reason string")
    return every.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def next_pages(queue: DataFrame, limit: int = MOST_PAGES, fetched: int = 0) -> DataFrame:
    """The pages a run takes next: by rank, then in order of discovery; ``limit`` is of one run, ``fetched`` what it has had."""
    return queue.orderBy("rank", "depth", "page_id", "seq").limit(max(0, limit - fetched))


def merged(*queues: DataFrame) -> DataFrame:
    """One queue of several (in flight first): each page once, at its best place."""
    rows = None
    for i, q in enumerate(queues):
        part = q.select("url", "depth", "reason", "rank", "page_id", "seq", F.lit(i).alias("queue"))
        rows = part if rows is None else rows.unionByName(part)
    best = F.min_by(F.struct("depth", "reason", "rank", "page_id", "seq"), F.struct("queue", "rank", "depth", "page_id", "seq"))
    return rows.groupBy("url").agg(best.alias("e")).select("url", "e.*")


def paced(requests: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """``wait_ms, wait_reason`` of each request (``host, seq, at_ms``, perhaps ``crawl_delay_ms`` of its host and ``retry_at_ms``).

    The longest of the rate limit, the host's crawl delay and a live backoff holds, the first named on a tie.
    """
    w = Window.partitionBy("host").orderBy("at_ms", "seq")
    since = F.col("at_ms") - F.lag("at_ms").over(w)
    delay = F.coalesce(F.col("crawl_delay_ms"), F.lit(0)) if "crawl_delay_ms" in requests.columns else F.lit(0)
    retry = F.coalesce(F.col("retry_at_ms") - F.col("at_ms"), F.lit(0)) if "retry_at_ms" in requests.columns else F.lit(0)
    owed = requests.withColumns({"_rate": F.coalesce(interval_ms - since, F.lit(0)), "_delay": F.coalesce(delay - since, F.lit(0)), "_retry": retry})
    most = F.greatest("_rate", "_delay", "_retry", F.lit(0))
    reason = F.when(most <= 0, "go").when(F.col("_rate") == most, "rate-limit").when(F.col("_delay") == most, "crawl-delay").otherwise("backoff")
    return owed.withColumns({"wait_ms": most.cast("long"), "wait_reason": reason}).drop("_rate", "_delay", "_retry")


def stop_text(kind: Column, host: Column, count: Column) -> Column:
    """Why a crawl stopped, in words."""
    n = count.cast("string")
    return (
        F.when(kind == "consecutive-errors", F.concat(F.lit("host stopped: "), host, F.lit(" failed "), n, F.lit(" times in a row")))
        .when(kind == "all-hosts-failing", F.concat(F.lit("all "), n, F.lit(" hosts are failing")))
        .when(kind == "error-budget", F.concat(n, F.lit(" failures in all")))
    )


def robots_text(reason: Column, rule: Column) -> Column:
    """Why robots rules leave a page out, in words."""
    return F.concat(F.lit("robots: "), reason, F.when(rule.isNotNull(), F.concat(F.lit(" ("), rule, F.lit(")"))).otherwise(""))
