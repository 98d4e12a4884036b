"""Crawls: summaries, robots rules, pacing, failures and stops, and the frontier (AGG13-14, JN8-9, JN14-15, TOP9, WIN10-13, WIN15, STR12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.session import cut, stored

# Fixed values of pacing: milliseconds, and what stops a crawl.
BASE_MS, MOST_MS, INTERVAL_MS = 1_000, 60_000, 1_000
HOST_ERRORS, ALL_ERRORS = 5, 50
FAILING_HOSTS = 3


def summary(crawl_records: DataFrame) -> DataFrame:
    """A row a crawl: pages by outcome and the sum of warnings.  Null outcomes count as pages only."""
    kind = F.col("outcome.kind")
    return crawl_records.groupBy("crawl_name").agg(
        F.count("*").alias("pages"),
        F.sum((kind == "fetched").cast("long")).alias("fetched"),
        F.sum((kind == "error").cast("long")).alias("errors"),
        F.sum((kind == "skipped").cast("long")).alias("skipped"),
        F.sum(F.coalesce(F.size("warnings"), F.lit(0)).cast("long")).alias("warnings"),
        F.max("written_at").alias("updated_at"),
    )


def reasons(crawl_records: DataFrame) -> DataFrame:
    """How often each reason stands, by crawl and outcome."""
    return crawl_records.where(F.col("outcome.reason").isNotNull()).groupBy("crawl_name", F.col("outcome.kind").alias("kind"), F.col("outcome.reason").alias("reason")).agg(F.count("*").alias("n"))


def domain_coverage(crawl_records: DataFrame) -> DataFrame:
    """Records a top-level part of their data, in readable data; the count of unreadable ones under ``(unreadable)``."""
    parsed = F.try_parse_json("data")
    keys = F.json_object_keys("data")
    rows = crawl_records.where(F.col("data").isNotNull()).select(F.when(parsed.isNull(), F.array(F.lit("(unreadable)"))).otherwise(F.coalesce(keys, F.array())).alias("keys"))
    return rows.select(F.explode("keys").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def warnings(crawl_records: DataFrame) -> DataFrame:
    """Warnings a phase and reason."""
    return crawl_records.select(F.explode("warnings").alias("w")).where(F.col("w").isNotNull()).groupBy(F.col("w.phase").alias("phase"), F.col("w.reason").alias("reason")).agg(F.count("*").alias("n"))


def latest(crawl_records: DataFrame) -> DataFrame:
    """The crawl written to last; ties by name."""
    return summary(crawl_records).orderBy(F.col("updated_at").desc(), "crawl_name").limit(1).select("crawl_name", "pages")


def host_failure(ok: Column, status: Column) -> Column:
    """A failure the host is to blame for: no status, 429, or 500 and above."""
    return ~ok & (status.isNull() | (status == 429) | (status >= 500))


def backoff_ms(streak: Column, retry_after_s: Column | None = None) -> Column:
    """The wait after a streak of failures: doubled each time, or what the server asked, within the bounds."""
    ladder = F.lit(float(BASE_MS)) * F.pow(F.lit(2.0), F.least(streak, F.lit(30)) - 1)
    asked = F.coalesce(retry_after_s * 1000.0, ladder) if retry_after_s is not None else ladder
    return F.least(F.greatest(asked, F.lit(float(BASE_MS))), F.lit(float(MOST_MS)))


def streaks(outcomes: DataFrame, key: str = "host", order: str = "seq") -> DataFrame:
    """``streak``: failures in a row up to each outcome; a success ends one, a neutral outcome does neither.

    Two running counts: of successes (islands), then of failures within the island.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    islands = outcomes.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    inside = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum(F.col("failed").cast("int")).over(inside)).drop("island")


def stops(outcomes: DataFrame, key: str = "host", order: str = "seq") -> DataFrame:
    """The first outcome of each host at which its streak reaches the limit."""
    hit = streaks(outcomes, key, order).where(F.col("failed") & (F.col("streak") >= HOST_ERRORS))
    return hit.groupBy(key).agg(F.min(order).alias("stopped_at"), F.min_by("streak", order).alias("streak"))


def crawl_stop(outcomes: DataFrame, budget: int = ALL_ERRORS) -> DataFrame:
    """``stopped_at, kind, host, count``: the first reason to stop a crawl; no row if there is none.

    Input: ``host, seq, at_ms, ok, failed`` and perhaps ``retry_after_s`` of one crawl, each request once it is
    answered.  A host fails ``HOST_ERRORS`` times in a row; else all hosts tried so far, ``FAILING_HOSTS`` or more,
    are inside a live backoff; else the failures of the crawl reach ``budget``.  The budget ends any crawl at its
    ``budget``-th failure, so no more failures, and no more hosts than one beyond them, need be compared.
    """
    w = Window.partitionBy("host").orderBy("seq")
    asked = F.col("retry_after_s") if "retry_after_s" in outcomes.columns else None
    followed = streaks(outcomes).withColumn("next", F.min(F.when(F.col("ok") | F.col("failed"), F.col("seq"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    failures = cut(
        followed.where(F.col("failed")).select("host", "seq", "at_ms", "streak", "next", (F.col("at_ms") + backoff_ms(F.col("streak"), asked)).alias("retry_at")).orderBy("seq").limit(budget)
    )
    tried = outcomes.groupBy("host").agg(F.min("seq").alias("first")).orderBy("first").limit(budget + 1)
    f, g = failures.alias("f"), failures.alias("g")
    live = (F.col("g.seq") <= F.col("f.seq")) & (F.col("g.next").isNull() | (F.col("g.next") > F.col("f.seq"))) & (F.col("g.retry_at") > F.col("f.at_ms"))
    failing = f.join(g, live, "left").groupBy(F.col("f.seq").alias("seq")).agg(F.countDistinct("g.host").alias("failing"))
    attempted = f.join(tried, F.col("first") <= F.col("f.seq")).groupBy(F.col("f.seq").alias("seq")).agg(F.count("*").alias("attempted"))
    errors = f.join(g, F.col("g.seq") <= F.col("f.seq")).groupBy(F.col("f.seq").alias("seq")).agg(F.count("*").alias("errors"))
    every = failures.join(failing, "seq").join(attempted, "seq").join(errors, "seq")
    nobody = F.lit(None).cast(outcomes.schema["host"].dataType)

    def reason(kind: str, host: Column, count: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), host.alias("host"), F.col(count).cast("long").alias("count"))

    why = F.when(F.col("streak") >= HOST_ERRORS, reason("consecutive-errors", F.col("host"), "streak"))
    why = why.when((F.col("attempted") >= FAILING_HOSTS) & (F.col("failing") == F.col("attempted")), reason("all-hosts-failing", nobody, "attempted"))
    why = why.when(F.col("errors") >= budget, reason("error-budget", nobody, "errors"))
    return every.select(F.col("seq").alias("stopped_at"), why.alias("why")).where(F.col("why").isNotNull()).orderBy("stopped_at").limit(1).select("stopped_at", "why.kind", "why.host", "why.count")


def waits(requests: DataFrame, key: str = "host", order: str = "at_ms", interval_ms: int = INTERVAL_MS) -> DataFrame:
    """``wait_ms`` a request owes since the one before it on its host; ties of the time by ``seq``."""
    w = Window.partitionBy(key).orderBy(order, "seq")
    elapsed = F.col(order) - F.lag(order).over(w)
    return requests.withColumn("wait_ms", F.coalesce(F.greatest(F.lit(interval_ms) - elapsed, F.lit(0)), F.lit(0)).cast("long"))


def robots_rules(files: DataFrame) -> DataFrame:
    """``host, group, agents, pos, allow, path`` of robots files (``host, text``).

    Consecutive agents share a group; rules outside one bind nobody; an empty rule is none; comments,
    byte order marks and unknown fields are skipped.  Windows over a file's lines, all in the JVM.
    """
    lines = files.select("host", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), r"\r\n|\r|\n")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parsed = lines.select("host", "line", F.lower(F.trim(F.regexp_extract(clean, r"^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value")).where(
        F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay")
    )
    w = Window.partitionBy("host").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("group", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("group") > 0)
    agents = grouped.where((F.col("field") == "user-agent") & (F.col("value") != "")).groupBy("host", "group").agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = grouped.where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return agents.join(rules.select("host", "group", F.col("line").alias("pos"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")), ["host", "group"], "left")


def rule_pattern(path: Column) -> Column:
    """A rule's path as a regular expression: ``*`` any run, a last ``$`` the end, all else as it is."""
    body = F.regexp_replace(path, r"\$$", "")
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(path.endswith("$"), "$").otherwise(""))


def robots_verdicts(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``page_id, allowed, reason, rule`` of ``page_id, url`` by the rules of each host's file (host ``*`` for hosts without one).

    The group of the longest agent token named in the user agent, else that of ``*``; among its rules that
    match, the longest wins and a tie goes to allow.  A host's rules are one array, joined by host; the match is
    made within the row, so no page is paired with rules of other hosts.
    """
    low = F.lit(agent.lower())
    token = F.array_max(F.transform("agents", lambda a: F.when(a == "*", 0).when(F.contains(low, a), F.length(a)).otherwise(-1)))
    ranked = rules.withColumn("token", token).where(F.col("token") >= 0)
    w = Window.partitionBy("host").orderBy(F.col("token").desc(), "group")
    chosen = ranked.withColumn("r", F.dense_rank().over(w)).where(F.col("r") == 1)
    rule = F.struct(F.length("path").alias("n"), "allow", "path", rule_pattern(F.col("path")).alias("pattern"))
    of_host = chosen.groupBy("host").agg(F.collect_list(F.when(F.col("path").isNotNull(), rule)).alias("rules"))
    general = of_host.where(F.col("host") == "*").select(F.col("rules").alias("general"))
    u = F.col("url")
    target = F.concat(F.when(urls.path(u) == "", "/").otherwise(urls.path(u)), F.when(urls.query(u) == "", "").otherwise(F.concat(F.lit("?"), urls.query(u))))
    asked = pages.select("page_id", urls.host(u).alias("host"), target.alias("target")).join(of_host.where(F.col("host") != "*"), "host", "left")
    asked = asked.join(general.agg(F.first("general").alias("general")), how="cross")  # one row
    held = F.coalesce("rules", "general")
    best = F.array_max(F.transform(F.filter(held, lambda r: F.regexp_like(F.col("target"), r["pattern"])), lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"), r["path"].alias("path"))))
    return asked.withColumn("b", best).select(
        "page_id", F.coalesce(F.col("b.allow"), F.col("target").isNotNull()).alias("allowed"),
        F.when(F.col("target").isNull(), "unparseable-url").when(held.isNull(), "no-group-matched").when(F.col("b").isNull(), "no-rule-matched").when(F.col("b.allow"), "allow-rule").otherwise("disallow-rule").alias("reason"),
        F.col("b.path").alias("rule"),
    )


def frontier_rounds(seeds: DataFrame, edges: DataFrame, most_rounds: int = 3) -> DataFrame:
    """``url, depth``: breadth-first rounds over links (``src, dst``) from ``seeds`` (``url``).

    The links are stored once.  Each round is one join and one anti-join against the rounds before, distinct before the shuffle, and
    is stored in the shared folder; none is written twice.  Cycles end, since a seen page never returns.
    """
    edges = stored(edges.select("src", "dst"))
    rounds = [stored(seeds.select("url").where(F.col("url").isNotNull()).distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, most_rounds + 1):
        reached = rounds[-1].join(edges, rounds[-1]["url"] == edges["src"]).select(F.col("dst").alias("url")).where(F.col("url").isNotNull()).distinct()
        front = stored(reached.join(reduce(DataFrame.unionByName, rounds), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)


def sample_robots(spark: SparkSession) -> DataFrame:
    """The rules of a small robots file, for pages of any host."""
    text = "User-agent: *\nDisallow: /item/\nAllow: /item/1\nDisallow: /*?page=\nDisallow: /guide/*.html$\n\nUser-agent: other\nDisallow: /"
    return robots_rules(spark.createDataFrame([("*", text)], "host string, text string"))
