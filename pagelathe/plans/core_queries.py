"""Queries of the core on the given tables: name -> (session, folder) -> DataFrame, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.functions import urls
from pagelathe.operators import archive, content, crawls, design, entities, links, nested, network, page_tree, timestamps
from pagelathe.plans.core_sql import SQL
from pagelathe.session import table
from pagelathe.sources import dom

AGENT = "pagelathe-bot/1"
SHAPE = {"title": "title", "heading": "h1", "lang": "html@lang", "first_link": "ul > li a@href", "charset": "meta[charset]@charset"}


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


def _links(s, d):
    p = _pages(s, d)
    return links.links(dom.dom_nodes(p), p)


def _requests(s, d):
    """Events as requests: user as host, type as resource type, value as size."""
    kind = F.when(F.col("event_type") == "click", "xhr").when(F.col("event_type") == "purchase", "fetch").otherwise(F.col("event_type"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), "ts", "event_type", kind.alias("resource_type"), F.col("value").alias("size"), status.alias("status"))


def _outcomes(s, d):
    """Errors fail, clicks and views succeed, the rest is neutral."""
    r = _requests(s, d)
    return r.select("host", "seq", "ts", F.col("event_type").isin("click", "view").alias("ok"), (F.col("event_type") == "error").alias("failed"))


def url_normalize(s, d):
    return _pages(s, d).select("page_id", urls.normalize(F.col("url")).alias("normalized"))


def url_dedupe(s, d):
    return url_normalize(s, d).where(F.col("normalized").isNotNull()).groupBy("normalized").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page_id"))


def url_parts(s, d):
    u = F.col("url")
    return _pages(s, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.site(urls.host(u)).alias("site"), urls.path(u).alias("path"))


def url_tracking(s, d):
    p = _pages(s, d).select(F.explode(urls.parameters(F.col("url"))).alias("e"))
    return p.groupBy(F.col("e.name").alias("name")).agg(F.count("*").alias("n"), F.max(urls.is_tracking(F.col("e.name"))).alias("tracks"))


def url_redact(s, d):
    return table(s, d, "crawl_records").where(F.col("url").isNotNull()).select("record_id", urls.redact_url(F.col("url")).alias("redacted"))


def links_all(s, d):
    return _links(s, d).select("page_id", "pos", "href")


def link_targets(s, d):
    return _links(s, d).select("page_id", "pos", "url", "internal")


def page_titles(s, d):
    h = F.col("html")
    title = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return _pages(s, d).select("page_id", F.nullif(title, F.lit("")).alias("title"))


def page_outline(s, d):
    return content.outline(dom.dom_nodes(_pages(s, d)))


def page_outline_violations(s, d):
    return content.outline_violations(page_outline(s, d))


def doc_words(s, d):
    n = T.word_count(F.col("text")).cast("long")
    return table(s, d, "documents").select("doc_id", n.alias("n_words")).withColumn("minutes", T.reading_minutes(F.col("n_words")))


def doc_facts(s, d):
    return entities.document_facts(table(s, d, "documents"))


def doc_availability(s, d):
    return table(s, d, "documents").select("doc_id", T.availability(F.col("text")).alias("availability")).where(F.col("availability").isNotNull())


def doc_redacted(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.struck_texts(F.col("text")).alias("redacted"))


def entity_best_tier(s, d):
    e = table(s, d, "entity_dates").where(F.col("value").isNotNull())
    return entities.best_tier(e, ["page_id", "field"]).select("date_id", "page_id", "field", "value", "tier")


def entity_dedupe(s, d):
    e = table(s, d, "entity_dates").where(F.col("value").isNotNull())
    return entities.first_wins(e, ["page_id", "field", "value"], ["pos", "date_id"]).select("date_id", "page_id", "field", "value")


def entity_first(s, d):
    e = table(s, d, "entity_dates").where(F.col("value").isNotNull())
    return entities.first_of_best(e, ["page_id", "field"], ["pos", "date_id"]).select("date_id", "page_id", "field", "value")


def net_totals(s, d):
    return _requests(s, d).agg(F.count("*").alias("n_requests"), F.round(F.sum("size"), 4).alias("bytes"), F.countDistinct("host").alias("n_hosts"))


def net_status_classes(s, d):
    return _requests(s, d).groupBy("host", network.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def net_skip_reasons(s, d):
    r = _requests(s, d)
    reason = F.when(F.col("event_type") == "view", "binary-type").when(F.col("event_type") == "error", "unreadable").when(F.col("size") > 300, "over-cap")
    counts = r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where(F.col("reason").isNotNull())
    return network.zero_filled(counts, "reason", network.SKIP_REASONS)


def net_body_budget(s, d):
    return network.body_budget(_requests(s, d), "host", "seq", "size", 500.0).select("host", "seq", "kept")


def event_ring(s, d):
    return network.ring(_requests(s, d), "host", "seq", 20).select("host", "seq", "rn")


def error_streaks(s, d):
    return crawls.streaks(_outcomes(s, d)).select("host", "seq", "streak")


def backoff_ladder(s, d):
    st = crawls.streaks(_outcomes(s, d)).where(F.col("failed"))
    return st.select("host", "seq", crawls.backoff_ms(F.col("streak")).alias("backoff_ms"))


def rate_limit_waits(s, d):
    r = _requests(s, d).select("host", "seq", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"))
    return crawls.waits(r, interval_ms=3_600_000).select("host", "seq", "wait_ms")


def stop_hosts(s, d):
    return crawls.stops(_outcomes(s, d))


def crawl_stop(s, d):
    return crawls.crawl_stop(_outcomes(s, d).withColumn("at_ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000")))


def vitals(s, d):
    """Per user: the sum of views as shifts, the longest click as interaction, the last purchase as largest paint."""
    e = table(s, d, "events")
    v = e.groupBy("user_id").agg(
        F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value") / 10000)), 6).alias("cls"),
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("inp"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("value") * 20), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("lcp"),
    )
    return v.select("user_id", "cls", "inp", "lcp", *[network.rating(k, F.col(k)).alias(f"{k}_rating") for k in ("cls", "inp", "lcp")])


def events_hourly(s, d):
    """Tumbling windows over events; beyond what the reference has."""
    e = table(s, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def events_sessions(s, d):
    """Sessions of a user with gaps of six hours; beyond what the reference has."""
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


def report_availability(s, d):
    """Per page: whether a report stands, its words and headings, and how many dates were found; absent is null."""
    reports = table(s, d, "content_reports").groupBy("page_id").agg(F.count("*").alias("n_reports"), F.max("word_count").alias("word_count"), F.max(F.size("outline")).alias("n_headings"))
    dates = table(s, d, "entity_dates").where(F.col("value").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n_dates"))
    return _pages(s, d).select("page_id").join(reports, "page_id", "left").join(dates, "page_id", "left")


def robots_verdicts(s, d):
    return crawls.robots_verdicts(_pages(s, d), crawls.sample_robots(s), AGENT)


def frontier(s, d):
    found = _links(s, d).where("internal").select("page_id", urls.normalize(F.col("url")).alias("dst"))
    own = _pages(s, d).select(F.col("page_id").cast("long").alias("page_id"), urls.normalize(F.col("url")).alias("src"))
    edges = own.join(found, "page_id").select("src", "dst").distinct()
    return crawls.frontier_rounds(own.select(F.col("src").alias("url")), edges)


def queries() -> dict:
    p, r = _pages, lambda s, d: table(s, d, "crawl_records")
    reports = lambda s, d: table(s, d, "content_reports")
    return {
        "p1_found": lambda s, d: timestamps.p1_found(table(s, d, "entity_dates"), r(s, d), table(s, d, "sites")),
        "p5_found": lambda s, d: nested.p5_found(r(s, d)),
        "url_normalize": url_normalize, "url_normalize_dedupe": url_dedupe, "url_hosts": url_parts, "url_tracking_params": url_tracking, "url_redact": url_redact,
        "links_all": links_all, "links_internal_external": link_targets,
        "links_by_host": lambda s, d: links.links_by_host(_links(s, d)), "links_totals": lambda s, d: links.link_totals(_links(s, d)), "links_zone_histogram": lambda s, d: links.zone_histogram(_links(s, d)),
        "page_titles": page_titles, "page_outline": page_outline, "outline_violations": page_outline_violations,
        "report_outline": lambda s, d: content.report_outline(reports(s, d)), "report_outline_violations": lambda s, d: content.outline_violations(content.report_outline(reports(s, d)), "report_id"),
        "page_word_count": lambda s, d: content.word_counts(p(s, d)), "doc_word_count": doc_words, "doc_language_stopwords": lambda s, d: content.stopword_language(table(s, d, "documents")),
        "doc_facts": doc_facts, "doc_availability": doc_availability, "redact_documents": doc_redacted,
        "entity_best_tier": entity_best_tier, "entity_dedupe": entity_dedupe, "entity_first_of_best": entity_first, "entity_date_fallback": lambda s, d: entities.date_fallback(table(s, d, "entity_dates")),
        "crawl_summary": lambda s, d: crawls.summary(r(s, d)), "crawl_reasons": lambda s, d: crawls.reasons(r(s, d)), "crawl_warnings": lambda s, d: crawls.warnings(r(s, d)),
        "crawl_domain_coverage": lambda s, d: crawls.domain_coverage(r(s, d)), "crawl_latest": lambda s, d: crawls.latest(r(s, d)),
        "net_host_rollup": lambda s, d: network.host_rollup(_requests(s, d)), "net_totals": net_totals, "net_status_classes": net_status_classes, "net_skip_reasons": net_skip_reasons,
        "net_body_budget": net_body_budget, "event_ring_buffer": event_ring, "error_streaks": error_streaks, "backoff_ladder": backoff_ladder, "rate_limit_waits": rate_limit_waits, "stop_reasons": stop_hosts, "crawl_stop": crawl_stop,
        "vitals_ratings": vitals, "events_tumbling": events_hourly, "events_session": events_sessions, "availability_summary": report_availability,
        "stack_signatures": lambda s, d: network.technologies(p(s, d)), "third_party_hosts": lambda s, d: network.third_party_hosts(p(s, d)),
        "css_declarations": lambda s, d: network.css_declarations(p(s, d)), "css_tokens_topk": lambda s, d: network.top_tokens(network.css_declarations(p(s, d))),
        "css_breakpoints": lambda s, d: design.breakpoints(p(s, d)), "css_fonts": lambda s, d: design.fonts(p(s, d)), "css_grids": lambda s, d: design.grids(p(s, d)), "css_colors": lambda s, d: design.colors(p(s, d)),
        "archive_pages": lambda s, d: archive.archives(p(s, d)).select("page_id", "name", F.length("content").alias("bytes")), "flat_records": lambda s, d: nested.flatten_records(r(s, d)),
        "robots_verdicts": robots_verdicts, "frontier_rounds": frontier,
        "content_split": lambda s, d: page_tree.splits(p(s, d)), "regions": lambda s, d: page_tree.region_rows(p(s, d)), "distill_pages": lambda s, d: page_tree.distilled(p(s, d)),
        "layout_pages": lambda s, d: page_tree.layouts(p(s, d)), "find_pages": lambda s, d: page_tree.find_regions(p(s, d), "calendar"), "scrape_fields": lambda s, d: page_tree.scrape(p(s, d), SHAPE),
        "component_inventory": lambda s, d: page_tree.components(p(s, d)), "page_declared": lambda s, d: page_tree.declared(p(s, d)), "page_media": lambda s, d: page_tree.media(p(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return SQL
