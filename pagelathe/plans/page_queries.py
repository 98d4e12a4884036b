"""Further queries of the core: what pages state and are built of, the frontier, and reports; with the SQL that checks them.

The SQL is written for these tables from what each operator is to give, with another engine's own functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.operators import facts, frontier, page_tree, reports, stack, subtrees
from pagelathe.plans.core_queries import _links, _pages, _requests
from pagelathe.session import table
from pagelathe.sources import dom


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crawl_records")


def _expansion(s, d):
    """Every page of the table is discovered from at depth 1 but the first of its site, which is the seed."""
    p = _pages(s, d)
    seeds = p.groupBy("site_id").agg(F.min("page_id").alias("page_id")).select(F.col("page_id").cast("long").alias("page_id"), F.lit(0).alias("depth"))
    found = frontier.discoveries(_links(s, d), facts.pagination(p)).join(seeds, "page_id")
    seen = p.join(seeds, "page_id", "left_semi").select(urls.normalize(F.col("url")).alias("url"))
    return frontier.expanded(found, seen, table(s, d, "sites"))


def _crawl_requests(s, d):
    r = _records(s, d).where(F.col("crawl_name").isNotNull())
    return r.select(F.col("crawl_name").alias("host"), F.col("record_id").alias("seq"), F.expr("unix_micros(cast(written_at as timestamp)) div 1000").alias("at_ms"), F.when(F.col("crawl_name").startswith("shop."), 5000).otherwise(0).alias("crawl_delay_ms"))


def queries() -> dict:
    return {
        "page_facts": lambda s, d: facts.facts(_pages(s, d)),
        "page_best_facts": lambda s, d: facts.best_facts(facts.facts(_pages(s, d))),
        "record_facts": lambda s, d: facts.record_facts(_records(s, d)),
        "record_best_facts": lambda s, d: facts.best_facts(facts.record_facts(_records(s, d)), "record_id"),
        "record_types": lambda s, d: reports.declared_types(_records(s, d)),
        "record_lines": lambda s, d: reports.page_lines(reports.declared_types(_records(s, d)), facts.record_facts(_records(s, d))),
        "page_pagination": lambda s, d: facts.pagination(_pages(s, d)),
        "page_assets": lambda s, d: stack.assets(_pages(s, d)).select("page_id", "pos", "tag", "url"),
        "page_technologies": lambda s, d: stack.technologies(_pages(s, d)),
        "page_third_parties": lambda s, d: stack.third_parties(_pages(s, d)),
        "page_consent": lambda s, d: stack.consent_platforms(_pages(s, d)),
        "links_rel_tokens": lambda s, d: _links(s, d).select(F.explode("rel").alias("rel")).groupBy("rel").agg(F.count("*").alias("n")),
        "frontier_expand": lambda s, d: _expansion(s, d).select("page_id", "seq", "url", "depth", "reason", "rank", "skip"),
        "frontier_skips": lambda s, d: frontier.skip_tally(_expansion(s, d)),
        "frontier_next": lambda s, d: frontier.next_pages(_expansion(s, d).where(F.col("skip").isNull())).select("url", "depth", "reason", "rank"),
        "paced_requests": lambda s, d: frontier.paced(_crawl_requests(s, d), 1000).select("host", "seq", "wait_ms", "wait_reason"),
        "fetchable_urls": lambda s, d: _records(s, d).where(F.col("url").isNotNull()).select("record_id", urls.may_fetch(F.col("url")).alias("fetchable")),
        "crawl_reason_lines": lambda s, d: reports.reason_lines(_records(s, d)),
        "crawl_texts": lambda s, d: reports.crawl_texts(_records(s, d)),
        "crawl_resources": lambda s, d: reports.resource_rollup(_records(s, d).select("crawl_name", F.col("outcome.driver").alias("kind"), F.length("data").cast("double").alias("bytes")), "crawl_name"),
        "net_host_order": lambda s, d: reports.host_order(_requests(s, d)),
        "media_inventory": lambda s, d: reports.media_inventory(page_tree.media(_pages(s, d))),
        "pages_without_frame": lambda s, d: subtrees.without(dom.dom_nodes(_pages(s, d)), subtrees.matching(_pages(s, d), "nav, footer, aside")).groupBy("page_id").agg(F.count("*").alias("n_elements")),
        "element_names": lambda s, d: subtrees.element_names(_pages(s, d), "h1, nav a"),
        "page_handles": lambda s, d: subtrees.read_handles(_pages(s, d), 3),
        "page_shells": lambda s, d: reports.shells(page_tree.region_rows(_pages(s, d)), _pages(s, d)),
    }


_TYPES = """WITH n AS (SELECT record_id, unnest(json_extract(data, '$.structured.jsonLd[*]')) AS node FROM crawl_records WHERE json_valid(data)),
ty AS (SELECT record_id, unnest(CASE json_type(node, '$."@type"') WHEN 'VARCHAR' THEN [json_extract_string(node, '$."@type"')] WHEN 'ARRAY' THEN json_extract_string(node, '$."@type"[*]') END) AS raw FROM n),
counted AS (SELECT record_id, regexp_extract(trim(raw), '([^/#]*)[/#]?$', 1) AS type, count(*) AS n FROM ty WHERE raw IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, type) AS pos, type, n FROM counted WHERE type <> '')"""
_REASONS = """c AS (SELECT crawl_name, outcome.reason AS reason, count(*) AS n FROM crawl_records WHERE outcome.reason IS NOT NULL GROUP BY 1, 2),
r AS (SELECT crawl_name, n, reason, row_number() OVER (PARTITION BY crawl_name ORDER BY n DESC, reason) AS pos, count(*) OVER (PARTITION BY crawl_name) AS whole FROM c),
lines AS (SELECT crawl_name, CAST(pos AS INT) AS pos, CASE WHEN pos <= 6 THEN n || ' ' || CASE WHEN length(reason) > 60 THEN rtrim(substring(reason, 1, 59), ' ') || '…' ELSE reason END ELSE '… ' || (whole - 6) || ' more' END AS line FROM r WHERE pos <= 7)"""

SQL = {
    "record_types": f"{_TYPES} SELECT record_id, CAST(pos AS INT) AS pos, type, n FROM ranked WHERE pos <= 2",
    "crawl_reason_lines": f"WITH {_REASONS} SELECT crawl_name, pos, line FROM lines",
    "crawl_texts": f"""WITH {_REASONS}, k AS (SELECT crawl_name, count(*) AS n, count(*) FILTER (outcome.kind = 'fetched') AS f, count(*) FILTER (outcome.kind = 'error') AS e, count(*) FILTER (outcome.kind = 'skipped') AS s FROM crawl_records GROUP BY 1),
b AS (SELECT crawl_name, 'reasons' || chr(10) || string_agg('  ' || line, chr(10) ORDER BY pos) AS below FROM lines GROUP BY 1)
SELECT k.crawl_name, k.crawl_name || ': ' || n || CASE WHEN n = 1 THEN ' record' ELSE ' records' END || ', ' || f || ' fetched, ' || e || ' error, ' || s || ' skipped' || coalesce(chr(10) || below, '') AS text FROM k LEFT JOIN b ON b.crawl_name = k.crawl_name""",
    "crawl_resources": "SELECT crawl_name, coalesce(nullif(trim(outcome.driver), ''), 'other') AS kind, count(*) AS n, CAST(sum(length(data)) AS DOUBLE) AS bytes FROM crawl_records GROUP BY 1, 2",
    "net_host_order": "WITH c AS (SELECT user_id AS host, count(*) FILTER (event_type IN ('click', 'purchase')) AS n_api, count(*) AS n FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n_api DESC, n DESC, host) AS INT) AS pos, host, n_api, n FROM c",
    "paced_requests": """WITH q AS (SELECT crawl_name AS host, record_id AS seq, epoch_us(written_at) // 1000 AS at_ms, CASE WHEN starts_with(crawl_name, 'shop.') THEN 5000 ELSE 0 END AS delay FROM crawl_records WHERE crawl_name IS NOT NULL),
g AS (SELECT host, seq, delay, at_ms - lag(at_ms) OVER (PARTITION BY host ORDER BY at_ms, seq) AS since FROM q)
SELECT host, seq, CAST(greatest(coalesce(1000 - since, 0), coalesce(delay - since, 0), 0) AS BIGINT) AS wait_ms,
CASE WHEN greatest(coalesce(1000 - since, 0), coalesce(delay - since, 0), 0) <= 0 THEN 'go' WHEN 1000 >= delay THEN 'rate-limit' ELSE 'crawl-delay' END AS wait_reason FROM g""",
    "fetchable_urls": r"""WITH u AS (SELECT record_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d+$', '') AS host FROM crawl_records WHERE url IS NOT NULL)
SELECT record_id, scheme IN ('http', 'https') AND host <> '' AND NOT regexp_matches(host, '(^|\.)localhost$')
AND NOT regexp_matches(host, '^(0|10|127|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01])|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\.[0-9]') AND NOT regexp_matches(host, '^\[?(::1?\]?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)') AS fetchable FROM u""",
    "links_rel_tokens": r"""WITH a AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '<a\s[^>]*href=[^>]*>', 0, 'i')) AS tag FROM pages WHERE html IS NOT NULL),
t AS (SELECT unnest(list_distinct(string_split_regex(lower(trim(regexp_extract(tag, '\srel\s*=\s*"([^"]*)"', 1, 'i'))), '\s+'))) AS rel FROM a) SELECT rel, count(*) AS n FROM t WHERE rel <> '' GROUP BY rel""",
}

_OBJECTS = r"""WITH tree AS (SELECT r.record_id, t.type, t.fullkey FROM crawl_records r, json_tree(CASE WHEN json_valid(r.data) THEN r.data ELSE '{}' END) t),
objects AS (SELECT record_id, fullkey, regexp_replace(fullkey, '(\.("[^"]*"|[^."\[]+))?(\[\d+\])*$', '') AS above FROM tree WHERE type = 'OBJECT' AND regexp_matches(fullkey, '^\$\.structured\.(jsonLd|microdata)($|[.\[])')),
plain AS (SELECT record_id, above, fullkey, 'data' || regexp_replace(substring(fullkey, 2), '\."([^"]*)"', '.\1', 'g') AS path FROM objects),
flat AS (SELECT c.record_id, coalesce(p.path, '$') AS parent_path, c.path AS child_path FROM plain c LEFT JOIN plain p ON p.record_id = c.record_id AND p.fullkey = c.above)"""
SQL["p5_found"] = f"""{_OBJECTS} SELECT record_id, parent_path, child_path FROM flat
UNION ALL SELECT record_id, '$', 'warnings[' || (i - 1) || ']' FROM (SELECT record_id, unnest(warnings) AS w, generate_subscripts(warnings, 1) AS i FROM crawl_records) WHERE w IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return SQL
