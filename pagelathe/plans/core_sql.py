"""The SQL of the core's queries, for an engine that has the tables as views."""

from __future__ import annotations

import re

from pagelathe.functions.text import CODES, SCRIPTS, STOPWORDS

_ABS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
_PARTS = rf"""lower(nullif(regexp_extract(url, {_ABS}, 1), '')) AS scheme, lower(nullif(regexp_replace(regexp_extract(url, {_ABS}, 2), '^[^@]*@', ''), '')) AS host,
regexp_extract(url, {_ABS}, 3) AS path, regexp_extract(url, {_ABS}, 4) AS query"""
_PAGES = f"pg AS (SELECT page_id, url, html, {_PARTS} FROM pages)"
_TRACKS = r"(lower(name) LIKE 'utm\_%' ESCAPE '\' OR lower(name) IN ('gclid', 'fbclid'))"
_PARAMS = f"pr AS (SELECT page_id, split_part(x, '=', 1) AS name, x, i FROM (SELECT page_id, unnest(string_split(query, '&')) AS x, generate_subscripts(string_split(query, '&'), 1) AS i FROM pg) WHERE x <> '')"
_NORM = f"""{_PAGES}, {_PARAMS}, kept AS (SELECT page_id, string_agg(x, '&' ORDER BY name, i) AS search FROM pr WHERE NOT {_TRACKS} GROUP BY page_id),
norm AS (SELECT pg.page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN regexp_replace(path, '/index\\.html$', '/') = '' THEN '/' ELSE regexp_replace(path, '/index\\.html$', '/') END
|| CASE WHEN coalesce(search, '') = '' THEN '' ELSE '?' || search END END AS normalized FROM pg LEFT JOIN kept USING (page_id))"""
_BARE = r"regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis')"
_ANCHORS = rf"""an AS (SELECT page_id, url AS page_url, unnest(a) AS href, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all({_BARE}, '<a\s[^>]*href="([^"]*)"', 1, 'i') AS a FROM pages WHERE html IS NOT NULL))"""
_RESOLVED = "rs AS (SELECT an.page_id, pos, CASE WHEN href LIKE '/%' THEN scheme || '://' || host || href ELSE href END AS target, CASE WHEN href LIKE '/%' THEN true ELSE lower(regexp_extract(href, '^[a-z]+://[^/?#]*')) = scheme || '://' || host END AS internal FROM an JOIN pg ON an.page_id = pg.page_id)"
_HEADS = rf"""hd AS (SELECT page_id, unnest(h) AS raw, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all({_BARE}, '<h[1-6]\b[^>]*>.*?</h[1-6]>', 0, 'is') AS h FROM pages WHERE html IS NOT NULL)),
ol AS (SELECT page_id, CAST(pos AS INT) AS pos, CAST(substr(raw, 3, 1) AS INT) AS level, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM hd)"""


def _violations(key: str) -> str:
    return f"""mk AS (SELECT *, lag(level) OVER (PARTITION BY {key} ORDER BY pos) AS before, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) AS h1s FROM ol)
SELECT {key}, 'skipped-level' AS kind, pos, level FROM mk WHERE level > before + 1
UNION ALL SELECT {key}, 'multiple-h1', pos, level FROM mk WHERE level = 1 AND h1s > 1
UNION ALL SELECT {key}, 'missing-h1', CAST(NULL AS INT), arg_min(level, pos) FROM ol GROUP BY {key} HAVING sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) = 0"""


_REPORT_OUTLINE = "ol AS (SELECT report_id, CAST(i - 1 AS INT) AS pos, h.level AS level, h.text AS text FROM (SELECT report_id, unnest(outline) AS h, generate_subscripts(outline, 1) AS i FROM content_reports))"
_EAST = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]"
_WORD = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"


def _words(column: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{_EAST}')) + len(regexp_extract_all(regexp_replace(coalesce({column}, ''), '{_EAST}', ' ', 'g'), '{_WORD}'))"


_SCRIPTS = tuple((lang, re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)) for lang, pattern in SCRIPTS)  # the same table in the other engine's writing
_STOPVALUES = ", ".join(f"('{lang}', '{w}')" for lang, ws in STOPWORDS.items() for w in ws.split())
_LANGUAGE = f"""WITH sc AS (SELECT doc_id, CASE {' '.join(f"WHEN len(regexp_extract_all(coalesce(text, ''), '{p}')) >= 4 THEN '{lang}'" for lang, p in _SCRIPTS)} END AS script FROM documents),
tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS w FROM documents), sw(lang, w) AS (VALUES {_STOPVALUES}),
vt AS (SELECT doc_id, lang, count(*) AS n FROM tk JOIN sw USING (w) GROUP BY ALL), rk AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m, count(*) OVER (PARTITION BY doc_id, n) AS ties FROM vt),
win AS (SELECT doc_id, lang FROM rk WHERE n = m AND ties = 1 AND n >= 3) SELECT doc_id, coalesce(script, lang) AS lang FROM sc LEFT JOIN win USING (doc_id) WHERE coalesce(script, lang) IS NOT NULL"""

_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]{2,})+"
_CODES = "|".join(CODES)
_PRICE = rf"(?:[$€£¥₹₽₩]|\b(?:{_CODES})\b)\s?(?:\d[\d.,'']*\d|\d)|(?:\d[\d.,'']*\d|\d)\s?(?:[$€£¥₹₽₩]|\b(?:{_CODES})\b)"
_PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]\d{2,4}){1,4}"
_FACTS = rf"""WITH f AS (SELECT doc_id, 'email' AS kind, regexp_extract_all(coalesce(text, ''), '{_EMAIL}') AS a FROM documents
UNION ALL SELECT doc_id, 'phone', list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_PHONE}'), lambda m: trim(m)), lambda m: length(regexp_replace(m, '\D', '', 'g')) BETWEEN 9 AND 15 AND (regexp_matches(m, '[+()\s]') OR length(regexp_replace(m, '\D', '', 'g')) >= 10)) FROM documents
UNION ALL SELECT doc_id, 'price', list_transform(regexp_extract_all(coalesce(text, ''), '{_PRICE}', 0, 'i'), lambda m: trim(m)) FROM documents)
SELECT doc_id, kind, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, unnest(a) AS value FROM f"""
_RANK = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END"
_BEST = f"bt AS (SELECT * FROM (SELECT *, {_RANK} AS tier, min({_RANK}) OVER (PARTITION BY page_id, field) AS best FROM entity_dates WHERE value IS NOT NULL) WHERE tier = best)"
_REQ = """rq AS (SELECT user_id AS host, event_id AS seq, ts, event_type, CASE event_type WHEN 'click' THEN 'xhr' WHEN 'purchase' THEN 'fetch' ELSE event_type END AS resource_type, value AS size,
CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status, event_type IN ('click', 'view') AS ok, event_type = 'error' AS failed FROM events)"""
_STREAK = f"""{_REQ}, isl AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM rq),
st AS (SELECT *, sum(CAST(failed AS INT)) OVER (PARTITION BY host, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS streak FROM isl)"""
_CSS = r"""sh AS (SELECT unnest(regexp_extract_all(html, '<style[^>]*>(.*?)</style>', 1, 'is')) AS css FROM pages),
bd AS (SELECT unnest(regexp_extract_all(regexp_replace(css, '/\*.*?\*/', '', 'gs'), '\{([^{}]*)\}', 1)) AS body FROM sh),
dc AS (SELECT unnest(string_split(body, ';')) AS d FROM bd),
cs AS (SELECT lower(trim(split_part(d, ':', 1))) AS property, lower(trim(regexp_extract(d, '^[^:]*:(.*)$', 1))) AS value, count(*) AS n FROM dc WHERE contains(d, ':') GROUP BY ALL)"""


def _rate(c: str, good: float, fair: float) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= {good} THEN 'good' WHEN {c} <= {fair} THEN 'needs-improvement' ELSE 'poor' END AS {c}_rating"


_SIGNS = {"google-analytics": "google-analytics.com", "tag-manager": "googletagmanager.com", "jquery": "jquery", "wordpress": "wp-content", "shopify": "cdn.shopify.com", "react": "react", "no-js-fallback": 'class="no-js"', "noscript-notice": "<noscript"}
_RULES = [(False, "/item/", "^/item/"), (True, "/item/1", "^/item/1"), (False, "/*?page=", r"^/.*\?page="), (False, "/guide/*.html$", r"^/guide/.*\.html$")]
_RULEVALUES = ", ".join(f"({str(a).lower()}, '{p}', '{x}')" for a, p, x in _RULES)

SQL: dict[str, str] = {
    "url_normalize": f"WITH {_NORM} SELECT page_id, normalized FROM norm",
    "url_normalize_dedupe": f"WITH {_NORM} SELECT normalized, count(*) AS n_pages, min(page_id) AS first_page_id FROM norm WHERE normalized IS NOT NULL GROUP BY normalized",
    "url_hosts": f"WITH {_PAGES} SELECT page_id, scheme, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS site, path FROM pg",
    "url_tracking_params": f"WITH {_PAGES}, {_PARAMS} SELECT name, count(*) AS n, bool_or({_TRACKS}) AS tracks FROM pr GROUP BY name",
    "links_all": f"WITH {_ANCHORS} SELECT page_id, CAST(pos AS INT) AS pos, href FROM an",
    "page_titles": r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')), '') AS title FROM pages",
    "page_outline": f"WITH {_HEADS} SELECT page_id, pos, level, text FROM ol",
    "outline_violations": f"WITH {_HEADS}, {_violations('page_id')}",
    "report_outline": f"WITH {_REPORT_OUTLINE} SELECT report_id, pos, level, text FROM ol",
    "report_outline_violations": f"WITH {_REPORT_OUTLINE}, {_violations('report_id')}",
    "doc_word_count": f"SELECT doc_id, n_words, round(n_words / 200, 1) AS minutes FROM (SELECT doc_id, CAST({_words('text')} AS BIGINT) AS n_words FROM documents)",
    "doc_language_stopwords": _LANGUAGE,
    "doc_facts": _FACTS,
    "doc_availability": r"""SELECT doc_id, availability FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '\b(out of stock|sold out|unavailable)\b', 'i') THEN 'out-of-stock' WHEN regexp_matches(text, '\b(pre-?order)\b', 'i') THEN 'preorder'
WHEN regexp_matches(text, '\b(back-?order(ed)?)\b', 'i') THEN 'backorder' WHEN regexp_matches(text, '\b(discontinued)\b', 'i') THEN 'discontinued' WHEN regexp_matches(text, '\b(in stock|available now)\b', 'i') THEN 'in-stock' END AS availability FROM documents) WHERE availability IS NOT NULL""",
    "redact_documents": rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '[email]', 'g'), '((?:password|passwd|secret|token|api[_-]?key|authorization)\s*[=:]\s*)[^\s&;,]+', '\1[redacted]', 'gi') AS redacted FROM documents WHERE text IS NOT NULL",
    "entity_best_tier": f"WITH {_BEST} SELECT date_id, page_id, field, value, tier FROM bt",
    "entity_dedupe": "SELECT date_id, page_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field, value ORDER BY pos, date_id) AS rn FROM entity_dates WHERE value IS NOT NULL) WHERE rn = 1",
    "entity_first_of_best": f"WITH {_BEST} SELECT date_id, page_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY pos, date_id) AS rn FROM bt) WHERE rn = 1",
    "entity_date_fallback": "SELECT page_id, value, field FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE field WHEN 'published' THEN 0 ELSE 1 END, pos, date_id) AS rn FROM entity_dates WHERE field IN ('published', 'modified') AND value IS NOT NULL) WHERE rn = 1",
    "crawl_summary": "SELECT crawl_name, count(*) AS pages, CAST(sum(CASE WHEN outcome.kind = 'fetched' THEN 1 ELSE 0 END) AS BIGINT) AS fetched, CAST(sum(CASE WHEN outcome.kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN outcome.kind = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(coalesce(len(warnings), 0)) AS BIGINT) AS warnings, max(written_at) AS updated_at FROM crawl_records GROUP BY crawl_name",
    "crawl_reasons": "SELECT crawl_name, outcome.kind AS kind, outcome.reason AS reason, count(*) AS n FROM crawl_records WHERE outcome.reason IS NOT NULL GROUP BY ALL",
    "crawl_warnings": "SELECT w.phase AS phase, w.reason AS reason, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM crawl_records) WHERE w IS NOT NULL GROUP BY ALL",
    "crawl_domain_coverage": "SELECT domain, count(*) AS n FROM (SELECT unnest(CASE WHEN json_valid(data) THEN json_keys(CASE WHEN json_valid(data) THEN data ELSE '{}' END) ELSE ['(unreadable)'] END) AS domain FROM crawl_records WHERE data IS NOT NULL) GROUP BY domain",
    "crawl_latest": "SELECT crawl_name, count(*) AS pages FROM crawl_records GROUP BY crawl_name ORDER BY max(written_at) DESC, crawl_name LIMIT 1",
    "net_host_rollup": f"WITH {_REQ} SELECT host, count(*) AS n_requests, round(sum(coalesce(size, 0)), 4) AS bytes, CAST(sum(CASE WHEN resource_type IN ('xhr', 'fetch', 'eventsource', 'websocket') THEN 1 ELSE 0 END) AS BIGINT) AS n_api, array_to_string(list_sort(list_distinct(list(CAST(status // 100 AS VARCHAR) || 'xx'))), ',') AS classes FROM rq GROUP BY host",
    "net_totals": f"WITH {_REQ} SELECT count(*) AS n_requests, round(sum(size), 4) AS bytes, count(DISTINCT host) AS n_hosts FROM rq",
    "net_status_classes": f"WITH {_REQ} SELECT host, CAST(status // 100 AS VARCHAR) || 'xx' AS class, count(*) AS n FROM rq GROUP BY ALL",
    "net_skip_reasons": f"WITH {_REQ}, c AS (SELECT CASE WHEN event_type = 'view' THEN 'binary-type' WHEN event_type = 'error' THEN 'unreadable' WHEN size > 300 THEN 'over-cap' END AS reason, count(*) AS n FROM rq GROUP BY 1) SELECT v.reason, coalesce(n, 0) AS n FROM (VALUES ('binary-type'), ('unreadable'), ('over-cap'), ('evicted')) v(reason) LEFT JOIN c USING (reason)",
    "net_body_budget": f"WITH {_REQ} SELECT host, seq, sum(coalesce(size, 0)) OVER (PARTITION BY host ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 500.0 AS kept FROM rq",
    "event_ring_buffer": f"WITH {_REQ} SELECT host, seq, rn FROM (SELECT host, seq, CAST(row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS INT) AS rn FROM rq) WHERE rn <= 20",
    "error_streaks": f"WITH {_STREAK} SELECT host, seq, CAST(streak AS BIGINT) AS streak FROM st",
    "backoff_ladder": f"WITH {_STREAK} SELECT host, seq, least(greatest(1000.0 * pow(2, streak - 1), 1000.0), 60000.0)::DOUBLE AS backoff_ms FROM st WHERE failed",
    "rate_limit_waits": "WITH r AS (SELECT user_id AS host, event_id AS seq, epoch_us(ts) // 1000 AS at_ms FROM events) SELECT host, seq, CAST(coalesce(greatest(3600000 - (at_ms - lag(at_ms) OVER (PARTITION BY host ORDER BY at_ms, seq)), 0), 0) AS BIGINT) AS wait_ms FROM r",
    "stop_reasons": f"WITH {_STREAK} SELECT host, min(seq) AS stopped_at, CAST(arg_min(streak, seq) AS BIGINT) AS streak FROM st WHERE failed AND streak >= 5 GROUP BY host",
    "vitals_ratings": f"WITH v AS (SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN value / 10000 END), 6) AS cls, max(CASE WHEN event_type = 'click' THEN value END) AS inp, arg_max(CASE WHEN event_type = 'purchase' THEN value * 20 END, CASE WHEN event_type = 'purchase' THEN event_id END) AS lcp FROM events GROUP BY user_id) SELECT user_id, cls, inp, lcp, {_rate('cls', 0.1, 0.25)}, {_rate('inp', 200, 500)}, {_rate('lcp', 2500, 4000)} FROM v",
    "events_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k",
    "availability_summary": "WITH r AS (SELECT page_id, count(*) AS n_reports, max(word_count) AS word_count, CAST(max(len(outline)) AS INT) AS n_headings FROM content_reports GROUP BY page_id), e AS (SELECT page_id, count(*) AS n_dates FROM entity_dates WHERE value IS NOT NULL GROUP BY page_id) SELECT page_id, n_reports, word_count, n_headings, n_dates FROM pages LEFT JOIN r USING (page_id) LEFT JOIN e USING (page_id)",
    "stack_signatures": "SELECT page_id, technology FROM pages JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SIGNS.items()) + ") s(technology, needle) ON contains(lower(html), needle)",
    "third_party_hosts": f"WITH {_PAGES}, n AS (SELECT page_id, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS own, unnest(list_distinct(list_transform(regexp_extract_all(html, 'https?://([A-Za-z0-9.-]+)', 1), lambda h: lower(h)))) AS named FROM pg) SELECT named AS host, count(*) AS n_pages FROM n WHERE array_to_string(list_slice(string_split(named, '.'), -2, -1), '.') <> own GROUP BY named",
    "css_declarations": f"WITH {_CSS} SELECT property, value, n FROM cs",
    "css_tokens_topk": f"WITH {_CSS} SELECT property, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property ORDER BY n DESC, value) AS INT) AS rank FROM cs WHERE n >= 2) WHERE rank <= 24",
    "robots_verdicts": f"""WITH {_PAGES}, t AS (SELECT page_id, (CASE WHEN path = '' THEN '/' ELSE path END) || CASE WHEN query = '' THEN '' ELSE '?' || query END AS target FROM pg), ru(allow, path, pattern) AS (VALUES {_RULEVALUES}),
m AS (SELECT page_id, allow, ru.path AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(ru.path) DESC, allow DESC, ru.path DESC) AS rn FROM t JOIN ru ON regexp_matches(target, pattern))
SELECT page_id, coalesce(allow, true) AS allowed, CASE WHEN rule IS NULL THEN 'no-rule-matched' WHEN allow THEN 'allow-rule' ELSE 'disallow-rule' END AS reason, rule FROM t LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (page_id)""",
    "page_word_count": rf"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, n_words, round(n_words / 200, 1) AS minutes FROM (SELECT page_id, CAST({_words('plain')} AS BIGINT) AS n_words FROM t)""",
    "links_internal_external": f"WITH {_PAGES}, {_ANCHORS}, {_RESOLVED} SELECT page_id, CAST(pos AS INT) AS pos, target AS url, internal FROM rs",
    "links_totals": f"WITH {_PAGES}, {_ANCHORS}, {_RESOLVED} SELECT page_id, count(*) AS n_links, CAST(sum(CAST(internal AS INT)) AS BIGINT) AS n_internal, CAST(sum(1 - CAST(internal AS INT)) AS BIGINT) AS n_external FROM rs GROUP BY page_id",
    "links_by_host": f"WITH {_PAGES}, {_ANCHORS}, {_RESOLVED} SELECT lower(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM rs WHERE NOT internal GROUP BY 1",
    "frontier_rounds": f"WITH RECURSIVE {_NORM}, {_ANCHORS}, {_RESOLVED}, e AS (SELECT DISTINCT normalized AS src, target AS dst FROM rs JOIN norm USING (page_id) WHERE internal AND normalized IS NOT NULL), fr(url, depth) AS (SELECT DISTINCT normalized, 0 FROM norm WHERE normalized IS NOT NULL UNION SELECT dst, depth + 1 FROM fr JOIN e ON url = src WHERE depth < 3) SELECT url, min(depth) AS depth FROM fr GROUP BY url",
    "url_redact": rf"""WITH c AS (SELECT record_id, url, regexp_extract(url, '\?([^#]*)', 1) AS q FROM crawl_records WHERE url IS NOT NULL),
x AS (SELECT record_id, url, list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: regexp_replace(lower(url_decode(split_part(p, '=', 1))), '[^a-z0-9]', '', 'g')) AS names FROM c)
SELECT record_id, CASE WHEN len(list_filter(names, lambda n: regexp_matches(n, 'token|secret|password|passwd|apikey|accesskey|sessionid|credential|signature|authorization|authentication|cookie|^(auth|key|code|sig|jwt|bearer|pwd|otp|session|sid)$'))) > 0
OR regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN NULL ELSE url END AS redacted FROM x""",
    "css_grids": f"WITH {_CSS} SELECT property, value, n FROM cs WHERE property IN ('grid-template-columns', 'gap', 'column-gap', 'row-gap', 'grid-gap', 'max-width')",
    "css_colors": rf"""WITH {_CSS}, k AS (SELECT CASE WHEN regexp_matches(value, '^#[0-9a-f]{{3}}$') THEN regexp_replace(value, '^#(.)(.)(.)$', '#\1\1\2\2\3\3') WHEN regexp_matches(value, '^#[0-9a-f]{{6}}$') THEN value END AS color, n FROM cs WHERE regexp_matches(property, 'color$|^background$'))
SELECT color, CAST(sum(n) AS BIGINT) AS n FROM k WHERE color IS NOT NULL GROUP BY color""",
}
