"""Technologies, third parties, the frontier, pacing, redaction and reports on small tables."""

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import http, text, urls
from pagelathe.operators import crawls, frontier, reports, stack


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_technologies(spark):
    one = """<html><head><meta content="WordPress 6.4.2" name=generator><script src="https://www.googletagmanager.com/gtag/js?id=1"></script><script>window.dataLayer = []</script></head>
<body data-v-app><img src=/wp-content/a.png><p>a reaction to cookies and consent, data-reactroot</p><div id="cookie-bar">We use cookies <button>ok</button></div><!-- <div id="___gatsby"> --></body></html>"""
    pages = spark.createDataFrame([(1, "https://a.test/x", one), (2, "https://b.test/", "<p>Shopify and ng-version are words here</p><div class='x cc-window y'></div>"), (3, None, None), (4, "https://c.test/", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.technology): (r.category, r.evidence, r.matched) for r in stack.technologies(pages).collect()}
    assert set(got) == {(1, "Google Analytics"), (1, "WordPress"), (1, "Vue"), (1, "Google Tag Manager")}
    assert got[1, "WordPress"] == ("framework", "asset-host", "https://a.test/wp-content/a.png") and got[1, "Google Analytics"][1] == "script-url"
    requests = spark.createDataFrame([(2, 0, "https://cdn.b2.test/x.js", "script", {"X-Vercel-Id": "a"}), (2, 1, "https://stats.google-analytics.com/c", "fetch", {"Server": "nginx"})], "page_id long, seq int, url string, resource_type string, response_headers map<string,string>")
    cookies = spark.createDataFrame([(2, "_ga_1", "b.test"), (2, "other", "b.test")], "page_id long, name string, domain string")
    more = {(r.technology, r.evidence) for r in stack.technologies(pages, requests, cookies).where("page_id = 2").collect()}
    assert more == {("Vercel", "response-header"), ("Google Analytics", "asset-host")}
    hosts = {(r.page_id, r.host): (r.channel, r.n, r["class"]) for r in stack.third_parties(pages, requests).collect()}
    assert hosts == {(1, "www.googletagmanager.com"): ("referenced", 1, "tracker"), (2, "cdn.b2.test"): ("recorded", 1, "cdn"), (2, "stats.google-analytics.com"): ("recorded", 1, "tracker")}
    assert {(r.page_id, r.platform) for r in stack.consent_platforms(pages).collect()} == {(1, "unnamed"), (2, "Cookie Consent")}
    assert stack.technologies(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("../../../../../../x?b=2&a=1&utm_source=q", "https://a.test/x?a=1&b=2"), ("..", "https://a.test/p/q/"), (".", "https://a.test/p/q/r/"), ("/a/./b/../index.html#top", "https://a.test/a/"), ("https://A.test:443?t=2&t=1", "https://a.test/?t=2&t=1"),
        ("?q=a%20b&flag", "https://a.test/p/q/r/s?flag=&q=a+b"), ("mailto:x@a.test", None), ("//b.test:80/x", "https://b.test:80/x"), ("", "https://a.test/p/q/r/s"),
    ],
)
def test_normal_form_of_links(spark, href, want):
    assert column(spark, [href], lambda c: urls.normalize(c, base=F.lit("https://a.test/p/q/r/s")))[0] == want


def test_redaction(spark):
    assert column(spark, ["https://u:p@a.test/x?author=me&token=1&Token=2&token=3#f", "https://a.test/x?author=me&pin=3", "no url", "https://a.test/?code=1"], urls.redact_url) == [
        "https://[redacted]@a.test/x?author=me&token=[redacted]&Token=[redacted]#f", "https://a.test/x?author=me&pin=3", "no url", "https://a.test/?code=[redacted]",
    ]
    body = ['{"author":"a","api_key" : "x\\"y","nested":{"Session-ID":"q","n":"v"}}', "a=1&csrf=2&password=p q=3", "code=1&encode=2", "[1]", None]
    assert column(spark, body, text.redact_body) == ['{"author":"a","api_key" : "[redacted]","nested":{"Session-ID":"[redacted]","n":"v"}}', "a=1&csrf=2&password=[redacted] q=3", "code=[redacted]&encode=2", "[1]", None]
    headers = {"Set-Cookie": 'sid=a=b; Path=/; Expires=Wed, 09 Sep 2026 10:00:00 GMT\nx="q"; Secure\ngone=; Max-Age=0\nbroken', "Cookie": "a=1; b=2; ", "X-Author": "me", "X-Cookie-Hash": "h", "Authorization": "B"}
    row = spark.createDataFrame([(headers, {"cookie": "a=1; odd"})], "h map<string,string>, o map<string,string>").select(http.redacted_headers(F.col("h")).alias("h"), http.redacted_headers(F.col("o")).alias("o")).first()
    assert row.h == {"Set-Cookie": 'sid=[redacted]; Path=/; Expires=Wed, 09 Sep 2026 10:00:00 GMT\nx="[redacted]"; Secure\ngone=; Max-Age=0\n[redacted]', "Cookie": "a=[redacted]; b=[redacted]; ", "X-Author": "me", "X-Cookie-Hash": "[redacted]", "Authorization": "[redacted]"}
    assert row.o == {"cookie": "[redacted]"}
    assert column(spark, ["application/xhtml+xml", "application/graphql", "TEXT/plain; charset=x", None], http.keeps_body) == [True, False, True, False]


def test_addresses_no_crawl_may_fetch(spark):
    given = ["http://127.0.0.1/", "http://[::1]:80/", "http://[fe80::1]/", "http://[fd00::2]/", "http://[::ffff:10.0.0.1]/", "http://localhost:3/", "ftp://a.test/", "https://a.test/", "http://[2001:db8::1]/", "http://128.0.0.1/", None]
    assert column(spark, given, urls.may_fetch) == [False] * 7 + [True, True, True, False]


def test_cookies_last_write(spark):
    rows = [(1, 0, "a.test", "s=1; Max-Age=60; Expires=Wed, 09 Sep 2026 10:00:00 GMT\nt=2; Domain=.A.test; SameSite=odd", "2024-01-01 00:00:00"), (1, 1, "a.test", "s=3; Expires=Wed, 09-Sep-2026 10:00:00 GMT; HttpOnly\n=x\nnone", "2024-01-01 00:00:00"), (2, 0, "b.test", None, None)]
    df = spark.createDataFrame(rows, "page_id long, seq int, host string, header string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    got = {(r.page_id, r.name, r.domain): (str(r.expires), r.http_only, r.same_site) for r in http.cookie_inventory(df).collect()}
    assert got == {(1, "s", "a.test"): ("2026-09-09 10:00:00", True, None), (1, "t", "a.test"): ("None", False, None)}


def test_frontier(spark):
    links = spark.createDataFrame(
        [(1, 0, "/a", "https://a.test/a", "nav"), (1, 1, "/b#x", "https://a.test/b#x", "content"), (1, 2, "/b", "https://a.test/b", "footer"), (1, 3, "x:", "x:", "content"), (1, 4, "//o.test", "https://o.test/", "content"), (1, 5, "/s", "https://a.test/s", "aside"), (2, 0, "/d", "https://a.test/d", "unknown")],
        "page_id long, pos int, href string, url string, zone string",
    )
    pager = spark.createDataFrame([(1, 0, "next", "https://a.test/?p=2"), (1, 1, "prev", "https://a.test/?p=0"), (1, 2, "numbered", "https://a.test/?p=3")], "page_id long, pos int, kind string, href string")
    depths = spark.createDataFrame([(1, 0), (2, 3)], "page_id long, depth int")
    seen, hosts = spark.createDataFrame([("https://a.test/s",)], "url string"), spark.createDataFrame([("A.test",)], "host string")
    got = frontier.expanded(frontier.discoveries(links, pager).join(depths, "page_id"), seen, hosts)
    skips = {(r.href): r.skip for r in got.collect()}
    assert skips == {"/a": None, "/b#x": None, "/b": "already-seen", "x:": "non-document-scheme", "//o.test": "external-host", "/s": "already-seen", "/d": "depth-cap", "https://a.test/?p=2": None, "https://a.test/?p=3": None}
    queue = got.where("skip is null")
    assert [r.url for r in frontier.next_pages(queue).collect()] == ["https://a.test/?p=2", "https://a.test/?p=3", "https://a.test/b", "https://a.test/a"]
    assert frontier.next_pages(queue, 3, 2).count() == 1 and frontier.merged(queue.limit(1), queue).count() == 4
    assert {r.reason: r.n for r in frontier.skip_tally(got).collect()} == {"non-document-scheme": 1, "external-host": 1, "already-seen": 2, "depth-cap": 1}


def test_pacing(spark):
    rows = [("a", 1, 0, 0, None), ("a", 2, 300, 0, None), ("a", 3, 400, 5000, None), ("a", 4, 9000, 0, 9500), ("b", 5, 9000, 0, 9001)]
    df = spark.createDataFrame(rows, "host string, seq int, at_ms long, crawl_delay_ms int, retry_at_ms long")
    assert [(r.wait_ms, r.wait_reason) for r in frontier.paced(df, 1000).orderBy("seq").collect()] == [(0, "go"), (700, "rate-limit"), (4900, "crawl-delay"), (500, "backoff"), (1, "backoff")]


def test_robots_by_host(spark):
    files = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /x\nAllow: /x\nDisallow: /y\n"), ("*", "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:")], "host string, text string")
    pages = spark.createDataFrame([(1, "https://a.test/x"), (2, "https://a.test/y?z"), (3, "https://b.test/y"), (4, None)], "page_id long, url string")
    rules = crawls.robots_rules(files)
    assert {r.page_id: (r.allowed, r.reason) for r in crawls.robots_verdicts(pages, rules, "other/1").collect()} == {1: (True, "allow-rule"), 2: (False, "disallow-rule"), 3: (True, "no-rule-matched"), 4: (False, "unparseable-url")}
    assert {r.page_id: r.reason for r in crawls.robots_verdicts(pages, rules, "my-bot/1").collect()}[3] == "disallow-rule"
    assert {r.reason for r in crawls.robots_verdicts(pages, rules.limit(0), "x").collect()} == {"no-group-matched", "unparseable-url"}


def test_reports(spark):
    rows = [("c", i, n) for i, n in enumerate([3, 1, 2, 9, 8, 7, 6, 5])] + [("d", 0, 1)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = [(r.k, r.pos, r.line) for r in reports.capped(df, "k", [F.col("n").desc()], F.col("n").cast("string"), 3).orderBy("k", "pos").collect()]
    assert got == [("c", 1, "9"), ("c", 2, "8"), ("c", 3, "7"), ("c", 4, "… 5 more"), ("d", 1, "1")]
    assert reports.domains_of(["network"]) == ["entities", "links", "network"]
    with pytest.raises(ValueError):
        reports.domains_of(["weather"])
    entries = spark.createDataFrame([(1, "img", 5.0), (1, " ", None), (1, None, float("nan")), (1, "img", -1.0)], "page_id long, kind string, bytes double")
    assert {(r.kind, r.n, r.bytes) for r in reports.resource_rollup(entries).collect()} == {("img", 2, 5.0), ("other", 2, None)}
    assert column(spark, [1.5, 2.4999, None, float("nan"), float("inf"), -1.5], reports.rounded, "double") == [2, 2, None, None, None, -1]
    assert column(spark, [999, 1500, 2_500_000], text.bytes_text, "long") == ["999 B", "1.5 kB", "2.5 MB"] and column(spark, ["https://schema.org/Person", "a#B", "C/"], text.short_type) == ["Person", "B", "C"]
    assert column(spark, ["Hugo 0.121", "v2", " Ghost ", "", None], text.product_of) == ["Hugo", "v2", "Ghost", None, None]


PAGE = "<body><nav class='a b'><a href=1>n</a><p>m</p></nav><div><h1 id='x y'>t</h1><p>c<b>d</b></p></div><footer><p>f</p></footer></body>"


def test_subtrees(spark):
    from pagelathe.operators import subtrees
    from pagelathe.sources import dom

    pages = spark.createDataFrame([(1, PAGE, "z"), (2, None, "z"), (3, "<p>only</p>", "z")], "page_id long, html string, tag string")
    nodes = dom.dom_nodes(pages)
    left = subtrees.without(nodes, subtrees.matching(pages, "nav, footer")).orderBy("page_id", "node_id").collect()
    assert [(r.page_id, r.tag) for r in left] == [(1, "body"), (1, "div"), (1, "h1"), (1, "p"), (1, "b"), (3, "p")]
    assert subtrees.without(nodes, subtrees.matching(pages, "table")).count() == nodes.count()
    assert [r.tag for r in subtrees.around(nodes, subtrees.matching(pages, "div > p")).orderBy("node_id").collect()] == ["body", "div", "p", "b"]
    named = {r.description: (r.css, r.path) for r in subtrees.element_names(pages, "nav, h1, b").collect()}
    assert named == {"nav.a": ("nav:nth-child(1)", [0]), "h1#x y": ("#x\\ y", [1, 0]), "b": ("div:nth-child(2) > p:nth-child(2) > b:nth-child(1)", [1, 1, 0])}
    root = dom.parse(PAGE)
    assert subtrees.by_path(root, [1, 1, 0]).tag == "b" and subtrees.by_path(root, [9]) is None and subtrees.handle_text(root, 999) is None
    got = {r.text for h in range(1, 9) for r in subtrees.read_handles(pages.where("page_id = 1"), h).collect()}
    assert "n" in got and subtrees.read_handles(pages, 999).count() == 0
    assert column(spark, ["Shop.Ex_A.test:8080", "--", None], text.crawl_name) == ["shop.ex-a.test-8080", "crawl", "crawl"] and column(spark, [1536, 3 << 20], text.size_text, "long") == ["2 KB", "3.0 MB"]
