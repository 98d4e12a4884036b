import pytest
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.functions import urls
from pagelathe.operators import content, crawls, entities, links, network, page_tree
from pagelathe.sources import dom

PAGE = """<!doctype html><html lang="en"><head><title>A  title</title><meta name="robots" content="noindex, nofollow"><meta property="og:title" content="OG"><meta name="twitter:title" content="TW">
<link rel="canonical" href="/c"><style>.a{color:#123;margin:0}</style><script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Product"},{"@type":"Offer"}]}</script><script type="application/ld+json">{bad</script></head>
<body><!-- <a href="/no">no</a> --><nav><ul><li><a href="/a" rel="next  NEXT nofollow">A</a><li><a href="b/../c?x=1#y">B</a></ul></nav>
<main><article><h1>One</h1><h3>Three</h3><p>First<p>Second &amp; third <a href="https://other.test/z">z</a></p></article></main>
<div itemscope itemtype="T/Product"><span itemprop="name">N</span><div itemprop="offers" itemscope itemtype="T/Offer"><meta itemprop="price" content="5"></div></div>
<footer><a href="//x.test/">X</a><a>none</a></footer></body></html>"""


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(1, "https://shop.site.test/d/p.html", PAGE, "extra"), (2, "https://shop.site.test/", None, "extra"), (3, "not a url", "", "extra"), (4, None, "<p>x", "extra")], "page_id long, url string, html string, tag string")


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    given = ["HTTP://Ex.Test/A/index.html?utm_source=f&b=2&a=1&a=0#t", "https://ex.test", "ftp://x/y", None, "nonsense", "https://ex.test/p?gclid=1", "https://ex.test/INDEX.html"]
    assert column(spark, given, urls.normalize) == ["http://ex.test/A/?a=1&a=0&b=2", "https://ex.test/", None, None, None, "https://ex.test/p", "https://ex.test/INDEX.html"]


def test_url_parts(spark):
    given = ["https://u:p@a.b.co.test:8080/x?token=1&q=2", None, "x"]
    assert column(spark, given, urls.host) == ["a.b.co.test:8080", None, None]
    assert column(spark, given, lambda c: urls.site(urls.host(c))) == ["co.test", None, None]
    assert column(spark, given, urls.redact_url)[0] == "https://[redacted]@a.b.co.test:8080/x?token=[redacted]&q=2"
    assert column(spark, ["10.0.0.1", "172.20.1.1", "8.8.8.8", "example.test"], urls.private_ipv4) == [True, True, False, False]


def test_links(spark, pages):
    nodes = dom.dom_nodes(pages)
    rows = links.links(nodes, pages).orderBy("page_id", "pos").collect()
    assert [(r.url, r.internal, r.zone) for r in rows] == [
        ("https://shop.site.test/a", True, "nav"), ("https://shop.site.test/d/c?x=1#y", True, "nav"), ("https://other.test/z", False, "content"), ("https://x.test/", False, "footer"),
    ]
    assert rows[0].rel == ["next", "nofollow"]
    found = links.links(nodes, pages)
    assert {r.host: r.n_links for r in links.links_by_host(found).collect()} == {"other.test": 1, "x.test": 1}
    assert links.links(dom.dom_nodes(pages.limit(0)), pages.limit(0)).count() == 0


def test_outline(spark, pages):
    heads = content.outline(dom.dom_nodes(pages))
    assert [(r.level, r.text) for r in heads.orderBy("pos").collect()] == [(1, "One"), (3, "Three")]
    given = spark.createDataFrame([(1, 0, 2), (1, 1, 4), (2, 0, 1), (2, 1, 1), (2, 2, 2), (3, 0, None)], "page_id long, pos int, level int")
    rows = sorted((r.page_id, r.kind, r.pos) for r in content.outline_violations(given).collect() if r.kind != "missing-h1")
    assert rows == [(1, "skipped-level", 1), (2, "multiple-h1", 1)]
    assert [r.page_id for r in content.outline_violations(given).where("kind = 'missing-h1'").collect()] == [1]


def test_words_and_money(spark):
    assert column(spark, ["It's a well-known fact", "日本語 text", None, ""], T.word_count) == [4, 4, 0, 0]
    assert [[(p.amount, p.currency) for p in v] for v in column(spark, ["only $1,299.00 or 1.299,50 €, 5 EUR", "no price"], T.prices)] == [[(1299.0, "USD"), (1299.5, "EUR"), (5.0, "EUR")], []]
    assert column(spark, ["call +44 20 7946 0958 or 2024-01-05"], T.phones) == [["+44 20 7946 0958"]]
    assert column(spark, ["hello"], T.fnv1a) == ["4f9f2cab"]
    assert column(spark, ["password=abc me@x.org"], T.struck_texts) == ["password=[redacted] [email]"]


def test_best_tier(spark):
    df = spark.createDataFrame([(1, "f", "a", "low", 0), (1, "f", "b", "high", 1), (1, "f", "c", "high", 2), (1, "g", "d", "low", 0), (1, "g", "e", None, 1)], "page_id long, field string, value string, confidence string, pos int")
    assert sorted(r.value for r in entities.best_tier(df, ["page_id", "field"]).collect()) == ["b", "c", "d"]
    assert sorted(r.value for r in entities.first_of_best(df, ["page_id", "field"], ["pos"]).collect()) == ["b", "d"]
    prices = spark.createDataFrame([(1, 5.0, "original"), (1, 4.0, None), (2, 3.0, None)], "page_id long, amount double, role string")
    assert sorted((r.amount, r.role) for r in entities.price_roles(prices).collect() if r.role) == [(4.0, "current"), (5.0, "original")]


def test_streaks_and_backoff(spark):
    rows = [("h", i, ok, failed) for i, (ok, failed) in enumerate([(False, True), (False, True), (False, False), (False, True), (True, False), (False, True)])]
    df = spark.createDataFrame(rows, "host string, seq int, ok boolean, failed boolean")
    st = crawls.streaks(df).orderBy("seq")
    assert [r.streak for r in st.collect()] == [1, 2, 2, 3, 0, 1]
    assert [r[0] for r in st.where("failed").select(crawls.backoff_ms(F.col("streak"))).collect()] == [1000.0, 2000.0, 4000.0, 1000.0]
    assert spark.range(1).select(crawls.backoff_ms(F.lit(40)), crawls.backoff_ms(F.lit(1), F.lit(0)), crawls.backoff_ms(F.lit(1), F.lit(86400))).first()[:] == (60000.0, 1000.0, 60000.0)


def test_robots(spark):
    text = "﻿# c\nDisallow: /lost\nUser-agent: A\nUser-agent: bot\nDisallow: /x # y\nAllow: /x/y\nDisallow:\nCrawl-delay: no\nUser-agent: *\nDisallow: /*.pdf$\n"
    rules = crawls.robots_rules(spark.createDataFrame([("h.test", text), ("e.test", "")], "host string, text string"))
    pages = spark.createDataFrame([(1, "https://h.test/x/z"), (2, "https://h.test/x/y"), (3, "https://h.test/lost"), (4, "https://other.test/x"), (5, None)], "page_id long, url string")
    got = {r.page_id: (r.allowed, r.reason) for r in crawls.robots_verdicts(pages, rules, "My-Bot/2").collect()}
    assert got == {1: (False, "disallow-rule"), 2: (True, "allow-rule"), 3: (True, "no-rule-matched"), 4: (True, "no-group-matched"), 5: (False, "unparseable-url")}
    other = {r.page_id: r.allowed for r in crawls.robots_verdicts(pages.where("page_id < 5").withColumn("url", F.lit("https://h.test/f.pdf")), rules, "someone").collect()}
    assert set(other.values()) == {False}


def test_frontier_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None), ("c", "a")], "src string, dst string")
    got = {r.url: r.depth for r in crawls.frontier_rounds(spark.createDataFrame([("a",), (None,)], "url string"), edges, 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_budget_and_ring(spark):
    df = spark.createDataFrame([("h", i, 4.0) for i in range(5)], "host string, seq int, size double")
    assert [r.seq for r in network.body_budget(df, "host", "seq", "size", 10.0).where("kept").orderBy("seq").collect()] == [3, 4]
    assert [r.seq for r in network.ring(df, "host", "seq", 2).orderBy("seq").collect()] == [3, 4]
    r = spark.range(1).select(network.rating("cls", F.lit(0.1)), network.rating("lcp", F.lit(2501)), network.rating("inp", F.lit(501)), network.rating("inp", F.lit(None).cast("double"))).first()
    assert r[:] == ("good", "needs-improvement", "poor", None)


def test_declared(pages):
    rows = page_tree.declared(pages).orderBy("page_id", "pos").collect()
    assert [r.source for r in rows] == ["json-ld", "json-ld", "warning", "microdata", "meta", "social", "seo"]
    assert rows[3].payload == '{"properties": {"name": ["N"], "offers": [{"properties": {"price": ["5"]}, "types": ["T/Offer"]}]}, "types": ["T/Product"]}'
    assert '"title": "OG"' in rows[5].payload


def test_scrape(pages):
    row = page_tree.scrape(pages, {"t": "title", "second": "article > p:nth-child(4)", "lang": "html@lang", "rel": "a[rel~='nofollow']@href", "none": "video"}).where("page_id = 1").first()
    assert (row.t, row.second, row.lang, row.rel, row.none) == ("A title", "Second & third z", "en", "/a", None)
    assert page_tree.split_attr("a[href='@x']@title") == ("a[href='@x']", "title")
    with pytest.raises(page_tree.BadSelector):
        page_tree.scrape(pages, {"x": "p::"})


def brute_distill(found, budget):
    by_id = {r.id: r for r in found}
    order = sorted(found, key=lambda r: (-r.score, r.id))
    used, pages = set(), []
    while len(used) < len(found):
        chosen, fallback = set(), None
        for r in order:
            if r.id in used or r.id in chosen:
                continue
            need = {p for p in r.parents if p not in used} | {r.id}
            fallback = fallback or need
            trial = chosen | need
            if page_tree.token_count("\n".join(page_tree.line(by_id[i]) for i in sorted(trial))) <= budget:
                chosen = trial
        chosen = chosen or fallback
        used |= chosen
        pages.append(sorted(chosen))
    return pages


def test_distill_shows_every_region_once():
    found = page_tree.regions(dom.parse(PAGE))
    for budget in (5, 30, 60, 500):
        got = page_tree.distill(found, budget)
        want = brute_distill(found, budget)
        assert [p["n_regions"] for p in got] == [len(p) for p in want]
        assert "\n".join(p["text"] for p in got).count("\n") + 1 == len(found)
    assert page_tree.distill([], 10) == [] and page_tree.layout([], 10) == []


def test_region_wrappers_collapse():
    found = page_tree.regions(dom.parse("<body><div><div><section>hi<a href='/x'>go</a></section></div></div></body>"))
    assert [(r.id, r.tag, r.role) for r in found] == [(1, "section", "region"), (2, "a", "generic")]
    assert found[0].actions == [(3, "link", "go")]


def test_split_and_components(pages):
    row = content.split_content(dom.dom_nodes(pages)).where("page_id = 1").first()
    assert 0 < row.main_chars < row.total_chars and row.confidence > 0.75
    assert page_tree.components(pages).count() > 0
    assert page_tree.class_token("btn-a8f3e1-12") == "btn-#"


def test_entry_needs_no_llm():
    import __spark_entry__

    assert "p1_found" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
