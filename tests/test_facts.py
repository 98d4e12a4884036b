import json

import pytest

from pagelathe.operators import facts
from pagelathe.operators.facts import Fact
from pagelathe.sources.dom import parse


@pytest.mark.parametrize(("raw", "want"), [("1,234.50", 1234.5), ("1.234,5", 1234.5), ("1'000", 1000.0), ("12,345", 12345.0), (7, 7.0), (True, None), ("free", None), (None, None), ("", None), (float("nan"), None), ("9.", 9.0)])
def test_amounts(raw, want):
    assert facts.amount(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-03-01", "2024-03-01"), ("March 5, 2024", "2024-03-05T00:00:00.000Z"), ("5th Mar. 2024", "2024-03-05T00:00:00.000Z"), ("2024-03-05T10:00:00+02:00", "2024-03-05T08:00:00.000Z"), ("soon", None), ("", None), ("Feb 31, 2024", None)],
)
def test_days(raw, want):
    assert facts.day_of(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("https://schema.org/OutOfStock", "out-of-stock"), ("InStock", "in-stock"), ("https://schema.org#PreOrder", "preorder"), ("unknown", None), ("", None)])
def test_availability(raw, want):
    assert facts.availability_of(raw) == want


def test_accounts():
    assert facts.account_of("https://www.linkedin.com/company/acme/", "https://a.test/") == ("linkedin", "acme", "https://www.linkedin.com/company/acme/")
    assert facts.account_of("https://x.com/@bo", "https://a.test/")[:2] == ("x", "@bo")
    assert facts.account_of("https://github.com/", "https://a.test/") is None and facts.account_of("/about", "https://a.test/") is None and facts.account_of("https://[bad", "x") is None


def kept(found, *fields):
    return [f[:1] + f[2:] for f in found if f.field in fields]


def test_declared_nodes():
    node = {
        "@type": "Product", "Name": "Kettle", "offers": {"priceCurrency": "eur", "price": "12,50", "availability": "https://schema.org/InStock", "nested": [{"price": 3}]}, "price": 9,
        "aggregateRating": {"ratingValue": "4.5", "bestRating": 5, "ratingCount": "1,024"}, "author": [{"name": " Ada  L ", "url": "/ada"}, "Bo", {"name": 3}], "datePublished": "2024-01-02", "dateModified": "some day",
        "address": {"streetAddress": "1 Mill Lane", "addressCountry": {"name": "Elbonia"}}, "sameAs": ["https://x.com/kettle", 4], "email": "mailto:k@a.test", "telephone": "tel:+1 22",
    }
    got = facts.declared_facts([node, None, "text", {"highPrice": 9, "lowPrice": "7"}, {"listPrice": 5}, {"price": 2, "priceType": "MSRP"}], "json-ld")
    assert kept(got, "price") == [("price", None, 9.0, None, None), ("price", None, 12.5, "EUR", None), ("price", None, 3.0, "EUR", None), ("price", None, 9.0, None, "original"), ("price", None, 7.0, None, "current"), ("price", None, 5.0, None, "original"), ("price", None, 2.0, None, "original")]
    assert kept(got, "author") == [("author", "Ada L", None, "/ada", None), ("author", "Bo", None, None, None)]
    assert kept(got, "rating") == [("rating", json.dumps({"best": 5.0, "reviewCount": 1024.0}), 4.5, None, None)]
    assert kept(got, "published", "warning") == [("published", "2024-01-02", None, None, None), ("warning", "unparseable datemodified: some day", None, None, None)]
    assert [f.value for f in got if f.field == "address"] == [json.dumps({"country": "Elbonia", "street": "1 Mill Lane"})]
    assert kept(got, "social", "email", "phone") == [("email", "k@a.test", None, None, None), ("phone", "+1 22", None, None, None), ("social", "@kettle", None, "https://x.com/kettle", "x")]
    deep = {"price": 1}
    for _ in range(12):
        deep = {"x": deep}
    assert facts.declared_facts(deep, "json-ld") == [] and facts.declared_facts(None, "rdfa") == []
    assert facts.lower_keys({"Price": None, "price": 2, "PRICE": 3}) == {"price": 2}


PAGE = """<html><head><base href="/shop/"><meta property="product:price:amount" content="10.00"><meta property="product:price:currency" content="usd"><meta name="author" content="Cy"><meta name="author" content="Di">
<meta name="pubdate" content="2024-02-02"><link rel="next" href="?p=2"><script type="application/ld+json">{"@graph":[{"price":"8","priceCurrency":"GBP"}]}</script><script type="application/ld+json">{bad</script></head>
<body><p>Written by Grace Brewster Hopper. Posted on March 3rd, 2024. Now <del>$30</del> <ins>20 EUR</ins></p><address> 2  Mill Lane </address><a href="mailto:a%2Bb@a.test?x=1">m</a><a href="tel: +44 20 7946 0958 ">t</a><a href="https://github.com/acme">g</a>
<div itemscope itemtype="https://schema.org/Thing"><span itemprop="price">1</span><div itemprop="offers" itemscope><meta itemprop="price" content="6"></div></div><span itemprop="ratingValue">4,5</span>
<div vocab="https://schema.org/" typeof="Event"><time property="schema:startDate" datetime="2024-05-05">x</time></div>
<div><time datetime="2024-04-04">then</time></div><p>Rated 4.5 out of 5 stars by 1,200 reviews, sold out, call 020 7946 0958 or 12 34</p>
<nav class="pager"><a href="/p/1">1</a><a href="/p/2">2</a><a href="/p/x">x</a></nav><button aria-label="Load more"></button><a href="next.html">Older posts</a></body></html>"""


def test_facts_of_a_page():
    got = facts.page_facts(parse(PAGE), "https://a.test/shop/x")
    assert kept([f for f in got if f.source == "json-ld"], "price", "warning") == [("price", None, 8.0, "GBP", None), ("warning", "malformed json-ld", None, None, None)]
    assert kept([f for f in got if f.source == "microdata"], "price") == [("price", None, 1.0, None, None), ("price", None, 6.0, None, None)]
    assert Fact("eventStart", "rdfa", "2024-05-05") in got
    assert kept([f for f in got if f.source == "meta"], "price", "author", "published") == [("price", None, 10.0, "USD", None), ("published", "2024-02-02", None, None, None), ("author", "Cy", None, None, None)]
    markup = [f for f in got if f.source == "semantic-markup"]
    assert kept(markup, "price") == [("price", "$30", 30.0, "USD", "original"), ("price", "20 EUR", 20.0, "EUR", "current")]
    assert kept(markup, "email", "phone", "social") == [("email", "a+b@a.test", None, None, None), ("phone", "+44 20 7946 0958", None, None, None), ("social", "acme", None, "https://github.com/acme", "github")]
    assert kept(markup, "rating", "published") == [("rating", None, 4.5, None, None)]  # a higher tier dates the page
    text = [f for f in got if f.source == "text-heuristic"]
    assert kept(text, "author", "published") == [("published", "2024-03-03T00:00:00.000Z", None, None, None), ("author", "Grace Brewster Hopper", None, None, None)]
    assert kept(text, "availability", "phone") == [("availability", "out-of-stock", None, None, None), ("phone", "020 7946 0958", None, None, None)]
    assert [f.number for f in text if f.field == "rating"] == [4.5]


def test_unlabelled_time_dates_a_page_without_another_date():
    got = facts.page_facts(parse("<body><i><time datetime='2024-04-04'>x</time></i><i><time datetime='2024-04-05'>y</time></i></body>"), "https://a.test/")
    assert kept(got, "published") == [("published", "2024-04-04", None, None, None)]


def test_further_pages():
    got = [(t["kind"], t["href"], t["label"], t["source"]) for t in facts.further_pages(parse(PAGE), "https://a.test/shop/x")]
    assert got == [
        ("next", "https://a.test/shop/?p=2", None, "semantic-markup"), ("numbered", "https://a.test/p/1", "1", "semantic-markup"), ("numbered", "https://a.test/p/2", "2", "semantic-markup"),
        ("load-more", None, "Load more", "text-heuristic"), ("next", "https://a.test/shop/next.html", "Older posts", "text-heuristic"),
    ]


def test_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.test/shop/x", PAGE, 7), (2, None, None, 7), (3, "https://b.test/", "", 7), (1, "https://a.test/shop/x", PAGE, 7)], "page_id long, url string, html string, pos int")
    found = facts.facts(pages)
    best = {(r.page_id, r.field, r.kind): (r.source, r.number, r.value) for r in facts.best_facts(found).collect()}
    assert best[1, "price", None] == ("json-ld", 8.0, None) and best[1, "price", "original"][1] == 30.0 and best[1, "author", None][2] == "Cy"
    assert found.where("page_id <> 1").count() == 0 and found.count() % 2 == 0 and facts.facts(pages.limit(0)).count() == 0
    assert facts.pagination(pages).count() == 10
    records = spark.createDataFrame([(5, json.dumps({"structured": {"jsonLd": [{"price": 2}], "microdata": {"price": "3"}}})), (6, "{cut"), (7, None), (8, "[]"), (9, '{"structured": null}')], "record_id long, data string")
    assert [(r.record_id, r.source, r.number) for r in facts.record_facts(records).orderBy("pos").collect()] == [(5, "json-ld", 2.0), (5, "microdata", 3.0)]
