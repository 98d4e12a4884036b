"""Facts a page states: prices, availability, dates, authors, ratings, contacts, addresses, accounts, further pages.

A fact has a field, the tier it was read from and its place in the page.  Tiers are read apart, by one visitor over
declared nodes (JSON-LD, microdata, RDFa), by the meta map, by markup and by text, and their rows are one
table: which tier holds for a field is decided by windows over it (``entities.best_tier``).
JSN3-7, JSN12-18, NUM2, NUM4, DAT1-3, URL8, SET2.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.text import AVAILABILITY, CODES, SIGNS
from pagelathe.operators.page_tree import _microdata, _schema, body_of, flatten_graph, per_page, rdfa_items
from pagelathe.session import slices, spread
from pagelathe.sources.dom import Node, collapse

TIERS = ("json-ld", "microdata", "rdfa", "meta", "semantic-markup", "text-heuristic")
MOST_DEPTH = 10
# Properties of dates, of ratings and of addresses, in lower case.
DATES = {
    "datepublished": "published", "datecreated": "published", "publishdate": "published", "datemodified": "modified", "dateupdated": "modified",
    "startdate": "eventStart", "enddate": "eventEnd",
}
RATINGS = ("ratingvalue", "bestrating", "reviewcount", "ratingcount")
ADDRESS = {"streetaddress": "street", "addresslocality": "locality", "addressregion": "region", "postalcode": "postalCode", "addresscountry": "country"}
# Names of the meta map by what they state, the first present counts.
META_DATES = {
    "published": ("article:published_time", "datepublished", "pubdate"), "modified": ("article:modified_time", "og:updated_time", "lastmod"),
    "eventStart": ("event:start_time",), "eventEnd": ("event:end_time",),
}
# Hosts of social platforms, path parts before an account, platforms that write it with an @.
PLATFORMS = {
    "twitter.com": "twitter", "x.com": "x", "facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "github.com": "github",
    "youtube.com": "youtube", "tiktok.com": "tiktok", "threads.net": "threads", "pinterest.com": "pinterest", "reddit.com": "reddit", "mastodon.social": "mastodon",
}
BEFORE_ACCOUNT = frozenset("company in school showcase pages groups channel c user u r".split())
WITH_AT = frozenset("twitter x instagram threads tiktok mastodon".split())
# Availability as schemas and prose write it, in this order.
SCHEMA_AVAILABILITY = (
    ("out ?of ?stock|soldout|oos|unavailable", "out-of-stock"), ("pre-?order|presale", "preorder"), ("back-?order", "backorder"), ("discontinued", "discontinued"),
    ("in ?stock|instoreonly|onlineonly|limitedavailability|available", "in-stock"),
)
# Tags that tell what a price is, and wordings of links to further pages.
PRICE_TAGS = {"del": "original", "s": "original", "strike": "original", "ins": "current"}
LIST_PRICE = re.compile(r"list ?price|msrp|strikethrough|regular", re.I)
NEXT = re.compile(r"(next|next page|older|older posts?|»|›|→|>)\Z", re.I)
BACK = re.compile(r"(prev|previous|previous page|newer|newer posts?|«|‹|←|<)\Z", re.I)
MORE = re.compile(r"\b(load|show|view|see)\s+more\b", re.I)

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = rf"(?:{'|'.join(_MONTHS)})[a-z]*\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_PROSE = rf"(?:{_MONTH}\s+{_DAY},?\s+\d{{4}}|{_DAY}\s+{_MONTH},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
_BY_MONTH = re.compile(rf"({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\Z", re.I)
_BY_DAY = re.compile(rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH}),?\s+(\d{{4}})\Z", re.I)
_PRICE = re.compile(rf"(?:(?P<s1>[{''.join(SIGNS)}]|\b(?:{'|'.join(CODES)})\b)\s?(?P<a1>\d[\d.,']*\d|\d))|(?:(?P<a2>\d[\d.,']*\d|\d)\s?(?P<s2>[{''.join(SIGNS)}]|\b(?:{'|'.join(CODES)})\b))", re.I)
_PROSE_DATES = {"published": re.compile(rf"\b(?:published|posted)(?:\s+(?:on|at))?\s+({_PROSE})", re.I), "modified": re.compile(rf"\b(?:updated|modified|revised)(?:\s+(?:on|at))?\s+({_PROSE})", re.I)}
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЁ"
_NAME = rf"[{_UPPER}](?:(?:[^\W\d_]|['’.-])*[^\W\d_])?"
_BYLINE = re.compile(rf"\bby\s+({_NAME}(?:\s+{_NAME}){{0,2}})")
_STARS = re.compile(r"\b(\d(?:[.,]\d)?)\s*(?:out of|/)\s*(\d(?:[.,]\d)?)\s*stars?", re.I)
_REVIEWS = re.compile(r"\b(\d[\d.,\s]*\d|\d)\s+(?:reviews?|ratings?)\b", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]{2,})+")
_PHONE = re.compile(r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]\d{2,4}){1,4}")
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")


class Fact(NamedTuple):
    field: str
    source: str
    value: str | None
    number: float | None = None
    unit: str | None = None
    kind: str | None = None


def amount(raw: object) -> float | None:
    """A number, or a written amount: its last separator is decimal where at most two digits follow it."""
    if isinstance(raw, bool) or raw is None:
        return None
    if isinstance(raw, (int, float)):
        return float(raw) if raw == raw and abs(raw) != float("inf") else None
    text = re.sub(r"[\s']", "", raw) if isinstance(raw, str) else ""
    if not re.fullmatch(r"[0-9][0-9.,]*", text):
        return None
    whole, separator, tail = re.fullmatch(r"(.*?)([.,]?)([^.,]*)", text).groups() if re.search("[.,]", text) else (text, "", "")
    digits = re.sub("[.,]", "", whole)
    return float(f"{digits}.{tail or 0}" if separator and len(tail) <= 2 else digits + tail)


def day_of(raw: str) -> str | None:
    """A plain day as it is; any other date as an instant of UTC with milliseconds, prose dates at midnight; None where there is none."""
    text = collapse(raw)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return text
    if m := _BY_MONTH.match(text):
        month, day, year = m.groups()
    elif m := _BY_DAY.match(text):
        day, month, year = m.groups()
    else:
        if not _ISO.match(text):
            return None
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    try:
        return datetime(int(year), _MONTHS.index(month[:3].lower()) + 1, int(day)).strftime("%Y-%m-%dT00:00:00.000Z")
    except ValueError:
        return None


def availability_of(raw: str) -> str | None:
    tail = re.split("[/#]", raw)[-1].lower()
    return next((value for pattern, value in SCHEMA_AVAILABILITY if re.search(pattern, tail)), None)


def account_of(href: str, base: str) -> tuple[str, str, str] | None:
    """(platform, account, URL) of a link to a social platform."""
    try:
        url = urljoin(base, href.strip())
        parts = urlsplit(url)
        host = re.sub(r"^www\.", "", (parts.hostname or "").lower())
    except ValueError:
        return None
    steps = [p for p in parts.path.split("/") if p]
    at = 1 if steps and steps[0].lower() in BEFORE_ACCOUNT else 0
    if host not in PLATFORMS or len(steps) <= at:
        return None
    platform, name = PLATFORMS[host], re.sub("^@", "", steps[at])
    return platform, f"@{name}" if platform in WITH_AT else name, url


def lower_keys(record: dict) -> dict:
    """Keys in lower case; of keys that come together the first with a value counts."""
    out: dict = {}
    for k, v in record.items():
        if out.get(k.lower()) is None:
            out[k.lower()] = v
    return out


def plain_record(item: dict) -> dict:
    """A microdata or RDFa item as a record of its properties: one value alone, several as a list, prefixes of names dropped."""
    out = {}
    for name, values in item["properties"].items():
        read = [plain_record(v) if isinstance(v, dict) else v for v in values]
        out[name.rsplit(":", 1)[-1]] = read[0] if len(read) == 1 else read
    return out


def authors_of(raw: object) -> list[tuple[str, str | None]]:
    """(name, URL) of authors written as text, as an object, or as a list of those at any depth."""
    out, stack = [], [raw]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, str):
            out += [(collapse(v), None)] if collapse(v) else []
        elif isinstance(v, dict) and isinstance(v.get("name"), str) and collapse(v["name"]):
            out.append((collapse(v["name"]), v["url"] if isinstance(v.get("url"), str) and v["url"] else None))
    return out


def address_of(raw: object) -> dict | None:
    """The parts of a postal address; of one written as text the text."""
    if isinstance(raw, str):
        return {"raw": collapse(raw)} if collapse(raw) else None
    if not isinstance(raw, dict):
        return None
    low, out = lower_keys(raw), {}
    for name, part in ADDRESS.items():
        v = low.get(name)
        v = v.get("name") if isinstance(v, dict) else v
        if isinstance(v, str) and collapse(v):
            out[part] = collapse(v)
    return out or None


def declared_prices(low: dict) -> list[tuple[float, str | None]]:
    """(amount, kind) of the prices of one node: its own, that of a list, and the bounds of a range."""
    read = {k: amount(low.get(k)) for k in ("price", "listprice", "highprice", "lowprice")}
    span = read["highprice"] is not None and read["lowprice"] is not None
    of_list = isinstance(low.get("pricetype"), str) and bool(LIST_PRICE.search(low["pricetype"]))
    kinds = {"price": "original" if of_list else None, "listprice": "original", "highprice": "original" if span else None, "lowprice": "current" if span else None}
    return [(v, kinds[k]) for k, v in read.items() if v is not None]


def _rating(value: object, best: object, count: object, source: str) -> list[Fact]:
    if (v := amount(value)) is None:
        return []
    more = {k: x for k, x in (("best", amount(best)), ("reviewCount", amount(count))) if x is not None}
    return [Fact("rating", source, json.dumps(more) if more else None, v)]


def _stated(low: dict, currency: str | None, source: str) -> Iterator[Fact]:
    """The facts one declared node states itself."""
    for number, kind in declared_prices(low):
        yield Fact("price", source, None, number, currency, kind)
    if isinstance(low.get("availability"), str) and (state := availability_of(low["availability"])):
        yield Fact("availability", source, state)
    for name, field in DATES.items():
        if isinstance(low.get(name), str):
            at = day_of(low[name])
            yield Fact(field, source, at) if at else Fact("warning", source, f"unparseable {name}: {low[name]}")
    for name, url in authors_of(low.get("author")):
        yield Fact("author", source, name, None, url)
    count = low.get("reviewcount") if amount(low.get("reviewcount")) is not None else low.get("ratingcount")
    yield from _rating(low.get("ratingvalue"), low.get("bestrating"), count, source)
    if isinstance(low.get("email"), str) and "@" in low["email"]:
        yield Fact("email", source, collapse(re.sub("^mailto:", "", low["email"], flags=re.I)))
    phone = low.get("telephone") if low.get("telephone") is not None else low.get("phone")
    if isinstance(phone, str) and re.search(r"\d", phone):
        yield Fact("phone", source, collapse(re.sub("^tel:", "", phone, flags=re.I)))
    if (place := address_of(low.get("address"))) is not None:
        yield Fact("address", source, json.dumps(place, ensure_ascii=False, sort_keys=True))
    same = low.get("sameas")
    for href in same if isinstance(same, list) else [same]:
        if isinstance(href, str) and (found := account_of(href, href)):
            yield Fact("social", source, found[1], None, found[2], found[0])


def declared_facts(nodes: object, source: str) -> list[Fact]:
    """The facts of declared nodes, in document order: one depth-first pass to ``MOST_DEPTH``, a node's currency holding below it."""
    out: list[Fact] = []
    stack: list[tuple[object, str | None, int]] = [(nodes, None, 0)]
    while stack:
        node, currency, depth = stack.pop()
        if depth > MOST_DEPTH or not isinstance(node, (dict, list)):
            continue
        if isinstance(node, list):
            stack += [(v, currency, depth + 1) for v in reversed(node)]
            continue
        low = lower_keys(node)
        if isinstance(low.get("pricecurrency"), str) and low["pricecurrency"].strip():
            currency = low["pricecurrency"].strip().upper()
        out += _stated(low, currency, source)
        stack += [(v, currency, depth + 1) for k, v in reversed(low.items()) if k not in RATINGS and k != "author"]
    return out


def meta_facts(root: Node) -> list[Fact]:
    """What the meta map states; of names that repeat the first with content counts."""
    bag: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta" and (content := n.attrs.get("content", "").strip()):
            name = (n.attrs["property"] if "property" in n.attrs else n.attrs.get("name", "")).strip().lower()
            if name:
                bag.setdefault(name, content)

    def first(*names: str) -> str | None:
        return next((bag[k] for k in names if k in bag), None)

    out = []
    if (number := amount(first("product:price:amount", "og:price:amount"))) is not None:
        unit = first("product:price:currency", "og:price:currency")
        out.append(Fact("price", "meta", None, number, unit.upper() if unit else None))
    state = first("product:availability", "og:availability")
    if state and (state := availability_of(state)):
        out.append(Fact("availability", "meta", state))
    for field, names in META_DATES.items():
        if (raw := first(*names)) is not None:
            at = day_of(raw)
            out.append(Fact(field, "meta", at) if at else Fact("warning", "meta", f"unparseable {names[0]}: {raw}"))
    author = first("author", "article:author", "twitter:creator")
    if author and not re.match("https?://|@", author, re.I):
        out.append(Fact("author", "meta", collapse(author)))
    return out


def price_in(text: str) -> Fact | None:
    """The first price of a text."""
    for m in _PRICE.finditer(text):
        number, sign = amount(m["a1"] or m["a2"]), m["s1"] or m["s2"]
        if number is not None:
            return Fact("price", "text-heuristic", m.group().strip(), number, SIGNS.get(sign, sign.upper()))
    return None


def time_field(n: Node) -> str | None:
    """What a time element dates, by its own names and the beginning of what stands around it."""
    own = " ".join(n.attrs.get(k, "") for k in ("itemprop", "property", "class", "rel"))
    around = f"{own} {collapse(n.parent.text())[:120] if n.parent is not None else ''}".lower()
    tests = (("dtstart|start", "eventStart"), (r"dtend|\bend", "eventEnd"), ("modif|updat|revis", "modified"), (r"publish|pubdate|posted|\bdate", "published"))
    return next((field for pattern, field in tests if re.search(pattern, around)), None)


def _below(n: Node, attribute: str) -> bool:
    while n is not None:
        if attribute in n.attrs:
            return True
        n = n.parent
    return False


def markup_facts(root: Node, page_url: str, published: bool) -> list[Fact]:
    """What elements state by their meaning; ``published`` tells whether a higher tier dates the page."""
    source, out, loose, unlabelled = "semantic-markup", [], {}, None
    for n in root.walk():
        if n.tag == "time" and "datetime" in n.attrs:
            at = day_of(n.attrs["datetime"])
            if at is None:
                out.append(Fact("warning", source, f"unparseable time datetime: {n.attrs['datetime']}"))
            elif field := time_field(n):
                out.append(Fact(field, source, at))
            else:
                unlabelled = unlabelled or at
        elif n.tag == "address" and (raw := collapse(n.text())):
            out.append(Fact("address", source, json.dumps({"raw": raw}, ensure_ascii=False)))
        elif n.tag == "a" and "href" in n.attrs:
            href = n.attrs["href"]
            scheme = href[:7].lower()
            if scheme == "mailto:":
                mail = unquote(href[7:].split("?")[0])
                out += [Fact("email", source, mail)] if "@" in mail else []
            elif scheme[:4] == "tel:":
                out += [Fact("phone", source, collapse(href[4:]))] if collapse(href[4:]) else []
            elif found := account_of(href, page_url):
                out.append(Fact("social", source, found[1], None, found[2], found[0]))
        if n.tag in PRICE_TAGS and (price := price_in(collapse(n.text()))):
            out.append(price._replace(source=source, kind=PRICE_TAGS[n.tag]))
        if "itemprop" in n.attrs and not _below(n, "itemscope"):
            name = n.attrs["itemprop"].strip().lower()
            value = next((collapse(n.attrs[k]) for k in ("content", "datetime", "value") if k in n.attrs), None)
            if value is None:
                value = n.attrs["href"].strip() if "href" in n.attrs and n.tag != "a" else collapse(n.text())
            if name and value:
                loose.setdefault(name, value)
    if unlabelled and not published and not any(f.field == "published" for f in out):
        out.append(Fact("published", source, unlabelled))
    if loose:
        single = {k: v for k, v in loose.items() if k in ("price", "availability", "ratingvalue", "bestrating", "reviewcount", "ratingcount", "author", "email", "telephone", *DATES)}
        unit = loose["pricecurrency"].upper() if "pricecurrency" in loose else None
        out += [f for f in _stated(single, unit, source) if f.field != "warning"]
    return out


def text_facts(texts: list[str]) -> list[Fact]:
    """What plain texts of elements state, each pattern once an element."""
    source, out = "text-heuristic", []
    for t in texts:
        for m in _PRICE.finditer(t):
            number, sign = amount(m["a1"] or m["a2"]), m["s1"] or m["s2"]
            if number is not None:
                out.append(Fact("price", source, m.group().strip(), number, SIGNS.get(sign, sign.upper())))
        out += [Fact("availability", source, value) for pattern, value in AVAILABILITY if re.search(pattern, t)][:1]
        for field, pattern in _PROSE_DATES.items():
            if (m := pattern.search(t)) and (at := day_of(m.group(1))):
                out.append(Fact(field, source, at))
        if m := _BYLINE.search(t):
            out.append(Fact("author", source, m.group(1)))
        if m := _STARS.search(t):
            count = _REVIEWS.search(t)
            out += _rating(m.group(1), m.group(2), re.sub(r"\s", "", count.group(1)) if count else None, source)
        out += [Fact("email", source, m.group()) for m in _EMAIL.finditer(t)]
        for m in _PHONE.finditer(t):
            digits = len(re.sub(r"\D", "", m.group()))
            if 9 <= digits <= 15 and (re.search(r"[+()\s]", m.group().strip()) or digits >= 10):
                out.append(Fact("phone", source, m.group().strip()))
    return out


def further_pages(root: Node, page_url: str) -> list[dict]:
    """``kind, href, label, path, source`` of links to further pages: by rel, numbered within a pager, by their words."""
    base_node = next((n for n in root.walk() if n.tag == "base" and "href" in n.attrs), None)
    base = urljoin(page_url, base_node.attrs["href"]) if base_node is not None else page_url
    out = []

    def add(n: Node, kind: str, label: str, source: str) -> None:
        href = n.attrs.get("href", "").strip()
        out.append({"kind": kind, "href": urljoin(base, href) if href else None, "label": label or None, "path": n.path(), "source": source})

    nodes = list(root.walk())
    for n in nodes:
        if n.tag in ("a", "link") and "rel" in n.attrs:
            rel = set(n.attrs["rel"].lower().split())
            if kind := "next" if "next" in rel else "prev" if rel & {"prev", "previous"} else None:
                add(n, kind, collapse(n.text()), "semantic-markup")
    for pager in nodes:
        named = pager.tag == "nav" or (pager.tag in ("ul", "ol") and "class" in pager.attrs) or (pager.tag == "div" and pager.attrs.get("role") == "navigation")
        if named and "pag" in f"{pager.attrs.get('aria-label', '')} {pager.attrs.get('class', '')}".lower():
            for n in pager.walk():
                if n.tag == "a" and "href" in n.attrs and re.fullmatch("[0-9]+", label := collapse(n.text())):
                    add(n, "numbered", label, "semantic-markup")
    for n in nodes:
        if n.tag in ("a", "button") or n.attrs.get("role") == "button":
            label = collapse(n.text()) or collapse(n.attrs.get("aria-label", ""))
            if kind := "load-more" if MORE.search(label) else "next" if NEXT.match(label) else "prev" if BACK.match(label) else None:
                add(n, kind, label, "text-heuristic")
    return out


_FACTS = "page_id long, pos int, field string, source string, value string, number double, unit string, kind string"


def page_facts(root: Node, page_url: str) -> list[Fact]:
    """The facts of a page, tier by tier."""
    out: list[Fact] = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type", "").lower().startswith("application/ld+json") and (text := n.text().strip()):
            try:
                out += declared_facts(flatten_graph(json.loads(text)), "json-ld")
            except (ValueError, RecursionError):
                out.append(Fact("warning", "json-ld", "malformed json-ld"))
    for n in root.walk():
        if "itemscope" in n.attrs and "itemprop" not in n.attrs:
            out += declared_facts(plain_record(_microdata(n)), "microdata")
    for item in rdfa_items(root):
        out += declared_facts(plain_record(item), "rdfa")
    out += meta_facts(root)
    out += markup_facts(root, page_url, any(f.field == "published" for f in out))
    body = body_of(root)
    return out + text_facts([t for n in body.walk() if n.tag not in ("script", "style", "noscript", "template") and (t := n.own_text())])


def facts(pages: DataFrame) -> DataFrame:
    """``page_id, pos, field, source, value, number, unit, kind`` of every fact of ``page_id, url, html``.

    ``pos`` is the order within the page, higher tiers first.  Null and empty pages have no rows; what cannot be read is
    a row of field ``warning``; a page captured twice has rows under each id; other columns are ignored.
    """
    from pagelathe.sources.dom import parse

    names = [f.split()[0] for f in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for page, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                    if source:
                        rows += [(page, i, *f) for i, f in enumerate(page_facts(parse(source), url or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(slim).mapInArrow(run, _FACTS)


def record_facts(records: DataFrame) -> DataFrame:
    """The facts that crawl records (``record_id, data``) declare in their JSON-LD and microdata, under ``record_id``; data that is no JSON has none."""
    names = ["record_id", *[f.split()[0] for f in _FACTS.split(", ")][1:]]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for ident, data in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        held = json.loads(data).get("structured") if data else None
                    except (ValueError, RecursionError, AttributeError):
                        held = None
                    if isinstance(held, dict):
                        found = declared_facts(held.get("jsonLd"), "json-ld") + declared_facts(held.get("microdata"), "microdata")
                        rows += [(ident, i, *f) for i, f in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    slim = records.select(F.col("record_id").cast("long").alias("record_id"), F.col("data").cast("string").alias("data")).where(F.length("data") > 0)
    return spread(slim).mapInArrow(run, _FACTS.replace("page_id", "record_id"))


def best_facts(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Of each field the facts of its best tier, each once; a price is one of its kind."""
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("source"))
    role = F.when(F.col("field") == "price", F.concat(F.lit("price "), F.coalesce("kind", F.lit("")))).otherwise(F.col("field"))
    ranked = found.where(F.col("field") != "warning").withColumn("role", role).withColumn("tier", tier)
    best = ranked.groupBy(key, "role").agg(F.min("tier").alias("best"))
    kept = ranked.join(best, [key, "role"]).where(F.col("tier") == F.col("best"))
    same = [key, "role", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("value", "number", "unit")]]
    return kept.groupBy(*same).agg(F.min_by(F.struct("pos", "field", "source", "value", "number", "unit", "kind"), "pos").alias("f")).select(key, "f.*")


def pagination(pages: DataFrame) -> DataFrame:
    """``page_id, pos, kind, href, label, path, source`` of links to further pages; hrefs are resolved against the page's base."""
    from pagelathe.sources.dom import parse

    schema = "page_id long, pos int, kind string, href string, label string, path array<int>, source string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for page, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += [(page, i, *(t[n] for n in names[2:])) for i, t in enumerate(further_pages(parse(source), url or ""))] if source else []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(slim).mapInArrow(run, schema)
