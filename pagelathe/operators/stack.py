"""What a page is built of and whom it talks to: technologies by their traces, third-party hosts and their classes.

URLs, markup, globals, headers and cookies are matched with fixed lists, as Column expressions over what a
page names; of a technology the first trace counts, in the order of the passes.  JN4-7, AGG5-6, JSN25, STF26.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.functions.text import product_of

# Parts of URLs that name a product, in the order they are tried.
URL_SIGNS = (
    ("/_next/static/", "framework", "Next.js"),
    ("/_nuxt/", "framework", "Nuxt"),
    ("/wp-content/", "framework", "WordPress"),
    ("/wp-includes/", "framework", "WordPress"),
    ("cdn.shopify.com", "framework", "Shopify"),
    ("googletagmanager.com/gtm.js", "tag-manager", "Google Tag Manager"),
    ("assets.adobedtm.com", "tag-manager", "Adobe Experience Platform Tag"),
    ("tags.tiqcdn.com", "tag-manager", "Tealium"),
    ("googletagmanager.com/gtag/js", "analytics", "Google Analytics"),
    ("google-analytics.com", "analytics", "Google Analytics"),
    ("cdn.segment.com", "analytics", "Segment"),
    ("plausible.io/js", "analytics", "Plausible"),
    ("static.hotjar.com", "analytics", "Hotjar"),
    ("cdn.amplitude.com", "analytics", "Amplitude"),
    ("cdn.mxpnl.com", "analytics", "Mixpanel"),
    ("clarity.ms", "analytics", "Microsoft Clarity"),
    ("js.hs-scripts.com", "analytics", "HubSpot"),
    ("doubleclick.net", "ad-network", "Google Ads"),
    ("googlesyndication.com", "ad-network", "Google AdSense"),
    ("connect.facebook.net", "ad-network", "Meta Pixel"),
    ("analytics.tiktok.com", "ad-network", "TikTok Pixel"),
    ("snap.licdn.com", "ad-network", "LinkedIn Insight"),
    ("cdn.jsdelivr.net", "cdn", "jsDelivr"),
    ("unpkg.com", "cdn", "unpkg"),
    ("cdnjs.cloudflare.com", "cdn", "cdnjs"),
    ("ajax.googleapis.com", "cdn", "Google Hosted Libraries"),
    ("cdn.optimizely.com", "ab-testing", "Optimizely"),
    ("visualwebsiteoptimizer.com", "ab-testing", "VWO"),
    ("widget.intercom.io", "chat-widget", "Intercom"),
    ("js.intercomcdn.com", "chat-widget", "Intercom"),
    ("embed.tawk.to", "chat-widget", "Tawk.to"),
    ("static.zdassets.com", "chat-widget", "Zendesk"),
    ("client.crisp.chat", "chat-widget", "Crisp"),
    ("js.stripe.com", "payment", "Stripe"),
    ("paypalobjects.com", "payment", "PayPal"),
    ("checkout.razorpay.com", "payment", "Razorpay"),
    ("js.braintreegateway.com", "payment", "Braintree"),
)
# Ids and attributes a framework leaves in the markup (tag or none, attribute, its value or none).
MARKUP_SIGNS = (
    ("script", "id", "__NEXT_DATA__", "framework", "Next.js"),
    (None, "id", "__NUXT_DATA__", "framework", "Nuxt"),
    (None, "id", "___gatsby", "framework", "Gatsby"),
    (None, "ng-version", None, "framework", "Angular"),
    (None, "data-reactroot", None, "framework", "React"),
    (None, "data-v-app", None, "framework", "Vue"),
)
# Names inline scripts use.
GLOBAL_SIGNS = (("dataLayer", "tag-manager", "Google Tag Manager"), ("__NUXT__", "framework", "Nuxt"), ("Shopify", "framework", "Shopify"))
# Response headers (name, a part of the value or any) and prefixes of cookie names.
HEADER_SIGNS = (
    ("server", "cloudflare", "cdn", "Cloudflare"),
    ("x-vercel-id", "", "cdn", "Vercel"),
    ("x-amz-cf-id", "", "cdn", "Amazon CloudFront"),
    ("x-fastly-request-id", "", "cdn", "Fastly"),
    ("x-powered-by", "next.js", "framework", "Next.js"),
    ("x-shopify-stage", "", "framework", "Shopify"),
)
COOKIE_SIGNS = (("_ga", "analytics", "Google Analytics"), ("_fbp", "ad-network", "Meta Pixel"), ("_hjSession", "analytics", "Hotjar"), ("__stripe_mid", "payment", "Stripe"))
# Containers of consent platforms (id or class), and what a category says of a host.
CONSENT_SIGNS = (
    ("id", "onetrust-banner-sdk", "OneTrust"),
    ("id", "CybotCookiebotDialog", "Cookiebot"),
    ("id", "usercentrics-root", "Usercentrics"),
    ("id", "didomi-host", "Didomi"),
    ("id", "truste-consent-track", "TrustArc"),
    ("id", "cookie-law-info-bar", "CookieYes"),
    ("class", "cc-window", "Cookie Consent"),
)
HOST_CLASSES = {
    "framework": "functional", "analytics": "tracker", "tag-manager": "tracker", "ad-network": "advertising", "cdn": "cdn",
    "ab-testing": "tracker", "chat-widget": "functional", "payment": "functional",
}
CONSENT_WORDS = r"cookie|consent|gdpr"

_COMMENTS = r"(?s)<!--.*?(?:-->|\z)"
_ASSET = r"(?i)<(script|img|iframe|source|video|audio|embed|link)\b[^>]*?\s(?:src|href)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
_TARGET = r"(?i)\s(?:src|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def _attribute(name: str, value: str | None) -> str:
    """A pattern of an attribute within a tag."""
    if value is None:
        return rf"\s{re.escape(name)}(?=[\s=>/])"
    if name == "class":
        return rf"\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{re.escape(value)}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{re.escape(value)}(?:\s[^']*)?'|{re.escape(value)}(?=[\s>]))"
    return rf"\s{re.escape(name)}\s*=\s*(?:\"{re.escape(value)}\"|'{re.escape(value)}'|{re.escape(value)}(?=[\s>]))"


def bare(html: Column) -> Column:
    return F.regexp_replace(html, _COMMENTS, " ")


def assets(pages: DataFrame) -> DataFrame:
    """``page_id, page_url, pos, tag, url``: what a page's markup loads, resolved; null and empty pages have no rows.

    A link loads something only as a stylesheet, an icon or a preload.
    """
    found = F.regexp_extract_all(bare(F.col("html")), F.lit(_ASSET), F.lit(0))
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "tag"))
    target = F.concat(*[F.regexp_extract("tag", _TARGET, i) for i in (1, 2, 3)])
    named = each.select("page_id", "page_url", "pos", F.lower(F.regexp_extract("tag", r"^<(\w+)", 1)).alias("name"), F.col("tag"), target.alias("href"))
    loads = (F.col("name") != "link") | F.col("tag").rlike(r"(?i)\srel\s*=\s*[\"']?[^\"'>]*(stylesheet|icon|preload)")
    whole = F.coalesce(urls.resolve(F.col("href"), F.col("page_url")), F.col("href"))
    return named.where(loads & (F.trim("href") != "")).select("page_id", "page_url", "pos", F.col("name").alias("tag"), whole.alias("url"))


def url_sign(url: Column) -> Column:
    """The first sign in a URL as (category, name); null without one."""
    out = None
    for part, category, name in URL_SIGNS:
        value = F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"))
        out = F.when(url.contains(part), value) if out is None else out.when(url.contains(part), value)
    return out


def _found(order: int, category, name, evidence, matched, host) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(order).alias("pass"), as_column(category).alias("category"), as_column(name).alias("name"), as_column(evidence).alias("evidence"), as_column(matched).alias("matched"), as_column(host).alias("host"))


def _traces(pages: DataFrame, requests: DataFrame | None, cookies: DataFrame | None) -> DataFrame:
    """``page_id, pos, t``: every trace of every pass."""
    seen = assets(pages).select("page_id", "pos", "url", F.when(F.col("tag") == "script", "script-url").otherwise("asset-host").alias("evidence"))
    if requests is not None:
        asked = requests.select("page_id", (F.col("seq") + (1 << 20)).cast("int").alias("pos"), "url", F.when(F.col("resource_type") == "script", "script-url").otherwise("asset-host").alias("evidence"))
        seen = seen.unionByName(asked)
    sign = url_sign(F.col("url"))
    out = seen.withColumn("s", sign).where(F.col("s").isNotNull()).select("page_id", "pos", _found(1, F.col("s.category"), F.col("s.name"), F.col("evidence"), F.col("url"), urls.host(F.col("url"))).alias("t"))
    plain = bare(F.col("html"))
    marks = [F.when(plain.rlike(rf"<{tag or '[a-zA-Z]'}[^>]*{_attribute(a, v)}"), _found(2, c, n, "global-name", v or a, None)) for tag, a, v, c, n in MARKUP_SIGNS]
    tag = F.regexp_extract(plain, r"(?i)<meta\b[^>]*\bname\s*=\s*[\"']?generator[\"'\s][^>]*>", 0)
    declared = F.trim(F.concat(*[F.regexp_extract(tag, r"(?i)\scontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", i) for i in (1, 2, 3)]))
    generator = F.when(declared != "", _found(3, "framework", product_of(declared), "global-name", declared, None))
    scripts = F.array_join(F.regexp_extract_all(plain, F.lit(r"(?is)<script\b(?![^>]*\ssrc\s*=)[^>]*>(.*?)</script"), F.lit(1)), "\n")
    names = [F.when(F.contains(scripts, F.lit(g)), _found(4, c, n, "global-name", g, None)) for g, c, n in GLOBAL_SIGNS]
    inside = F.posexplode(F.filter(F.array(*marks, generator, *names), lambda x: x.isNotNull())).alias("pos", "t")
    out = out.unionByName(pages.where(F.col("html").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), inside))
    if requests is not None and "response_headers" in requests.columns:
        low = F.transform_keys("response_headers", lambda k, _: F.lower(k))
        value = lambda name: F.try_element_at(low, F.lit(name))
        heads = [F.when(value(h).isNotNull() & F.contains(F.lower(value(h)), F.lit(part)), _found(5, c, n, "response-header", F.concat(F.lit(f"{h}: "), value(h)), urls.host(F.col("url")))) for h, part, c, n in HEADER_SIGNS]
        out = out.unionByName(requests.select("page_id", F.col("seq").cast("int").alias("pos"), F.explode(F.filter(F.array(*heads), lambda x: x.isNotNull())).alias("t")))
    if cookies is not None:
        sets = [F.when(F.col("name").startswith(p), _found(6, c, n, "cookie", F.col("name"), F.col("domain"))) for p, c, n in COOKIE_SIGNS]
        out = out.unionByName(cookies.select("page_id", F.lit(0).alias("pos"), F.coalesce(*sets).alias("t")).where(F.col("t").isNotNull()))
    return out


def technologies(pages: DataFrame, requests: DataFrame | None = None, cookies: DataFrame | None = None) -> DataFrame:
    """``page_id, category, technology, evidence, matched``: each technology of a page once, by its first trace.

    URLs come first, then markup, the generator, globals, headers and cookies.  ``requests`` (``page_id, seq, url,
    resource_type`` and perhaps ``response_headers``) and ``cookies`` (``page_id, name, domain``) are what was recorded, if it was.
    """
    first = F.min(F.struct("t.pass", "pos", "t.evidence", "t.matched"))
    return _traces(pages, requests, cookies).groupBy("page_id", F.col("t.category").alias("category"), F.col("t.name").alias("technology")).agg(first.alias("f")).select("page_id", "category", "technology", "f.evidence", "f.matched")


def third_parties(pages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """``page_id, host, channel, n, class``: hosts of other sites a page talks to, the busiest first within a page.

    What was recorded goes before what the markup refers to; the class is that of the first technology found on the host, else unknown.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), urls.host(F.col("url")).alias("page_host"))
    named = assets(pages).select("page_id", urls.host(F.col("url")).alias("host"), F.lit(0).alias("recorded"))
    if requests is not None:
        named = named.unionByName(requests.select("page_id", urls.host(F.col("url")).alias("host"), F.lit(1).alias("recorded")))
    apart = named.where(F.col("host").isNotNull()).join(own, "page_id").where(F.coalesce(urls.site(F.col("host")) != urls.site(F.col("page_host")), F.lit(True)))
    tally = apart.groupBy("page_id", "host").agg(F.sum("recorded").alias("r"), F.count("*").alias("a"))
    classes = F.create_map(*[F.lit(x) for kv in HOST_CLASSES.items() for x in kv])
    known = _traces(pages, requests, None).where(F.col("t.host").isNotNull()).groupBy("page_id", F.col("t.host").alias("host")).agg(F.min(F.struct("t.pass", "pos", "t.category")).alias("f"))
    found = tally.join(known, ["page_id", "host"], "left")
    return found.select(
        "page_id", "host", F.when(F.col("r") > 0, "recorded").otherwise("referenced").alias("channel"), F.when(F.col("r") > 0, F.col("r")).otherwise(F.col("a")).alias("n"),
        F.coalesce(classes[F.col("f.category")], F.lit("unknown")).alias("class"),
    )


def consent_platforms(pages: DataFrame) -> DataFrame:
    """``page_id, platform``: the consent platform a page's markup shows, "unnamed" for a banner that only names itself after cookies.

    Such a banner has a control and speaks of cookies, consent or privacy within the element; prose about them has no such id or class.
    """
    plain = bare(F.col("html"))
    named = None
    for attribute, value, name in CONSENT_SIGNS:
        test = plain.rlike(rf"<[a-zA-Z][^>]*{_attribute(attribute, value)}")
        named = F.when(test, name) if named is None else named.when(test, name)
    opened = rf"<(div|section|aside|dialog|form|footer|header|p)\b[^>]*\s(?:id|class)\s*=\s*(?:\"[^\"]*(?:{CONSENT_WORDS})[^\"]*\"|'[^']*(?:{CONSENT_WORDS})[^']*'|[^\s>\"']*(?:{CONSENT_WORDS}))[^>]*>"
    inside = F.regexp_extract(plain, rf"(?s){opened}(.*?)</\1\s*>", 2)
    control = inside.rlike(r"(?i)<button|role\s*=\s*[\"']?button|<input[^>]*type\s*=\s*[\"']?button|<a\b[^>]*\shref")
    words = F.regexp_replace(inside, r"(?s)<[^>]*>", " ").rlike("(?i)cookie|consent|privacy")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), named.when(control & words, "unnamed").alias("platform")).where(F.col("platform").isNotNull())
