"""URLs as Column expressions: parts, hosts, resolution, and the form a crawl keys pages by.

All of it stays in the JVM; a null or unparseable URL gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track; a trailing star is a prefix.
TRACKING = ("utm_*", "gclid", "fbclid")
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, ABSOLUTE, 1), F.lit("")))


def host(url: Column) -> Column:
    """Lower-case host with its port; null where there is none."""
    return F.lower(F.nullif(F.regexp_replace(F.regexp_extract(url, ABSOLUTE, 2), r"^.*@", ""), F.lit("")))


def site(host_: Column) -> Column:
    """The last two labels of a host: what is the same for pages of one site."""
    labels = F.split(F.regexp_replace(host_, r":\d+$", ""), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def path(url: Column) -> Column:
    return F.regexp_extract(url, ABSOLUTE, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, ABSOLUTE, 4)


def is_tracking(name: Column, patterns=TRACKING) -> Column:
    low = F.lower(name)
    tests = [low.startswith(p[:-1].lower()) if p.endswith("*") else low == p.lower() for p in patterns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def parameters(url: Column) -> Column:
    """The parameters of the query as (name, position, text)."""
    parts = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("name"), i.alias("pos"), x.alias("text")))


def recoded(text: Column) -> Column:
    """A name or value of a query as a form writes it: decoded where it can be, then encoded."""
    return F.url_encode(F.coalesce(F.try_url_decode(text), text))


def pairs(url: Column) -> Column:
    """The parameters of the query, decoded, as (name, position, value)."""
    parts = F.filter(F.split(query(url), "&"), lambda x: x != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(parts, lambda x, i: F.struct(decoded(F.split_part(x, F.lit("="), F.lit(1))).alias("name"), i.alias("pos"), decoded(F.regexp_extract(x, "=(.*)$", 1)).alias("value")))


def written(pair: Column) -> Column:
    return F.concat(F.url_encode(pair["name"]), F.lit("="), F.url_encode(pair["value"]))


def without_default_port(scheme_: Column, host_: Column) -> Column:
    return F.when(scheme_ == "http", F.regexp_replace(host_, ":80$", "")).when(scheme_ == "https", F.regexp_replace(host_, ":443$", "")).otherwise(host_)


def normalize(url: Column, patterns=TRACKING, base: Column | None = None) -> Column:
    """One key a page: no fragment, host in lower case without its scheme's own port, no dots in the path, no index.html, no tracking, parameters in order of name.

    ``base`` is the page an href stands on; without one the URL is absolute.  Parameters of one name keep their order
    and are encoded as a form does; null for anything but http and https.
    """
    whole = F.trim(url) if base is None else resolve(url, base)
    kept = F.array_sort(F.filter(pairs(whole), lambda e: ~is_tracking(e["name"], patterns)))
    search = F.array_join(F.transform(kept, written), "&")
    clean = F.regexp_replace(without_dots(path(whole)), r"/index\.html$", "/")
    key = F.concat(scheme(whole), F.lit("://"), without_default_port(scheme(whole), host(whole)), F.when(clean == "", "/").otherwise(clean), F.when(search == "", "").otherwise(F.concat(F.lit("?"), search)))
    return F.when(scheme(whole).isin("http", "https"), key)


def without_dots(path_: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken, at any depth; what climbs above the root stays there."""
    parts = F.split(path_, "/")
    empty = F.array().cast("array<string>")
    taken = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty,
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(taken, "/"), F.when(F.size(taken) == 0, F.lit("")).otherwise(tail))
    return F.when(path_.rlike(r"(^|/)\.{1,2}(/|$)"), joined).otherwise(path_)


def resolve(href: Column, base: Column) -> Column:
    """An href against a page's URL, for the forms hrefs take: absolute, //host, /path, ?query, #part and relative paths."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), r"[^/]*$", "")
    h = F.trim(href)
    own, rest = F.regexp_replace(h, r"(?s)[?#].*$", ""), F.regexp_extract(h, r"(?s)[?#].*$", 0)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, without_dots(own), rest))
        .when((h == "") | h.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), h))
        .when(h.startswith("?"), F.concat(root, path(base), h))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def document_base(declared: Column, page_url: Column) -> Column:
    """What hrefs of a page are resolved against: its ``base`` element, itself resolved, else the page; null where the page has no URL."""
    return F.when(scheme(page_url).isNotNull(), F.when(F.length(F.trim(declared)) > 0, resolve(declared, page_url)).otherwise(page_url))


# Names whose values are secrets, by a part of the name and by the whole name.
SECRET_PARTS = "token secret password passwd apikey accesskey sessionid credential signature authorization authentication cookie".split()
SECRET_NAMES = "auth key code sig jwt bearer pwd otp session sid".split()
REDACTED = "[redacted]"


def flat_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def is_secret_name(name: Column) -> Column:
    plain = flat_name(name)
    return plain.rlike("|".join(SECRET_PARTS)) | plain.isin(*SECRET_NAMES)


def redact_url(url: Column) -> Column:
    """A URL with its user part and the values of secret parameters struck out; as it is where there are none.

    Of a secret parameter that repeats one remains; where anything was struck out, parameters are encoded as a form does.
    """
    user = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^@/?#]*)@", 1) != ""
    all_ = pairs(url)
    names = F.transform(all_, lambda e: e["name"])
    kept = F.filter(all_, lambda e: ~is_secret_name(e["name"]) | (F.array_position(names, e["name"]) == e["pos"] + 1))
    one = lambda e: F.when(is_secret_name(e["name"]), F.concat(F.url_encode(e["name"]), F.lit(f"={REDACTED}"))).otherwise(written(e))
    search = F.array_join(F.transform(kept, one), "&")
    struck = F.concat(
        scheme(url), F.lit("://"), F.when(user, f"{REDACTED}@").otherwise(""), without_default_port(scheme(url), host(url)), F.when(path(url) == "", "/").otherwise(path(url)),
        F.when(search == "", "").otherwise(F.concat(F.lit("?"), search)), F.regexp_extract(url, "#.*$", 0),
    )
    return F.when(host(url).isNull(), url).when(user | F.exists(all_, lambda e: is_secret_name(e["name"])), struck).otherwise(url)


def private_ipv4(host_: Column) -> Column:
    """Whether a host is an IPv4 address no crawl may fetch: this host, private, link-local or shared."""
    return host_.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)\d")


def private_ipv6(host_: Column) -> Column:
    """Whether a host is an IPv6 address no crawl may fetch: loopback, unspecified, unique local, link-local, or a private IPv4 address within."""
    bare = F.lower(F.regexp_replace(host_, r"^\[|\](:\d+)?$", ""))
    within = F.regexp_extract(bare, r"^::(?:ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    return bare.rlike(r"^(::1?|(0{1,4}:){7}0{0,3}[01])$") | bare.rlike(r"^f[cd][0-9a-f]{2}:") | bare.rlike(r"^fe[89ab][0-9a-f]:") | private_ipv4(within)


def may_fetch(url: Column) -> Column:
    """Whether a crawl may fetch a URL: http or https, a host, and none that is local or private as written."""
    bare = F.regexp_replace(host(url), r":\d+$", "")
    return F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull() & ~(private_ipv4(bare) | private_ipv6(bare) | bare.rlike(r"(^|\.)localhost$")), F.lit(False))
