"""Headers as Column expressions: waits a server asks for, cookies, what must not be kept (DAT4-5, JSN19-21, PRJ13, HLP8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.urls import REDACTED, flat_name, is_secret_name, redact_url

# Content types whose bodies are kept, by prefix.
KEPT_TYPES = ("application/json", "application/ld+json", "application/xml", "application/xhtml+xml", "application/javascript", "application/x-www-form-urlencoded", "text/")
_DATE = r"(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2})"


def retry_after_s(value: Column, now: Column) -> Column:
    """Seconds a Retry-After asks for: a whole number, or until a date (0 if past); null for anything else."""
    t = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(t, _DATE, 0), r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(date.isNotNull(), F.greatest(F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6, F.lit(0.0)))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("double")).when(t.rlike(r"^[+-]?[\d.]+$"), F.lit(None).cast("double")).otherwise(until)


def keeps_body(content_type: Column) -> Column:
    low = F.lower(F.trim(content_type))
    out = F.lit(False)
    for p in KEPT_TYPES:
        out = out | low.startswith(p)
    return F.coalesce(out, F.lit(False))


def content_length(value: Column) -> Column:
    """A length that is a whole number not below 0; null otherwise."""
    return F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("long"))


def cookies(header: Column, arrived: Column | None = None) -> Column:
    """Structs (name, domain, path, expires, secure, http_only, same_site) of Set-Cookie lines; values are never kept.

    ``expires`` is an instant: Max-Age counts from ``arrived`` and goes before Expires; null for a cookie of the session and
    for a date that cannot be read.  A line without a name is none.
    """
    lines = F.filter(F.split(F.coalesce(header, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^\s*[^=;\s][^=;]*="))

    def one(line: Column) -> Column:
        attr = lambda name: F.nullif(F.trim(F.regexp_extract(line, rf"(?i);\s*{name}\s*=\s*([^;]*)", 1)), F.lit(""))
        age = attr("max-age").try_cast("double")
        after = F.when(age.isNotNull(), F.timestamp_micros(F.unix_micros(arrived) + (age * 1e6).cast("long"))) if arrived is not None else F.lit(None).cast("timestamp")
        date = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(F.regexp_replace(attr("expires"), "-", " "), _DATE, 0), r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy HH:mm:ss"))
        same = F.lower(attr("samesite"))
        return F.struct(
            F.trim(F.split_part(F.split_part(line, F.lit(";"), F.lit(1)), F.lit("="), F.lit(1))).alias("name"), F.lower(F.regexp_replace(attr("domain"), r"^\.", "")).alias("domain"), attr("path").alias("path"),
            F.when(age.isNotNull(), after).otherwise(date).alias("expires"), line.rlike(r"(?i);\s*secure\s*(;|$)").alias("secure"), line.rlike(r"(?i);\s*httponly\s*(;|$)").alias("http_only"),
            F.when(same.isin("strict", "lax", "none"), same).alias("same_site"),
        )

    return F.transform(lines, one)


def cookie_inventory(set_cookies: DataFrame) -> DataFrame:
    """The last write of each (page, name, domain): rows of ``page_id, seq, host, header, arrived`` (Set-Cookie of a response)."""
    each = set_cookies.select("page_id", "seq", "host", F.posexplode(cookies(F.col("header"), F.col("arrived"))).alias("pos", "c"))
    named = each.select("page_id", "seq", "pos", F.coalesce("c.domain", F.lower("host")).alias("domain"), "c.name", "c.path", "c.expires", "c.secure", "c.http_only", "c.same_site")
    last = F.max_by(F.struct("path", "expires", "secure", "http_only", "same_site"), F.struct("seq", "pos"))
    return named.groupBy("page_id", "name", "domain").agg(last.alias("c")).select("page_id", "name", "domain", "c.*")


def redacted_set_cookie(value: Column) -> Column:
    """Set-Cookie lines with the cookies' values struck out, attributes as they are; empty values stay, a line without a name goes whole."""
    def one(line: Column) -> Column:
        pair, tail = F.regexp_extract(line, r"^[^;]*", 0), F.regexp_extract(line, r";.*$", 0)
        return F.when(F.trim(line) == "", line).when(~pair.rlike(r"^[^=]*[^=\s][^=]*="), REDACTED).otherwise(F.concat(_struck(pair), tail))

    return F.array_join(F.transform(F.split(value, "\n"), one), "\n")


def redacted_cookie(value: Column) -> Column:
    """A Cookie header with its values struck out; the whole of it where a part has no name."""
    parts = F.split(value, ";")
    odd = F.exists(parts, lambda p: (F.trim(p) != "") & ~p.rlike(r"^[^=]*[^=\s][^=]*="))
    return F.when(odd, REDACTED).otherwise(F.array_join(F.transform(parts, lambda p: F.when(F.trim(p) == "", p).otherwise(_struck(p))), ";"))


def _struck(pair: Column) -> Column:
    name, value = F.regexp_extract(pair, r"^[^=]*=", 0), F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)
    bare = F.trim(value)
    return F.when(bare == "", pair).when(bare.rlike(r'(?s)^".*"$') & (F.length(bare) > 1), F.concat(name, F.lit(f'"{REDACTED}"'))).otherwise(F.concat(name, F.lit(REDACTED)))


def redacted_headers(headers: Column) -> Column:
    """A map of headers with cookies reduced to their names and attributes, and secret values struck out."""
    def one(k: Column, v: Column) -> Column:
        flat = flat_name(k)
        return F.when(flat == "setcookie", redacted_set_cookie(v)).when(flat == "cookie", redacted_cookie(v)).when(is_secret_name(k), F.lit(REDACTED)).otherwise(v)

    return F.transform_values(headers, one)


def redacted_requests(requests: DataFrame) -> DataFrame:
    """Recorded requests (``url, request_headers, response_headers, body``) without what must not be kept; other columns stay."""
    from pagelathe.functions.text import redact_body

    return requests.withColumns(
        {"url": redact_url(F.col("url")), "request_headers": redacted_headers(F.col("request_headers")), "response_headers": redacted_headers(F.col("response_headers")), "body": redact_body(F.col("body"))}
    )
