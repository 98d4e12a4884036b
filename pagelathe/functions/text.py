"""Scans of plain text as Column expressions: words, money, contacts, ratings, secrets.  All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.urls import REDACTED, SECRET_NAMES, SECRET_PARTS

WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
EAST = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]{2,})+"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]\d{2,4}){1,4}"
# Signs and codes of currencies.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW"}
CODES = "USD EUR GBP JPY INR CAD AUD CHF CNY SEK NOK DKK NZD BRL MXN ZAR SGD HKD PLN TRY AED KRW".split()
PRICE = rf"(?i)(?:[$€£¥₹₽₩]|\b(?:{'|'.join(CODES)})\b)\s?(?:\d[\d.,']*\d|\d)|(?:\d[\d.,']*\d|\d)\s?(?:[$€£¥₹₽₩]|\b(?:{'|'.join(CODES)})\b)"
# Everyday words that give a language away.
STOPWORDS = {
    "en": "the and of to is in that for with it",
    "es": "el la los las de que y en con se",
    "fr": "le la les des et est pour dans avec que",
    "de": "der die das und ist mit nicht den ein zu",
    "pt": "o a de que e em para com uma no",
    "it": "il la di che e per con non una del",
}
# Scripts that give a language away, in this order.
SCRIPTS = (
    ("ja", r"[\u3040-\u309f\u30a0-\u30ff]"),
    ("ko", r"[\uac00-\ud7af]"),
    ("zh", r"[\u4e00-\u9fff]"),
    ("ru", r"[\u0400-\u04ff]"),
    ("ar", r"[\u0600-\u06ff]"),
    ("hi", r"[\u0900-\u097f]"),
    ("he", r"[\u0590-\u05ff]"),
    ("el", r"[\u0370-\u03ff]"),
    ("th", r"[\u0e00-\u0e7f]"),
)
SCRIPT_HITS, WORD_HITS, WORDS_A_MINUTE = 4, 3, 200


def word_count(text: Column) -> Column:
    """Words, of text without spaces characters; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(EAST)) + F.regexp_count(F.regexp_replace(t, EAST, " "), F.lit(WORD))


def reading_minutes(words: Column) -> Column:
    return F.round(words / WORDS_A_MINUTE, 1)


def plain(html: Column) -> Column:
    """Page source without comments, scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    """Runs of 9 to 15 digits with a sign of a phone number, or of 10 and more."""
    digits = lambda m: F.length(F.regexp_replace(m, r"\D", ""))
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda m: F.trim(m)), lambda m: digits(m).between(9, 15) & (m.rlike(r"[+()\s]") | (digits(m) >= 10)))


def amount(raw: Column) -> Column:
    """A written amount: the last separator is decimal where one or two digits follow it."""
    clean = F.regexp_replace(raw, r"[\s']", "")
    tail = F.regexp_extract(clean, r"[.,]([^.,]*)$", 1)
    split = clean.rlike(r"[.,][^.,]{0,2}$")
    whole = F.regexp_replace(F.regexp_replace(clean, r"[.,][^.,]*$", ""), r"[.,]", "")
    digits = F.when(split, F.concat(whole, F.lit("."), tail)).otherwise(F.regexp_replace(clean, r"[.,]", ""))
    return F.when(clean.rlike(r"^\d[\d.,]*$"), digits.try_cast("double"))


def prices(text: Column) -> Column:
    """Structs (amount, currency, matched) of the prices in a text, in order."""
    sign = lambda m: F.regexp_extract(m, r"[$€£¥₹₽₩]|[A-Za-z]{3}", 0)
    currency = lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), sign(m)), F.upper(sign(m)))
    found = F.regexp_extract_all(text, F.lit(PRICE), F.lit(0))
    return F.transform(found, lambda m: F.struct(amount(F.regexp_extract(m, r"\d[\d.,']*", 0)).alias("amount"), currency(m).alias("currency"), F.trim(m).alias("matched")))


# Prose that tells availability, in this order.
AVAILABILITY = ((r"(?i)\b(out of stock|sold out|unavailable)\b", "out-of-stock"), (r"(?i)\b(pre-?order)\b", "preorder"), (r"(?i)\b(back-?order(ed)?)\b", "backorder"), (r"(?i)\b(discontinued)\b", "discontinued"), (r"(?i)\b(in stock|available now)\b", "in-stock"))


def availability(text: Column) -> Column:
    out = F.when(text.rlike(AVAILABILITY[0][0]), AVAILABILITY[0][1])
    for pattern, value in AVAILABILITY[1:]:
        out = out.when(text.rlike(pattern), value)
    return out


def redact_body(text: Column) -> Column:
    """A body with the values of secret fields struck out: string fields of JSON, and pairs of a form unless it is JSON.

    Names are taken apart by their separators; the patterns are those of ``urls.is_secret_name``.
    """
    gap = r"[^A-Za-z0-9\"=&\s]*"
    spelled = lambda words: "|".join(gap.join(w) for w in words)
    within, whole = spelled(SECRET_PARTS), spelled(SECRET_NAMES)
    name = rf'(?:(?:[^"\\]|\\.)*?(?:{within})(?:[^"\\]|\\.)*|{gap}(?:{whole}){gap})'
    json = F.regexp_replace(text, rf'(?i)("{name}"\s*:\s*)"(?:[^"\\]|\\.)*"', rf'$1"{REDACTED}"')
    plain = rf"(?:[^=&\s]*?(?:{within})[^=&\s]*|{gap}(?:{whole}){gap})"
    form = F.regexp_replace(json, rf"(?i)(^|[?&])({plain})=[^&\s]*", rf"$1$2={REDACTED}")
    return F.when(F.ltrim(json).rlike(r"^[{\[]"), json).otherwise(form)


def struck_texts(text: Column) -> Column:
    """A text with e-mail addresses and what is set to secret words struck out; beyond bodies of requests."""
    t = F.regexp_replace(text, EMAIL, "[email]")
    return F.regexp_replace(t, r"(?i)((?:password|passwd|secret|token|api[_-]?key|authorization)\s*[=:]\s*)[^\s&;,]+", "$1[redacted]")


def short_type(declared: Column) -> Column:
    """The last part of a schema type: after a slash or a hash."""
    return F.regexp_extract(F.trim(declared), r"([^/#]*)[/#]?$", 1)


def product_of(generator: Column) -> Column:
    """The product a generator names, without its version; as declared where nothing else stands."""
    declared = F.trim(generator)
    bare = F.trim(F.regexp_replace(declared, r"[\s,]+v?\d[\w.+-]*$", ""))
    return F.when(declared != "", F.when(bare == "", declared).otherwise(bare))


def elided(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters, cut with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def plural(n: Column, word: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {many or word + 's'}"))


def size_text(n: Column) -> Column:
    """A number of bytes as KB, from one MB on as MB, in powers of 1,024."""
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")))


def data_url(content: Column, mime: str) -> Column:
    """Bytes as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def crawl_name(host: Column) -> Column:
    """The name of a crawl by the host of its first page: what is safe in a file name, "crawl" where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), "[^a-z0-9.-]", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "crawl").otherwise(bare)


def bytes_text(n: Column) -> Column:
    """A number of bytes as B, kB or MB."""
    return F.when(n < 1000, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1_000_000, F.format_string("%.1f kB", n / 1000)).otherwise(F.format_string("%.1f MB", n / 1_000_000))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text, in hexadecimal."""
    fold = F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda h, c: F.pmod((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))
    return F.lower(F.lpad(F.hex(fold), 8, "0"))
