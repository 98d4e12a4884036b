"""Values of stylesheets as Column expressions: colours, lengths, contrast (STF11-13, NUM10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex2(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int"))), 2, "0")


def normal_color(raw: Column) -> Column:
    """#rrggbb of #rgb, #rrggbb and rgb(); transparent for alpha 0, rgba() for other alphas; null for anything else."""
    t = F.lower(F.trim(raw))
    rgb = r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)(?:[\s,/]+([\d.]+))?\s*\)$"
    part = lambda i: F.regexp_extract(t, rgb, i)
    channels = [part(i).try_cast("int") for i in (1, 2, 3)]
    alpha = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("double"), F.lit(1.0))
    as_hex = F.concat(F.lit("#"), *[_hex2(c) for c in channels])
    rgba = F.concat(F.lit("rgba("), F.concat_ws(", ", *[c.cast("string") for c in channels], F.round(alpha, 3).cast("string")), F.lit(")"))
    return (
        F.when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(t, "^#(.)(.)(.)$", "#$1$1$2$2$3$3"))
        .when(t.rlike("^#[0-9a-f]{6}$"), t)
        .when(t.rlike(rgb), F.when(alpha == 0, "transparent").when(alpha == 1, as_hex).otherwise(rgba))
    )


def normal_length(raw: Column) -> Column:
    """A length with two decimals at most; 0 without unit; null for keywords and what cannot be read."""
    t = F.lower(F.trim(raw))
    number = F.regexp_extract(t, r"^(-?\d*\.?\d+)([a-z%]*)$", 1).try_cast("double")
    short = F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", "")
    return F.when(number == 0, "0").when(number.isNotNull(), F.concat(short, F.regexp_extract(t, r"([a-z%]*)$", 1)))


def pixels(raw: Column) -> Column:
    """Pixels of a length in px, rem or em of 16; null otherwise."""
    t = F.lower(F.trim(raw))
    number = F.regexp_extract(t, r"^(-?\d*\.?\d+)(px|rem|em)$", 1).try_cast("double")
    return F.when(t.endswith("px"), number).otherwise(number * 16)


def luminance(color: Column) -> Column:
    """The relative luminance of a #rrggbb colour."""
    parts = []
    for i, weight in ((2, 0.2126), (4, 0.7152), (6, 0.0722)):
        c = F.conv(F.substring(color, i, 2), 16, 10).cast("double") / 255
        parts.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) * weight)
    return reduce(lambda a, b: a + b, parts)


def contrast(a: Column, b: Column) -> Column:
    """The contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
