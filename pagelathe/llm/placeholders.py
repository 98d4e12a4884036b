"""Unfilled variables of template languages, by their syntax."""

from __future__ import annotations

import re

_NAME = r"[$]?[A-Za-z_][A-Za-z_0-9]*(?:[.\-_][A-Za-z_0-9]+)*"
TEMPLATE = re.compile(
    rf"\{{\{{[^{{}}]*\}}\}}|\{{%[^%]*%\}}|\{{!![^!]*!!\}}|<%[^%]*%>|<\?(?:php|=)[^?]*\?>|[$#]\{{[^{{}}]*\}}|%%{_NAME}%%|@@{_NAME}@@|\*\*\*{_NAME}\*\*\*|__[A-Za-z][A-Za-z_0-9]*?__"
    rf"|\[\[\s?{_NAME}\s?\]\]|(?<![/\w])\{{\s?{_NAME}\s?\}}|(?<![/\w\]])\[[a-z]+(?:[._][a-z]+)*\](?!\()|«{_NAME}»|(?<!\w)%[A-Z_]+%|(?<!\w)%[sd](?!\w)"
)
SIGN = re.compile(r"[{}\[%<«@*_$#]")


def without_templates(text: str) -> tuple[str, int]:
    """(a text with its template variables taken out, how many there were)."""
    return TEMPLATE.subn(" ", text) if SIGN.search(text) else (text, 0)
