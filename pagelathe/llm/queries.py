"""Queries of the llm subpackage on the given tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from pagelathe.llm import abuse, boilerplate, bpe, language, mixing, residue
from pagelathe.session import table


def queries() -> dict:
    return {
        "p2_found": lambda s, d: boilerplate.p2_found(table(s, d, "pages")),
        "p3_found": lambda s, d: residue.p3_found(table(s, d, "pages"), table(s, d, "crawl_records")),
        "p4_found": lambda s, d: language.p4_found(*(table(s, d, t) for t in ("documents", "pages", "content_reports", "crawl_records"))),
        "p6_ids": lambda s, d: bpe.p6_ids(table(s, d, "documents")),
        "p7_shares": lambda s, d: mixing.p7_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares_entropy": lambda s, d: mixing.p7_shares_entropy(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares_exact": lambda s, d: mixing.p7_shares_exact(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_plan": lambda s, d: mixing.p7_plan(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: abuse.p8_found(table(s, d, "documents"), table(s, d, "labels")),
        "p8_scores": lambda s, d: abuse.p8_scores(table(s, d, "documents"), table(s, d, "labels")),
        "p8_rates": lambda s, d: abuse.p8_rates(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
