import inspect
import random

import pytest

from pagelathe.llm import language, residue
from pagelathe.llm.page_blocks import unpack_body
from pagelathe.llm.phrases import ABOUT, phrases


def close(a, b):
    assert a.weights.keys() == b.weights.keys() and a.bias == b.bias
    assert max(abs(v - b.weights[t]) for t, v in a.weights.items()) < 1e-6


def test_every_page_takes_part_in_the_fit(spark):
    random.seed(5)
    words = "bridge road spring market opened repaired river town council winter please reload page".split()
    n = 2_700  # more than any bound of a sample
    html = [f"<body><main><h1>t{i % 7}</h1><p>{' '.join(random.choices(words, k=12))} word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}</p></main></body>" for i in range(n)]
    pages = spark.createDataFrame([(i, i % 900, h) for i, h in enumerate(html)], "page_id long, site_id long, html string")
    held = residue.page_tokens(pages)
    no_records = spark.createDataFrame([], "record_id long, outcome struct<kind:string,reason:string>")
    model = residue.fit_bodies(held, no_records)
    bodies = [unpack_body(r.body) for r in held.select("body").collect()]
    close(model, residue.fit(((residue.tokens(p), 1.0) for body in bodies for p in residue.page_passages(body)), harmless=[p for _, p in phrases(ABOUT)]))
    assert sum(t.startswith("word") and len(t) == 7 for t in model.weights) == n


def test_every_reason_takes_part_in_the_fit(spark):
    reasons = [f"timeout of host {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["undefined", "{{ x }}"] * 5
    held = residue.reason_tokens(spark.createDataFrame([(r, "error") for r in reasons], "reason string, kind string"))
    close(residue.fit_over((held, residue.Fit(residue.REASON_AGAINST)))[0], residue.fit(((residue.tokens(r), float(reasons.count(r))) for r in set(reasons)), residue.REASON_AGAINST))


def test_worst_passage_of_a_page(spark):
    import pyarrow as pa

    model = residue.fit((residue.tokens(t), 1.0) for t in ["the old bridge was repaired", "{{ x }}"])
    pages = [["the old bridge", "{{ x }}"], [], ["bridge"], [""]]
    got = residue.worst(model, pa.array([residue.packed([residue.tokens(p) for p in page]) for page in pages], pa.string()))
    assert got[0] == pytest.approx(max(model.score(residue.tokens(p)) for p in pages[0])) and got[1] != got[1]
    assert got[2] == pytest.approx(model.score(["bridge"])) and got[3] == float("-inf")


def test_labelled_texts_of_the_language_fit():
    assert language.FIT_TEXTS == inspect.signature(language.fit_on).parameters["bound"].default == 4_000


def test_passages_packed_and_taken_apart():
    import pyarrow as pa

    rows = [[["a", "^a b"], [], ["§template", "c"]], [], [[]], [["d"] * 9 + ["§nothing"]]]
    flat, sizes, per_row, texts = residue.taken_apart(pa.array([residue.packed(r) for r in rows], pa.string()))
    assert flat.to_pylist() == [t for r in rows for p in r for t in p] and sizes.tolist() == [2, 0, 2, 0, 10] and per_row.tolist() == [3, 0, 1, 1]
    assert residue.placeholders(flat, sizes).tolist() == [False, False, True, False, False] and len(texts) == 5
