import json
import random

import pytest

from pagelathe.operators import nested


def brute(value, path, parent):
    if isinstance(value, dict):
        yield path, parent
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}", path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}[{i}]", parent)


def some(depth):
    r = random.random()
    if depth == 0 or r < 0.3:
        return random.choice([1, "x", None, True, {}, []])
    if r < 0.65:
        return {random.choice(["a", "b c", "d.e"]): some(depth - 1) for _ in range(3)}
    return [some(depth - 1) for _ in range(3)]


def test_visit_against_recursion():
    random.seed(1)
    for _ in range(300):
        v = some(5)
        assert [(p, q) for p, q, _ in nested.visit(v, "r", "$")] == list(brute(v, "r", "$"))


def test_parsers_agree():
    random.seed(2)
    for _ in range(500):
        text = json.dumps(some(4))
        k = random.randrange(len(text) + 1)
        for t in (text, text[:k], text[:k] + "," + text[k:], text + " "):
            def value(f, t=t):
                try:
                    return f(t)
                except nested.NotJson:
                    return "not"

            assert value(nested.parse_json) == value(nested._parse_deep)


@pytest.mark.parametrize("bad", ["", "{", "NaN", "[1,]", "{'a':1}", "[Infinity]", "01", "nul"])
def test_not_json(bad):
    with pytest.raises(nested.NotJson):
        nested.parse_json(bad)


def test_very_deep():
    v = nested.parse_json('{"a":' * 30_000 + "1" + "}" * 30_000)
    assert isinstance(v, dict)


def test_found_and_tables(spark, tmp_path):
    data = {"structured": {"jsonLd": [{"@type": "Product", "name": "n", "offers": [{"price": "1"}, [{"price": "2"}], "s", None]}], "microdata": {"types": ["T"], "properties": {"a.b": [{"id": "i"}]}}, "social": {"x": {"y": 1}}}}
    rows = [(1, json.dumps(data), [None, ("p", None, "r", None)], "x"), (2, "{cut", None, "x"), (3, None, [], "x"), (4, json.dumps({"structured": None}), None, "x"), (1, json.dumps({"structured": {"jsonLd": 3}}), None, "x")]
    df = spark.createDataFrame(rows, "record_id long, data string, warnings array<struct<phase:string,url:string,reason:string,detail:string>>, tag string")
    found = sorted(map(tuple, nested.p5_found(df).collect()))
    root, micro = "data.structured.jsonLd[0]", "data.structured.microdata"
    assert found == sorted([
        (1, "$", root), (1, root, f"{root}.offers[0]"), (1, root, f"{root}.offers[1][0]"), (1, "$", micro), (1, micro, f"{micro}.properties"),
        (1, f"{micro}.properties", f"{micro}.properties.a.b[0]"), (1, "$", "warnings[1]"),
    ])
    nested.write_flat_tables(nested.flatten_records(df), str(tmp_path / "flat"))
    products = nested.read_flat_table(spark, str(tmp_path / "flat"), "jsonLd").orderBy("path").collect()
    assert [(r["@type"], r["price"]) for r in products] == [("Product", None), (None, "1"), (None, "2")]
    assert nested.read_flat_table(spark, str(tmp_path / "flat"), "warnings").first()["reason"] == "r"
    assert nested.p5_found(df.limit(0)).count() == 0
