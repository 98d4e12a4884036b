"""Deeply nested records turned into flat tables whose rows still know their parent.

One depth-first pass over each record emits every object once, as (tag, key, parent key, payload);
the tagged rows are then written partitioned by tag, and each tag's table gets its own schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag -> the place in the record below which objects are emitted.
PLACES = {"jsonLd": ("structured", "jsonLd"), "microdata": ("structured", "microdata")}
ROW = "tag string, record_id long, path string, parent_path string, payload string"


class NotJson(ValueError):
    pass


def _refuse(name: str):
    raise NotJson(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_PART = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def parse_json(text: str):
    """The value of strict JSON; raises NotJson.  Nesting too deep for the built-in parser is read without recursion."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        raise NotJson(str(e)) from None


def _parse_deep(text: str):
    root: list = []
    stack: list = [root]
    keys: list = [None]
    want, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _PART.match(text, at)
        if not m:
            raise NotJson(f"at {at}")
        at = m.end()
        mark, string, scalar = m.groups()
        if mark is None or mark in "{[":
            if want == "key or end" or want == "key":
                if string is None:
                    raise NotJson(f"at {at}")
                keys[-1] = json.loads(string)
                want = "colon"
                continue
            if want not in ("value", "value or end"):
                raise NotJson(f"at {at}")
            value = {} if mark == "{" else [] if mark == "[" else json.loads(string or scalar)
            here = stack[-1]
            if isinstance(here, dict):
                here[keys[-1]] = value
            else:
                here.append(value)
            want = "comma or end"
            if mark:
                stack.append(value)
                keys.append(None)
                want = "key or end" if mark == "{" else "value or end"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "comma or end" and len(stack) > 1:
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif mark in "}]" and len(stack) > 1 and want in ("comma or end", "key or end" if mark == "}" else "value or end") and isinstance(stack[-1], dict) == (mark == "}"):
            stack.pop()
            keys.pop()
            want = "comma or end"
        else:
            raise NotJson(f"at {at}")
    if len(stack) != 1 or len(root) != 1:
        raise NotJson("cut off")
    return root[0]


def visit(value, path: str, parent: str) -> Iterator[tuple[str, str, dict]]:
    """(path, parent's path, object) of every object at or below ``value``, depth first, in document order."""
    stack = [(value, path, parent)]
    while stack:
        value, path, parent = stack.pop()
        if isinstance(value, dict):
            yield path, parent, value
            stack.extend((v, f"{path}.{k}", path) for k, v in reversed(value.items()) if isinstance(v, (dict, list)))
        elif isinstance(value, list):
            stack.extend((value[i], f"{path}[{i}]", parent) for i in range(len(value) - 1, -1, -1) if isinstance(value[i], (dict, list)))


def own_part(value: dict) -> str:
    """An object's payload: its scalars and the scalars of its lists; objects below have rows of their own."""
    out = {}
    for k, v in value.items():
        if isinstance(v, list):
            kept = [x for x in v if not isinstance(x, (dict, list))]
            if kept or not v:
                out[k] = kept
        elif not isinstance(v, dict):
            out[k] = v
    return json.dumps(out, ensure_ascii=False)


def flatten_records(records: DataFrame, *, payload: bool = True) -> DataFrame:
    """Tagged rows of ``crawl_records``: tag, record_id, path, parent_path, payload.

    Null data, data that is not valid JSON, missing parts and null elements give no rows; an absent
    list and an empty one alike.  A record written twice gives its rows for each of its ids.  Of a key
    that an object holds twice the last value counts.  Other columns are ignored.
    """
    slim = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.col("data").cast("string").alias("data"),
        (F.to_json("warnings") if payload else F.expr("to_json(transform(warnings, w -> if(w is null, null, struct(1 as a))))")).alias("warnings"),
    )
    slim = slim.where(F.col("data").isNotNull() | F.col("warnings").isNotNull())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, ids, paths, parents, payloads = [], [], [], [], []

            def add(tag, record, path, parent, value):
                tags.append(tag)
                ids.append(record)
                paths.append(path)
                parents.append(parent)
                payloads.append(own_part(value) if payload else None)

            for record, data, warnings in zip(*(c.to_pylist() for c in batch.columns)):
                if data is not None and ('"structured"' in data or "\\u" in data):  # else it has no such part
                    try:
                        top = parse_json(data)
                    except NotJson:
                        top = None
                    for tag, place in PLACES.items():
                        here = top
                        for key in place:
                            here = here.get(key) if isinstance(here, dict) else None
                        for path, parent, value in visit(here, "data." + ".".join(place), "$"):
                            add(tag, record, path, parent, value)
                if warnings is not None:
                    for i, value in enumerate(json.loads(warnings)):
                        if value is not None:
                            add("warnings", record, f"warnings[{i}]", "$", value)
            columns = [pa.array(tags, pa.string()), pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(parents, pa.string()), pa.array(payloads, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tag", "record_id", "path", "parent_path", "payload"])

    return slim.mapInArrow(emit, ROW)


#: Schemas put on the payloads of each tag when its table is read.
TABLES = {
    "jsonLd": "`@type` string, `@id` string, name string, headline string, price string, priceCurrency string, position string, text string, url string",
    "microdata": "types array<string>, id string",
    "warnings": "phase string, url string, reason string, detail string",
}


def write_flat_tables(rows: DataFrame, folder: str) -> None:
    """The tagged rows as Parquet, one partition a tag."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(folder)


def read_flat_table(spark, folder: str, tag: str) -> DataFrame:
    """One tag's table with its schema: only that partition is read."""
    rows = spark.read.parquet(folder).where(F.col("tag") == tag)
    return rows.select("record_id", "path", "parent_path", F.from_json("payload", TABLES[tag]).alias("v"), "payload").select("record_id", "path", "parent_path", "v.*", "payload")


def p5_found(crawl_records: DataFrame) -> DataFrame:
    return flatten_records(crawl_records, payload=False).select("record_id", "parent_path", F.col("path").alias("child_path"))
