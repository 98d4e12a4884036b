"""Crawl stores as JSON Lines: append, scan with what cannot be read, latest, checkpoint (SRC13-14, SNK1-2, WIN15)."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "url string, depth int, at string, outcome struct<kind:string,driver:string,reason:string,detail:string>, data string, "
    "warnings array<struct<phase:string,url:string,reason:string,detail:string>>"
)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``ok, raw`` and the fields of a record for each line that is not blank; a line that cannot be read has ok false.

    An absent file is an empty table.
    """
    schema = f"ok boolean, raw string, {RECORD}"
    if not list(Path().glob(path)) if not os.path.isabs(path) else not os.path.exists(path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{RECORD}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.col("value").alias("raw"), parsed.alias("r"))
    fields = [f.split()[0] for f in RECORD.replace("struct<kind:string,driver:string,reason:string,detail:string>", "s").replace("array<struct<phase:string,url:string,reason:string,detail:string>>", "w").split(", ")]
    return rows.select(F.col("r._bad").isNull().alias("ok"), "raw", *[F.col(f"r.{f}").alias(f) for f in fields])


def unreadable(records: DataFrame) -> int:
    return records.where(~F.col("ok")).count()


def append(records: DataFrame, folder: str) -> None:
    """Records as further JSON Lines files of a folder."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def save_state(path: str, state: dict) -> None:
    """A checkpoint written whole or not at all: to a file beside it, then renamed."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as file:
        json.dump(state, file)
    os.replace(name, path)


def read_state(path: str) -> dict | None:
    """The checkpoint; None where there is none or it cannot be read."""
    try:
        with open(path) as file:
            return json.load(file)
    except (OSError, ValueError):
        return None
