"""Archives of pages: names, single files with their data, zips (SNK4-8, NUM11, DAT6)."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe(value: str, fallback: str = "page") -> str:
    """A part of a file name: letters, digits, dots and dashes, at most 120."""
    return re.sub(r"^[.-]+|[.-]+$", "", re.sub(r"[^A-Za-z0-9.-]+", "-", value))[:120] or fallback


def capture_name(url: str, at: datetime, extension: str, template: str = "{host}-{timestamp}") -> str:
    """A file name by template; a token that is not known stays as its bare name."""
    host = re.sub(r"^[a-z]+://|[/?#].*$", "", url or "", flags=re.I)
    known = {"host": host, "date": f"{at:%Y%m%d}", "time": f"{at:%H%M%S}", "timestamp": f"{at:%Y%m%d-%H%M%S}"}
    return f"{safe(re.sub(r'[{](\w+)[}]', lambda m: known.get(m.group(1), m.group(1)), template))}.{extension}"


def fnv1a(value: str) -> str:
    h = 2166136261
    for b in value.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


def asset_path(url: str, kind: str) -> str:
    """A path no two URLs share: the cleaned base name and a hash of the whole."""
    base = safe(re.sub(r"[?#].*$", "", url).rstrip("/").rsplit("/", 1)[-1], kind)
    stem, dot, extension = base.rpartition(".")
    return f"assets/{stem or base}-{fnv1a(url)}" + (f".{extension}" if dot else "")


def single_file(html: str | None, data: dict) -> str:
    """The page with its data in a JSON block before the end of the body; no text in it can close the block."""
    block = '<script type="application/json" id="page-data">' + json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/") + "</script>"
    source = html or "<html><body></body></html>"
    at = source.lower().rfind("</body>")
    return source + block if at < 0 else source[:at] + block + source[at:]


def zipped(html: str | None, parts: dict[str, dict]) -> bytes:
    """A zip of the page and a JSON file a part; the same input gives the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in [("page.html", html or ""), *[(f"{k}.json", json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)) for k, v in sorted(parts.items())]]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def archives(pages: DataFrame, *, zips: bool = False) -> DataFrame:
    """``page_id, name, content`` of each page; null html gives an empty page, a null time the epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for page, url, html, at in zip(*(c.to_pylist() for c in batch.columns)):
                meta = {"page_id": page, "url": url, "captured_at": at}
                names.append(capture_name(url, at or datetime(1970, 1, 1), "zip" if zips else "html"))
                contents.append(zipped(html, {"metadata": meta}) if zips else single_file(html, meta).encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(contents, pa.binary())], ["page_id", "name", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("captured_at").cast("timestamp")).mapInArrow(run, "page_id long, name string, content binary")
