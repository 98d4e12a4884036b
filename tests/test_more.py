import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import design, http
from pagelathe.operators import archive, crawls, network
from pagelathe.operators import design as sheets
from pagelathe.sources import store
from pagelathe.streaming import stateful


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_colors_and_lengths(spark):
    assert column(spark, ["#AbC", "#aabbcc", "rgb(1, 2, 300)", "rgba(0,0,0,0)", "rgba(1,2,3,.5)", "red", None], design.normal_color) == ["#aabbcc", "#aabbcc", "#0102ff", "transparent", "rgba(1, 2, 3, 0.5)", None, None]
    assert column(spark, ["1.50rem", "0px", "auto", "12PX", "-.125em", ""], design.normal_length)[:4] == ["1.5rem", "0", None, "12px"]
    assert column(spark, ["2rem", "10px", "5%"], design.pixels) == [32.0, 10.0, None]
    ratio = spark.range(1).select(design.contrast(F.lit("#000000"), F.lit("#ffffff"))).first()[0]
    assert ratio == pytest.approx(21.0)


def test_retry_after(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 0, 0, 0)).cast("timestamp")
    assert column(spark, ["120", "-5", "1.5", "Mon, 01 Jan 2024 00:01:00 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "soon", None], lambda c: http.retry_after_s(c, now)) == [120.0, None, None, 60.0, 0.0, None, None]


def test_cookies_and_headers(spark):
    found = column(spark, ["a=1; Domain=.X.test; Max-Age=60; Secure; HttpOnly; SameSite=Lax\nb=2", None, "junk"], lambda c: http.cookies(c, F.lit("2024-01-01 00:00:00").cast("timestamp")))
    assert [[c.name for c in v] for v in found] == [["a", "b"], [], []]
    assert found[0][0].domain == "x.test" and str(found[0][0].expires) == "2024-01-01 00:01:00" and found[0][0].secure and found[0][0].http_only and found[0][0].same_site == "lax"
    row = spark.sql("select map('Cookie','a=1; b=2','X-Api-Key','s','Accept','t') as h").select(http.redacted_headers(F.col("h")).alias("h")).first().h
    assert row == {"Cookie": "a=[redacted]; b=[redacted]", "X-Api-Key": "[redacted]", "Accept": "t"}
    assert column(spark, ["Text/html", "image/png", None], http.keeps_body) == [True, False, False]


def test_sheets(spark):
    css = "<style>/* @media (x) */@media (min-width: 640PX) {.a{color:#FFF;font-family:\"Inter\", sans-serif;gap:4px}} @media(min-width:640px){b{color:white}}</style>"
    pages = spark.createDataFrame([(1, css), (2, None)], "page_id long, html string")
    assert [(r.query, r.n, r.px) for r in sheets.breakpoints(pages).collect()] == [("(min-width:640px)", 2, 640.0)]
    assert [(r.family, r.n) for r in sheets.fonts(pages).collect()] == [("inter", 1)]
    assert [(r.color, r.n) for r in sheets.colors(pages).collect()] == [("#ffffff", 1)]
    assert [r.property for r in sheets.grids(pages).collect()] == ["gap"]


def test_archive(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert archive.capture_name("https://a.test/x?y", at, "html") == "a.test-20240102-030405.html"
    assert archive.capture_name("https://a.test/x", at, "zip", "{host}_{odd}_{date}") == "a.test-odd-20240102.zip"
    assert archive.fnv1a("hello") == "4f9f2cab" and archive.asset_path("https://a.test/i/p.png?x", "image") != archive.asset_path("https://b.test/i/p.png?x", "image")
    text = archive.single_file("<html><body><p>x</body></html>", {"a": "</script>"})
    assert text.count("</script>") == 1 and text.endswith("</body></html>")
    parts = zipfile.ZipFile(io.BytesIO(archive.zipped("<p>", {"metadata": {"a": 1}})))
    assert parts.namelist() == ["page.html", "metadata.json"] and json.loads(parts.read("metadata.json")) == {"a": 1}
    pages = spark.createDataFrame([(1, "https://a.test", "<p>", at), (2, None, None, None)], "page_id long, url string, html string, captured_at timestamp")
    assert archive.archives(pages).count() == 2 and archive.archives(pages, zips=True).count() == 2


def test_store(spark, tmp_path):
    folder = str(tmp_path / "crawl")
    assert store.scan(spark, folder).count() == 0
    records = spark.createDataFrame([("u1", 0, "t", ("fetched", None, None, None), "{}", None)], store.RECORD)
    store.append(records, folder)
    store.append(records, folder)
    (tmp_path / "crawl" / "part-bad.txt").write_text('{"url":"cut\n\n  \n{"url":"u2","depth":1}\n')
    found = store.scan(spark, folder)
    assert sorted((r.url or "", r.ok) for r in found.collect() if r.ok) == [("u1", True), ("u1", True), ("u2", True)]
    assert store.unreadable(found) == 1
    store.save_state(str(tmp_path / "state.json"), {"a": 1})
    assert store.read_state(str(tmp_path / "state.json")) == {"a": 1} and store.read_state(str(tmp_path / "none.json")) is None


def stream(spark, rows, schema, folder, f, mode="append"):
    """A stream over the rows in two files, run to its end."""
    df = spark.createDataFrame(rows, schema)
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    name = "out" + folder.name.replace("-", "_").replace(".", "_")
    q = f(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_stream_budget_is_the_batch_budget(spark, tmp_path):
    rows = [(i % 2, i, float(3 + i % 4)) for i in range(20)]
    out = stream(spark, rows, "host long, seq long, size double", tmp_path, lambda s: stateful.body_budget(s, 12.0, 100.0))
    kept = {(r.host, r.seq) for r in out if r.decision == "kept"} - {(r.host, int(x)) for r in out for x in r.evicted.split(",") if x}
    batch = network.body_budget(spark.createDataFrame(rows, "host long, seq long, size double"), "host", "seq", "size", 12.0)
    assert kept == {(r.host, r.seq) for r in batch.where("kept").collect()}


def test_stream_ring(spark, tmp_path):
    out = stream(spark, [(1, i) for i in range(9)], "host long, seq long", tmp_path, lambda s: stateful.ring(s, 3))
    assert {r.seq: r.oldest for r in out}[8] == 6 and {r.seq: r.oldest for r in out}[1] == 0


def test_stream_pacing_is_the_batch_streak(spark, tmp_path):
    import random

    random.seed(3)
    rows = [(i % 2, i, i * 400, *((True, False) if (x := random.random()) < 0.3 else (False, x > 0.4)), None) for i in range(40)]
    schema = "host long, seq long, at_ms long, ok boolean, failed boolean, retry_after_s double"
    out = stream(spark, rows, schema, tmp_path, stateful.pacing)
    batch = {(r.host, r.seq): r.streak for r in crawls.streaks(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.host, r.seq): r.streak for r in out} == batch
    assert all(r.wait_ms >= 0 for r in out) and any(r.reason == "backoff" for r in out)


def test_stream_vitals(spark, tmp_path):
    rows = [(1, 0, "layout-shift", 0.1, False), (1, 1, "layout-shift", 0.5, True), (1, 2, "event", 80.0, False), (1, 3, "largest-contentful-paint", 900.0, False), (1, 4, "event", 60.0, False), (2, 5, "event", 1.0, False)]
    out = stream(spark, rows, "host long, seq long, kind string, value double, recent_input boolean", tmp_path, stateful.vitals)
    last = [r for r in out if r.host == 1][-1]
    assert (round(last.cls, 3), last.inp, last.lcp) == (0.1, 80.0, 900.0)
    assert [r.cls for r in out if r.host == 2] == [None]


def test_stream_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(hours=i), "view", 1.0) for i in range(30)]
    out = stream(spark, rows, "event_id long, ts timestamp, event_type string, value double", tmp_path, stateful.tumbling)
    assert all(r.n == 6 for r in out) and len(out) >= 3
