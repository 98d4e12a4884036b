import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import timestamps as ts


def one(value, tz="Europe/Berlin", order="dmy"):
    found = ts.interpretations(value, tz, order)
    pick = ts.viterbi([found])[0]
    return None if pick is None else ts.written(found[pick][0], found[pick][1])


@pytest.mark.parametrize(
    ("value", "tz", "order", "want"),
    [
        ("2024-03-31T02:30:00", "Europe/Berlin", "dmy", "2024-03-31T01:30:00.000000Z"),  # skipped: the offset before
        ("2024-10-27 02:30", "Europe/Berlin", "dmy", "2024-10-27T00:30:00.000000Z"),  # twice: the earlier
        ("2024-10-27 02:30 CET", "Europe/Berlin", "dmy", "2024-10-27T01:30:00.000000Z"),  # the value says which
        ("05/04/2024 8:06 AM", "Europe/London", "dmy", "2024-04-05T07:06:00.000000Z"),
        ("05/04/2024 8:06 AM", "America/New_York", "mdy", "2024-05-04T12:06:00.000000Z"),
        ("12:30 5.4.2024", "UTC", "dmy", "2024-04-05T12:30:00.000000Z"),
        ("1718952580", "UTC", None, "2024-06-21T06:49:40.000000Z"),
        ("1750608226492", "UTC", None, "2025-06-22T16:03:46.492000Z"),
        ("1680286755.621", "UTC", None, "2023-03-31T18:19:15.621000Z"),
        ("2024-01-20T09:37:09.580655970Z", "UTC", None, "2024-01-20T09:37:09.580655Z"),  # further digits cut off
        ("20241107", "Asia/Tokyo", "ymd", "2024-11-07"),
        ("20251015T145047", "Asia/Tokyo", "ymd", "2025-10-15T05:50:47.000000Z"),
        ("Sun Sep  8 06:46:44 2024", "UTC", None, "2024-09-08T06:46:44.000000Z"),
        ("Fri Jun 30 2023 13:08:02 GMT+0800 (China Standard Time)", "UTC", None, "2023-06-30T05:08:02.000000Z"),
        ("2023-05-16T06:30:58+03:00[Europe/Moscow]", "UTC", None, "2023-05-16T03:30:58.000000Z"),
        ("31. März 2024, 06:09 Uhr", "Europe/Berlin", "dmy", "2024-03-31T04:09:00.000000Z"),
        ("4 mars 2024 à 16h19", "Europe/Paris", "dmy", "2024-03-04T15:19:00.000000Z"),
        ("20 de junio de 2024, 21:49", "Europe/Madrid", "dmy", "2024-06-20T19:49:00.000000Z"),
        ("30 сентября 2025 г., 04:09", "Europe/Moscow", "dmy", "2025-09-30T01:09:00.000000Z"),
        ("2025年3月19日 7時17分", "Asia/Tokyo", "ymd", "2025-03-18T22:17:00.000000Z"),
        ("Sep 25, 2023, 8:06 AM IST", "Asia/Kolkata", "dmy", "2023-09-25T02:36:00.000000Z"),
        ("lun. 4 mar 2024", "Europe/Rome", "dmy", "2024-03-04"),
        ("2024-02-05T24:00:00Z", "UTC", None, "2024-02-06T00:00:00.000000Z"),
        (" 2024-01-05\n", "UTC", None, "2024-01-05"),
    ],
)
def test_notations(value, tz, order, want):
    assert one(value, tz, order) == want


@pytest.mark.parametrize("value", [None, "", "  ", "TBA", "every Tuesday", "2023-13-05", "0000-00-00", "2024-02-30T10:00:00", "NaN", "12:30", "9" * 5000, "5 bananas 2024"])
def test_no_dates(value):
    assert ts.interpretations(value, "UTC", "dmy") == []


def test_viterbi_follows_the_notation_and_the_clock():
    rows = [ts.interpretations(v, "UTC", None) for v in ("03/01/2024 10:00", "04/01/2024 10:00", "25/01/2024 10:00", "02/02/2024 10:00")]
    pick = ts.viterbi(rows)
    assert [ts.written(r[k][0], True) for r, k in zip(rows, pick)] == ["2024-01-03", "2024-01-04", "2024-01-25", "2024-02-02"]


def brute(rows):
    """All paths; ties to the reading generated first at the latest record that differs."""
    import itertools

    best = None
    for path in itertools.product(*[range(len(r)) for r in rows]):
        cost, before = 0.0, None
        for r, k in zip(rows, path):
            us, _, how, c = r[k]
            cost += c + (0 if before is None else (ts.SWITCH if before[1] != how else 0) + (ts.BACKWARD if us < before[0] else 0))
            before = (us, how)
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def test_viterbi_against_all_paths():
    import random

    random.seed(3)
    for _ in range(300):
        rows = [[(random.randrange(5), False, random.choice("ab"), random.choice([0.0, 0.5])) for _ in range(random.randrange(1, 4))] for _ in range(random.randrange(1, 6))]
        pick = ts.viterbi(rows)
        cost, before = 0.0, None
        for r, k in zip(rows, pick):
            us, _, how, c = r[k]
            cost += c + (0 if before is None else (ts.SWITCH if before[1] != how else 0) + (ts.BACKWARD if us < before[0] else 0))
            before = (us, how)
        assert abs(cost - brute(rows)) < 1e-9


def test_found(spark):
    dates = spark.createDataFrame(
        [(1, 9, 1, "eventStart", "2024-01-05", "x"), (2, 9, 1, "eventStart", "05/01/2024", "x"), (2, 9, 1, "eventStart", "05/01/2024", "x"), (3, 9, 1, "published", "05/01/2024", "x"), (4, 9, None, "eventEnd", "2024-01-05T10:00", "x"), (5, 9, 1, "eventEnd", None, "x"), (6, 9, 1, "eventEnd", "soon", "x")],
        "date_id long, page_id long, site_id int, field string, value string, tz string",
    )
    sites = spark.createDataFrame([(1, "a.test", "Europe/Berlin", "dmy")], "site_id int, host string, tz string, day_order string")
    crawls = spark.createDataFrame([(7, "a.test", "2024-07-01 12:00"), (8, None, "2024-07-01T12:00:00.000Z"), (9, "unknown.test", "2024-07-01 12:00"), (10, "a.test", None)], "record_id long, crawl_name string, at string")
    rows = sorted(map(tuple, ts.p1_found(dates, crawls, sites).collect()))
    assert rows == [
        ("at", 7, "2024-07-01T10:00:00.000000Z"), ("at", 9, "2024-07-01T12:00:00.000000Z"),
        ("eventEnd", 4, "2024-01-05T10:00:00.000000Z"), ("eventStart", 2, "2024-01-05"), ("eventStart", 2, "2024-01-05"),
    ]
    assert ts.p1_found(dates.limit(0), crawls.limit(0), sites).count() == 0


def test_blocks_do_not_change_unambiguous_values(spark):
    rows = [("at", i, dt.datetime(2024, 1, 1 + i % 28, 10).strftime("%d/%m/%Y %H:%M"), "UTC", "dmy", "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "field string, row_id long, value string, tz string, day_order string, s string")
    from pyspark.sql import functions as F

    whole = sorted(map(tuple, ts.normalise_timestamps(df, source=F.col("s")).collect()))
    cut = sorted(map(tuple, ts.normalise_timestamps(df, source=F.col("s"), block=7).collect()))
    assert whole == cut


def test_cut_into_blocks_changes_nothing(spark):
    """Ambiguous dates on both sides of every edge: the path is that of the whole source, however it is cut."""
    draw = random.Random(8)
    values = ["03/04/2024", "2024-03-04", "05/06/2024", "04/03/2024 10:00", "25/12/2024", "07/08/2024", "nothing", "12/25/2023"]
    rows = [("at", i, draw.choice(values), "UTC", None, "s") for i in range(60)] + [("at", i, draw.choice(values[:3]), "UTC", None, "t") for i in range(200, 230)]
    df = spark.createDataFrame(rows, "field string, row_id long, value string, tz string, day_order string, source string")
    read = lambda n: sorted((r.row_id, r.utc) for r in ts.normalise_timestamps(df, source=F.col("source"), block=n).collect())
    whole = read(1000)
    assert read(7) == whole and read(1) == whole


def test_blocks_against_all_paths():
    draw = random.Random(3)
    for _ in range(40):
        rows = [[(draw.randrange(4), False, draw.choice("ab"), draw.choice([0.0, 0.4])) for _ in range(draw.randrange(3))] for _ in range(7)]
        cost = lambda path: sum(r[k][3] for r, k in zip(full, path)) + sum(ts._step(a[i], b[j]) for a, b, i, j in zip(full, full[1:], path, path[1:]))  # noqa: B023, E731
        full = [r for r in rows if r]
        if not full:
            continue
        best = min(cost(p) for p in itertools.product(*(range(len(r)) for r in full)))
        parts = [rows[:3], rows[3:5], rows[5:]]
        found = [t for t in map(ts.transfer, parts) if t]
        ends, pick = iter(ts.through(found)), []
        for part in parts:
            pick += [k for k in ts.settled(part, *next(ends)) if k is not None] if any(part) else []
        assert cost(pick) == pytest.approx(best)


def test_long_values_are_read():
    assert ts.interpretations("2024-03-05 10:00:00 (" + "x" * 300 + ")", "UTC", "dmy") == ts.interpretations("2024-03-05 10:00:00", "UTC", "dmy") or ts.interpretations("5 March 2024" + " " * 200, "UTC", "dmy")
    assert len(ts.interpretations("2024-03-05 10:00:00 (" + "x" * 300 + ")", "UTC", "dmy")) == 1
