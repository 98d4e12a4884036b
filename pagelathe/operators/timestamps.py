"""Mixed timestamp notations and zones, brought to one unambiguous UTC form.

Every value gets the array of all its valid interpretations (order of day and month, unit of an
epoch number, either side of a repeated wall time).  Which of them holds is decided by Viterbi over
the records of one source in their order: switching the notation and jumping back in time cost, and
so does leaving what is declared of the source (its day order; the earlier of two instants).

Records of a source are cut into blocks of ``BLOCK`` consecutive ids, so that a source which holds a
third of all rows is still many bounded groups; the cut depends on ids alone, never on partitions.  The path
is that of the whole source all the same: where a source declares no day order, each block is first summed up
as the cheapest paths from the readings of its first record to those of its last, a row a block; the best way
through the blocks of a source then fixes the readings at both ends of each.  Where one is declared, no transition
outweighs it, and blocks cannot differ.
"""

from __future__ import annotations

import json
import math
import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536
SWITCH, BACKWARD, AGAINST_DECLARED, WRONG_WEEKDAY = 1.0, 1.5, 40.0, 6.0
CANONICAL = r"^(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)$"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ORDERS = ("dmy", "mdy", "ymd")

# Names of months, of weekdays, and small words of dates in the supported languages.
MONTH_NAMES = """
january february march april may june july august september october november december
jan feb mar apr may jun jul aug sep oct nov dec
januar februar märz april mai juni juli august september oktober november dezember
jän feb mrz apr mai jun jul aug sept okt nov dez
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
janv févr mars avr mai juin juil août sept oct nov déc
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
ene feb mar abr may jun jul ago sept oct nov dic
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
jan fev mar abr mai jun jul ago set out nov dez
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
gen feb mar apr mag giu lug ago set ott nov dic
januari februari maart april mei juni juli augustus september oktober november december
jan feb mrt apr mei jun jul aug sep okt nov dec
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
янв фев мар апр мая июн июл авг сен окт ноя дек
"""
WEEKDAY_NAMES = """
monday tuesday wednesday thursday friday saturday sunday
mon tue wed thu fri sat sun
montag dienstag mittwoch donnerstag freitag samstag sonntag
mo di mi do fr sa so
lundi mardi mercredi jeudi vendredi samedi dimanche
lun mar mer jeu ven sam dim
lunes martes miércoles jueves viernes sábado domingo
lun mar mié jue vie sáb dom
segunda terça quarta quinta sexta sábado domingo
seg ter qua qui sex sáb dom
lunedì martedì mercoledì giovedì venerdì sabato domenica
lun mar mer gio ven sab dom
maandag dinsdag woensdag donderdag vrijdag zaterdag zondag
ma di wo do vr za zo
понедельник вторник среда четверг пятница суббота воскресенье
пн вт ср чт пт сб вс
"""
SMALL_WORDS = "at on the of de del du le la el à as às um am den der om op il alle ore a las uhr hrs h г года год в feira st nd rd th er º ª".split()
# Offsets in minutes of zone abbreviations, for sources whose own zone does not use them.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480, "ACST": 570,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "ART": -180, "NPT": 345, "SAST": 120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

MONTHS = {w: i for line in MONTH_NAMES.strip().splitlines() for i, w in enumerate(line.split(), 1)}
WEEKDAYS = {w: i for line in WEEKDAY_NAMES.strip().splitlines() for i, w in enumerate(line.split())}
SMALL = frozenset(SMALL_WORDS)

_ZONE = r"(?P<zone>Z|(?:UTC|GMT)?\s?[+\-−]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?"
_ISO = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp])?(?(8)\.?[Mm]\.?)\s*" + _ZONE + r"(?:\s*\[[^\]]*\])?)?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*" + _ZONE + ")?")
_NUMBER = re.compile(r"(-?\d{9,19})(?:[.,](\d+))?")
_BRACKET = re.compile(r"\s*[\[(][^\])]*[\])]\s*\Z")
_CLOCK = re.compile(
    r"(?<![\d/.-])(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|\s?h\s?(\d{2})(?!\d)|\s?(?:時|时|點|点|시)\s?(\d{1,2})\s?(?:分|분))"
    r"(?:\s?([AaPp])\.?[Mm]\.?(?![^\W\d_]))?"
)
_OFFSET = re.compile(r"(?:UTC|GMT)?\s?([+\-−])(\d{2}):?(\d{2})?\Z")
_EAST = re.compile(r"(\d{4})\s?[年년]\s?(\d{1,2})\s?[月월]\s?(\d{1,2})\s?[日일号]")
_NUMERIC = re.compile(r"(\d{1,4})([./-])(\d{1,2})\2(\d{1,4})")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


@lru_cache(maxsize=512)
def zone_of(name: str | None) -> ZoneInfo | timezone:
    try:
        return ZoneInfo(name) if name else timezone.utc
    except (KeyError, ValueError, OSError):
        return timezone.utc


def _minutes(m: re.Match) -> int:
    return (1 if m.group(1) == "+" else -1) * (int(m.group(2)) * 60 + int(m.group(3) or 0))


def _known_zone(text: str) -> bool:
    return bool(_OFFSET.fullmatch(text)) or text.upper() in ABBREVIATIONS


@lru_cache(maxsize=4096)
def _offset_named(tz_name: str | None, abbreviation: str, year: int) -> int | None:
    """Minutes east of UTC that an abbreviation means in a zone: by that zone's own names, else generally."""
    tz = zone_of(tz_name)
    for month in range(1, 13):
        there = datetime(year, month, 1, 12, tzinfo=tz)
        if there.tzname() == abbreviation:
            return int(there.utcoffset().total_seconds() // 60)
    return ABBREVIATIONS.get(abbreviation)


def _instants(y, mo, d, clock, zone, tz_name) -> list[tuple[int, float]]:
    """(microseconds of UTC, cost) for a wall time; nothing if there is no such time."""
    h, mi, s, digits, half = clock
    h, mi, s = int(h), int(mi or 0), int(s or 0)
    if half and h <= 12:
        if h == 0:
            return []
        h = h % 12 + (12 if half in "pP" else 0)
    carry = timedelta()
    if h == 24 and not mi and not s:
        h, carry = 0, timedelta(days=1)
    if s == 60:
        s, carry = 59, carry + timedelta(seconds=1)
    micro = int((digits or "")[:6].ljust(6, "0"))
    try:
        wall = datetime(y, mo, d, h, mi, s) + carry
        zone = (zone or "").strip()
        if zone:
            if m := _OFFSET.fullmatch(zone):
                minutes = _minutes(m)
            else:
                name = zone.upper()
                if name in ("Z", "UTC", "GMT", "UT"):
                    minutes = 0
                else:
                    tz = zone_of(tz_name)
                    for fold in (0, 1):
                        there = wall.replace(tzinfo=tz, fold=fold)
                        if there.tzname() == name and there.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) == wall:
                            return [(_us(there, micro), 0.0)]
                    minutes = _offset_named(tz_name, name, wall.year)
                    if minutes is None:
                        return []
            return [(_us(wall.replace(tzinfo=timezone.utc) - timedelta(minutes=minutes), micro), 0.0)]
        tz = zone_of(tz_name)
        first, second = wall.replace(tzinfo=tz), wall.replace(tzinfo=tz, fold=1)
        found = [(_us(first, micro), 0.0)]
        if second.utcoffset() < first.utcoffset():  # a wall time that occurs twice; in a gap the later offset is the larger
            found.append((_us(second, micro), AGAINST_DECLARED))
        return found
    except (ValueError, OverflowError):
        return []


def _us(t: datetime, micro: int) -> int:
    delta = t - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + micro


def _day(y: int, mo: int, d: int) -> int | None:
    try:
        return (date(y, mo, d) - date(1970, 1, 1)).days * 86_400_000_000
    except ValueError:
        return None


def interpretations(value: str | None, tz: str | None, day_order: str | None) -> list[tuple[int, bool, str, float]]:
    """All valid readings of a value as (microseconds, is a plain day, notation, cost); [] if it names no date."""
    if value is None:
        return []
    v = value.strip()
    if not any(c.isdigit() for c in v):
        return []

    def made(y, mo, d, clock, zone, how, cost=0.0):
        if clock is None:
            at = _day(y, mo, d)
            return [] if at is None else [(at, True, how, cost)]
        return [(us, False, how, cost + more) for us, more in _instants(y, mo, d, clock, zone, tz)]

    if m := _ISO.fullmatch(v):
        y, mo, d, h, mi, s, digits, half = m.groups()[:8]
        if m["zone"] is None or _known_zone(m["zone"].strip()):
            return made(int(y), int(mo), int(d), None if h is None else (h, mi, s, digits, half), m["zone"], "iso")
        return []
    if v.isdigit() and len(v) in (8, 12, 14) or (v[:8].isdigit() and len(v) > 8 and v[8] in "Tt"):
        if m := _COMPACT.fullmatch(v):
            y, mo, d, h, mi, s, digits = m.groups()[:7]
            if m["zone"] is None or _known_zone(m["zone"].strip()):
                return made(int(y), int(mo), int(d), None if h is None else (h, mi, s, digits, None), m["zone"], "compact")
        return []
    if m := _NUMBER.fullmatch(v):
        number, digits = m.groups()
        unit = {9: 1, 10: 1, 12: 1000, 13: 1000, 15: 10**6, 16: 10**6, 18: 10**9, 19: 10**9}.get(len(number.lstrip("-")))
        if unit is None:
            return []
        whole = int(number + (digits or ""))
        return [(whole * 1_000_000 // (unit * 10 ** len(digits or "")), False, f"epoch{unit}", 0.0)]

    rest, clock, zone = v, None, None
    while m := _BRACKET.search(rest):
        rest = rest[: m.start()]
    if m := _CLOCK.search(rest):
        h, mi, s, digits, with_h, east, half = m.groups()
        clock = (h, mi or with_h or east, s, digits, half)
        after = rest[m.end() :].strip()
        if z := re.match(r"((?:UTC|GMT)?\s?[+\-−]\d{2}:?(?:\d{2})?(?!\d)|[A-Za-z]{1,5}(?![^\W\d_]))", after):
            if _known_zone(z.group(1).strip()) and z.group(1).lower() not in MONTHS:
                zone, after = z.group(1), after[z.end() :]
        rest = rest[: m.start()] + " " + after
    elif re.search(r"\d:\d|\d\s?[時时點点시]", rest):
        return []
    rest = rest.strip(" ,")
    if m := _EAST.search(rest):
        if re.sub(r"[\s,（(][^\s]?[)）]?|\W", "", rest[: m.start()] + rest[m.end() :]):
            return []
        return made(int(m[1]), int(m[2]), int(m[3]), clock, zone, "east")

    weekday, month, numbers, order = None, None, [], None
    numeric = _NUMERIC.search(rest)
    if numeric:
        order = (int(numeric[1]), int(numeric[3]), int(numeric[4]), len(numeric[1]), len(numeric[4]))
        rest = rest[: numeric.start()] + " " + rest[numeric.end() :]
    for token in _TOKEN.findall(rest):
        low = token.lower()
        if low.isdigit():
            if len(low) > 4:
                return []
            numbers.append((int(low), len(low)))
        elif low in MONTHS and month is None and numeric is None and not (weekday is None and low in WEEKDAYS and not numbers and _has_month_later(rest, token)):
            month = MONTHS[low]
        elif low in WEEKDAYS and weekday is None:
            weekday = WEEKDAYS[low]
        elif low in SMALL or not low.isalnum():
            continue
        else:
            return []

    def checked(found):
        if weekday is None:
            return found
        wrong = date(*checked.day).weekday() != weekday if checked.day else False
        return [(a, b, c, cost + (WRONG_WEEKDAY if wrong else 0.0)) for a, b, c, cost in found]

    checked.day = None
    if month is not None and numeric is None:
        if len(numbers) != 2:
            return []
        (a, la), (b, lb) = numbers
        day, year = (b, a) if la == 4 else (a, b)
        if lb != 4 and la != 4:
            year += 2000 if year < 70 else 1900
        found = made(year, month, day, clock, zone, "words")
        if found:
            checked.day = (year, month, day)
        return checked(found)
    if order is None or numbers:
        return []
    a, b, c, la, lc = order
    out = []
    for name in ORDERS:
        if name == "ymd":
            if la < 3 and (lc == 4 or day_order != "ymd"):
                continue
            y, mo, d, ly = a, b, c, la
        else:
            if la > 2 or lc == 3:
                continue
            (d, mo), y, ly = ((a, b) if name == "dmy" else (b, a)), c, lc
        if ly == 3 or ly == 1:
            continue
        if ly == 2:
            y += 2000 if y < 70 else 1900
        declared = day_order is None or name == day_order or la == 4
        found = made(y, mo, d, clock, zone, f"{name}{numeric[2]}", 0.0 if declared else AGAINST_DECLARED)
        checked.day = (y, mo, d) if found else None
        out += checked(found)
    return out


def _has_month_later(rest: str, token: str) -> bool:
    """Words like "mar" are a weekday in one language and a month in another; a later month name settles it."""
    return any(w.lower() in MONTHS for w in re.findall(r"[^\W\d_]+", rest.split(token, 1)[1]))


Reading = tuple[int, bool, str, float]


def _step(before: Reading, after: Reading) -> float:
    return (SWITCH if before[2] != after[2] else 0.0) + (BACKWARD if after[0] < before[0] else 0.0)


def viterbi(rows: list[list[Reading]]) -> list[int | None]:
    """The index of the reading chosen for each record of one source in order; None where there is none.

    A record with one reading pins the path, so the chain falls apart into independent stretches there.
    Ties go to the reading generated first.
    """
    chosen: list[int | None] = [None] * len(rows)
    back: list[tuple[int, list[int]]] = []
    before: list[Reading] = []
    costs: list[float] = []

    def settle(end: int) -> None:
        for at, links in reversed(back):
            chosen[at] = end
            end = links[end] if links else end
        back.clear()

    for i, found in enumerate(rows):
        if not found:
            continue
        new, links = [], []
        for now in found:
            if not before:
                new.append(now[3])
                continue
            best, arg = None, 0
            for j, was in enumerate(before):
                c = costs[j] + _step(was, now)
                if best is None or c < best:
                    best, arg = c, j
            new.append(best + now[3])
            links.append(arg)
        if len(found) == 1:  # pinned: settle all that is open and start again
            if back:
                settle(links[0])
            chosen[i], before, costs = 0, found, [0.0]
            continue
        back.append((i, links if back else []))
        before, costs = found, new
    if back:
        settle(min(range(len(costs)), key=costs.__getitem__))
    return chosen


def transfer(rows: list[list[Reading]]) -> tuple[list[Reading], list[Reading], list[list[float]]] | None:
    """(readings of the first record, of the last, the least cost from each to each) of a block; None of one without readings."""
    found = [r for r in rows if r]
    if not found:
        return None
    costs = [[r[3] if i == j else math.inf for j, r in enumerate(found[0])] for i in range(len(found[0]))]
    for before, after in zip(found, found[1:]):
        costs = [[min(c + _step(b, a) for c, b in zip(row, before)) + a[3] for a in after] for row in costs]
    return found[0], found[-1], costs


def through(blocks: list[tuple[list[Reading], list[Reading], list[list[float]]]]) -> list[tuple[int, int]]:
    """The readings (of the first record, of the last) of each block of a source on the cheapest path through all; ties go to the first."""
    ways: list[list[tuple[int, int]]] = []  # of each block and last reading: (first reading, last reading of the block before)
    costs: list[float] = []
    for n, (first, last, within) in enumerate(blocks):
        enter = [(0.0, 0)] * len(first) if not n else [min((c + _step(b, a), j) for j, (c, b) in enumerate(zip(costs, blocks[n - 1][1]))) for a in first]
        best = [min((enter[i][0] + within[i][j], i) for i in range(len(first))) for j in range(len(last))]
        ways.append([(i, enter[i][1]) for _, i in best])
        costs = [c for c, _ in best]
    out, end = [], min(range(len(costs)), key=costs.__getitem__) if costs else 0
    for way in reversed(ways):
        out.append((way[end][0], end))
        end = way[end][1]
    return out[::-1]


def settled(rows: list[list[Reading]], first: int | None = None, last: int | None = None) -> list[int | None]:
    """``viterbi`` with the readings of the first and the last record that has any fixed, where they are given."""
    some = [i for i, r in enumerate(rows) if r]
    if first is None or not some:
        return viterbi(rows)
    fixed = {some[0]: first, some[-1]: last} if len(some) > 1 else {some[0]: first}
    pick = viterbi([[r[fixed[i]]] if i in fixed else r for i, r in enumerate(rows)])
    return [fixed.get(i, k) for i, k in enumerate(pick)]


def written(us: int, is_day: bool) -> str | None:
    try:
        t = EPOCH + timedelta(microseconds=us)
    except OverflowError:
        return None
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}" if is_day else f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond:06d}Z"


def _readings(pdf: pd.DataFrame) -> list[list[Reading]]:
    known: dict[tuple, list] = {}
    rows = []
    for key in zip(pdf["value"], pdf["tz"], pdf["day_order"]):
        if (found := known.get(key)) is None:
            found = known[key] = interpretations(*(None if not isinstance(x, str) else x for x in key))
        rows.append(found)
    return rows


def _normalise_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["row_id", "field"], kind="stable")
    rows = _readings(pdf)
    first, last = pdf["first"].iloc[0], pdf["last"].iloc[0]
    pick = settled(rows, int(first), int(last)) if first == first and first is not None else viterbi(rows)
    return pd.DataFrame(
        {
            "field": pdf["field"].to_numpy(),
            "row_id": pdf["row_id"].to_numpy(),
            "value": pdf["value"].to_numpy(),
            "utc": [None if k is None else written(found[k][0], found[k][1]) for found, k in zip(rows, pick)],
            "readings": [len(found) for found in rows],
        }
    )


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    found = transfer(_readings(pdf.sort_values(["row_id", "field"], kind="stable")))
    rows = [] if found is None else [(pdf["source"].iloc[0], int(pdf["block"].iloc[0]), json.dumps(found))]
    return pd.DataFrame(rows, columns=["source", "block", "ends"])


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    chosen = through([json.loads(e) for e in pdf["ends"]])
    return pd.DataFrame({"source": pdf["source"].to_numpy(), "block": pdf["block"].to_numpy(), "first": [a for a, _ in chosen], "last": [b for _, b in chosen]})


def normalise_timestamps(df: DataFrame, *, source: Column, block: int = BLOCK) -> DataFrame:
    """``field, row_id, value, utc, readings`` for rows of ``field, row_id, value, tz, day_order``.

    Nulls, blanks and values that name no date come out with ``utc`` null and ``readings`` 0; a null or
    unknown zone is UTC; a null day order, which a source has for all its rows or none, leaves the order of day and month
    to the Viterbi pass.  Rows that repeat come out as often as they went in; an empty table gives an empty table; other
    columns are ignored.
    """
    slim = df.select("field", F.col("row_id").cast("long").alias("row_id"), "value", "tz", "day_order", F.coalesce(source.cast("string"), F.lit("")).alias("source"))
    slim = slim.withColumn("block", F.floor(F.coalesce("row_id", F.lit(0)) / block))
    ends = slim.where(F.col("day_order").isNull()).groupBy("source", "block").applyInPandas(_summary, "source string, block long, ends string").groupBy("source").applyInPandas(_ends, "source string, block long, first int, last int")
    return slim.join(ends, ["source", "block"], "left").groupBy("source", "block").applyInPandas(_normalise_group, "field string, row_id long, value string, utc string, readings int")


def p1_found(entity_dates: DataFrame, crawl_records: DataFrame, sites: DataFrame) -> DataFrame:
    """Non-canonical values of eventStart, eventEnd and at, with the instant or plain day they name."""
    zones = sites.select("site_id", "host", "tz", "day_order")
    events = (
        entity_dates.where(F.col("field").isin("eventStart", "eventEnd") & F.col("value").isNotNull())
        .select("field", F.col("date_id").alias("row_id"), "value", "site_id")
        .join(zones.drop("host"), "site_id", "left")
        .select("field", "row_id", "value", "tz", "day_order", F.concat(F.lit("site "), F.coalesce(F.col("site_id").cast("string"), F.lit(""))).alias("source"))
    )
    crawls = (
        crawl_records.where(F.col("at").isNotNull())
        .select(F.lit("at").alias("field"), F.col("record_id").alias("row_id"), F.col("at").alias("value"), "crawl_name")
        .join(zones.drop("site_id").withColumnRenamed("host", "crawl_name"), "crawl_name", "left")
        .select("field", "row_id", "value", "tz", "day_order", F.concat(F.lit("crawl "), F.coalesce("crawl_name", F.lit(""))).alias("source"))
    )
    return normalise_timestamps(events.unionByName(crawls), source=F.col("source")).where(F.col("utc").isNotNull() & ~F.col("value").rlike(CANONICAL.replace("$", r"\z"))).select("field", "row_id", "utc")
