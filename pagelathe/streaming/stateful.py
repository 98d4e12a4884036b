"""Stateful operators on streams: body budget, ring buffer, pacing of hosts, web vitals; and windows with late data.

State a key is bounded: by the cap of the budget, the size of the ring, or a fixed record.  Each also has
a batch form in ``operators``, which the tests hold it against.  STR1-7, STR11.
Stops of a whole crawl (STR12, WIN13) are in batch only: ``crawls.crawl_stop``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelathe.operators.crawls import BASE_MS, HOST_ERRORS, INTERVAL_MS, MOST_MS


def _keyed(stream: DataFrame, key: str, update, output: str) -> DataFrame:
    """``update(state, rows) -> rows`` run for each key with its state as JSON."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(batches), ignore_index=True)
        out = update(held, pdf)
        state.update((json.dumps(held),))
        out.insert(0, key, k[0])
        yield out

    return stream.groupBy(key).applyInPandasWithState(run, output, "held string", "append", GroupStateTimeout.NoTimeout)


def body_budget(stream: DataFrame, cap: float, each: float) -> DataFrame:
    """``host, seq, decision, evicted``: each body as it arrives, and the numbers of those that go for it.

    A body above ``each`` is over-cap; null sizes are unreadable; the oldest kept go until the rest is within ``cap``.
    """

    def update(held: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = held.setdefault("kept", [])
        rows = []
        for seq, size in sorted(zip(pdf["seq"].tolist(), pdf["size"].tolist()), key=lambda x: x[0]):
            gone = []
            if size is None or size != size:
                decision = "unreadable"
            elif size > each:
                decision = "over-cap"
            else:
                decision = "kept"
                kept.append([int(seq), float(size)])
                total = sum(s for _, s in kept)
                while kept and total > cap:
                    old, s = kept.pop(0)
                    total -= s
                    gone.append(str(old))
            rows.append((seq, decision, ",".join(gone)))
        return pd.DataFrame(rows, columns=["seq", "decision", "evicted"])

    return _keyed(stream.select("host", "seq", "size"), "host", update, "host long, seq long, decision string, evicted string")


def ring(stream: DataFrame, size: int) -> DataFrame:
    """``host, seq, oldest``: for each entry the oldest one still in the ring after it."""

    def update(held: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        entries: list = held.setdefault("entries", [])
        rows = []
        for seq in sorted(int(s) for s in pdf["seq"]):
            entries.append(seq)
            del entries[:-size]
            rows.append((seq, entries[0]))
        return pd.DataFrame(rows, columns=["seq", "oldest"])

    return _keyed(stream.select("host", "seq"), "host", update, "host long, seq long, oldest long")


def pacing(stream: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """``host, seq, wait_ms, reason, streak, stopped``: what each request owes, and what its outcome does to its host.

    Input: ``host, seq, at_ms, ok, failed, retry_after_s``.  The longest of the rate limit and the backoff
    holds; a success clears the streak; the limit of failures in a row stops the host for good.
    """

    def update(held: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for seq, at, ok, failed, asked in sorted(pdf[["seq", "at_ms", "ok", "failed", "retry_after_s"]].itertuples(index=False), key=lambda r: r[0]):
            owed = {"rate-limit": held["last"] + interval_ms - at if "last" in held else 0, "backoff": held.get("retry", 0) - at}
            reason = max(owed, key=lambda k: owed[k])
            wait = max(0, int(owed[reason]))
            held["last"] = int(at)
            if ok:
                held["streak"] = 0
                held.pop("retry", None)
            elif failed:
                held["streak"] = held.get("streak", 0) + 1
                proposed = asked * 1000.0 if asked is not None and asked == asked else BASE_MS * 2.0 ** min(held["streak"] - 1, 30)
                held["retry"] = int(at + min(max(proposed, BASE_MS), MOST_MS))
                held["stopped"] = held.get("stopped", False) or held["streak"] >= HOST_ERRORS
            rows.append((seq, wait, reason if wait else "go", held.get("streak", 0), held.get("stopped", False)))
        return pd.DataFrame(rows, columns=["seq", "wait_ms", "reason", "streak", "stopped"])

    return _keyed(stream.select("host", "seq", "at_ms", "ok", "failed", "retry_after_s"), "host", update, "host long, seq long, wait_ms long, reason string, streak int, stopped boolean")


def vitals(stream: DataFrame) -> DataFrame:
    """``host, cls, inp, lcp`` so far after each batch: sum of shifts without recent input, longest interaction, last paint.

    Input: ``host, seq, kind, value, recent_input``; what was never observed stays null.
    """

    def update(held: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        for seq, kind, value, recent in sorted(pdf[["seq", "kind", "value", "recent_input"]].itertuples(index=False), key=lambda r: r[0]):
            if kind == "layout-shift":
                held["cls"] = held.get("cls", 0.0) + (0.0 if recent else value)
            elif kind in ("event", "first-input"):
                held["inp"] = max(held.get("inp", value), value)
            elif kind == "largest-contentful-paint":
                held["lcp"] = value
        return pd.DataFrame([(held.get("cls"), held.get("inp"), held.get("lcp"))], columns=["cls", "inp", "lcp"]).astype(float)

    return _keyed(stream.select("host", "seq", "kind", "value", "recent_input"), "host", update, "host long, cls double, inp double, lcp double")


def tumbling(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts a window and type, events later than the watermark left out.  Beyond what the reference has."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
