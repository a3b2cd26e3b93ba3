"""Greedy sliding windows over request logs: rate limits and login lockout, in batch and as streams.

Only allowed requests count for later ones, so no SQL frame gives these. A key's events are folded in
order of time; state is the few times that still count. The batch twin cuts a key's events where a window passes without
one and spreads the runs over tasks; the stream keeps events and state in Spark's store until event time has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


@dataclass
class Limit:
    """At most ``limit`` allowed requests in ``window`` seconds."""

    limit: int
    window: float
    times: list[float] = field(default_factory=list)

    def step(self, now: float, kind: str = "request") -> tuple[bool, float, int]:
        """(allowed, seconds to wait, requests left)."""
        self.times = [t for t in self.times if now - t < self.window]
        if len(self.times) >= self.limit:
            return False, round(max(1.0, self.window - (now - self.times[0])), 1), 0
        self.times.append(now)
        return True, 0.0, self.limit - len(self.times)


@dataclass
class Lockout:
    """Locked at ``limit`` failures in ``window`` seconds; attempts while locked don't count, a success clears."""

    limit: int
    window: float
    times: list[float] = field(default_factory=list)

    def step(self, now: float, kind: str) -> tuple[bool, float, int]:
        self.times = [t for t in self.times if now - t < self.window]
        if len(self.times) >= self.limit:
            return False, round(max(1.0, self.window - (now - self.times[0])), 1), 0
        if kind == "login_failed":
            self.times.append(now)
        elif kind == "login_ok":
            self.times = []
        return True, 0.0, self.limit - len(self.times)


KINDS = {"limit": Limit, "lockout": Lockout}
OUT = "event_id bigint, key string, ts double, allowed boolean, retry_after double, remaining int"


#: Windows that a stretch of a key's time is wide, when events are cut into islands.
STRETCH = 64


def islands(events: DataFrame, window: float) -> DataFrame:
    """Events (key, ts, event_id, and more) with ``stretch`` and ``island``, which with the key name runs without a gap of ``window``.

    Nothing counts any more after such a gap, so runs are independent of each other. A key's time is cut into stretches of
    ``STRETCH`` windows, each numbered by itself; a second pass over one row for each stretch joins runs that go on in the
    next. So no task holds a key's events, only a stretch's.
    """
    place = Window.partitionBy("key", "_s").orderBy("ts", "event_id")
    cut = events.withColumn("_s", F.floor(F.col("ts") / (STRETCH * window)))
    before = F.lag("ts").over(place)
    cut = cut.withColumn("_new", (before.isNull() | (F.col("ts") - before >= window)).cast("int"))
    cut = cut.withColumn("_n", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = cut.groupBy("key", "_s").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("_n").alias("n"))
    order = Window.partitionBy("key").orderBy("_s")
    pieces = pieces.withColumn("goes_on", F.coalesce(F.col("first") - F.lag("last").over(order) < window, F.lit(False)))
    tail = F.when((F.col("n") > 1) | ~F.col("goes_on"), F.struct(F.col("_s").alias("s"), F.col("n").alias("n")))
    origin = F.last(tail, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("key", "_s", F.when(F.col("goes_on"), origin).alias("origin"))
    joined = cut.join(pieces, ["key", "_s"])
    from_before = (F.col("_n") == 1) & F.col("origin").isNotNull()
    stretch, number = F.when(from_before, F.col("origin.s")).otherwise(F.col("_s")), F.when(from_before, F.col("origin.n")).otherwise(F.col("_n"))
    return joined.withColumn("stretch", stretch).withColumn("island", number).drop("_s", "_new", "_n", "origin")


def _folded(events: DataFrame, kind: str, limit: int, window: float) -> DataFrame:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, KINDS[kind](limit, window)
        for b in batches:
            rows = []
            for e, k, t, what, s, n in zip(b["event_id"], b["key"], b["ts"], b["kind"], b["stretch"], b["island"], strict=True):
                if (k, s, n) != run:
                    run, state = (k, s, n), KINDS[kind](limit, window)
                rows.append((e, k, t, *state.step(t, what), s, n))
            yield pd.DataFrame(rows, columns=["event_id", "key", "ts", "allowed", "retry_after", "remaining", "stretch", "island"])

    rows = islands(events.select("event_id", "key", "ts", "kind").where("key is not null and ts is not null"), window)
    dealt = rows.repartition("key", "stretch", "island").sortWithinPartitions("key", "stretch", "island", "ts", "event_id")
    return dealt.select("event_id", "key", "ts", "kind", "stretch", "island").mapInPandas(fold, OUT + ", stretch bigint, island bigint")


def replay(events: DataFrame, kind: str, limit: int, window: float) -> DataFrame:
    """Decisions on events (event_id, key, ts in seconds, kind), folded in order (ts, event_id) within each island of a key."""
    return _folded(events, kind, limit, window).drop("stretch", "island")


def state_spans(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Times in which a rate limit holds state for a key: (key, since, until, allowed requests); at ``until`` the key is evicted.

    ``until`` is the last allowed request's time and the window.
    """
    allowed = _folded(events, "limit", limit, window).where("allowed")
    place = Window.partitionBy("key", "stretch", "island").orderBy("ts", "event_id")
    before = F.lag("ts").over(place)
    opened = allowed.withColumn("_open", (before.isNull() | (F.col("ts") - before >= window)).cast("int"))
    spans = opened.withColumn("_span", F.sum("_open").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    found = spans.groupBy("key", "stretch", "island", "_span").agg(F.min("ts").alias("since"), (F.max("ts") + window).alias("until"), F.count("*").alias("n"))
    return found.select("key", "since", "until", "n")


#: Rows that come later than this behind the newest are late.
LATENESS = "10 minutes"


class _Processor(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them, then folds them in order of time."""

    def __init__(self, kind: str, limit: int, window: float):
        self.kind, self.limit, self.window = kind, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")
        self.waiting = handle.getListState("waiting", "event_id long, ts double, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        late, earliest = [], None
        for b in rows:
            for e, t, what in zip(b["event_id"].tolist(), b["ts"].tolist(), b["kind"].tolist(), strict=True):
                if t <= mark:
                    late.append((e, key[0], t, None, None, None, True))
                else:
                    self.waiting.appendValue((e, t, what))
                    earliest = t if earliest is None else min(earliest, t)
        if earliest is not None:
            self._wake(earliest)
        yield _decisions(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        events = sorted((t, e, what) for e, t, what in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in events if x[0] <= mark], [(e, t, what) for t, e, what in events if t > mark]
        state = KINDS[self.kind](self.limit, self.window, [t for (t,) in self.times.get()] if self.times.exists() else [])
        out = [(e, key[0], t, *state.step(t, what), False) for t, e, what in due]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        live = [t for t in state.times if mark - t < self.window]
        self.times.put([(t,) for t in live]) if live else self.times.clear()
        if rest:
            self._wake(min(t for _, t, _ in rest))
        if live:
            self._wake(live[-1] + self.window)
        yield _decisions(out)

    def _wake(self, seconds: float) -> None:
        self.handle.registerTimer(int(-(-seconds * 1000 // 1)) + 1)

    def close(self) -> None:
        pass


_COLUMNS = ["event_id", "key", "ts", "allowed", "retry_after", "remaining", "late"]


def _decisions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"allowed": "boolean", "retry_after": "Float64", "remaining": "Int64"})


def stream(events: DataFrame, kind: str, limit: int, window: float, lateness: str = LATENESS) -> DataFrame:
    """The same decisions on a stream of events, by event time, whatever the order in which they come.

    A decision comes out when the watermark (``lateness`` behind the newest event) has passed its event, so rows in any order
    within it get what :func:`replay` gives them. Rows behind the watermark are given back with ``late`` and no decision; they
    change nothing. A key without live times has no state once the watermark is a window further. The session needs the
    RocksDB state store.
    """
    timed = events.where("key is not null and ts is not null").withColumn("_time", F.timestamp_micros(F.floor(F.col("ts") * 1e6).cast("bigint")))
    # without the time's column the rows behind the watermark are not dropped by Spark, but reach the processor
    rows = timed.withWatermark("_time", lateness).select("event_id", "key", "ts", "kind")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Processor(kind, limit, window), outputStructType=OUT + ", late boolean", outputMode="append", timeMode="EventTime")


def numbered(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """Timestamps as seconds."""
    return events.withColumn(time_col, F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6)
