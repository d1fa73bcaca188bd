"""Streaming forms of the event operators; over the same rows they give what the batch forms give."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cortexlake.operators.pairing import pair_up


def debounced_stream(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Runs of rows of the same keys that follow each other by at most ``gap``: a session window for each; rows later than ``late`` are dropped.

    State holds open windows only: a window is given out and forgotten once the watermark has passed its end.
    """
    w = F.session_window(ts, gap)
    runs = events.withWatermark(ts, late).groupBy(*keys, w).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return runs.select(*keys, "start", "last", "repeats")


def window_counts_stream(events: DataFrame, keys: list[str], ts: str, size: str, slide: str, late: str) -> DataFrame:
    """Rows per sliding window."""
    w = F.window(ts, size, slide)
    return events.withWatermark(ts, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


class _Pairing(StatefulProcessor):
    """Events of a session wait until the watermark has passed them, so that they are folded in order; then only first events that may still be paired stay."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t long, opens boolean, closes boolean")
        self.waiting = handle.getListState("waiting", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = list(zip(part["t"].astype(int).tolist(), part["opens"].astype(bool).tolist(), part["closes"].astype(bool).tolist()))
            if new:
                self.events.appendList(new)
                for at in {t // 1000 + 1 for t, _, _ in new}:
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(tuple(x) for x in self.events.get())
        due, later = [x for x in held if x[0] < now], [x for x in held if x[0] >= now]
        waiting = deque(x[0] for x in self.waiting.get())
        pairs = list(pair_up(waiting, due, self.within))
        for state, left in ((self.events, later), (self.waiting, [(t,) for t in waiting if t >= now - self.within])):
            state.put(left) if left else state.clear()
        if waiting and not later:  # forget those that nothing can follow any more
            self.handle.registerTimer((max(waiting) + self.within) // 1000 + 2)
        if pairs:
            first, second = zip(*pairs)
            yield pd.DataFrame({"session": pd.Series([key[0]] * len(pairs), dtype=object), "first_us": first, "second_us": second})

    def close(self) -> None:
        pass


def paired_stream(events: DataFrame, session: str, ts: str, is_first: Column, is_second: Column, within_us: int, late: str) -> DataFrame:
    """``session, first_us, second_us`` as greedy_pairs() gives them, each once the watermark has passed its second event; times in microseconds.

    Rows later than ``late`` are dropped. State holds the events that the watermark hasn't passed and the first events that
    may still be paired, and nothing of a session whose last event is ``within_us`` behind the watermark. Needs the RocksDB state store.
    """
    epoch = F.unix_micros(F.col(ts))
    marked = events.filter(is_first | is_second).withWatermark(ts, late).select(F.col(session).alias("session"), F.col(ts).alias("ts"), epoch.alias("t"), is_first.alias("opens"), is_second.alias("closes"))
    shape = f"session {marked.schema['session'].dataType.simpleString()}, first_us long, second_us long"
    return marked.groupBy("session").transformWithStateInPandas(_Pairing(within_us), shape, "Append", "EventTime")
