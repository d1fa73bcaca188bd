"""Greedy pairs of a first and a second event: the fold over events in order that the batch and the stream share."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexlake.operators.events import with_island


def pair_up(waiting: deque[int], events: Iterable[tuple[int, bool, bool]], within: int) -> Iterator[tuple[int, int]]:
    """Pairs of times from events ``t, opens, closes`` in order of time; at equal times those that only close come first.

    Each closing event takes the earliest opening one still ``waiting`` that is earlier and at most ``within`` back; that is the one whose
    first unused second event it is. ``waiting`` holds what is left.
    """
    for t, opens, closes in events:
        while waiting and waiting[0] < t - within:
            waiting.popleft()
        if closes and waiting and waiting[0] < t:
            yield waiting.popleft(), t
        if opens:
            waiting.append(t)


def greedy_pairs(df: DataFrame, session: str, t: str, is_first: Column, is_second: Column, within: int) -> DataFrame:
    """Pairs each first event with the earliest unused second event after it, at most ``within`` later; earlier first events choose first.

    No pair spans a gap wider than ``within``, so runs of events without such a gap are dealt out and each is folded as its sorted rows
    come by; only first events that still wait are held. Events without a session or a time are left out.
    """
    marked = df.filter(is_first | is_second).select(F.col(session).alias("session"), F.col(t).cast("long").alias("t"), is_first.alias("opens"), is_second.alias("closes")).na.drop(subset=["session", "t"])
    runs = with_island(marked, ["session"], "t", within, "opens").repartition("session", "island").sortWithinPartitions("session", "island", "t", "opens")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting = None, deque()
        for part in parts:
            out = []
            for s, island, at, opens, closes in zip(*(part[c].tolist() for c in ("session", "island", "t", "opens", "closes"))):
                if (s, island) != now:
                    now, waiting = (s, island), deque()
                out += [(s, a, b) for a, b in pair_up(waiting, ((at, opens, closes),), within)]
            yield pd.DataFrame(out, columns=["session", "first_us", "second_us"])

    kind = marked.schema["session"].dataType.simpleString()
    return runs.mapInPandas(fold, f"session {kind}, first_us long, second_us long")
