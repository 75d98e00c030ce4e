"""Trends of boards as a stream: a state for each board holds its last five observations, whatever order they come in (INC-07, AGG-21, WIN-28)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.num import rounded

LAST = 5
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "board string, seen array<struct<at:timestamp,heat:double>>, expired boolean"


class LastObservations(StatefulProcessor):
    """Keeps a board's last observations by their time; a late one takes its place among them or is too old to count. A board without any for so many days is dropped."""

    def __init__(self, days: float):
        self.quiet = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at array<long>, heat array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(zip(*self.seen.get())) if self.seen.exists() else []
        for part in rows:
            held += zip((int(t.value // 1000) for t in part["at"]), part["heat"].tolist())
            held = sorted(held)[-LAST:]  # at most a part and five more are held
        self.seen.update((([a for a, _ in held]), [h for _, h in held]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1][0] // 1000 + self.quiet)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(zip(*self.seen.get())) if self.seen.exists() else []
        self.seen.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass

    def _row(self, key, held, expired: bool) -> pd.DataFrame:
        seen = [{"at": pd.Timestamp(a * 1000), "heat": float(h)} for a, h in held]
        return pd.DataFrame({"board": [key[0]], "seen": [seen], "expired": [expired]})


def trend_columns(seen: Column, threshold: float = 5.0) -> dict[str, Column]:
    """What heat_trends tells, from an array of a board's last observations (at, heat) in their order."""
    heat = F.transform(seen, lambda x: x["heat"])
    n = F.size(heat)
    latest, first, prev = F.get(heat, n - 1), F.get(heat, F.lit(0)), F.get(heat, n - 2)
    trend = rounded(latest - first)
    cooling = rounded(F.greatest(F.coalesce(prev - latest, F.lit(0.0)), F.lit(0.0)))
    persistence = rounded(F.size(F.filter(heat, lambda h: h >= 60)) * 100.0 / n)
    state = F.when(cooling >= threshold, "cooling").when(trend >= threshold, "warming").when((persistence >= 66.6667) & (F.array_max(heat) > 0), "persistent_hot").when(trend <= -threshold, "weakening").otherwise("flat")
    return {"observations": n.cast("long"), "latest": rounded(latest), "trend": trend, "cooling": cooling, "persistence": persistence, "state": state}


def trend_stream(stream: DataFrame, late: str = "10 days", quiet_days: float = 90.0) -> DataFrame:
    """board, expired and the trend of each board that a batch changes, of a stream of (board, at, heat); write it in update mode.

    Observations later than the watermark are dropped; others take their place by time. A board that the watermark has left behind by so many days is told once more, as expired, and
    forgotten. Heats out of 0 to 100 don't count. The state store has to be RocksDB's, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.where("board is not null and at is not null and heat between 0 and 100").select("board", "at", "heat").withWatermark("at", late)
    held = rows.groupBy("board").transformWithStateInPandas(LastObservations(quiet_days), OUT, "Update", "EventTime")
    return held.select("board", "expired", *[c.alias(n) for n, c in trend_columns(F.col("seen")).items()])
