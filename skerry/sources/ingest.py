"""Resumable ingest into a keyed table: days are committed up to the first that failed, symbols until all are done (INC-01, INC-02).

Progress is a note in the table's manifest, committed with the rows themselves and kept under the signature of what was asked. So it can't say more or less than the table holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .keyed import KeyedTable


class IngestStopped(Exception):
    """A day failed. What came before it is committed."""

    def __init__(self, day: str, done: str | None):
        super().__init__(f"stopped at {day}; committed up to {done or 'nothing'}")
        self.day, self.done = day, done


def signature(**asked) -> str:
    """A short name for what was asked; other questions have other progress."""
    return sha256(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()[:16]


def progress(table: KeyedTable, name: str) -> dict:
    """done: the last day committed under the signature; failed: the day it stopped at, if any."""
    head = table.head()
    return (head["notes"] if head else {}).get(name, {"done": None, "failed": None})


def commit_days(table: KeyedTable, batch: DataFrame, name: str, failed: Column, day: str = "date", number: int | None = None) -> dict:
    """Commit the days of a batch that are before its first failed one and after what is done already, as one version.

    failed marks rows that couldn't be fetched or read; one of them fails its day. Days are taken in their order over the whole batch by one aggregation. Raises IngestStopped after the
    commit if there is a failed day, so that a caller (or a stream) runs the batch again later; that run skips what is done.
    """
    at = F.col(day).cast("string")
    known = progress(table, name)
    left = batch if known["done"] is None else batch.where(at > known["done"])
    bad = F.coalesce(failed, F.lit(True))
    seen = left.agg(F.min(F.when(bad, at)).alias("failed"), F.max(at).alias("last")).first()
    if seen.last is None:
        return known
    good = left if seen.failed is None else left.where(at < seen.failed)
    done = seen.last if seen.failed is None else good.agg(F.max(at)).first()[0]
    note = {"done": done or known["done"], "failed": seen.failed}
    if note != known:
        table.upsert(good, name if number is not None and seen.failed is None else None, number, {name: note})
    if seen.failed is not None:
        raise IngestStopped(seen.failed, note["done"])
    return note


def ingest_stream(stream: DataFrame, table: KeyedTable, name: str, failed: Column, checkpoint: str, day: str = "date") -> StreamingQuery:
    """The same for a stream of days: a batch with a failed day commits what is before it and then fails the query; started again, the stream runs that batch anew and goes on."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: commit_days(table, batch, name, failed, day, number) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_days(table: KeyedTable, calendar: DataFrame, name: str, day: str = "date") -> DataFrame:
    """The days of a calendar that come after what is done under the signature, in their order."""
    done = progress(table, name)["done"]
    days = calendar.select(F.col(day).cast("string").alias("day")).distinct()
    return (days if done is None else days.where(F.col("day") > done)).orderBy("day")


def pending(table: KeyedTable, universe: DataFrame, end: str, key: str = "code") -> DataFrame:
    """Symbols of the universe (key, ...) that the table doesn't have up to end, by an anti join on what it holds."""
    if table.head() is None:
        return universe
    held = table.read().groupBy(key).agg(F.max(F.col(table.dated).cast("string")).alias("_last")).where(F.col("_last") >= end)
    return universe.join(held.select(key), key, "left_anti")


def ingest_symbols(table: KeyedTable, universe: DataFrame, fetch: Callable[[DataFrame], DataFrame], end: str, name: str, size: int = 500, key: str = "code") -> int:
    """Fetch the pending symbols, so many at a time in the order of their keys, and commit each lot; returns how many lots were committed.

    fetch turns symbols into rows, as a Spark job. A lot that fails leaves those before it committed, and the next run begins with it. A symbol that has no rows up to end is asked for once in a run:
    the note says how far the order of keys has come.
    """
    after, lots = progress(table, name).get("after"), 0
    while True:
        left = pending(table, universe, end, key)
        if after is not None:
            left = left.where(F.col(key) > F.lit(after))
        lot = left.select(key).distinct().orderBy(key).limit(size)
        last = lot.agg(F.max(key)).first()[0]
        if last is None:
            if after is not None:
                table.upsert(table.read().limit(0), notes={name: {"done": None, "failed": None}})  # the next run looks at all symbols again
            return lots
        after = last
        table.upsert(fetch(lot), notes={name: {"done": None, "failed": None, "after": after}})
        lots += 1
