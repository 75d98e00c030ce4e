"""The keyed table, ingest in days and lots, and boards' trends as a stream, with failures on the way."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators.boards import heat_trends
from skerry.sources.ingest import IngestStopped, commit_days, ingest_stream, ingest_symbols, missing_days, pending, progress, signature
from skerry.sources.keyed import KeyedTable, StaleTable
from skerry.streaming.heat import heat_stream
from skerry.streaming.last_five import trend_stream

BAR = "code long, date string, close double, seq int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(table):
    return {r.bucket: r.folder for r in table.stats().collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["code", "date"], order=["seq"], dated="date", buckets=8)
    first = [(c, f"2024-01-{d:02d}", float(c * d), 1) for c in range(20) for d in (1, 2)]
    assert t.upsert(spark.createDataFrame(first, BAR), "days", 1) == 1
    before, pinned = files(t), t.read()
    assert rows(pinned) == sorted(first) and sum(r.rows for r in t.stats().collect()) == 40
    late = [(3, "2024-01-01", 99.0, 0), (3, "2024-01-02", 98.0, 2), (3, "2024-01-02", 97.0, 2), (3, "2024-01-02", 1.0, 1), (21, "2024-01-03", 5.0, None)]
    batch = spark.createDataFrame(late, BAR)
    assert t.upsert(batch, "days", 2) == 2 and t.upsert(batch, "days", 2) == 2  # run again, it changes nothing
    want = {(c, d): (c, d, x, s) for c, d, x, s in first} | {(3, "2024-01-02"): (3, "2024-01-02", 98.0, 2), (21, "2024-01-03"): (21, "2024-01-03", 5.0, None)}
    assert rows(t.read()) == sorted(want.values(), key=str) or sorted(map(str, rows(t.read()))) == sorted(map(str, want.values()))
    after = files(t)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and all(after[b] == before[b] for b in before if b not in changed)
    assert rows(pinned) == sorted(first) == rows(t.read(version=1))  # a reader keeps its version
    assert [r.code for r in t.read(since="2024-01-03").collect()] == [21]
    t.upsert(spark.createDataFrame([(30, "2024-01-04", 1.0, 1)], BAR))
    assert t.vacuum(keep=1) and t.versions() == [3] and t.read().count() == 42
    assert KeyedTable(spark, str(tmp_path / "t")).keys == ["code", "date"]
    with pytest.raises(StaleTable):
        t.read(version=1)
    with pytest.raises(StaleTable):
        t.fresh(0.0)
    with pytest.raises(StaleTable):
        t.fresh(1e6, ["volume"])
    assert t.fresh(1e6, ["close"]).count() == 42
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "other"))


def test_a_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["code"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 2.0, 1)], BAR))

    def away(manifest):
        raise OSError("away")

    monkeypatch.setattr(t, "_create", away)
    batch = spark.createDataFrame([(1, "b", 3.0, 1), (5, "b", 4.0, 1)], BAR)
    with pytest.raises(OSError):
        t.upsert(batch, "days", 1)
    assert rows(t.read()) == [(1, "a", 1.0, 1), (2, "a", 2.0, 1)]
    monkeypatch.undo()
    t.upsert(batch, "days", 1)
    assert rows(t.read()) == [(1, "b", 3.0, 1), (2, "a", 2.0, 1), (5, "b", 4.0, 1)]
    assert len(t.vacuum(keep=1)) >= 2  # what the failed run wrote goes too


def test_days_up_to_the_first_that_failed(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["code", "date"], dated="date", buckets=4)
    days = [f"2024-01-0{d}" for d in range(1, 6)]
    name = signature(command="update", end=days[-1])
    whole = [(c, d, 1.0 if d != days[2] or c else None, 1) for d in days for c in range(3)]
    failed = F.col("close").isNull()
    with pytest.raises(IngestStopped) as e:
        commit_days(t, spark.createDataFrame(whole, BAR), name, failed)
    assert e.value.day == days[2] and e.value.done == days[1] and progress(t, name) == {"done": days[1], "failed": days[2]}
    assert {r.date for r in t.read().collect()} == set(days[:2])
    calendar = spark.createDataFrame([(d,) for d in days], "date string")
    assert [r.day for r in missing_days(t, calendar, name).collect()] == days[2:]
    assert missing_days(t, calendar, signature(command="update", end="later")).count() == 5  # another question has no progress
    mended = [(c, d, 1.0, 1) for d in days for c in range(3)]
    assert commit_days(t, spark.createDataFrame(mended, BAR), name, failed) == {"done": days[4], "failed": None}
    assert t.read().count() == 15
    version = t.head()["version"]
    commit_days(t, spark.createDataFrame(mended, BAR), name, failed)
    assert t.head()["version"] == version


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["code", "date"], dated="date", buckets=4)
    (tmp_path / "in").mkdir()
    for d in range(1, 6):
        (tmp_path / "in" / f"{d}.json").write_text("\n".join(json.dumps({"code": c, "date": f"2024-01-0{d}", "close": c + 0.5, "seq": d}) for c in range(2)))
    gate = tmp_path / "mended"
    stream = lambda: spark.readStream.schema(BAR).json(str(tmp_path / "in"))
    failed = F.lit(not gate.exists()) & (F.col("date") == "2024-01-03")
    q = ingest_stream(stream(), t, "s", failed, str(tmp_path / "c"))
    with pytest.raises(Exception, match="2024-01-03"):
        q.awaitTermination(120)
    assert {r.date for r in t.read().collect()} == {"2024-01-01", "2024-01-02"}
    ingest_stream(stream(), t, "s", F.lit(False), str(tmp_path / "c")).awaitTermination(120)
    assert t.read().count() == 10 and progress(t, "s")["done"] == "2024-01-05"


def test_symbols_in_lots(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["code", "date"], dated="date", buckets=4)
    universe = spark.createDataFrame([(c,) for c in range(10)], "code long")
    asked = []

    def fetch(lot):
        codes = [r.code for r in lot.collect()]
        asked.append(codes)
        if len(asked) == 2:
            raise OSError("away")
        return spark.createDataFrame([(c, "2024-01-05", 1.0, 1) for c in codes if c != 7], BAR)

    with pytest.raises(OSError):
        ingest_symbols(t, universe, fetch, "2024-01-05", "init", 4)
    assert rows(t.read().select("code")) == [(0,), (1,), (2,), (3,)]
    assert ingest_symbols(t, universe, fetch, "2024-01-05", "init", 4) == 2
    assert asked[1:] == [[4, 5, 6, 7], [4, 5, 6, 7], [8, 9]] and rows(pending(t, universe, "2024-01-05")) == [(7,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trend_stream_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    seen = [{"board": b, "generated_at": (dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 20), seconds=i)).isoformat(), "max_board_heat_score": rng.choice([-5, 20, 55, 61, 70, 88, 101])} for i, b in enumerate("abcd" * 12)]
    rng.shuffle(seen)
    (tmp_path / "in").mkdir()
    for i in range(0, len(seen), 10):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(map(json.dumps, seen[i : i + 10])))
    stream = heat_stream(spark, str(tmp_path / "in"), 1)
    history = spark.read.schema("board string, generated_at timestamp, max_board_heat_score double").json(str(tmp_path / "in")).select("board", F.col("generated_at").alias("at"), F.col("max_board_heat_score").alias("heat"))
    out = {}

    def take(batch, _):
        out.update({r.board: tuple(r) for r in batch.drop("expired").collect()})

    q = trend_stream(stream, "30 days").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = {r.board: tuple(r) for r in heat_trends(history).collect()}
    assert out == want


def test_quiet_boards_expire(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = lambda b, d: json.dumps({"board": b, "generated_at": d, "max_board_heat_score": 70})
    (tmp_path / "in" / "1.jsonl").write_text(record("old", "2024-01-01T00:00:00"))
    (tmp_path / "in" / "2.jsonl").write_text(record("new", "2024-06-01T00:00:00"))
    (tmp_path / "in" / "3.jsonl").write_text(record("new", "2024-06-02T00:00:00"))
    told = []
    q = trend_stream(heat_stream(spark, str(tmp_path / "in"), 1), "1 day", 30).writeStream.foreachBatch(lambda b, _: told.extend((r.board, r.expired) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert ("old", True) in told and ("new", True) not in told
