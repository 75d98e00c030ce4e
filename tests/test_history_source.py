"""The store of bars as a data source, and topics among many."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skerry.functions.text import match_score, topic_key
from skerry.operators.boards import matching_keys, resolve_topics
from skerry.sources.history_source import read_history, store_codes


def save(root, code, year, closes):
    (root / code).mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"date": [dt.date(year, 1, 2 + i) for i in range(len(closes))], "close": closes, "volume": [100] * len(closes)}), root / code / f"{year}.parquet")


def test_files_outside_a_filter_aren_t_opened(spark, tmp_path):
    root, stale = tmp_path / "store", tmp_path / "stale"
    for code in ("000001", "000002", "600519"):
        for year in (2022, 2023, 2024):
            save(root, code, year, [float(int(code) % 7 + year), 1.0])
    (root / "000002" / "2023.parquet").write_bytes(b"broken")
    (root / "600519" / "2022.parquet").write_bytes(b"broken")
    df = read_history(spark, str(root), retries="2", pause="0.01", buckets="2")
    got = df.where((F.col("code") == "600519") & (F.col("date") >= F.lit(dt.date(2023, 1, 3)))).collect()
    assert sorted((str(r.date), r.close) for r in got) == [("2023-01-03", 1.0), ("2024-01-02", 2024.0 + 600519 % 7), ("2024-01-03", 1.0)] and not any(r.is_stale for r in got)
    assert df.where(F.col("code").isin("000001", "000002") & (F.col("date") > F.lit(dt.date(2024, 1, 1)))).count() == 4
    with pytest.raises(Exception, match="000002 in 2023"):
        df.where("code = '000002'").count()
    assert read_history(spark, str(root), retries="1", pause="0.01", missing="skip").count() == 14
    save(stale, "000002", 2023, [5.0, 6.0, 7.0])
    both = read_history(spark, str(root), stale=str(stale), retries="1", pause="0.01").where("code = '000002'").collect()
    assert sum(r.is_stale for r in both) == 3 and len(both) == 7
    assert [r.code for r in store_codes(spark, str(root)).orderBy("code").collect()] == ["000001", "000002", "600519"]
    assert df.where("code = 'none'").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_no_matching_key_is_left_out(spark, seed):
    """Against every pair."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeabc人工智能芯片é9", k=rng.randrange(0, 9)))
    queries = [word() for _ in range(150)] + ["a", "", "ab"]
    topics = [(f"{word()}{i % 3}", [word(), rng.choice(queries) + word()], float(i % 5)) for i in range(120)] + [("b", ["", "a"], 9.0)]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    t = spark.createDataFrame(topics, "topic string, aliases array<string>, heat double")
    pairs = q.distinct().withColumn("q", topic_key(F.col("query"))).crossJoin(t.select(F.explode(F.concat(F.array("topic"), "aliases")).alias("a")).select(topic_key(F.col("a")).alias("k")).distinct())
    want = {(r.q, r.k) for r in pairs.where(match_score(F.col("q"), F.col("k")) > 0).collect()}
    got = {(r.q, r.k) for r in matching_keys(pairs.select("q").distinct(), pairs.select("k").distinct()).collect()}
    assert want <= got and len(want) > 100
    best = resolve_topics(q, t, 1)
    assert best.where("query = 'ab'").count() <= 1 and best.where("query = ''").count() == 0
