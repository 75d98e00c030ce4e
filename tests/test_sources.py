"""Sources, strategy documents and streams on small files."""

import json

import pytest

from skerry.plans import spec
from skerry.sources import readers
from skerry.streaming import heat


def test_snapshot_spellings(spark):
    df = spark.createDataFrame([("600519.0", "A", "10.5", "1,000", "5%"), ("1", "nan", "-", "2", "3")], "`代码` string, `名称` string, `最新价` string, amount string, `换手率` string")
    rows = readers.normalize_snapshot(df).collect()
    assert [(r.code, r.price, r.amount, r.turnover_rate) for r in rows] == [("600519", 10.5, 1000.0, 5.0)]
    assert readers.missing_columns(df, ["amount", "pe_ratio"]) == ["pe_ratio"]


def test_fallback_takes_the_first_complete_source(spark):
    good = spark.createDataFrame([("1", 5.0, 2.0)], "code string, price double, pe_ratio double")

    def broken(_):
        raise OSError("away")

    df, name, errors = readers.first_complete(spark, [("a", broken), ("b", lambda s: good.drop("pe_ratio")), ("c", lambda s: good)], ["price", "pe_ratio"])
    assert name == "c" and df.count() == 1 and errors == ["a: OSError", "b: lacks pe_ratio"]
    with pytest.raises(ValueError):
        readers.first_complete(spark, [("a", broken)], ["price"])


def test_label_map_and_runs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("代码,所属行业,concepts\n1,银行,\"a，b,a\"\n000000,x,y\n")
    assert [tuple(r) for r in readers.read_label_map(spark, str(tmp_path / "m.csv")).collect()] == [("000001", "银行", "a,b")]
    readers.write_runs(spark.createDataFrame([(1, "s")], "run_id int, strategy string"), spark.createDataFrame([(1, "x")], "run_id int, code string"), str(tmp_path / "runs"))
    kinds = sorted(json.loads(r.value)["type"] for r in spark.read.text(str(tmp_path / "runs")).collect())
    assert kinds == ["pick", "run"]


def test_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string"), path, ["p"])
    readers.overwrite_partitions(spark.createDataFrame([(3, "b")], "x int, p string"), path, ["p"])
    assert sorted((r.x, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_documents(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("name: a\nscreening:\n  hard_filters: {kdj_j_max: 13, main_inflow_streak_min: 5}\n  factor_weights: {value: 1}\n  max_output: 7\n")
    (tmp_path / "b.yaml").write_text("name: b\nscreening:\n  hard_filters: {nothing_max: 13}\n")
    found, wrong = spec.load_all(tmp_path)
    assert list(found) == ["a"] and "nothing_max" in wrong["b.yaml"] and found["a"].phases == "SDF" and found["a"].max_output == 7
    assert spec.requirements(found["a"]) == {"snapshot": ["name"], "daily": ["kdj_j"], "flow": ["main_inflow_streak"]}
    other = spec.spec_of({"name": "c", "screening": {"hard_filters": {"kdj_j_max": 20}}})
    assert spec.compare(found["a"], other)["hard_filters"]["changed"] == {"kdj_j_max": (13, 20)}


def test_heat_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"board": "a", "generated_at": f"2024-01-0{d}T10:00:00", "max_board_heat_score": 50 + d} for d in (1, 1, 2, 5, 9)]
    (folder / "1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n" + json.dumps(lines[0] | {"max_board_heat_score": 300}))
    q = heat.daily_heat(heat.heat_stream(spark, str(folder))).writeStream.format("memory").queryName("heat").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.day), r.n) for r in spark.table("heat").collect()} >= {("2024-01-01", 2), ("2024-01-02", 1)}
    assert readers.read_heat_history(spark, str(folder)).count() == 5
    for n, value in (("2", 80), ("3", 90)):
        (folder / f"{n}.jsonl").write_text(json.dumps(lines[0] | {"max_board_heat_score": value}))
        heat.upsert_stream(heat.heat_stream(spark, str(folder), 1), str(tmp_path / "t"), ["board", "at"], str(tmp_path / "c2")).awaitTermination(120)
    rows = {str(r["at"])[:10]: r.heat for r in heat.current(spark, str(tmp_path / "t")).collect()}
    assert rows["2024-01-01"] == 90 and len(rows) == 4
