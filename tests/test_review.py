"""Reviews, hotspots, envelopes and the semantics that reviews of this library asked for, on small frames."""

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skerry.operators import analyzers, boards, filters, flow, hotspots, review
from skerry.operators.bars import last_bars
from skerry.operators.places import medians
from skerry.sources import envelopes
from skerry.sources.staged import staged

PICK = "run_id long, strategy string, code string, rank int, status string, return_pct double, shape_status string, max_drawdown_pct double, llm_sector string, llm_tags array<string>, llm_risks array<string>, risk_flags array<string>"


def picks(spark):
    rows = [
        (1, "a", "1", 1, "ok", -6.0, "failed_breakout", -9.0, "bank", ["x", "x", " "], ["r"], ["f"]),
        (1, "a", "2", 2, "ok", 4.0, "", -1.0, None, ["x"], None, None),
        (1, "a", "3", 3, "missing", None, None, None, " ", None, None, None),
        (2, "b", "1", 1, "ok", -2.0, "breakout_unconfirmed", None, "bank", ["x", "y"], [], []),
        (2, "b", "4", 2, "ok", 9.0, "", -8.0, "bank", ["y"], None, None),
    ]
    return spark.createDataFrame(rows, PICK)


def test_failure_reasons(spark):
    got = {(r.run_id, r.code): r.failure_reasons for r in review.complete(picks(spark)).collect()}
    assert got[1, "1"] == ["negative_return", "large_loss", "shape_status:failed_breakout", "path_drawdown_breach", "risk_flag:f", "llm_risk:r"]
    assert got[1, "2"] == [] and got[1, "3"] == ["quote_status:missing"] and got[2, "1"] == ["negative_return", "shape_status:breakout_unconfirmed"] and got[2, "4"] == ["path_drawdown_breach"]
    s = review.failure_summary(picks(spark)).first()
    assert (s.failure_count, s.negative_pick_count, s.missing_count, s.failed_breakout_count, s.severe_drawdown_count, s.average_negative_return_pct, s.worst_return_pct) == (4, 2, 1, 1, 2, -4.0, -6.0)
    assert [(r.place, r.run_id, r.code) for r in review.failure_samples(picks(spark), 3).orderBy("place").collect()] == [(1, 1, "1"), (2, 2, "1"), (3, 2, "4")]


def test_failure_dimensions(spark):
    got = {(r.dimension, r.label): (r.failure_count, r.evaluated_failure_count, r.average_return_pct, r.worst_return_pct, r.sample_codes) for r in review.failure_dimensions(picks(spark)).collect()}
    assert {d for d, _ in got} == set(review.SINGLE) | set(review.MANY) and len(set(review.SINGLE) | set(review.MANY)) == 13
    assert got["sector", "bank"] == (3, 3, 0.3333, -6.0, "1,4") and got["sector", "unknown"] == (1, 0, None, None, "3")
    assert got["portfolio_flag", "none"][0] == 4 and got["llm_tag", "x"] == (2, 2, -4.0, -6.0, "1") and got["event_signal", "risk:r"][0] == 1
    assert review.failure_dimensions(picks(spark).limit(0)).count() == 0
    bare = picks(spark).select("run_id", "strategy", "code", "rank", "status", "return_pct")
    assert review.failure_summary(bare).first().failure_count == 3


def test_signals_and_suggestions(spark):
    got = {r.signal: r for r in review.signal_stats(picks(spark)).collect()}
    x = got["tag:x"]
    assert (x.pick_count, x.evaluated_pick_count, x.failure_count, x.failure_rate, x.average_return_pct, x.median_return_pct, x.win_rate, x.strategies, x.sample_codes, x.action) == (3, 3, 2, 66.6667, -1.3333, -2.0, 33.3333, "a,b", "1,2", "avoid")
    assert got["risk:r"].action == "avoid" and got["tag:y"].action == "avoid"
    s = {r.strategy: (r.preferred_event_tags, r.avoided_event_tags) for r in review.strategy_suggestions(picks(spark)).collect()}
    assert s == {"a": ("", "x,风险:r"), "b": ("", "y,x")}
    good = picks(spark).where("code = '2'").withColumn("llm_catalysts", F.array(F.lit("new")))
    assert review.strategy_suggestions(good).first().preferred_event_tags == "催化:new,x"


def test_hotspots(spark):
    b = spark.createDataFrame([("AI", "concept", 3.0, 2, 70.0), ("AI", "industry", 4.0, 1, 65.0), ("Old", "concept", -1.0, 9, 40.0), (" ", "concept", 9.0, 1, 99.0)], "topic string, source string, change_pct double, rank int, heat double")
    trends = boards.heat_trends(spark.createDataFrame([("AI", d, float(60 + 8 * d)) for d in range(4)], "board string, at int, heat double"))
    stocks = spark.createDataFrame([("AI", f"{i}", "" if i == 1 else f"n{i}", c, 1e9, 5.0, 2.0, 1e7, i == 2, 3, 1) for i, c in enumerate((1.0, 9.9, 10.0, -3.0))], "topic string, code string, name string, change_pct double, amount double, turnover_rate double, volume_ratio double, net_inflow double, is_limit_up boolean, active_days int, evidence_count int")
    got = hotspots.discover(b, trends, stocks, 5).orderBy("rank").collect()
    assert [(r.topic, r.source, r.heat_score, r.stage, r.stock_count, r.missing_fields) for r in got] == [("AI", "concept", 84.0, "加速主升", 4, ""), ("Old", "concept", 40.0, "初次异动", 0, "stocks,leader_stocks")]
    assert got[0].leaders.split(",")[:2] == ["n2", "1"]
    few = hotspots.detail(b.where("topic = 'AI'"), stocks, 2).orderBy("place").collect()
    assert [(r.place, r.code, r.role) for r in few] == [(1, "2", "核心龙头"), (2, "1", "核心龙头")]
    z = F.lit(None).cast("double")
    one = lambda *more: spark.range(1).select(boards.stock_score(z, z, z, z, z, *more).alias("s")).first().s
    assert one() == 35.0 and one(F.lit(True), F.lit(2), F.lit(9)) == 56.0 and one(F.lit(None).cast("boolean"), z, F.lit(1)) == 37.0


def test_envelopes(spark, tmp_path):
    texts = ['[{"code": "600519.0", "name": "A"}, 5, null]', '{"items": [{"code": 1}], "data": [{"code": 2}]}', '{"data": [{"code": 2}]}', '{"000003": {"name": "B"}, "4": "only text", "5": {"code": "6"}, "7": 8}', "not json", None, "", "[]", "3"]
    got = envelopes.context_rows(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert sorted((r.code, r.text) for r in got) == [("000001", None), ("000002", None), ("000003", None), ("000004", "only text"), ("000006", None), ("600519", None)]
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"code": "1", "name": "A", "text": "t"}]}, indent=1))
    (tmp_path / "b.jsonl").write_text('{"code": "2", "name": "B"}\nbroken\n[1]\n{"code": "3", "n": {"x": 1}}')
    (tmp_path / "c.csv").write_text("code,name\n4,D\n")
    read = lambda f: sorted(map(tuple, envelopes.read_context(spark, str(tmp_path / f), ["name"]).collect()))
    assert read("a.json") == [("000001", "t", "A")] and read("b.jsonl") == [("000002", "", "B"), ("000003", "", "")] and read("c.csv") == [("000004", "", "D")]
    with pytest.raises(ValueError):
        envelopes.read_context(spark, str(tmp_path / "d.xml"), [])


def test_judges_answers(spark):
    items = [{"code": "SH600519", "llm_score": 150, "confidence": "0.4", "industry": "bank", "risk_flags": ["a", " a", ""], "reason": "x" * 300}, {"code": "600519", "llm_score": 1}, {"code": "9"}, 7]
    answers = [(1, "Sure:\n" + json.dumps({"ranked": items})), (2, json.dumps([{"code": "2", "llm_score": "n/a"}])), (3, ""), (4, "no idea"), (5, '{"ranked": {"a": 1}}'), (6, '{"other": 1}'), (7, None)]
    a = spark.createDataFrame(answers, "run_id long, response string")
    candidates = spark.createDataFrame([(1, "600519"), (1, "000002"), (2, "2")] + [(r, "1") for r in (3, 4, 5, 6, 7)], "run_id long, code string")
    typed, problems = envelopes.typed_ranking(envelopes.judged_items(a), candidates)
    got = {(r.run_id, r.code): r for r in typed.collect()}
    assert len(got) == 8
    top = got[1, "600519"]
    assert (top.llm_score, top.llm_confidence, top.llm_sector, top.llm_risks, len(top.ranking_reason), top.llm_coverage) == (100.0, 0.4, "bank", ["a"], 180, 0.5)
    assert got[1, "000002"].llm_score is None and got[2, "2"].seq == 0 and got[2, "2"].llm_score is None and got[2, "2"].llm_coverage == 1.0
    assert {(r.run_id, r.problem) for r in problems.collect()} == {(1, "duplicate_code:600519"), (1, "unknown_code:000009"), (1, "non_object_item"), (3, "empty_response"), (4, "no_json_found"), (5, "ranked_not_list"), (7, "empty_response")}


@pytest.mark.parametrize("part_rows", [3, 10_000])
def test_exact_medians(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, 1.0, 2.0, rng.uniform(-5, 5)])) for _ in range(300)] + [("none", None)]
    df = staged(spark.createDataFrame(rows, "g string, x double").repartition(4), "t")
    want = {g: statistics.median(x for h, x in rows if h == g and x is not None) for g in ("hot", "cold", None)}
    assert {r.g: r.median for r in medians(df, ["g"], "x", part_rows).collect()} == pytest.approx(want)


def test_filters_on_nothing(spark):
    df = spark.createDataFrame([(1, "A", 5.0)], "code long, name string, price double")
    assert filters.apply(df.limit(0), {"pb_max": 1}).count() == 0 and filters.apply(df, {"price_min": 10, "pb_max": 1}).count() == 0
    with pytest.raises(filters.MissingFieldError):
        filters.apply(df, {"price_min": 1, "pb_max": 1})
    w = filters.waterfall(df, {"price_min": 10, "price_max": 3, "main_net_inflow_min": 5}).orderBy("step").collect()
    assert [(r.label, r.removed, r.suggestion[:20]) for r in w] == [("exclude_st", 0, ""), ("price_min", 1, "price_min eliminated"), ("price_max", 0, "")]


def test_flows(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rng = random.Random(1)
    tiers = [f"{s}_{t}_amount" for s in ("buy", "sell") for t in ("sm", "md", "lg", "elg")]
    rows = [(c, day(i), *[round(rng.uniform(0, 9), 3) for _ in tiers]) for c in range(4) for i in range(5 + 12 * c)] + [(9, day(0), *[0.0] * 8)]
    f = spark.createDataFrame(rows, "code long, date date, " + ", ".join(f"{t} double" for t in tiers))
    bars = spark.createDataFrame([(c, day(i), 10.0 + (i * 7 + c) % 5, None if i % 4 == 0 else 900.0) for c in range(4) for i in range(0, 40, 1 + c % 2)], "code long, date date, close double, volume double")
    names = ["main_net_inflow", "main_net_inflow_5d", "main_net_inflow_20d", "main_inflow_streak", "main_net_inflow_zscore_20d", "turnover_amount", "main_net_inflow_rate", "price_up_flow_out", "price_down_flow_in"]
    for b in (bars, None):
        whole = {r.code: tuple(r)[1:] for r in last_bars(flow.against_bars(flow.zscore(flow.streak(flow.rolling(flow.derive(f)))), b)).select("code", *names).collect()}
        quick = {r.code: tuple(r)[1:] for r in flow.latest(f, b).select("code", *names).collect()}
        for c, want in whole.items():
            assert quick[c] == pytest.approx(want, nan_ok=True) if None not in want else [x if x is None else pytest.approx(x) for x in want] == list(quick[c])
    assert whole[9][5] is None  # nothing was bought or sold
    told = f.withColumn("main_net_inflow", F.when((F.col("code") == 1) & (F.dayofmonth("date") == 2), 3.0))
    got = {(r.code, r.date.day): r.main_net_inflow for r in flow.derive(told).where("day(date) <= 3").collect()}
    assert got[1, 2] == 3.0 and got[1, 1] is None and got[2, 1] is not None
    s = {r.code: r for r in flow.snapshot(f, bars, "2024-01-03").collect()}
    assert s[2].as_of == day(2) and s[9].as_of == day(0) and s[9].price_up_flow_out is False and 7 not in s


def test_external_items_in_any_spelling(spark):
    p = spark.createDataFrame([(1, "600519", 60.0, None), (2, "000001", 50.0, None)], "rank int, code string, final_score double, risk_flags string")
    items = spark.createDataFrame([(0, "SH600519", 2.0, ["x"]), (1, "1", 20.0, None)], "seq long, code string, score_delta double, risk_flags array<string>")
    got = analyzers.analyze(p, ["external_http"], {"external_http": {"items": items, "most": 5}}).orderBy("rank").collect()
    assert [(r.code, r.final_score, r.external_status) for r in got] == [("000001", 70.0, "completed"), ("600519", 62.0, "completed")]


@pytest.mark.parametrize("few", [5, 10_000])
def test_medians_by_bounds(spark, few):
    """The bounds hold the middle, and the few values between them give the same as a sort of all."""
    from skerry.operators import evaluate
    from skerry.operators.places import _near_middle

    rng = random.Random(few)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, 1.0, rng.uniform(-5, 5), rng.uniform(-5, 5)])) for _ in range(20_000)] + [("none", None), ("one", 3.0), ("two", 1.0), ("two", 2.0)]
    df = staged(spark.createDataFrame(rows, "g string, x double").repartition(4), "t")
    want = {g: statistics.median(x for h, x in rows if h == g and x is not None) for g in ("hot", "cold", None, "one", "two")}
    assert {r.g: r.median for r in _near_middle(df, ["g"], "x", few).collect() if r.median is not None} == pytest.approx(want)
    out = {r.g: (r.pick_count, r.median_return_pct) for r in evaluate.rolled(df.withColumnRenamed("x", "return_pct"), ["g"]).collect()}
    assert out["none"] == (0, None) and {g: out[g][1] for g in want} == pytest.approx(want, abs=1e-4)
    assert evaluate.rolled(df.where("g = 'none'").withColumnRenamed("x", "return_pct"), []).first().asDict() == {"pick_count": 0, "average_return_pct": None, "median_return_pct": None, "win_rate": None}


def test_samples_are_few_before_the_shuffle(spark):
    """Codes in any number and order, over batches: the worst picks as plain Python finds them, with few rows left for the shuffle; nulls and NaN as Spark orders them."""
    rng = random.Random(4)
    rows = [(rng.choice([f"c{i}" for i in range(400)] + [None]), rng.choice([None, float("nan"), -0.0, *[rng.randrange(-60, 60) / 4] * 5]), rng.choice(["a", None, "b"]), [{"k": x, "n": y} for x, y in rng.sample([("x", 1), ("y", 2), ("z", None), (None, 3)], rng.randrange(5))]) for _ in range(6000)]
    df = spark.createDataFrame(rows, "code string, r double, s string, g array<struct<k: string, n: int>>").repartition(3).withColumn("_order", F.struct(F.col("r").isNull().alias("none"), "r", "s"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        got = {(r.k, r.n): r.sample_codes for r in review._sample_codes(df, F.col("g"), 3).collect()}
        shuffled = df.where("code is not null").selectExpr("g as _groups", "code as _code", "_order").mapInArrow(lambda b: review._few(3, b), "k string, n int, _code string, _order struct<none: boolean, r: double, s: string>").count()
    finally:
        spark.conf.set(key, was)
    order = lambda r, s: (r is None, (r is not None and r != r, 0.0 if r is None or r != r else r), (s is not None, s or ""))
    best = {}
    for code, r, s, groups in rows:
        for g in groups:
            if code is not None:
                own = best.setdefault((g["k"], g["n"]), {})
                own[code] = min(own.get(code, order(r, s)), order(r, s))
    assert got == {g: ",".join(c for _, c in sorted((o, c) for c, o in own.items())[:3]) for g, own in best.items()}
    assert shuffled <= 4 * 3 * 15  # groups x codes x batches; picks are 12,000


def test_failed_is_having_reasons(spark):
    rows = [(s, r, x, d, p) for s in ("ok", "missing", None) for r in (None, -9.0, -1.0, 0.0, float("nan")) for x in ("failed_breakout", "", None) for d in (None, -9.0, 1.0) for p in ("", "ok", "missing", None)]
    df = spark.createDataFrame([(i, "s", i, 1, *row) for i, row in enumerate(rows)], "run_id long, strategy string, code long, rank int, status string, return_pct double, shape_status string, max_drawdown_pct double, path_status string")
    got = review.complete(df).select(review.failed().alias("f"), (F.size("failure_reasons") > 0).alias("has"))
    assert got.where("f is null or f <> has").count() == 0 and got.where("f").count() not in (0, len(rows))
