"""Screening operators on small frames with numbers worked out by hand, and all registered queries against their SQL."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from skerry.functions import num, text
from skerry.operators import bars, boards, evaluate, filters, flow, history, indicators, pattern, ranking, scoring
from skerry.plans.screen import ScreenSpec, screen

DATA = "/root/testdata/sf0.001"


def series(spark, closes, code=1, start="2024-01-01"):
    day = dt.date.fromisoformat(start)
    rows = [(code, day + dt.timedelta(i), float(c), c + 0.5, c - 0.5, float(c), 1000.0, c * 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, volume double, amount double")


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("12%",), ("-",), ("nan",), (None,)], "x string")
    assert [r[0] for r in df.select(num.number("x")).collect()] == [1234.5, 12.0, None, None, None]
    assert one(spark.range(1).select(num.clip(F.lit(None).cast("double"), 0, 1).alias("a"), num.clip(F.lit(5.0), 0, 1).alias("b")), "a", "b") == [(None, 1.0)]


def test_codes_and_labels(spark):
    raw = ["600519", "1.0", "sh600519x", "AAPL", "x1y23", "nan", None, "12345678"]
    df = spark.createDataFrame([(r,) for r in raw], "x string")
    assert [r[0] for r in df.select(text.normalize_code(F.col("x"))).collect()] == ["600519", "000001", "600519", "", "000123", "", "", "345678"]
    assert df.select(text.normalize_code(F.col("x"), tickers=True)).collect()[3][0] == "AAPL"
    listed = spark.createDataFrame([(c,) for c in ("920001", "600000", "000001", "1", "830000", "x.SZ")], "x string").select(text.exchange_code(F.col("x"))).collect()
    assert [r[0] for r in listed] == ["920001.BJ", "600000.SH", "000001.SZ", "000001.SZ", "830000.BJ", "X.SZ"]
    row = spark.range(1).select(text.merge_labels(F.lit("a，b, nan"), F.lit("b、c")).alias("m"), F.concat_ws(" ", text.topic_tokens(F.lit("银行:+1.2%:rank=3 | 白酒/rank"))).alias("t")).first()
    assert row.m == "a,b,c" and row.t == "银行 白酒"


def test_rank_score_averages_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "code int, x double")
    got = dict(one(df.withColumn("s", num.rank_score(F.col("x"), False, 20)), "code", "s"))
    assert got[4] == 20 and math.isclose(got[1], 100 / 3) and math.isclose(got[2], got[3]) and math.isclose(got[2], 2.5 / 3 * 100)


def test_adjustment(spark):
    closes, factors = [100.5, 101.5, 102.5, 68.5, 69.5], [1.0, None, 1.0, 1.5, 1.5]
    b = series(spark, closes)
    f = b.select("code", "date").join(spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(factors)], "date date, adj_factor double"), "date")
    forward = [r[0] for r in bars.adjust(b, f).orderBy("date").select("close").collect()]
    back = [r[0] for r in bars.adjust(b, f, "hfq").orderBy("date").select("close").collect()]
    assert math.isclose(forward[0], 67.0) and math.isclose(forward[1], 101.5 / 1.5) and math.isclose(back[4], 104.25)


def test_long_line_needs_114_bars(spark):
    b = bars.long_line(series(spark, [10 + 0.01 * i for i in range(120)])).orderBy("date")
    z = [r[0] for r in b.select("zg_long").collect()]
    assert z[112] is None and z[113] is not None


def test_recursive_indicators_equal_plain_loops(spark):
    closes = [10 + math.sin(i / 3) * 2 + i * 0.05 for i in range(150)]
    r = indicators.snapshot(series(spark, closes)).first()

    def ewm(x, a):
        out = [x[0]]
        for v in x[1:]:
            out.append(out[-1] * (1 - a) + v * a)
        return out

    diff = [a - b for a, b in zip(ewm(closes, 2 / 13), ewm(closes, 2 / 27))]
    assert r.macd_diff == pytest.approx(diff[-1], abs=1e-4) and r.macd_dea == pytest.approx(ewm(diff, 0.2)[-1], abs=1e-4)
    assert r.zg_short == pytest.approx(ewm(ewm(closes, 2 / 11), 2 / 11)[-1], abs=1e-4)
    rsv = [(c - (min(closes[max(0, i - 8) : i + 1]) - 0.5)) / (max(closes[max(0, i - 8) : i + 1]) - min(closes[max(0, i - 8) : i + 1]) + 1) * 100 for i, c in enumerate(closes)]
    k = ewm(rsv, 1 / 3)
    assert r.kdj_k == pytest.approx(k[-1], abs=1e-3) and r.kdj_d == pytest.approx(ewm(k, 1 / 3)[-1], abs=1e-3)


def test_one_bar_has_no_previous(spark):
    r = indicators.snapshot(series(spark, [10.0])).first()
    assert r.prev_kdj_j is None and r.daily_change_pct is None and r.kdj_golden_cross is False and r.indicator_quality_flags == "zg_insufficient_bars"


def test_rising_series_is_not_overbought(spark):
    assert set(one(bars.rsi(series(spark, range(10, 40))), "rsi_status")) == {("neutral",)}


def test_filters_fail_closed(spark):
    df = spark.createDataFrame([(1, "A", 5.0, True), (2, "ST B", 5.0, True), (3, None, None, None), (4, "D", 50.0, False)], "code long, name string, price double, flag boolean")
    assert one(filters.apply(df, {"price_max": 10}), "code") == [(1,)]
    with pytest.raises(filters.MissingFieldError):
        filters.apply(df, {"pb_max": 1})
    with pytest.raises(ValueError):
        filters.apply(df, {"no_such_key": 1})
    flags = df.withColumn("ma_bullish", F.col("flag")).withColumn("price_up_flow_out", F.col("flag"))
    assert one(filters.apply(flags, {"exclude_st": None, "require_ma_bullish": True}), "code") == [(1,), (2,)]
    assert one(filters.apply(flags, {"exclude_st": None, "require_no_price_up_flow_out": True}), "code") == [(4,)]
    assert filters.phases_needed({"require_no_price_up_flow_out": True}) == "SDF" and filters.phases_needed({}) == "S"
    assert len({k.name for k in filters.KEYS}) == len(filters.KEYS)
    w = filters.waterfall(df, {"price_max": 10}).orderBy("step").collect()
    assert [(r.label, r.before, r.after, r.samples) for r in w] == [("exclude_st", 4, 3, "2"), ("price_max", 3, 1, "3,4")]


def test_flow_conditions_and_streak(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate([5.0, 5.0, -1.0, 3.0, None, 2.0, 2.0])]
    f = spark.createDataFrame(rows, "code long, date date, main_net_inflow double")
    assert [r[0] for r in flow.streak(f).orderBy("date").select("main_inflow_streak").collect()] == [1, 2, 0, 1, 0, 1, 2]
    with pytest.raises(ValueError):
        flow.condition("no_such_condition")


def test_scores_are_neutral_without_columns(spark):
    r = scoring.score(spark.createDataFrame([(1,)], "code long")).first()
    assert r.factor_value_score == 50 and r.factor_liquidity_score == 50 and r.factor_stability_score == 78
    assert scoring.weights_of({"value": 2, "nothing": 3, "size": -1}) == {"value": 1.0, "size": 0.0}
    assert scoring.weights_of({"nothing": 1}) == scoring.FALLBACK


def test_risk_and_portfolio(spark):
    df = spark.createDataFrame([("a", 90.0, 1, 9.0, "stale_cache;fallback_errors", 72.0, "x"), ("b", 89.0, 2, 0.0, "", 90.0, "x"), ("c", 88.0, 3, 0.0, None, None, "x")], "code string, final_score double, rank int, change_pct double, daily_quality_flags string, daily_quality_score double, sector string")
    r = {x.code: x for x in ranking.risk_overlay(df).collect()}
    assert r["a"].risk_points == 8.0 and r["a"].risk_level == "high" and r["a"].final_score == 82.0 and r["b"].rank == 1
    p = {x.code: x.portfolio_penalty for x in ranking.portfolio_overlay(df, F.col("sector")).collect()}
    assert p == {"a": 0.0, "b": 4.0, "c": 8.0}


def test_price_path_and_returns(spark):
    path = spark.createDataFrame([("000001", dt.date(2026, 3, 31), 99.0, 1.0, 99.0), ("000001", dt.date(2026, 4, 1), 10.5, 9.7, 11.5), ("000001", dt.date(2026, 4, 2), 11.0, 10.0, 11.2)], "code string, date date, close double, low double, high double")
    picks = spark.createDataFrame([("000001", dt.date(2026, 4, 1), 10.0)], "code string, created date, entry double")
    r = evaluate.price_path(picks, path).first()
    assert (r.path_days, r.path_end_pct, r.path_drawdown_pct, r.path_runup_pct) == (2, 10.0, -3.0, 15.0)
    quotes = spark.createDataFrame([("000001", dt.date(2026, 4, 2), 11.0)], "code string, date date, price double")
    got = evaluate.returns(picks.unionByName(picks.withColumn("code", F.lit("x"))), quotes).select("status", "return_pct").collect()
    assert sorted((s, round(v, 6) if v else v) for s, v in map(tuple, got)) == [("missing", None), ("ok", 10.0)]


def test_boards(spark):
    m = spark.createDataFrame([("600519", "白酒", "消费,白酒"), ("000001", "银行", "金融,银行"), ("600000", "银行", " ")], "code string, industry string, concepts string")
    f = spark.createDataFrame([("600519", dt.date(2024, 1, 5), 535.0), ("000001", dt.date(2024, 1, 5), 126.0), ("600000", dt.date(2024, 1, 5), 75.0)], "code string, date date, flow double")
    rows = {(r.board_type, r.board): (r.stock_count, r.total, r.mean) for r in boards.flow_rank(f, boards.membership(m), "flow").collect()}
    assert rows["industry", "银行"] == (2, 201.0, 100.5) and ("concept", "") not in rows and len(rows) == 6


def test_upkeep(spark):
    schema = "code long, date int, x double"
    old = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, None)], schema)
    new = spark.createDataFrame([(1, 2, 2.0 + 1e-9), (1, 3, None), (1, 4, 4.0), (1, 1, 5.0)], schema)
    assert {(r.date, r.status) for r in history.diff(old, new, ["code", "date"], ["x"]).collect()} == {(1, "updated"), (2, "unchanged"), (3, "unchanged"), (4, "added")}
    merged = history.keep_last(old, new, ["code", "date"])
    assert sorted((r.date, r.x) for r in merged.collect() if r.x) == [(1, 5.0), (2, 2.0 + 1e-9), (4, 4.0)]
    assert history.keep_last(merged, new, ["code", "date"]).count() == merged.count()


def test_patterns(spark):
    import numpy as np

    a, b = np.array([0.0, 1, 2, 3, 2, 1]), np.array([0.0, 0, 1, 2, 3, 2])
    assert pattern.warped(a, a) == 0 and 0 < pattern.warped(a, b) < np.abs(a - b).mean()
    r = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(pattern.pearson(F.col("a"), F.col("b")).alias("p"), pattern.spearman(F.col("a"), F.col("b")).alias("s"), pattern.lp(F.col("a"), F.col("b"), "linf").alias("l"), pattern.dtw(F.col("a"), F.col("b")).alias("w")).first()
    assert r.p == pytest.approx(np.corrcoef(a, b)[0, 1]) and r.l == 1.0 and r.w == pytest.approx(pattern.warped(a, b)) and -1 <= r.s <= 1
    found = pattern.search(series(spark, [10 + math.sin(i / 2) for i in range(60)]), [10 + math.sin(i / 2) for i in range(20)], "pearson").first()
    assert found.similarity == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        pattern.search(series(spark, [1.0] * 5), [1.0], "no such metric")


def test_screen_needs_its_tables(spark):
    snap = spark.createDataFrame([(1, "A", 5.0)], "code long, name string, price double")
    with pytest.raises(ValueError):
        screen(snap, ScreenSpec("d", {"kdj_j_max": 13}))
    assert screen(snap, ScreenSpec("s", {"price_min": 1})).select("code", "rank").first() == (1, 1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_query_equals_its_sql(spark):
    """All rows of every query against its SQL, numbers to ten digits."""
    import duckdb

    from skerry import catalog_extra, catalog_more, catalog_review, oracle_extra, oracle_more, oracle_review, oracle_search  # noqa: F401
    from skerry.catalog import QUERIES
    from skerry.oracle import SQL

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    assert set(SQL) <= set(QUERIES)

    def plain(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(str([f"{v:.10g}" if isinstance(v, float) else str(v) for v in (row[i] for i in order)]) for row in rows)

    differ = []
    for name, sql in SQL.items():
        found, want = QUERIES[name](spark, DATA), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(found.columns), name
        a, b = plain([[0.0 if isinstance(v, float) and v == 0 else v for v in r] for r in found.collect()], found.columns), plain([[0.0 if isinstance(v, float) and v == 0 else v for v in r] for r in want.fetchall()], columns)
        if a != b:
            differ.append((name, len(a), len(b), [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]))
    assert not differ, differ


def test_warping_equals_a_plain_loop():
    import numpy as np

    from skerry.operators.pattern import warped

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 12)), rng.normal(size=(20, 15))
    for p, q, got in zip(x, y, warped(x, y)):
        best = {(0, 0): (0.0, 0)}
        for i in range(1, 13):
            for j in range(max(1, i - 3), min(15, i + 3) + 1):
                ways = [best[k] for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best]
                cost, steps = min(ways, key=lambda w: w[0])
                best[i, j] = (cost + abs(p[i - 1] - q[j - 1]), steps + 1)
        assert abs(got - best[12, 15][0] / best[12, 15][1]) < 1e-12


def test_analyzers_by_name(spark):
    from skerry.operators import analyzers as A

    picks = spark.createDataFrame([(1, 1, 60.0, "completed", 60, None, " 买入", None, ["a"] * 5), (2, 2, 59.0, "failed", 100, 100, "买入", "看多", None), (3, 3, 59.0, "completed", None, None, None, None, None)], "rank int, code int, final_score double, deep_status string, deep_signal_score int, deep_sentiment_score int, deep_advice string, deep_trend string, deep_flags array<string>")
    out = A.analyze(picks, [" DSA ", "dsa"])
    assert [(r.rank, r.code, r.final_score) for r in out.orderBy("rank").collect()] == [(1, 1, 64.0), (2, 2, 59.0), (3, 3, 59.0)]
    with pytest.raises(ValueError):
        A.analyze(picks, ["dsa", "other"])
    assert A.analyze(picks, []) is picks
    items = spark.createDataFrame([(1, 3, 2.0, ["x"]), (0, 3, 0.5, None), (2, 9, 50.0, ["y"])], "seq long, code int, score_delta double, risk_flags array<string>")
    out = A.analyze(picks.withColumn("risk_flags", F.lit(None).cast("string")), ["external_http"], {"external_http": {"items": items, "most": 1}})
    assert [(r.code, r.final_score, r.external_status, r.risk_flags) for r in out.orderBy("rank").collect()] == [(3, 61.5, "skipped", "x"), (1, 60.0, "", ""), (2, 59.0, "skipped", "")]
    assert A.analyze(picks.limit(0), ["dsa"]).count() == 0
    assert (A.candidates(100, 10, 3, 50), A.candidates(100, 10, 0, 50), A.candidates(8, 10, 3, 50), A.candidates(100, 40, 3, 50)) == (30, 10, 8, 50)


def test_codes_of_long_keys(spark, tmp_path):
    from skerry.catalog import QUERIES

    keys = [8, 9, 11, 12345, 1234564, 1234565, 1234567]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.code for r in QUERIES["normalize_code"](spark, str(tmp_path)).collect()}
    assert got == {8: "000008", 9: "000009", 11: "000111", 12345: "012345", 1234564: "123456", 1234565: "123456", 1234567: "234567"}


def test_last_bar_columns(spark):
    """What is worked out at the last bar alone equals the moving columns' last values, with short series and missing closes."""
    import random

    from skerry.operators import bars as B
    from skerry.operators import indicators as I

    rng = random.Random(3)
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(i), *[None if c == 4 and i % 37 == 5 else rng.uniform(9, 11)] * 4, rng.uniform(1, 9)) for c, n in ((1, 1), (2, 19), (3, 113), (4, 200), (5, 114), (6, 300)) for i in range(n)]
    b = spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, volume double")
    assert {r.code: r["count"] for r in B.recent(b, 21).groupBy("code").count().collect()} == {1: 1, 2: 19, 3: 22, 4: 22, 5: 22, 6: 22}
    features = lambda x: B.last_bars(B.consolidation(B.true_range(B.drawdown(B.volatility(B.shape(B.rsi(B.change_60(B.averages(x)))))))))
    assert sorted(map(str, features(B.recent(b, 61)).collect())) == sorted(map(str, features(b).collect()))
    moving = {r.code: r for r in B.last_bars(B.long_line(B.bands(b))).collect()}
    closes = b.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("s"))
    last = F.slice("s", -F.least(F.size("s"), F.lit(20)), F.least(F.size("s"), F.lit(20)))
    for r in closes.select("code", I.last_bands(last).alias("band"), I.last_long_line(F.col("s")).alias("zg")).collect():
        m = moving[r.code]
        assert (r.zg, *r.band) == (m.zg_long, m.boll_mid, m.boll_upper, m.boll_lower)


def test_consolidation_looks_back_once(spark):
    """By plain Python, with nulls, NaN and prices that aren't positive; no frame is gone over anew for each length."""
    import datetime
    import random

    from skerry.operators.bars import consolidation

    rng, rows = random.Random(8), []
    for code in range(6):
        for i in range(60):
            low = rng.choice([10.0, 10.5, 11.0, 11.2] * 12 + [None, float("nan"), 0.0, 20.0])
            rows.append((code, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), None if low is None and rng.random() < 0.5 else (low or 1.0) + rng.random() / 2, low))
    key = lambda x: (x != x, 0.0 if x != x else x)

    def days(own, i):
        best = 0
        for d in range(2, min(i, 20) + 1):
            high, low = [b[2] for b in own[i - d : i] if b[2] is not None], [b[3] for b in own[i - d : i] if b[3] is not None]
            if high and low:
                h, l = max(high, key=key), min(low, key=key)  # noqa: E741
                if h == h and l == l and l > 0 and (h / l - 1) * 100 <= 12:
                    best = d
        return best if i else None

    got = consolidation(spark.createDataFrame(rows, "code int, date date, high double, low double").repartition(3))
    want = {(c, own[i][1]): days(own, i) for c in range(6) for own in [[r for r in rows if r[0] == c]] for i in range(60)}
    assert {(r.code, r.date): r.consolidation_days_20d for r in got.collect()} == want and len(set(want.values())) > 8
    assert got.columns == ["code", "date", "high", "low", "consolidation_days_20d"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max(high" not in plan and "min(low" not in plan


def test_shape_of_series_equals_moving_frames(spark):
    nan, rows = float("nan"), []
    for code, n in ((1, 1), (2, 19), (3, 20), (4, 75), (None, 25)):
        for i in range(n):
            x = 10 + (i * 7919 % 31) / 7 + (code or 0)
            odd = code == 4 and i % 9 == 4
            rows.append((code, dt.date(2026, 1, 1) + dt.timedelta(i), None if odd else x, nan if code == 4 and i == 40 else x + 1, None if odd else nan if i == 33 else x - 1, None if code == 4 and i == 60 else x, None if code == 2 else float(i * i)))
    b = spark.createDataFrame(rows[::-1], "code long, date date, open double, high double, low double, close double, volume double")
    names = ["code", "date", "prev_high_20d", "range_20d_pct", "breakout_20d_pct", "volume_ratio_20d", "body_pct", "pullback_to_ma20_pct"]
    got, want = ([tuple(map(str, r)) for r in f.select(names).orderBy("code", "date").collect()] for f in (bars.shape_of_series(b), bars.shape(bars.averages(b))))
    assert got == want and len(got) == len(rows)
    plan = bars.shape_of_series(b)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
