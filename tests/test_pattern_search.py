"""Searches of feature windows against a plain loop without any pruning."""

import datetime as dt
import math
import random
import time

import numpy as np
import pandas as pd
import pytest

from skerry.operators import pattern_search as PS


def series(code, n, seed):
    rng, close, out = random.Random(seed), 20.0, []
    for i in range(n):
        before, close = close, max(close * (1 + rng.gauss(0, 0.02)) + 0.3 * math.sin(i / (3 + code % 4)), 1.0)
        out.append((code, dt.date(2024, 1, 1) + dt.timedelta(days=i), before, max(before, close) + rng.random(), min(before, close) - rng.random(), close, float(rng.randrange(0, 5000))))
    return out


BAR = "code long, date date, open double, high double, low double, close double, volume double"


def plain_matrix(bars):
    f = pd.DataFrame(bars, columns=["code", "date", "open", "high", "low", "close", "volume"]).reset_index(drop=True)
    base = f.close.iloc[0] or 1.0
    change = f.close.pct_change().fillna(0.0)
    slope = [0.0 if i == 0 else np.polyfit(range(min(i, 4) + 1), f.close[max(i - 4, 0) : i + 1], 1)[0] for i in range(len(f))]
    cells = [f.close / base - 1, (f.close - f.open) / base, (f.high - f[["open", "close"]].max(axis=1)) / base, (f[["open", "close"]].min(axis=1) - f.low) / base, (f.high - f.low) / base]
    cells += [np.log1p(f.volume), change.expanding().mean(), change.expanding().std(ddof=0).fillna(0.0), pd.Series(slope)]
    m = np.column_stack([np.asarray(c, float) for c in cells])
    std = m.std(axis=0)
    m = np.clip((m - m.mean(axis=0)) / np.where(std == 0, 1, std), -5, 5)
    at = np.linspace(0, len(m) - 1, 32)
    return np.column_stack([np.interp(at, range(len(m)), m[:, k]) for k in range(9)])


def plain_warp(x, y, band=7):
    inf = float("inf")
    best = {(0, 0): 0.0}
    for i in range(1, 33):
        for j in range(max(1, i - band), min(32, i + band) + 1):
            best[i, j] = math.dist(x[i - 1], y[j - 1]) + min(best.get(k, inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    i = j = 32
    steps = 0
    while i or j:
        steps += 1
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda k: best.get(k, inf))
    return best[32, 32] / steps


def plain_group(metric, x, q):
    if metric == "dtw":
        return math.exp(-plain_warp(x, q))
    if metric == "cosine":
        return (float((x * q).sum() / (np.linalg.norm(x) * np.linalg.norm(q))) + 1) / 2
    if metric in ("pearson", "spearman"):
        rank = (lambda a: pd.Series(a).rank().to_numpy()) if metric == "spearman" else (lambda a: a)
        return (np.mean([np.corrcoef(rank(x[:, k]), rank(q[:, k]))[0, 1] for k in range(x.shape[1])]) + 1) / 2
    d = np.abs(x - q)
    return math.exp(-{"euclidean": np.linalg.norm(d) / 32, "manhattan": d.sum() / 32, "chebyshev": d.max()}[metric])


@pytest.fixture(scope="module")
def market(spark):
    rows = [b for code in range(8) for b in series(code, 75, code)] + series(50, 10, 1)
    asked = series(77, 40, 3)[12:34]
    return spark.createDataFrame(rows, BAR).repartition(4), rows, asked


@pytest.mark.parametrize("metric", PS.METRICS)
def test_search_equals_a_plain_loop(market, metric):
    df, rows, asked = market
    query = [dict(zip(("open", "high", "low", "close", "volume"), b[2:])) for b in asked]
    n, q, want = len(asked), plain_matrix(asked), []
    for code in range(8):
        own = [b for b in rows if b[0] == code][-60:]
        scored = []
        for s in range(0, 60 - n + 1, max(n // 15, 1)):
            x = plain_matrix(own[s : s + n])
            total = sum(w * plain_group(metric, x[:, PS.PLACES[g]], q[:, PS.PLACES[g]]) for g, w in PS.WEIGHTS.items())
            scored.append((round(total, 6), code, own[s][1], own[s + n - 1][1]))
        want += sorted(scored, key=lambda r: (-r[0], r[2]))[:3]
    want = sorted(want, key=lambda r: (-r[0], r[1], r[2]))[:10]
    got = [(r.similarity, r.code, r.start, r.end) for r in PS.search(df, query, metric, per_symbol=3, top=10, lookback=60).orderBy("rank").collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=2e-6)


def test_bounds_are_below_the_distance():
    rng = np.random.default_rng(5)
    q = rng.normal(size=(32, 9)).cumsum(axis=0)
    x = np.concatenate([rng.normal(size=(30, 32, 9)).cumsum(axis=1), q + rng.normal(size=(30, 32, 9)) * 0.1])
    exact = PS.total_similarity("dtw", x, q)[1]
    loose, close = PS.warp_ceiling(x, q), PS.warp_ceiling(x, q, PS.nearest_bound)
    assert (exact <= close + 1e-12).all() and (close <= loose + 1e-12).all()
    found, taken = PS.best_by_warping(x, q, 5)
    assert sorted(exact)[-5:] == pytest.approx(sorted(found)[-5:]) and taken.sum() < 45  # a third and more is ruled out here


def test_search_odd(spark, market):
    df, _, asked = market
    query = [dict(zip(("open", "high", "low", "close", "volume"), b[2:])) for b in asked]
    with pytest.raises(ValueError):
        PS.search(df, query[:10])
    with pytest.raises(ValueError):
        PS.search(df, query, "no such metric")
    with pytest.raises(ValueError):
        PS.search(df, query, top=0)
    assert PS.search(df.limit(0), query).count() == 0
    only = PS.search(df, query, codes=[1, 2, 50], exclude=[2]).collect()
    assert {r.code for r in only} == {1}  # 50 has fewer bars than the query
    closes = PS.search(spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10 + math.sin(i / 2)) for i in range(60)], "code long, date date, close double"), [10 + math.sin(i / 2) for i in range(20)]).orderBy("rank").first()
    assert closes.similarity == pytest.approx(1.0, abs=1e-6)


def test_search_is_quick_enough(spark):
    """100 symbols of 60 bars, a query of 20, by correlation: within 30 seconds."""
    df = spark.createDataFrame([b for c in range(100) for b in series(c, 60, c)], BAR)
    query = [dict(zip(("open", "high", "low", "close", "volume"), b[2:])) for b in series(1, 60, 1)[30:50]]
    began = time.time()
    assert PS.search(df, query, "pearson").count() == 20 and time.time() - began < 30


def test_window_features_are_the_window_s(spark):
    bars = series(1, 50, 4)
    got = PS.window_features(spark.createDataFrame(bars, BAR), 30).orderBy("date").collect()
    own = bars[-30:]
    assert len(got) == 30 and got[0].close_return == 0.0 and got[0].pct_change_mean == 0.0
    assert got[-1].close_return == pytest.approx(own[-1][5] / own[0][5] - 1)
    assert got[-1].pct_change_std == pytest.approx(np.std([0.0] + [own[i][5] / own[i - 1][5] - 1 for i in range(1, 30)]))


def test_normalized_work_is_linear(spark):
    """A window of thousands of values; work by its square or cube wouldn't end."""
    from pyspark.sql import functions as F

    from skerry.operators.pattern import normalized

    values = [float((i * 37) % 101) for i in range(4000)]
    df = spark.createDataFrame([(values,)], "a array<double>")
    began = time.time()
    for method, first in (("zscore", -1.7135), ("minmax", 0.0), ("robust", -1.0)):
        got = df.select(normalized(F.col("a"), method)).first()[0]
        assert len(got) == 4000 and got[0] == pytest.approx(first, abs=2e-2)
    assert time.time() - began < 60


def test_warping_is_bounded_in_memory():
    """Neither rows nor cells outside the band are held all at once; a query is one row for all."""
    import tracemalloc

    from skerry.operators.pattern import warped

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(20_000, 32, 3)), rng.normal(size=(32, 3))
    tracemalloc.start()
    got = warped(x, q[None])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the costs of all cells alone would be 160 MB
    assert [got[i] for i in (0, 1023, 1024, 19_999)] == pytest.approx([plain_warp(x[i], q) for i in (0, 1023, 1024, 19_999)])
    assert np.array_equal(got[:50], warped(x[:50], np.broadcast_to(q, (50, 32, 3))))


def test_warping_drops_only_what_cannot_reach():
    rng = np.random.default_rng(6)
    q = rng.normal(size=(32, 9)).cumsum(axis=0)
    x = np.concatenate([rng.normal(size=(300, 32, 9)).cumsum(axis=1), q + rng.normal(size=(30, 32, 9)) * 0.1])
    exact = PS.total_similarity("dtw", x, q)[1]
    bar = sorted(exact)[-20]
    found, taken = PS.reaching_by_warping(x, q, bar)
    assert set(np.flatnonzero(exact >= bar)) <= set(np.flatnonzero(taken)) and taken.sum() < 100
    assert np.array_equal(found[taken], exact[taken]) and PS.reaching_by_warping(x, q, -1.0)[1].all()


def test_search_is_whole_over_cut_batches(spark, market):
    """A symbol's bars may come in several batches, and several symbols in one; a bar taken from earlier symbols loses none of the best."""
    df, _, asked = market
    query = [dict(zip(("open", "high", "low", "close", "volume"), b[2:])) for b in asked]
    named = df.selectExpr("case when code = 5 then null else concat('s', code) end as code", "date", "open", "high", "low", "close", "volume")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, found = spark.conf.get(key), []
    for most in (7, 75, 10_000):
        spark.conf.set(key, str(most))
        try:
            found.append([PS.search(named, query, m, per_symbol=2, top=5).orderBy("rank").collect() for m in ("dtw", "euclidean")])
        finally:
            spark.conf.set(key, was)
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 5
    every = PS.scanned(named, query, "dtw", per_symbol=2)
    assert [r.similarity for r in found[0][0]] == sorted((r.similarity for r in every.collect()), reverse=True)[:5]
    assert {r.code for r in every.collect()} == {None, *(f"s{i}" for i in range(8) if i != 5)} and all(r.compared == r.windows for r in every.collect())
