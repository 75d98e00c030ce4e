"""Daily-bar operators for all symbols at once: slices, adjustment, moving statistics, shape, quality, signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.num import ratio, rounded
from ..functions.text import flags_of

def by_date():
    return Window.partitionBy("code").orderBy("date")


YEAR_ROOT = 252**0.5


def over(n: int, back: int = 0):
    """The last n bars, or those that end so many bars before."""
    return by_date().rowsBetween(-(n - 1) - back, -back)


def full(agg, c: str, n: int) -> Column:
    """A moving statistic that is NULL until n values are there."""
    return F.when(F.count(c).over(over(n)) == n, agg(c).over(over(n)))


def last_n(b: DataFrame, n: int, as_of: str | None = None) -> DataFrame:
    """The last n bars of each symbol up to a date (WIN-01, SRC-12)."""
    rows = b.where(F.col("date") <= F.to_date(F.lit(as_of))) if as_of else b
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return rows.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def last_bars(b: DataFrame) -> DataFrame:
    return last_n(b, 1)


def recent(b: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol and its first one: what moving columns of up to n bars need at the last bar, so that they aren't worked out at all others."""
    whole = Window.partitionBy("code")
    rows = b.withColumns({"_rn": F.row_number().over(by_date()), "_all": F.count(F.lit(1)).over(whole)})
    return rows.where((F.col("_rn") == 1) | (F.col("_rn") > F.col("_all") - n)).drop("_rn", "_all")


def with_previous(b: DataFrame) -> DataFrame:
    """change_pct against the bar before and volume_ratio against the mean of up to 20 bars before (SRC-08)."""
    prev = F.lag("close").over(by_date())
    base = F.avg("volume").over(over(20, 1))
    return b.withColumn("change_pct", ratio(F.col("close") - prev, prev) * 100).withColumn("volume_ratio", ratio("volume", base))


def adjust(b: DataFrame, factors: DataFrame, how: str = "qfq") -> DataFrame:
    """Forward (qfq) or backward (hfq) adjusted prices; factors are filled from later days (JOIN-03, WIN-02)."""
    latest = factors.where(F.col("adj_factor").isNotNull()).groupBy("code").agg(F.max_by("adj_factor", "date").alias("_latest"))
    filled = F.last("adj_factor", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
    rows = b.join(factors, ["code", "date"], "left").withColumn("_f", filled).join(latest, "code", "left")
    by = F.col("_f") if how == "hfq" else F.col("_f") / F.col("_latest")
    prices = {c: F.col(c) * by for c in ("open", "high", "low", "close")}
    return rows.withColumns(prices).drop("_f", "_latest", "adj_factor")


def averages(b: DataFrame) -> DataFrame:
    """ma5, ma20, ma60 rounded, and what compares them (WIN-03)."""
    mas = {f"ma{n}": rounded(full(F.avg, "close", n)) for n in (5, 20, 60)}
    rows = b.withColumns(mas)
    return rows.withColumns(
        {
            "ma_bullish": F.coalesce((F.col("ma5") >= F.col("ma20")) & (F.col("ma20") >= F.col("ma60")), F.lit(False)),
            "price_above_ma20": F.coalesce(F.col("close") >= F.col("ma20"), F.lit(False)),
        }
    )


def bands(b: DataFrame) -> DataFrame:
    """Bands of two population deviations around the mean of up to 20 bars (WIN-07)."""
    mid, dev = F.avg("close").over(over(20)), F.coalesce(F.stddev_pop("close").over(over(20)), F.lit(0.0))
    return b.withColumns({"boll_mid": mid, "boll_upper": mid + 2 * dev, "boll_lower": mid - 2 * dev})


def long_line(b: DataFrame) -> DataFrame:
    """Mean of the 14, 28, 57 and 114 bar means; NULL before bar 114 (WIN-08)."""
    parts = [full(F.avg, "close", n) for n in (14, 28, 57, 114)]
    return b.withColumn("zg_long", (parts[0] + parts[1] + parts[2] + parts[3]) / 4)


def change_60(b: DataFrame) -> DataFrame:
    """Change against the close 60 bars before, or the first one (WIN-12)."""
    base = F.coalesce(F.lag("close", 60).over(by_date()), F.first("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    return b.withColumn("change_60d", F.when(base > 0, rounded((F.col("close") / base - 1) * 100)))


def rsi(b: DataFrame) -> DataFrame:
    """Simple-mean RSI of 14 differences; NULL while there are fewer or nothing fell (WIN-14)."""
    rows = b.withColumn("_d", F.col("close") - F.lag("close").over(by_date()))
    rows = rows.withColumn("_g", F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))).withColumn("_l", F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))))
    gain, loss = full(F.avg, "_g", 14), full(F.avg, "_l", 14)
    value = F.when(loss > 0, 100 - 100 / (1 + gain / loss))
    status = F.when(F.col("_v") <= 35, "oversold").when(F.col("_v") >= 70, "overbought").otherwise("neutral")
    return rows.withColumn("_v", value).withColumn("rsi_status", status).withColumn("rsi14", rounded("_v")).drop("_d", "_g", "_l", "_v")


def shape(b: DataFrame) -> DataFrame:
    """Breakout, range, volume ratio, body and pullback over 20 bars; needs ma20 (WIN-15)."""
    return _shape(b, F.max("high").over(over(20)), F.min("low").over(over(20)), F.max("high").over(over(20, 1)), F.avg("volume").over(over(20, 1)))


def shape_of_series(b: DataFrame) -> DataFrame:
    """shape of all bars of whole series, ma20 included. Moving frames look at each bar 20 times; here a symbol's bars are arrays that are shifted 20 times."""
    kinds = StructType(b.schema.fields[:])
    for k in MOVED:
        kinds = kinds.add(k, DoubleType())
    rows = b.groupBy("code").applyInArrow(_moved(MOVED), kinds).withColumn("ma20", rounded("_mean"))
    return _shape(rows, *[F.col(k) for k in MOVED[:4]]).drop(*MOVED)


MOVED = ("_high", "_low", "_before", "_base", "_mean")


def _moved(names: tuple[str, ...], n: int = 20):
    """A function of a symbol's bars that adds the columns names; it needs no module of this package, so that executors needn't have it."""

    def run(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.take(pc.sort_indices(group, sort_keys=[("date", "ascending")], null_placement="at_start")).combine_chunks()
        size = group.num_rows

        def moving(name, fold, fill, back=0):
            """The fold of the known ones of n values up to so many bars before, and how many are known."""
            col = pc.cast(group[name], pa.float64())
            known = pc.is_valid(col).to_numpy()
            x = np.concatenate([np.full(n + back, fill), pc.fill_null(col, fill).to_numpy()])
            k = np.concatenate([np.zeros(n + back, np.int64), known])
            out, count = np.full(size, fill), np.zeros(size, np.int64)
            for at in range(1, n + 1):  # the oldest first, as a frame adds
                out = fold(out, x[at : at + size])
                count += k[at : at + size]
            return out, count

        def least(a, b):
            """NaN is greater than all else."""
            return np.where(np.isnan(b) | (a <= b), a, b)

        cols = {}
        cols["_high"] = moving("high", np.maximum, -np.inf)
        cols["_low"] = moving("low", least, np.inf)
        cols["_before"] = moving("high", np.maximum, -np.inf, 1)
        volume, many = moving("volume", np.add, 0.0, 1)
        closes, full = moving("close", np.add, 0.0)
        cols["_base"] = volume / np.maximum(many, 1), many
        cols["_mean"] = closes / n, full == n
        for k in names:
            x, known = cols[k]
            group = group.append_column(k, pa.array(x, pa.float64(), mask=known == 0))
        return group

    return run


def _shape(b: DataFrame, high: Column, low: Column, before: Column, base: Column) -> DataFrame:
    return b.withColumns(
        {
            "prev_high_20d": rounded(before),
            "range_20d_pct": rounded(F.when(low > 0, (high / low - 1) * 100)),
            "breakout_20d_pct": rounded(F.when(before > 0, (F.col("close") / before - 1) * 100)),
            "volume_ratio_20d": rounded(F.when(base > 0, F.col("volume") / base)),
            "body_pct": rounded(F.when(F.col("open") > 0, (F.col("close") / F.col("open") - 1) * 100)),
            "pullback_to_ma20_pct": rounded(F.when(F.col("ma20") > 0, (F.col("close") / F.col("ma20") - 1) * 100)),
        }
    )


def volatility(b: DataFrame) -> DataFrame:
    """Sample deviation of the returns within 20 bars, a year's worth in percent (WIN-16)."""
    rows = b.withColumn("_r", F.col("close") / F.lag("close").over(by_date()) - 1)
    w = over(19)
    value = F.when(F.count("_r").over(w) >= 2, F.stddev_samp("_r").over(w) * YEAR_ROOT * 100)
    return rows.withColumn("volatility_20d_pct", rounded(value)).drop("_r")


def drawdown(b: DataFrame) -> DataFrame:
    """Deepest fall from a running high within 20 closes (WIN-17); the window's start moves, so it is a fold over each window."""
    start = F.struct(F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("deep"))

    def step(acc: Column, c: Column) -> Column:
        high = F.greatest(acc["high"], c)
        return F.struct(high.alias("high"), F.least(acc["deep"], c / high - 1).alias("deep"))

    closes = F.collect_list("close").over(over(20))
    return b.withColumn("_c", closes).withColumn("max_drawdown_20d_pct", rounded(F.aggregate("_c", start, step, lambda a: a["deep"] * 100))).drop("_c")


def true_range(b: DataFrame) -> DataFrame:
    """Mean true range of up to 20 bars in percent of the close (WIN-18)."""
    prev = F.lag("close").over(by_date())
    rows = b.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return rows.withColumn("atr_20_pct", rounded(F.when(F.col("close") > 0, F.avg("_tr").over(over(20)) / F.col("close") * 100))).drop("_tr")


def consolidation(b: DataFrame, most_pct: float = 12.0) -> DataFrame:
    """The longest run of 2 to 20 bars before this one within a range; 0 if none, NULL without bars before (WIN-19)."""
    # extremes of 1, 2, 4, 8 and 16 bars before, each of two halves; any other length is two of these that overlap, so no bar is looked at once for each length
    lag, whole = (lambda c, d: F.lag(c, d).over(by_date())), (1, 2, 4, 8, 16)
    rows = b.withColumns({"_n": F.row_number().over(by_date()) - 1, "_high1": lag("high", 1), "_low1": lag("low", 1)})
    for p in whole[:-1]:
        rows = rows.withColumns({f"_{c}{2 * p}": two(f"_{c}{p}", lag(f"_{c}{p}", p)) for c, two in (("high", F.greatest), ("low", F.least))})
    spans = []
    for d in range(2, 21):
        p = max(x for x in whole if x <= d)
        high, low = (F.col(f"_{c}{p}") if d == p else two(f"_{c}{p}", lag(f"_{c}{p}", d - p)) for c, two in (("high", F.greatest), ("low", F.least)))
        spans.append(F.struct(F.lit(d).alias("d"), high.alias("high"), low.alias("low")))
    # one condition over an array: written out for each length it makes a method that the JVM leaves uncompiled (148 task s of 3,200,000 bars instead of 91)
    fit = F.filter(F.array(*spans), lambda s: (F.col("_n") >= s["d"]) & (s["low"] > 0) & ((s["high"] / s["low"] - 1) * 100 <= most_pct))
    rows = rows.withColumn("consolidation_days_20d", F.when(F.col("_n") > 0, F.coalesce(F.array_max(fit)["d"], F.lit(0))))
    return rows.drop("_n", *[f"_{c}{p}" for c in ("high", "low") for p in whole])


def quality(b: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Per symbol: daily_data_points, daily_quality_score and flags (WIN-20).

    fetched may tell how the bars were had (code, daily_stale, source_errors: how many, one row a code): old bars and failed sources cost points.
    """
    miss = {c: F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)) for c in ("open", "high", "low", "close", "volume")}
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))
    zero = F.least("open", "high", "low", "close") <= 0
    g = b.groupBy("code").agg(
        F.count(F.lit(1)).alias("daily_data_points"), *[m.alias(f"_m_{c}") for c, m in miss.items()], F.coalesce(F.max(bad), F.lit(False)).alias("_bad"), F.coalesce(F.max(zero), F.lit(False)).alias("_zero"), F.coalesce(F.max(F.col("volume") < 0), F.lit(False)).alias("_neg")
    )
    n = F.col("daily_data_points")
    cut = F.when(n < 30, 35.0).when(n < 60, 15.0).otherwise(0.0)
    for c in ("open", "high", "low", "close"):
        cut = cut + F.least(F.col(f"_m_{c}") * 40, F.lit(20.0))
    cut = cut + F.least(F.col("_m_volume") * 20, F.lit(10.0)) + F.when(F.col("_neg"), 20.0).otherwise(0.0) + F.when(F.col("_bad"), 30.0).otherwise(0.0) + F.when(F.col("_zero"), 35.0).otherwise(0.0)
    flags = flags_of(
        [(n < 30, "short_history_lt30"), ((n >= 30) & (n < 60), "short_history_lt60"), *[(F.col(f"_m_{c}") > 0, f"incomplete_{c}") for c in ("open", "high", "low", "close", "volume")], (F.col("_neg"), "negative_volume"), (F.col("_bad"), "invalid_ohlc"), (F.col("_zero"), "non_positive_price")]
    )
    if fetched is not None:
        g = g.join(fetched.select("code", "daily_stale", "source_errors"), "code", "left")
        stale, errors = F.coalesce("daily_stale", F.lit(False)), F.coalesce("source_errors", F.lit(0))
        cut = cut + F.when(stale, 25.0).otherwise(0.0) + F.least(errors * 5.0, F.lit(20.0))
        flags = F.concat_ws(";", F.when(flags != "", flags), F.when(stale, "stale_cache"), F.when(errors > 0, "fallback_errors"))
    return g.select("code", "daily_data_points", rounded(F.greatest(100 - cut, F.lit(0.0))).alias("daily_quality_score"), flags.alias("daily_quality_flags"))


def signal(b: DataFrame) -> DataFrame:
    """Trend signal from 0 to 100; needs change_60d, ma_bullish, price_above_ma20, macd_status, rsi_status (WIN-21)."""
    c = F.col("change_60d")
    s = 50 + F.when(F.col("ma_bullish"), 14.0).otherwise(0.0) + F.when(F.col("price_above_ma20"), 10.0).otherwise(0.0)
    s = s + F.when(F.col("macd_status") == "bullish", 12.0).when(F.col("macd_status") == "bearish", -12.0).otherwise(0.0)
    s = s + F.when(c.between(0, 35), F.least(c * 0.35, F.lit(12.0))).when(c > 60, -F.least((c - 60) * 0.2, F.lit(12.0))).when(c < -25, -F.least(F.abs(c + 25) * 0.25, F.lit(10.0))).otherwise(0.0)
    s = s + F.when(F.col("rsi_status") == "oversold", 4.0).when(F.col("rsi_status") == "overbought", -6.0).otherwise(0.0)
    return b.withColumn("signal_score", rounded(F.greatest(F.lit(0.0), F.least(s, F.lit(100.0)))))
