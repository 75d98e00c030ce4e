"""Recursive indicators: one fold over each symbol's bars that carries every average's state (WIN-04 to WIN-11, WIN-13).

Exponential averages depend on all earlier bars, which no window frame expresses. Bars of a symbol are collected in order once, and one
fold carries the states of all averages and of the bars before the last; nothing grows with the series but the bars themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import ratio, rounded
from .bars import over

STATES = ("e12", "e26", "dea", "z1", "z2", "k", "d", "a", "b4", "b5")


def ewm(old: Column, x: Column, alpha: float) -> Column:
    return F.when(old.isNull(), x).otherwise(old * (1 - alpha) + x * alpha)


def with_inputs(b: DataFrame) -> DataFrame:
    """What the averages average: rsv of 9 bars, and two places in the range of 4."""
    low9, high9 = F.min("low").over(over(9)), F.max("high").over(over(9))
    low4, high4 = F.min("low").over(over(4)), F.max("high").over(over(4))
    whole = lambda hi, lo: F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return b.withColumns(
        {
            "_rsv": (F.col("close") - low9) / whole(high9, low9) * 100,
            "_v1": (high4 - F.col("close")) / whole(high4, low4) * 100 - 90,
            "_v3": (F.col("close") - low4) / whole(high4, low4) * 100,
        }
    )


def last_bands(closes: Column) -> Column:
    """bars.bands of the last of up to 20 closes, summed in the same order: a struct of boll_mid, boll_upper and boll_lower."""
    known = F.filter(closes, lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n, delta = s["n"] + 1, x - s["mean"]
        return F.struct(n.alias("n"), (s["sum"] + x).alias("sum"), (s["mean"] + delta / n).alias("mean"), (s["m2"] + delta * (delta - delta / n)).alias("m2"))

    def told(s: Column) -> Column:
        mid, dev = F.when(s["n"] > 0, s["sum"] / s["n"]), F.when(s["n"] > 0, F.sqrt(s["m2"] / s["n"])).otherwise(0.0)
        return F.struct(mid.alias("boll_mid"), (mid + 2 * dev).alias("boll_upper"), (mid - 2 * dev).alias("boll_lower"))

    return F.aggregate(known, start, step, told)


def last_long_line(closes: Column) -> Column:
    """bars.long_line of the last of these closes; NULL with fewer than 114."""
    mean = lambda n: F.aggregate(F.slice(closes, -n, n), F.lit(0.0), lambda s, x: s + x) / n
    return F.when(F.size(closes) >= 114, (mean(14) + mean(28) + mean(57) + mean(114)) / 4)


def snapshot(b: DataFrame) -> DataFrame:
    """Per symbol, at its last bar: MACD, KDJ, bands, short and long lines, brick, and the comparisons of rounded values (WIN-11).

    Bands and the long line are worked out at the last bar only.
    """
    rows = with_inputs(b)
    series = F.sort_array(F.collect_list(F.struct("date", "close", "high", "low", "volume", "_rsv", "_v1", "_v3")))
    null = F.lit(None).cast("double")
    names = [*STATES, "brick", "pk", "pd", "brick1", "brick2"]
    start = F.struct(*[null.alias(n) for n in names])

    def step(s: Column, x: Column) -> Column:
        e12, e26 = ewm(s["e12"], x["close"], 2 / 13), ewm(s["e26"], x["close"], 2 / 27)
        z1 = ewm(s["z1"], x["close"], 2 / 11)
        k = ewm(s["k"], x["_rsv"], 1 / 3)
        b4 = ewm(s["b4"], x["_v3"], 1 / 6)
        b5 = ewm(s["b5"], b4, 1 / 6)
        a = ewm(s["a"], x["_v1"], 1 / 4)
        v6 = b5 + 100 - (a + 100)
        new = {"e12": e12, "e26": e26, "dea": ewm(s["dea"], e12 - e26, 2 / 10), "z1": z1, "z2": ewm(s["z2"], z1, 2 / 11), "k": k, "d": ewm(s["d"], k, 1 / 3), "a": a, "b4": b4, "b5": b5}
        new |= {"brick": F.when(v6 > 4, v6 - 4).otherwise(0.0), "pk": s["k"], "pd": s["d"], "brick1": s["brick"], "brick2": s["brick1"]}
        return F.struct(*[new[n].alias(n) for n in names])

    g = rows.groupBy("code").agg(series.alias("s"))
    g = g.withColumn("f", F.aggregate("s", start, step)).withColumn("n", F.size("s")).withColumn("x", F.element_at("s", -1)).withColumn("p", F.get("s", F.col("n") - 2))
    closes = lambda n: F.transform(F.slice("s", -F.least(F.col("n"), F.lit(n)), F.least(F.col("n"), F.lit(n))), lambda x: x["close"])
    g = g.withColumns({"band": last_bands(closes(20)), "zg": last_long_line(closes(114))})
    r = lambda c: rounded(F.col(c))
    j, pj = 3 * F.col("f.k") - 2 * F.col("f.d"), 3 * F.col("f.pk") - 2 * F.col("f.pd")
    change = ratio(F.col("x.close") - F.col("p.close"), F.col("p.close")) * 100
    yes = lambda c: F.coalesce(c, F.lit(False))
    diff = F.col("f.e12") - F.col("f.e26")
    macd = F.when(F.col("n") < 35, "neutral").when((diff > F.col("f.dea")) & (diff > 0), "bullish").when((diff < F.col("f.dea")) & (diff < 0), "bearish").otherwise("neutral")
    turn = yes(F.col("f.brick1") < F.col("f.brick2")) & yes(F.col("f.brick") > F.col("f.brick1")) & yes(F.col("f.brick") - F.col("f.brick1") >= F.col("f.brick2") - F.col("f.brick1"))
    prev_close = rounded("p.close")
    out = g.select(
        "code",
        F.col("n").cast("long").alias("bars"),
        macd.alias("macd_status"),
        rounded(diff).alias("macd_diff"),
        r("f.dea").alias("macd_dea"),
        r("f.z2").alias("zg_short"),
        r("zg").alias("zg_long"),
        r("f.k").alias("kdj_k"),
        r("f.d").alias("kdj_d"),
        rounded(j).alias("kdj_j"),
        rounded(pj).alias("prev_kdj_j"),
        r("f.pk").alias("_pk"),
        r("f.pd").alias("_pd"),
        r("band.boll_mid").alias("boll_mid"),
        r("band.boll_upper").alias("boll_upper"),
        r("band.boll_lower").alias("boll_lower"),
        r("f.brick").alias("brick"),
        rounded(change).alias("daily_change_pct"),
        rounded(ratio(rounded("x.high") - rounded("x.low"), prev_close) * 100).alias("daily_amplitude_pct"),
        yes(F.col("x.volume") > F.col("p.volume")).alias("volume_above_prev"),
        r("x.close").alias("_close"),
        (turn & yes(F.col("f.z2") > F.col("zg")) & yes(change <= 5)).alias("brick_turn_up"),
    )
    return out.select(
        *[c for c in out.columns if not c.startswith("_")],
        yes(F.col("zg_short") > F.col("zg_long")).alias("zg_short_above_long"),
        yes(F.col("_close") > F.col("zg_long")).alias("close_above_zg_long"),
        yes(F.col("_close") < F.col("boll_lower")).alias("close_below_boll_lower"),
        yes(F.col("_close") > F.col("boll_upper")).alias("close_above_boll_upper"),
        yes((F.col("_pk") <= F.col("_pd")) & (F.col("kdj_k") > F.col("kdj_d"))).alias("kdj_golden_cross"),
        F.when((F.col("bars") < 114) | F.col("zg_long").isNull(), "zg_insufficient_bars").otherwise("").alias("indicator_quality_flags"),
    )
