"""Money-flow operators (WIN-22 to WIN-26, JOIN-04, FLT-11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from .bars import by_date, full, over

TIERS = ("sm", "md", "lg", "elg")


def derive(f: DataFrame) -> DataFrame:
    """Main (large and extra large) and retail net inflow, missing cells as 0 (WIN-22). A main inflow that a code's rows already have, on any day, is left as it is."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    net = lambda tiers: sum((z(f"buy_{t}_amount") - z(f"sell_{t}_amount") for t in tiers), F.lit(0.0))
    main = net(("lg", "elg"))
    if "main_net_inflow" in f.columns:
        own = F.col("main_net_inflow").cast("double")
        main = F.when(F.max(own.isNotNull()).over(Window.partitionBy("code")), own).otherwise(main)
    return f.withColumns({"main_net_inflow": main, "retail_net_inflow": net(("sm", "md"))})


def rolling(f: DataFrame, windows: Iterable[int] = (5, 10, 20)) -> DataFrame:
    """Sums of main inflow over up to so many days (WIN-23), in exact units of 1e-6, so that the order of additions doesn't count."""
    units = F.col("main_net_inflow").cast("decimal(28,6)")
    return f.withColumns({f"main_net_inflow_{n}d": F.sum(units).over(over(n)).cast("double") for n in windows})


def streak(f: DataFrame) -> DataFrame:
    """Days in a row with inflow; anything else starts over (WIN-24): gaps and islands."""
    stop = F.when(F.coalesce(F.col("main_net_inflow") > 0, F.lit(False)), 0).otherwise(1)
    rows = f.withColumn("_stop", stop).withColumn("_island", F.sum("_stop").over(by_date()))
    place = Window.partitionBy("code", "_island").orderBy("date")
    return rows.withColumn("main_inflow_streak", F.sum(1 - F.col("_stop")).over(place)).drop("_stop", "_island")


def zscore(f: DataFrame) -> DataFrame:
    mean, dev = full(F.avg, "main_net_inflow", 20), full(F.stddev_samp, "main_net_inflow", 20)
    return f.withColumn("main_net_inflow_zscore_20d", F.when(dev > 0, (F.col("main_net_inflow") - mean) / dev))


def against_bars(f: DataFrame, bars: DataFrame | None) -> DataFrame:
    """Turnover, inflow rate and divergence of price and flow; close_pct is taken on the bars' own days (JOIN-04, WIN-26).

    Turnover is the bar's close times volume, in ten thousands; where that is missing or not positive, half of what was bought and sold; null if that isn't positive either. Without bars, close, close_pct and both divergences are null; a day without a bar diverges in neither way.
    """
    if bars is None:
        none = F.lit(None).cast("double")
        bars = f.select("code", "date", none.alias("close"), none.alias("volume")).limit(0)
        diverges = lambda _: F.lit(None).cast("boolean")
    else:
        diverges = lambda c: F.coalesce(c, F.lit(False))
    px = bars.select("code", "date", "close", (F.col("close") / F.lag("close").over(by_date()) - 1).alias("close_pct"), (F.col("close") * F.col("volume") / 10000).alias("_traded"))
    rows = f.join(px, ["code", "date"], "left")
    turnover = sum((F.coalesce(F.col(f"{s}_{t}_amount"), F.lit(0.0)) for s in ("buy", "sell") for t in TIERS), F.lit(0.0)) / 2
    rows = rows.withColumn("turnover_amount", F.coalesce(F.when(F.col("_traded") > 0, F.col("_traded")), F.when(turnover > 0, turnover))).drop("_traded")
    return rows.withColumns(
        {
            "main_net_inflow_rate": F.when(F.col("turnover_amount") > 0, F.col("main_net_inflow") / F.col("turnover_amount")),
            "price_up_flow_out": diverges((F.col("close_pct") > 0) & (F.col("main_net_inflow") < 0)),
            "price_down_flow_in": diverges((F.col("close_pct") < 0) & (F.col("main_net_inflow") > 0)),
        }
    )


def enrich(f: DataFrame, bars: DataFrame) -> DataFrame:
    return against_bars(zscore(streak(rolling(derive(f)))), bars)


def snapshot(f: DataFrame, bars: DataFrame | None, as_of: str | None = None) -> DataFrame:
    """Each code's fields on its last day up to a date (FLT-11): rounded, with divergences that aren't known as false. Codes without a day are left out."""
    rows = against_bars(zscore(streak(rolling(derive(f)))), bars)
    rows = rows.where(F.col("date") <= F.to_date(F.lit(as_of))) if as_of else rows
    last = rows.withColumn("_p", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("_p = 1")
    numbers = ("main_net_inflow", "main_net_inflow_rate", "main_net_inflow_zscore_20d", "main_net_inflow_5d", "main_net_inflow_10d", "main_net_inflow_20d")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("price_up_flow_out", "price_down_flow_in")]
    return last.select("code", F.col("date").alias("as_of"), "main_inflow_streak", *[rounded(c).alias(c) for c in numbers], *flags)


def latest(f: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """What enrich() has on each code's last day, without what no one asks for on other days: one sort and one aggregation of a code's rows, and its last two bars."""
    main = F.col("main_net_inflow")
    stop = F.when(~F.coalesce(main > 0, F.lit(False)), F.col("date"))
    tiers = sum((F.coalesce(F.col(f"{s}_{t}_amount"), F.lit(0.0)) for s in ("buy", "sell") for t in TIERS), F.lit(0.0)) / 2
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    rows = derive(f).withColumns({"_p": place, "_stop": F.max(stop).over(Window.partitionBy("code"))})
    within = lambda n, c: F.when(F.col("_p") <= n, c)
    units = main.cast("decimal(28,6)")
    last20 = within(20, main)
    dev = F.when(F.count(last20) == 20, F.stddev_samp(last20))
    out = rows.groupBy("code").agg(
        F.max("date").alias("date"),
        F.max(within(1, main)).alias("main_net_inflow"),
        F.max(within(1, tiers)).alias("_tiers"),
        *[F.sum(within(n, units)).cast("double").alias(f"main_net_inflow_{n}d") for n in (5, 10, 20)],
        F.count_if(F.col("_stop").isNull() | (F.col("date") > F.col("_stop"))).alias("main_inflow_streak"),
        F.when(dev > 0, (F.max(within(1, main)) - F.avg(last20)) / dev).alias("main_net_inflow_zscore_20d"),
    )
    if bars is None:
        none = F.lit(None)
        out = out.withColumns({"close_pct": none.cast("double"), "_traded": none.cast("double")})
        diverges = lambda _: none.cast("boolean")
    else:
        days = out.select("code", F.col("date").alias("_day"))
        two = bars.join(days, "code").where(F.col("date") <= F.col("_day")).withColumn("_b", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("_b <= 2")
        at = lambda k, c: F.max(F.when(F.col("_b") == k, c))
        px = two.groupBy("code").agg(at(1, F.col("date") == F.col("_day")).alias("_on"), (at(1, F.col("close")) / at(2, F.col("close")) - 1).alias("_pct"), at(1, F.col("close") * F.col("volume") / 10000).alias("_amount"))
        out = out.join(px, "code", "left").withColumns({"close_pct": F.when(F.col("_on"), F.col("_pct")), "_traded": F.when(F.col("_on"), F.col("_amount"))}).drop("_on", "_pct", "_amount")
        diverges = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("turnover_amount", F.coalesce(F.when(F.col("_traded") > 0, F.col("_traded")), F.when(F.col("_tiers") > 0, F.col("_tiers")))).drop("_traded", "_tiers")
    return out.withColumns(
        {
            "main_net_inflow_rate": F.when(F.col("turnover_amount") > 0, main / F.col("turnover_amount")),
            "price_up_flow_out": diverges((F.col("close_pct") > 0) & (main < 0)),
            "price_down_flow_in": diverges((F.col("close_pct") < 0) & (main > 0)),
        }
    )


def condition(name: str, **params: float) -> Column:
    """One named flow condition (FLT-11); an unknown name is a ValueError."""
    c = F.col
    known = {
        "main_inflow_streak_gte": lambda: c("main_inflow_streak") >= params.get("days", 5),
        "main_net_inflow_5d_gt": lambda: c("main_net_inflow_5d") > params.get("amount", 0),
        "no_price_up_flow_out": lambda: ~F.coalesce(c("price_up_flow_out"), F.lit(False)),
        "main_net_inflow_rate_gte": lambda: c("main_net_inflow_rate") >= params.get("rate", 0),
    }
    if name not in known:
        raise ValueError(f"unknown flow condition {name}")
    return F.coalesce(known[name](), F.lit(False))
