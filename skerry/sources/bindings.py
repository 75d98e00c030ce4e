"""Domain views over the test tables: bars, factors, money flow, snapshot, boards, runs and picks.

A symbol is a supplier; its bars are its line items by ship date; a run is an order and its picks are the order's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: code, date, open, high, low, close, volume, amount."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), key.alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("a")
    )
    # by symbol, not by symbol and day: a day has about one trade, so nothing is gained by adding up before the shuffle, and moving columns find their bars where and as they need them
    return rows.repartition("code").groupBy("code", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("q").alias("volume"), F.sum("a").alias("amount")
    )


def factors(b: DataFrame) -> DataFrame:
    """Adjustment factors on the first twenty days of a month, growing by the year."""
    return b.where(F.dayofmonth("date") <= 20).select("code", "date", (1 + 0.1 * (F.year("date") - 1992)).alias("adj_factor"))


def moneyflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy and sell amounts by tier of quantity and side, by symbol and day."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_quantity") <= 10, "sm").when(F.col("l_quantity") <= 20, "md").when(F.col("l_quantity") <= 35, "lg").otherwise("elg").alias("tier"),
        F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("side"),
        (F.col("l_extendedprice") / 1e4).alias("x"),
    )
    cells = [F.sum(F.when((F.col("tier") == t) & (F.col("side") == s), F.col("x")).otherwise(0.0)).alias(f"{s}_{t}_amount") for s in ("buy", "sell") for t in ("sm", "md", "lg", "elg")]
    return rows.groupBy("code", "date").agg(*cells)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, industry, concepts): the nation, and the region with the nation's first letter as a comma list."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.concat_ws(",", F.col("r_name"), F.concat(F.lit("group "), F.substring("n_name", 1, 1))).alias("concepts"))


def quotes(b: DataFrame) -> DataFrame:
    """The last bar of each symbol with what the one before gives: price, change_pct, volume_ratio, amount."""
    from ..operators.bars import last_bars, recent, with_previous

    return last_bars(with_previous(recent(b, 21)))


def snapshot(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    """One row per symbol: code, name, price, change_pct, amount, total_mv, pe_ratio, pb_ratio, volume_ratio, turnover_rate, industry, concepts."""
    q = quotes(bars(spark, sf_dir) if b is None else b)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), (F.col("s_acctbal") / 100).alias("pe_ratio"), (F.abs(F.col("s_acctbal")) / 1000).alias("pb_ratio"))
    out = q.join(s, "code", "left").join(membership(spark, sf_dir), "code", "left")
    return out.select(
        "code", "name", F.col("close").alias("price"), "change_pct", "amount", (F.col("amount") * 100).alias("total_mv"), "pe_ratio", "pb_ratio", "volume_ratio", (F.col("volume") / 20).alias("turnover_rate"), "industry", "concepts", "date"
    )
