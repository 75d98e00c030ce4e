"""Hotspots from boards to leaders: discovery and detail (HOT-06, HOT-07, SRC-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from .boards import roles, stage, stock_score

CORE = "核心龙头"


def distinct_boards(boards: DataFrame) -> DataFrame:
    """One row of each topic (topic, source, change_pct, rank, heat): the hottest, then that which rose most, then that of the best rank."""
    named = boards.where(F.trim(F.coalesce("topic", F.lit(""))) != "")
    key = [F.desc_nulls_last("heat"), F.desc_nulls_last("change_pct"), F.asc_nulls_last("rank"), F.asc("source")]
    return named.withColumn("_p", F.row_number().over(Window.partitionBy("topic").orderBy(*key))).where("_p = 1").drop("_p")


def scored_constituents(stocks: DataFrame) -> DataFrame:
    """Stocks of topics (topic, code, name, change_pct, amount, turnover_rate, volume_ratio, net_inflow, is_limit_up, active_days, evidence_count) with score, place and role in their topic."""
    score = stock_score(*[F.col(c) for c in ("change_pct", "amount", "turnover_rate", "volume_ratio", "net_inflow", "is_limit_up", "active_days", "evidence_count")])
    ranked = roles(stocks.withColumn("hot_stock_score", score).withColumnRenamed("topic", "board"))
    return ranked.withColumnRenamed("board", "topic").withColumnRenamed("rank", "place")


def leaders(scored: DataFrame, most: int = 3) -> DataFrame:
    """Per topic its leaders: the first of the core ones, or of all if there is none; with the number of its stocks."""
    core = F.col("role") == CORE
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.when(core, 0).otherwise(1), "place"))
    rows = scored.withColumns({"_p": place, "_core": F.max(core).over(Window.partitionBy("topic")), "_n": F.count(F.lit(1)).over(Window.partitionBy("topic"))})
    few = rows.where((F.col("_p") <= most) & (core | ~F.col("_core")))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("code").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", name.alias("name")))), lambda x: x["name"])
    return few.groupBy("topic").agg(F.max("_n").alias("stock_count"), F.array_join(listed, ",").alias("leaders"))


def discover(boards: DataFrame, trends: DataFrame, stocks: DataFrame, top: int = 20) -> DataFrame:
    """The hottest topics: boards, once each, with their trends and stage, ranked, and then only the ranked ones' stocks.

    Heat is the trend's latest, or the board's own where there is no history. What a topic lacks is told in missing_fields. Ties go by heat, change, trend, the board's rank and the topic.
    """
    t = trends.select(F.col("board").alias("topic"), "observations", "latest", "trend", "cooling", "persistence", "state")
    rows = distinct_boards(boards).join(t, "topic", "left").withColumn("board_rank", F.col("rank")).drop("rank")
    rows = rows.withColumns({"latest": F.coalesce("latest", "heat"), "observations": F.coalesce("observations", F.lit(0)), "state": F.coalesce("state", F.lit(""))})
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("trend", "cooling", "persistence")}
    rows = rows.withColumns(zero).withColumns({"heat_score": rounded("latest"), "stage": stage()})
    rows = rows.withColumn("hot_score", F.col("latest") + F.greatest(F.col("trend"), F.lit(0.0)) * 0.35 + F.col("persistence") * 0.05 - F.col("cooling") * 0.6)
    order = [F.desc("hot_score"), F.desc("latest"), F.desc_nulls_last("change_pct"), F.desc("trend"), F.asc_nulls_last("board_rank"), F.asc("topic")]
    first = rows.orderBy(*order).limit(top)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    own = stocks.join(F.broadcast(first.select("topic")), "topic", "left_semi")  # at most top topics
    out = first.join(leaders(scored_constituents(own)), "topic", "left")
    lacks = F.when(F.coalesce("stock_count", F.lit(0)) == 0, "stocks,leader_stocks").otherwise("")
    return out.select(
        "rank", "topic", "source", "heat_score", "trend", "persistence", "cooling", "observations", "state", "stage", F.coalesce("stock_count", F.lit(0)).alias("stock_count"), F.coalesce("leaders", F.lit("")).alias("leaders"), lacks.alias("missing_fields")
    )


def detail(topics: DataFrame, stocks: DataFrame, top: int = 10) -> DataFrame:
    """The first stocks of each asked topic (topic): place, code, name, score and role."""
    own = stocks.join(topics.select("topic").distinct(), "topic", "left_semi")
    return scored_constituents(own).where(F.col("place") <= top).select("topic", "place", "code", "name", "hot_stock_score", "role")
