"""Hard filters: conjunctive, fail closed, in a fixed order, with one-pass rejection waterfalls (FLT-01 to FLT-10)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import number
from ..sources.staged import staged


class MissingFieldError(ValueError):
    """A configured filter's column isn't there."""


@dataclass(frozen=True)
class Key:
    name: str
    column: str
    kind: str  # st, min, max, true, false, in
    phase: str  # S snapshot, D daily, F flow


# fixed values: the filter keys in the order they apply, as key, column, kind and phase
KEYS = (
    Key("exclude_st", "name", "st", "S"),
    Key("amount_min", "amount", "min", "S"),
    Key("price_min", "price", "min", "S"),
    Key("price_max", "price", "max", "S"),
    Key("market_cap_min", "total_mv", "min", "S"),
    Key("market_cap_max", "total_mv", "max", "S"),
    Key("pe_ttm_min", "pe_ratio", "min", "S"),
    Key("pe_ttm_max", "pe_ratio", "max", "S"),
    Key("pb_min", "pb_ratio", "min", "S"),
    Key("pb_max", "pb_ratio", "max", "S"),
    Key("volume_ratio_min", "volume_ratio", "min", "S"),
    Key("turnover_rate_min", "turnover_rate", "min", "S"),
    Key("change_pct_min", "change_pct", "min", "S"),
    Key("change_pct_max", "change_pct", "max", "S"),
    Key("change_60d_min", "change_60d", "min", "D"),
    Key("change_60d_max", "change_60d", "max", "D"),
    Key("require_ma_bullish", "ma_bullish", "true", "D"),
    Key("require_price_above_ma20", "price_above_ma20", "true", "D"),
    Key("signal_score_min", "signal_score", "min", "D"),
    Key("macd_status_whitelist", "macd_status", "in", "D"),
    Key("rsi_status_whitelist", "rsi_status", "in", "D"),
    Key("breakout_20d_pct_min", "breakout_20d_pct", "min", "D"),
    Key("breakout_20d_pct_max", "breakout_20d_pct", "max", "D"),
    Key("range_20d_pct_max", "range_20d_pct", "max", "D"),
    Key("volume_ratio_20d_min", "volume_ratio_20d", "min", "D"),
    Key("volume_ratio_20d_max", "volume_ratio_20d", "max", "D"),
    Key("body_pct_min", "body_pct", "min", "D"),
    Key("body_pct_max", "body_pct", "max", "D"),
    Key("pullback_to_ma20_pct_min", "pullback_to_ma20_pct", "min", "D"),
    Key("pullback_to_ma20_pct_max", "pullback_to_ma20_pct", "max", "D"),
    Key("consolidation_days_20d_min", "consolidation_days_20d", "min", "D"),
    Key("consolidation_days_20d_max", "consolidation_days_20d", "max", "D"),
    Key("volatility_20d_pct_min", "volatility_20d_pct", "min", "D"),
    Key("volatility_20d_pct_max", "volatility_20d_pct", "max", "D"),
    Key("max_drawdown_20d_pct_min", "max_drawdown_20d_pct", "min", "D"),
    Key("max_drawdown_20d_pct_max", "max_drawdown_20d_pct", "max", "D"),
    Key("atr_20_pct_min", "atr_20_pct", "min", "D"),
    Key("atr_20_pct_max", "atr_20_pct", "max", "D"),
    Key("kdj_j_max", "kdj_j", "max", "D"),
    Key("kdj_j_min", "kdj_j", "min", "D"),
    Key("prev_kdj_j_max", "prev_kdj_j", "max", "D"),
    Key("require_kdj_golden_cross", "kdj_golden_cross", "true", "D"),
    Key("require_zg_short_above_long", "zg_short_above_long", "true", "D"),
    Key("require_close_above_zg_long", "close_above_zg_long", "true", "D"),
    Key("require_close_below_boll_lower", "close_below_boll_lower", "true", "D"),
    Key("require_close_above_boll_upper", "close_above_boll_upper", "true", "D"),
    Key("daily_amplitude_max", "daily_amplitude_pct", "max", "D"),
    Key("daily_change_min", "daily_change_pct", "min", "D"),
    Key("daily_change_max", "daily_change_pct", "max", "D"),
    Key("require_volume_above_prev", "volume_above_prev", "true", "D"),
    Key("require_brick_turn_up", "brick_turn_up", "true", "D"),
    Key("main_inflow_streak_min", "main_inflow_streak", "min", "F"),
    Key("main_net_inflow_5d_min", "main_net_inflow_5d", "min", "F"),
    Key("main_net_inflow_min", "main_net_inflow", "min", "F"),
    Key("main_net_inflow_rate_min", "main_net_inflow_rate", "min", "F"),
    Key("require_no_price_up_flow_out", "price_up_flow_out", "false", "F"),
)
BY_NAME = {k.name: k for k in KEYS}


def predicate(key: Key, value) -> Column:
    """The rows that pass; a missing value fails, but a missing name isn't special treatment."""
    c = F.col(key.column)
    if key.kind == "st":
        return ~F.coalesce(c.rlike("ST|退"), F.lit(False))
    if key.kind == "min":
        return F.coalesce(number(c) >= float(value), F.lit(False))
    if key.kind == "max":
        return F.coalesce(number(c) <= float(value), F.lit(False))
    if key.kind == "true":
        return c.eqNullSafe(F.lit(True))
    if key.kind == "false":
        return c.isNotNull() & ~F.coalesce(c, F.lit(True))
    return F.coalesce(c.cast("string").isin(*[str(v) for v in value]), F.lit(False))


def active(config: dict, phases: str = "SDF") -> list[tuple[Key, object]]:
    """The configured filters in their order. exclude_st is on unless switched off; None, False and empty lists are off."""
    unknown = set(config) - set(BY_NAME)
    if unknown:
        raise ValueError(f"unknown filter keys: {', '.join(sorted(unknown))}")
    on = {"exclude_st": True} | config
    return [(k, on[k.name]) for k in KEYS if k.phase in phases and k.name in on and on[k.name] is not None and on[k.name] is not False and on[k.name] != []]


def phases_needed(config: dict) -> str:
    """Which feature phases a config needs; the no-divergence filter also needs daily bars (FLT-08)."""
    found = {k.phase for k, _ in active(config)}
    if any(k.name == "require_no_price_up_flow_out" for k, _ in active(config)):
        found.add("D")
    return "".join(p for p in "SDF" if p in found or p == "S")


def steps(df: DataFrame, config: dict, phases: str = "SDF") -> list[tuple[str, Column]]:
    out = []
    for key, value in active(config, phases):
        if key.column not in df.columns:
            raise MissingFieldError(f"{key.name} needs column {key.column}")
        out.append((key.name, predicate(key, value)))
    return out


def apply(df: DataFrame, config: dict, phases: str = "SDF") -> DataFrame:
    """Rows that pass every configured filter, in their order. A column that isn't there is an error only if any row is left to be judged by it."""
    cond = F.lit(True)
    for key, value in active(config, phases):
        if key.column not in df.columns:
            if df.where(cond).isEmpty():
                return df.where(F.lit(False))
            raise MissingFieldError(f"{key.name} needs column {key.column}")
        cond = cond & predicate(key, value)
    return df.where(cond)


def waterfall(df: DataFrame, config: dict, samples: int = 3) -> DataFrame:
    """Per step: step, label, before, after, removed, removed_pct, up to so many removed codes and a suggestion, in one pass over df. Flow filters are no steps.

    Each row's first failed step is found once and staged; steps' counts are running sums over at most 55 groups. A step is to be looked at if it left nothing, or took nine of ten.
    """
    named = steps(df, config, "SD")
    first = F.lit(len(named) + 1)
    for i in range(len(named), 0, -1):
        first = F.when(~named[i - 1][1], i).otherwise(first)
    marked = staged(df.select(F.col("code"), first.alias("step")), "first-failed")
    place = F.row_number().over(Window.partitionBy("step").orderBy("code"))
    few = marked.withColumn("_p", place).where(F.col("_p") <= samples).groupBy("step").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("samples"))
    counts = marked.groupBy("step").agg(F.count(F.lit(1)).alias("removed"))
    spark = df.sparkSession
    all_steps = spark.createDataFrame([(i + 1, n) for i, (n, _) in enumerate(named)] + [(len(named) + 1, None)], "step int, label string")
    rows = all_steps.join(counts, "step", "left").join(few, "step", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    gone = F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("before", total - F.coalesce(gone, F.lit(0)))
    rows = rows.withColumn("after", F.col("before") - F.col("removed")).where(F.col("label").isNotNull())
    pct = F.when(F.col("before") > 0, F.rint(F.col("removed") / F.col("before") * 1e6) / 1e4).otherwise(0.0)
    said = F.when((F.col("before") <= 0) | (F.col("removed") <= 0), "").when(F.col("after") == 0, F.concat("label", F.lit(" eliminated all remaining candidates; inspect threshold or data availability.")))
    said = said.when(F.col("removed") / F.col("before") >= 0.9, F.concat("label", F.lit(" removed over 90% of remaining candidates; consider reviewing this threshold."))).otherwise("")
    return rows.select("step", "label", "before", "after", "removed", pct.alias("removed_pct"), F.coalesce("samples", F.lit("")).alias("samples"), said.alias("suggestion"))


def rejections(df: DataFrame, config: dict, limit: int = 8) -> DataFrame:
    """The first steps that removed rows, as texts with counts before and after (FLT-09): step and summary, by one aggregation."""
    rows = waterfall(df, config, samples=0).where(F.col("removed") > 0)
    text = F.concat(F.col("label"), F.lit(" removed "), F.col("removed"), F.lit(" ("), F.col("before"), F.lit("->"), F.col("after"), F.lit(")"))
    return rows.orderBy("step").limit(limit).select("step", text.alias("summary"))
