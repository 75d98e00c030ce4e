"""Total order, risk and portfolio overlays, scorecard and blended re-rank (SRT-01 to SRT-04, RSK-01 to RSK-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from ..functions.text import flags_of
from ..sources.staged import staged
from .places import By, few_numbered, numbered
from .scoring import weights_of

# fixed values: bounds and points of the risk rules
RISK = {
    "chase_change_pct": 8.0,
    "chase_points": 4.0,
    "breakdown_change_pct": -7.0,
    "breakdown_points": 3.5,
    "abnormal_volume_ratio": 6.0,
    "abnormal_volume_ratio_points": 3.0,
    "high_turnover_rate": 15.0,
    "high_turnover_points": 3.0,
    "invalid_pe_points": 3.0,
    "high_pb": 8.0,
    "high_pb_points": 2.0,
    "weak_signal_score": 45.0,
    "weak_signal_points": 2.5,
    "macd_bearish_points": 2.0,
    "rsi_overbought_points": 1.5,
    "low_llm_confidence": 0.35,
    "low_llm_confidence_points": 1.5,
    "llm_risk_points": 1.2,
    "llm_risk_points_cap": 4.0,
    "deep_risk_points": 1.5,
    "deep_risk_points_cap": 4.5,
    "low_daily_quality_score": 70.0,
    "low_daily_quality_points": 2.0,
    "bad_daily_quality_flag_points": 3.0,
    "stale_daily_cache_points": 2.5,
    "fallback_daily_errors_points": 1.5,
    "fetch_failed_daily_points": 6.0,
}


def order_of(factor_weights: dict[str, float] | None = None) -> list[By]:
    """By screen_score, then factors by weight (ties by name), then code."""
    factors = sorted(weights_of(factor_weights).items(), key=lambda x: (-x[1], x[0]))
    return [By("screen_score", descending=True), *[By(f"factor_{f}_score", descending=True) for f, _ in factors], By("code")]


def ordered(df: DataFrame, factor_weights: dict[str, float] | None = None) -> DataFrame:
    """rank by screen_score, then factors by weight (ties by name), then code: a total order (SRT-01)."""
    return numbered(df, order_of(factor_weights))


def best(df: DataFrame, most: int, factor_weights: dict[str, float] | None = None) -> DataFrame:
    """The first rows of ordered(), without ordering the others."""
    return few_numbered(df, order_of(factor_weights), most)


def quality_list(flags: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(flags.cast("string"), F.lit("")), "[,，| ]", ";"), ";")


def risk(df: DataFrame, profile: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(points, flags) of a pick's risk rules, by the bounds and points of a profile (RSK-02).

    Rules on columns that aren't there don't count. Each of llm_risks and deep_flags (arrays) counts, up to its cap, and is a flag itself; blanks among the
    llm_risks don't. Every flag is named once.
    """
    p = RISK | (profile or {})
    has = set(df.columns)
    c = lambda name: F.col(name) if name in has else F.lit(None)
    quality = F.col("_quality") if "_quality" in has else quality_list(c("daily_quality_flags"))
    severe = F.array(*[F.lit(x) for x in ("invalid_ohlc", "non_positive_price", "negative_volume")])
    chase = F.coalesce(c("change_pct") >= p["chase_change_pct"], F.lit(False))
    rules = [
        (chase, "single_day_chase_risk", "chase_points"),
        (~chase & (c("change_pct") <= p["breakdown_change_pct"]), "single_day_breakdown_risk", "breakdown_points"),
        (c("volume_ratio") >= p["abnormal_volume_ratio"], "abnormal_volume_ratio", "abnormal_volume_ratio_points"),
        (c("turnover_rate") >= p["high_turnover_rate"], "high_turnover", "high_turnover_points"),
        (c("pe_ratio") <= 0, "negative_or_invalid_pe", "invalid_pe_points"),
        (c("pb_ratio") >= p["high_pb"], "high_pb", "high_pb_points"),
        (c("signal_score") < p["weak_signal_score"], "weak_daily_signal", "weak_signal_points"),
        (c("macd_status") == "bearish", "macd_bearish", "macd_bearish_points"),
        (c("rsi_status") == "overbought", "rsi_overbought", "rsi_overbought_points"),
        (c("llm_confidence") < p["low_llm_confidence"], "low_llm_confidence", "low_llm_confidence_points"),
        (c("daily_quality_score") < p["low_daily_quality_score"], "low_daily_quality", "low_daily_quality_points"),
        (F.array_contains(quality, "fetch_failed"), "daily_fetch_failed", "fetch_failed_daily_points"),
        (F.array_contains(quality, "stale_cache"), "daily_stale_cache", "stale_daily_cache_points"),
        (F.array_contains(quality, "fallback_errors"), "daily_source_fallback_errors", "fallback_daily_errors_points"),
        (F.arrays_overlap(quality, severe), "bad_daily_quality_flags", "bad_daily_quality_flag_points"),
    ]
    points = F.lit(0.0)
    for cond, _, key in rules:
        points = points + F.when(cond, float(p[key])).otherwise(0.0)
    flags = F.split(flags_of([(cond, flag) for cond, flag, _ in rules]), ";")
    for name, key in (("llm_risks", "llm_risk_points"), ("deep_flags", "deep_risk_points")):
        if name in has:
            listed = F.coalesce(F.array_compact(name), F.array().cast("array<string>"))
            if name == "llm_risks":
                listed = F.filter(listed, lambda x: x != "")
            points = points + F.least(F.size(listed) * float(p[key]), F.lit(float(p[f"{key}_cap"])))
            flags = F.concat(flags, listed)
    return points, F.array_join(F.array_distinct(F.filter(flags, lambda x: x != "")), ";")


def risk_overlay(df: DataFrame, max_penalty: float = 12.0, veto: bool = False, profile: dict[str, float] | None = None) -> DataFrame:
    """Subtract bounded risk from final_score, mark risk_level, optionally drop high risk, and rank anew (RSK-02, RSK-03)."""
    if "daily_quality_flags" in df.columns:
        df = df.withColumn("_quality", quality_list(F.col("daily_quality_flags")))  # split once, not by each rule
    points, flags = risk(df, profile)
    out = df.withColumn("risk_points", points).withColumn("risk_flags", flags).drop("_quality")
    p = F.col("risk_points")
    share = F.when(F.lit(max_penalty > 0), F.least(p / max(max_penalty, 1e-9) * 100, F.lit(100.0))).otherwise(0.0)
    level = F.when(F.lit(max_penalty <= 0), "low").when(p >= max_penalty * 0.66, "high").when(p >= max_penalty * 0.33, "medium").otherwise("low")
    out = out.withColumns({"risk_penalty": rounded(F.least(p, F.lit(float(max_penalty)))), "risk_score": rounded(share), "risk_level": level})
    out = out.withColumn("final_score", rounded(F.col("final_score") - F.col("risk_penalty")))
    if veto:
        out = out.where("risk_level <> 'high'")
    return rerank(out)


def rerank(df: DataFrame) -> DataFrame:
    """Stable: by final_score, then by the earlier rank (SRT-04)."""
    return numbered(df, [By("final_score", descending=True), By("rank")])


def portfolio_overlay(df: DataFrame, bucket: Column, most: int = 1, step: float = 4.0) -> DataFrame:
    """Later picks of a bucket lose step each, three steps at most; the order before penalties decides (RSK-04)."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("final_score"), F.asc("rank")))
    out = df.withColumn("bucket", bucket)
    extra = F.when(F.col("bucket").isNotNull() & (F.col("bucket") != ""), F.greatest(place - most, F.lit(0))).otherwise(0)
    out = out.withColumn("portfolio_penalty", rounded(F.least(extra * float(step), F.lit(step * 3.0))))
    return rerank(out.withColumn("final_score", rounded(F.col("final_score") - F.col("portfolio_penalty"))))


# fixed values: scorecard bounds and bonuses
CARD = {"value_min": 75.0, "stability_min": 65.0, "quality_bonus": 2.4, "momentum_min": 72.0, "activity_min": 65.0, "capital_bonus": 1.8, "reversal_min": 75.0, "reversal_bonus": 1.2, "hot_activity": 90.0, "hot_stability": 45.0, "hot_penalty": 2.5, "spike_ratio": 5.0, "spike_penalty": 1.2, "cap": 8.0}


def scorecard(df: DataFrame, card: dict[str, float] | None = None) -> DataFrame:
    """score_delta and tags from factor scores (RSK-05)."""
    p = CARD | (card or {})
    f = lambda n: F.coalesce(F.col(f"factor_{n}_score"), F.lit(50.0))
    quality = (f("value") >= p["value_min"]) & (f("stability") >= p["stability_min"])
    capital = (f("momentum") >= p["momentum_min"]) & (f("activity") >= p["activity_min"])
    reversal = (f("reversal") >= p["reversal_min"]) & (F.col("change_pct") < 0)
    hot = (f("activity") >= p["hot_activity"]) & (f("stability") < p["hot_stability"])
    spike = F.coalesce(F.col("volume_ratio") >= p["spike_ratio"], F.lit(False))
    delta = F.lit(0.0)
    for cond, n in ((quality, p["quality_bonus"]), (capital, p["capital_bonus"]), (reversal, p["reversal_bonus"]), (hot, -p["hot_penalty"]), (spike, -p["spike_penalty"])):
        delta = delta + F.when(cond, n).otherwise(0.0)
    delta = F.greatest(F.least(delta, F.lit(p["cap"])), F.lit(-p["cap"]))
    return df.withColumns({"score_delta": rounded(delta), "score_tags": flags_of([(quality, "value_quality"), (capital, "capital_confirmed"), (reversal, "controlled_reversal")]), "score_flags": flags_of([(hot, "hot_money_instability"), (spike, "volume_spike")])})


def blend(df: DataFrame, judged: DataFrame, weight: float = 0.4, coverage: float = 0.6) -> DataFrame:
    """Blend screen_score with llm_score of judged (code, llm_score and, if the judge gave an order, seq); where too few are covered, the screen order stands (RSK-01).

    Picks are placed as the judge lists them (a code's first mention counts, unknown codes don't), then the others by rank. A pick without a score gets one by
    its place, from 100 evenly down. Equal blends keep that order.
    """
    seq = F.col("seq").cast("long") if "seq" in judged.columns else F.lit(None).cast("long")
    first = judged.groupBy("code").agg(F.min_by(F.struct(seq.alias("seq"), "llm_score"), F.struct(F.coalesce(seq, F.lit(1 << 62)), "llm_score")).alias("_judged"))
    rows = staged(df.drop("llm_score").join(first, "code", "left").withColumns({"_unsaid": F.col("_judged").isNull().cast("int"), "_seq": F.col("_judged.seq")}), "judged")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count("_judged").alias("known")).first()
    rows = numbered(rows, [By("_unsaid"), By("_seq"), By("rank")], "_place").drop("_unsaid", "_seq")
    rows = rows.withColumns({"llm_coverage": rounded(F.lit(count.known) / F.lit(max(count.n, 1))), "_step": F.lit(100.0 / max(count.n, 1))})
    said = F.coalesce("_judged.llm_score", 100.0 - (F.col("_place") - 1) * F.col("_step"))
    counts = F.col("llm_coverage") >= coverage
    mixed = F.col("screen_score") * (1 - weight) + said * weight
    rows = rows.withColumns({"llm_score": F.when(counts, said), "final_score": rounded(F.when(counts, mixed).otherwise(F.col("screen_score"))), "rank": F.when(counts, F.col("_place")).otherwise(F.col("rank"))})
    return rerank(rows.drop("_judged", "_place", "_step"))
