"""Analyzers of ranked picks and their registry (JOIN-10, RSK-06, RSK-07, UDF-01, SRT-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import rounded
from ..functions.text import normalize_code
from .ranking import rerank, scorecard

# fixed values: points of advice and of predicted trends
ADVICE = {"强烈买入": 10.0, "买入": 8.0, "增持": 5.0, "持有": 1.5, "中性": 0.0, "观望": -4.0, "减持": -8.0, "卖出": -12.0, "回避": -12.0}
TREND = {"看多": 4.0, "震荡": 0.0, "中性": 0.0, "看空": -6.0}


def candidates(total: int, output: int, multiple: int, most: int) -> int:
    """How many picks a costly judge sees: a multiple of those asked for, within bounds (SRT-03)."""
    return min(max(output * multiple, output), most, total)


def _points(c: Column, table: dict[str, float]) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.trim(F.coalesce(c, F.lit("")))), F.lit(0.0))


def deep_delta() -> Column:
    """Points of a completed deep analysis: scores about 50, advice, trend, and at most 6 less for flags; what is missing counts nothing."""
    about = lambda c, w: F.coalesce((F.col(c) - 50) * w, F.lit(0.0))
    flags = F.least(F.coalesce(F.array_size("deep_flags"), F.lit(0)) * 2.0, F.lit(6.0))
    return about("deep_signal_score", 0.2) + about("deep_sentiment_score", 0.12) + _points(F.col("deep_advice"), ADVICE) + _points(F.col("deep_trend"), TREND) - flags


def deep_overlay(df: DataFrame) -> DataFrame:
    """Add deep_delta to the picks whose deep_status is completed, and rank anew; ties keep their order (RSK-07)."""
    added = F.when(F.col("deep_status") == "completed", deep_delta()).otherwise(0.0)
    return rerank(df.withColumn("final_score", rounded(F.col("final_score") + added)))


def external_overlay(df: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """Deltas and flags of an external analyzer's items (seq, code, score_delta, risk_flags array) on the picks of their codes.

    Codes are compared in their normal spelling. Several items of a code add up, with their flags in the order of seq; items of unknown codes and missing deltas count nothing. Only the first
    picks were shown to the analyzer: the others are skipped, though an item that names one still counts.
    """
    told = items.groupBy(normalize_code(F.col("code").cast("string")).alias("_code")).agg(F.sum(F.coalesce("score_delta", F.lit(0.0))).alias("external_delta"), F.array_sort(F.collect_list(F.struct("seq", "risk_flags"))).alias("_told"))
    more = F.flatten(F.transform(F.coalesce("_told", F.array().cast("array<struct<seq:bigint,risk_flags:array<string>>>")), lambda x: F.coalesce(x["risk_flags"], F.array().cast("array<string>"))))
    held = F.split(F.coalesce("risk_flags", F.lit("")), ";")
    flags = F.array_join(F.array_distinct(F.filter(F.concat(held, F.transform(more, lambda x: F.trim(x))), lambda x: x != "")), ";")
    status = F.when(F.col("rank") > most, "skipped").when(F.col("external_delta").isNotNull(), "completed").otherwise("")
    out = df.withColumn("_code", normalize_code(F.col("code").cast("string"))).join(told, "_code", "left").withColumns({"external_status": status, "risk_flags": flags, "final_score": rounded(F.col("final_score") + F.coalesce("external_delta", F.lit(0.0)))})
    return out.drop("_told", "_code")


def card_overlay(df: DataFrame) -> DataFrame:
    """The scorecard's deltas, added."""
    return scorecard(df).withColumn("final_score", rounded(F.col("final_score") + F.col("score_delta")))


ANALYZERS: dict[str, Callable[..., DataFrame]] = {"dsa": deep_overlay, "external_http": external_overlay, "scorecard": card_overlay}


def analyze(df: DataFrame, names: list[str], options: dict[str, dict] | None = None) -> DataFrame:
    """The named analyzers in turn, each name once, then a new rank by final_score; a name that isn't registered raises ValueError."""
    names = list(dict.fromkeys(x.strip().lower() for x in names if x.strip()))
    for name in names:
        if name not in ANALYZERS:
            raise ValueError(f"unknown post analyzer {name!r}; there are {', '.join(sorted(ANALYZERS))}")
    for name in names:
        df = ANALYZERS[name](df, **(options or {}).get(name, {}))
    return rerank(df) if names else df
