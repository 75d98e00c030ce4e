"""The screening plan: snapshot, filters by phase, features by phase, scores, total order, top k, overlays — one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import filters, flow, indicators, ranking, scoring
from ..sources.staged import staged


@dataclass(frozen=True)
class ScreenSpec:
    """A strategy: filters, factor weights, how many rows to return."""

    name: str
    hard_filters: dict = field(default_factory=dict)
    factor_weights: dict[str, float] = field(default_factory=dict)
    max_output: int = 5
    profile: dict[str, float] = field(default_factory=dict)

    @property
    def phases(self) -> str:
        return filters.phases_needed(self.hard_filters)


def daily_features(bars: DataFrame) -> DataFrame:
    """Every daily feature at each symbol's last bar."""
    rows = B.change_60(B.averages(B.recent(bars, 61)))  # no feature looks back further
    rows = B.consolidation(B.true_range(B.drawdown(B.volatility(B.shape(B.rsi(rows))))))
    last = B.last_bars(rows).drop("open", "high", "low", "close", "volume", "amount", "date")
    out = last.join(indicators.snapshot(bars), "code", "left").join(B.quality(bars), "code", "left")
    return B.signal(out)


def flow_features(moneyflow: DataFrame, bars: DataFrame) -> DataFrame:
    return flow.latest(moneyflow, bars).select("code", "main_net_inflow", "main_net_inflow_5d", "main_inflow_streak", "main_net_inflow_rate", "price_up_flow_out")


def screen(snapshot: DataFrame, spec: ScreenSpec, bars: DataFrame | None = None, moneyflow: DataFrame | None = None, prune: int | None = None) -> DataFrame:
    """The ranked rows of a strategy.

    Bars and flows are read for codes that passed the earlier phases only (a left semi join ahead of the windows). prune cuts the pool by its
    provisional score before daily features, which can change answers; without it the whole pool is looked at.
    """
    phases = spec.phases
    pool = filters.apply(snapshot, spec.hard_filters, "S")
    if "D" in phases:
        if bars is None:
            raise ValueError(f"{spec.name} needs daily bars")
        if prune:
            pool = ranking.best(scoring.score(pool, spec.factor_weights, profile=spec.profile), prune, spec.factor_weights).select(*snapshot.columns)
        pool = staged(pool, "pool")
        bars = staged(bars.join(pool.select("code"), "code", "left_semi"), "pool-bars")  # several features read them
        pool = pool.join(daily_features(bars), "code", "left")
        pool = filters.apply(pool, spec.hard_filters, "SD")
    if "F" in phases:
        if moneyflow is None or bars is None:
            raise ValueError(f"{spec.name} needs money flow and daily bars")
        pool = staged(pool, "pool")
        own, bars = (t.join(pool.select("code"), "code", "left_semi") for t in (moneyflow, bars))
        pool = pool.join(flow_features(own, bars), "code", "left")
        pool = filters.apply(pool, spec.hard_filters)
    return ranking.best(scoring.score(pool, spec.factor_weights, profile=spec.profile), spec.max_output, spec.factor_weights)
