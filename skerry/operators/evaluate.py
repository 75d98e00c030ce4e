"""Outcome evaluation of saved picks and its roll-ups (AGG-02 to AGG-11, JOIN-07, JOIN-08, RSK-08, RSK-09, WIN-29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from ..sources.staged import staged
from .places import with_medians


def returns(picks: DataFrame, quotes: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """return_pct after cost and status of picks (code, entry) against quotes (code, price); of repeated quotes the last by date counts."""
    last = quotes.groupBy("code").agg(F.max_by("price", "date").alias("price"))
    rows = picks.join(last, "code", "left")
    ok = (F.col("entry") > 0) & F.col("price").isNotNull()
    status = F.when(F.col("price").isNull(), "missing").when(~(F.coalesce(F.col("entry"), F.lit(0.0)) > 0), "bad_entry_price").otherwise("ok")
    return rows.withColumn("return_pct", F.when(ok, (F.col("price") / F.col("entry") - 1) * 100 - cost_bps / 100)).withColumn("status", status)


def price_path(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """What happened from each pick's day on: path_days, path_end_pct, path_drawdown_pct, path_runup_pct.

    Bars know the rest of their series by windows that run from the last day back; each pick takes the first bar from its day on, by one sort of
    picks and bars together. So no pick meets all its later bars.
    """
    ahead = Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    known = bars.select("code", "date", F.struct(F.count(F.lit(1)).over(ahead).alias("days"), F.first("close").over(ahead).alias("end"), F.min("low").over(ahead).alias("low"), F.max("high").over(ahead).alias("high")).alias("b"))
    both = picks.withColumn("date", F.to_date("created")).withColumn("b", F.lit(None).cast(known.schema["b"].dataType)).withColumn("_pick", F.lit(True))
    both = both.unionByName(known.withColumn("_pick", F.lit(False)), allowMissingColumns=True)
    # from the last day back, a day's own bar comes before its picks, so that it is their next one
    next_bar = F.last("b", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("date"), "_pick").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("b", next_bar).where("_pick")
    pct = lambda c: F.when(F.col("entry") > 0, rounded((F.col(c) / F.col("entry") - 1) * 100))
    return rows.select(*picks.columns, F.col("b.days").alias("path_days"), pct("b.end").alias("path_end_pct"), F.least(pct("b.low"), F.lit(0.0)).alias("path_drawdown_pct"), F.greatest(pct("b.high"), F.lit(0.0)).alias("path_runup_pct"))


def rolled(rows: DataFrame, by: list[str], before: list[Column] = (), after: list[Column] = (), c: str = "return_pct") -> DataFrame:
    """Per group of by, or over all: pick_count, mean, median and win rate of known returns (AGG-07), with further aggregates before and after them.

    rows should have the columns that these need and no others, as they are staged: their medians are had by more than one pass.
    """
    rows = staged(rows, "returns")
    win = F.avg(F.when(F.col(c) > 0, 100.0).when(F.col(c).isNotNull(), 0.0))
    own = [F.count(c).alias("pick_count"), rounded(F.avg(c)).alias("average_return_pct"), rounded(win).alias("win_rate")]
    g = rows.groupBy(*by).agg(*before, *own, *after)
    out = with_medians(rows, by, g, {"median_return_pct": c}).withColumn("median_return_pct", rounded("median_return_pct"))
    names = [n for n in g.columns if n != "win_rate"]
    at = names.index("average_return_pct") + 1
    return out.select(*names[:at], "median_return_pct", "win_rate", *names[at:])


def path_summary(paths: DataFrame) -> DataFrame:
    """Of picks with a known path: how many, and mean and median of their greatest falls and rises (AGG-02)."""
    rows = staged(paths.select("path_drawdown_pct", "path_runup_pct"), "paths")
    g = rows.agg(F.count("path_drawdown_pct").alias("path_pick_count"), *[rounded(F.avg(f"path_{c}_pct")).alias(f"average_max_{c}_pct") for c in ("drawdown", "runup")])
    g = with_medians(rows, [], g, {f"median_max_{c}_pct": f"path_{c}_pct" for c in ("drawdown", "runup")})
    return g.select("path_pick_count", *[x for c in ("drawdown", "runup") for x in (F.col(f"average_max_{c}_pct"), rounded(f"median_max_{c}_pct").alias(f"median_max_{c}_pct"))])


def summary(rows: DataFrame) -> DataFrame:
    counts = [F.countDistinct("run_id").alias("run_count"), F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status") == "missing").alias("missing_count")]
    return rolled(rows.select("run_id", "status", "return_pct"), [], counts)


def portfolios(rows: DataFrame, by: str = "strategy") -> DataFrame:
    """Equal-weight portfolios: the mean of each run, then over runs (AGG-03)."""
    runs = rows.groupBy(by, "run_id").agg(F.avg("return_pct").alias("return_pct"))
    return runs.groupBy(by).agg(F.count("return_pct").alias("portfolio_count"), rounded(F.avg("return_pct")).alias("average_return_pct"), rounded(F.min("return_pct")).alias("worst_return_pct"), rounded(F.max("return_pct")).alias("best_return_pct"))


def by_label(rows: DataFrame, label: Column) -> DataFrame:
    """Blank labels are unknown; labels with no known return stay with a count of 0 (AGG-05)."""
    named = F.when(F.trim(F.coalesce(label, F.lit(""))) == "", "unknown").otherwise(label)
    return rolled(rows.select(named.alias("label"), "return_pct"), ["label"])


def by_labels(rows: DataFrame, labels: Column) -> DataFrame:
    """A row counts for each of its labels, or for none (AGG-06)."""
    each = F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("none"))))
    return rolled(rows.select("return_pct", each.alias("label")), ["label"])


def holding_period(created: Column, now: Column) -> Column:
    """Bucket of whole days since (DAT-02)."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    return F.when(days.isNull(), "unknown").when(days <= 1, "0-1d").when(days <= 5, "2-5d").when(days <= 20, "6-20d").otherwise(">20d")


def shape_status(follow: float = 3.0, failed: float = -3.0) -> Column:
    """What became of a breakout or a pullback, from breakout_20d_pct, pullback_to_ma20_pct and return_pct (RSK-08)."""
    r = F.col("return_pct")
    out = F.when(F.col("breakout_20d_pct") >= -1.5, F.when(r.isNull(), "breakout_pending").when(r >= follow, "breakout_follow_through").when(r <= failed, "failed_breakout").otherwise("breakout_unconfirmed"))
    return out.when(F.col("pullback_to_ma20_pct").between(-3, 6), F.when(r.isNull(), "pullback_pending").when(r > 0, "pullback_rebound").otherwise("pullback_failed")).otherwise("")


def strategies(rows: DataFrame) -> DataFrame:
    """Per strategy: counts, stats, statuses as text, outcome (AGG-04, AGG-12)."""
    rows = staged(rows.select("strategy", "run_id", "status", "return_pct"), "picks")
    counts = [F.countDistinct("run_id").alias("run_count"), F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status") == "missing").alias("missing_count")]
    base = rolled(rows, ["strategy"], counts)
    each = rows.groupBy("strategy", "status").agg(F.count(F.lit(1)).alias("n"))
    text = each.groupBy("strategy").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"].cast("string"))), ";").alias("status_counts"))
    avg, win = F.col("average_return_pct"), F.col("win_rate")
    outcome = F.when(avg.isNull() | win.isNull(), "insufficient_data").when((avg >= 2) & (win >= 60), "strong").when((avg > 0) & (win >= 50), "positive").when((avg < 0) & (win < 50), "negative").otherwise("mixed")
    miss = F.col("missing_count") / F.col("pick_count")
    raw = 50 + avg * 2 + (win - 50) * 0.5 - miss * 20
    score = F.when(F.col("pick_count") > 0, rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1))
    return base.join(text, "strategy").withColumn("outcome", outcome).withColumn("performance_score", score)


def failures(rows: DataFrame, dimensions: list[str], bad: float = -5.0) -> DataFrame:
    """Failed picks rolled up by many dimensions at once: unpivoted, then one aggregation (AGG-10)."""
    failed = rows.where((F.col("return_pct") <= bad) | (F.col("status") != "ok"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("label")) for d in dimensions]))
    return failed.select("return_pct", each.alias("e")).groupBy("e.dimension", "e.label").agg(F.count(F.lit(1)).alias("failure_count"), rounded(F.avg("return_pct")).alias("average_return_pct"))


def event_signals(rows: DataFrame, signals: Column, bad: float = -5.0) -> DataFrame:
    """Per signal: stats, failure rate, extremes and an action (AGG-08)."""
    each = rows.select("return_pct", "strategy", F.explode(signals).alias("signal"))
    bad_rate = F.avg(F.when(F.col("return_pct") <= bad, 100.0).when(F.col("return_pct").isNotNull(), 0.0))
    more = [rounded(bad_rate).alias("failure_rate"), rounded(F.max("return_pct")).alias("best_return_pct"), rounded(F.min("return_pct")).alias("worst_return_pct"), F.countDistinct("strategy").alias("strategy_count")]
    g = rolled(each, ["signal"], after=more)
    action = F.when(F.col("pick_count") < 3, "collect_more").when((F.col("average_return_pct") > 0) & (F.col("win_rate") >= 55), "promote").when((F.col("average_return_pct") < 0) & (F.col("failure_rate") >= 40), "demote").otherwise("watch")
    return g.withColumn("action", action)
