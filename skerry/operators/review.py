"""Reviews of evaluated picks: failures with their reasons by thirteen dimensions, event signals with what to do about them, changes to strategies (AGG-08, AGG-09, AGG-10).

Picks have run_id, strategy, code, rank, status and return_pct, and may have shape_status, path_status, max_drawdown_pct, llm_sector, llm_theme and arrays of texts: risk_flags, portfolio_flags, shape_tags,
llm_tags, llm_catalysts, llm_risks, post_analysis_tags. A column that isn't there is null or empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.num import rounded
from ..sources.staged import staged
from .places import with_medians

# fixed values: bounds of failures, and the prefixes of a signal's kinds
LARGE_LOSS, DRAWDOWN = -5.0, -8.0
KINDS = {"tag": "llm_tags", "catalyst": "llm_catalysts", "risk": "llm_risks", "post": "post_analysis_tags"}
TEXTS = ("status", "shape_status", "path_status", "llm_sector", "llm_theme")
LISTS = ("risk_flags", "portfolio_flags", "shape_tags", "llm_tags", "llm_catalysts", "llm_risks", "post_analysis_tags")
SINGLE = {"strategy": "strategy", "sector": "llm_sector", "theme": "llm_theme", "shape_status": "shape_status"}
MANY = {
    "risk_flag": "risk_flags",
    "portfolio_flag": "portfolio_flags",
    "shape_tag": "shape_tags",
    "llm_tag": "llm_tags",
    "llm_catalyst": "llm_catalysts",
    "llm_risk": "llm_risks",
    "post_analysis_tag": "post_analysis_tags",
    "event_signal": "event_signals",
    "failure_reason": "failure_reasons",
}


def _clean(a: Column) -> Column:
    """Trimmed, without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def _own_reasons() -> list[tuple[Column, Column]]:
    """What makes a completed pick a failure, and how it is called."""
    r, shape, named = F.col("return_pct"), F.col("shape_status"), lambda prefix, c: F.concat(F.lit(f"{prefix}:"), c)
    return [
        (F.col("status") != "ok", named("quote_status", F.col("status"))),
        (r < 0, F.lit("negative_return")),
        (r <= LARGE_LOSS, F.lit("large_loss")),
        (shape.isin("failed_breakout", "pullback_failed", "breakout_unconfirmed"), named("shape_status", shape)),
        (F.col("max_drawdown_pct") <= DRAWDOWN, F.lit("path_drawdown_breach")),
        (~F.col("path_status").isin("", "ok"), named("path_status", F.col("path_status"))),
    ]


def failed() -> Column:
    """Whether a completed pick has failure_reasons, told without building them: a filter's expression is worked out apart from the columns'."""
    return F.greatest(*[F.coalesce(holds, F.lit(False)) for holds, _ in _own_reasons()])


def complete(picks: DataFrame) -> DataFrame:
    """picks with all columns that a review looks at, and with event_signals and failure_reasons."""
    has = set(picks.columns)
    out = picks.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("") for c in TEXTS})
    out = out.withColumns({c: _clean(F.col(c)) if c in has else F.array().cast("array<string>") for c in LISTS})
    if "max_drawdown_pct" not in has:
        out = out.withColumn("max_drawdown_pct", F.lit(None).cast("double"))
    named = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(f"{prefix}:"), x))
    own = F.array_compact(F.array(*[F.when(holds, said) for holds, said in _own_reasons()]))
    out = out.withColumns({"event_signals": F.array_distinct(F.concat(*[named(k, F.col(c)) for k, c in KINDS.items()])), "_own": own})
    beside = F.concat(F.col("_own"), named("risk_flag", F.col("risk_flags")), named("portfolio_flag", F.col("portfolio_flags")), named("llm_risk", F.col("llm_risks")))
    return out.withColumn("failure_reasons", F.when(F.size("_own") > 0, F.array_distinct(beside)).otherwise(F.array().cast("array<string>"))).drop("_own")


def _worst_first() -> Column:
    """What failures are ordered by: the worst return first, then those without one."""
    return F.struct(F.col("return_pct").isNull().alias("none"), F.coalesce("return_pct", F.lit(0.0)).alias("r"), F.when(F.col("return_pct").isNull(), F.col("status")).otherwise("").alias("s"), "strategy", "rank", "code")


def _few(most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_groups, _code, _order) -> a row for each group and code that is among a batch's first of the group, so many different codes each, with the code's first order.

    A code that is among a group's first of all is among the first of the batch that holds its first row: whatever comes before it there comes before it everywhere.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        code, order = batch.column("_code"), batch.column("_order")
        by = []
        for key in [*order.flatten(), code]:
            if pa.types.is_floating(key.type):  # NaN is greater than all other values
                nan = pc.is_nan(key)
                by += [nan, pc.if_else(nan, pa.scalar(0, key.type), key)]
            else:
                by.append(key)
        sort_keys = [(f"k{i}", "ascending") for i in range(len(by))]
        at = pc.sort_indices(pa.table({k: c for (k, _), c in zip(sort_keys, by)}), sort_keys=sort_keys, null_placement="at_start")
        lists = batch.column("_groups").take(at)
        row, groups = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        label = np.zeros(len(row), np.int64)
        for name in groups.type:
            own = pc.struct_field(groups, name.name).dictionary_encode()
            label = label * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy()
        own = code.take(at).dictionary_encode()
        first = np.sort(np.unique(label * len(own.dictionary) + own.indices.to_numpy()[row], return_index=True)[1])
        first = first[np.argsort(label[first], kind="stable")]
        starts = np.flatnonzero(np.diff(label[first], prepend=-1))
        first = first[np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first)))) < most]
        rows, kept = at.take(pa.array(row[first])), groups.take(pa.array(first))
        names = [f.name for f in groups.type]
        yield pa.RecordBatch.from_arrays([*[pc.struct_field(kept, k) for k in names], code.take(rows), order.take(rows)], names=[*names, "_code", "_order"])


def _sample_codes(rows: DataFrame, groups: Column, most: int) -> DataFrame:
    """The codes of each group's worst picks by _order, each once. groups is an array of structs, the groups that a row belongs to.

    Batches give out their few first codes of each group before anything is sorted or shuffled; a code's worst pick is then had by one aggregation, and the first of each group.
    """
    narrow = rows.where(F.col("code").isNotNull()).select(groups.alias("_groups"), F.col("code").cast("string").alias("_code"), "_order")
    keys = narrow.schema["_groups"].dataType.elementType.fields
    by = [k.name for k in keys]
    schema = StructType([*[StructField(k.name, k.dataType) for k in keys], StructField("_code", narrow.schema["_code"].dataType), StructField("_order", narrow.schema["_order"].dataType)])
    code = narrow.mapInArrow(lambda batches: _few(most, batches), schema).groupBy(*by, "_code").agg(F.min("_order").alias("_order"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_order", "_code"))
    few = code.withColumn("_p", place).where(F.col("_p") <= most)
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_code"))), lambda x: x["_code"]), ",").alias("sample_codes"))


def failures(picks: DataFrame) -> DataFrame:
    """The picks that failed, with their reasons."""
    return complete(picks).where(failed())


def failure_samples(picks: DataFrame, most: int = 5) -> DataFrame:
    """The worst failures, most at a time: place, run_id, strategy, code, status, return_pct and reasons."""
    few = failures(picks).withColumn("_order", _worst_first()).orderBy("_order", "run_id").limit(most)
    place = F.row_number().over(Window.orderBy("_order", "run_id"))
    return few.select(place.alias("place"), "run_id", "strategy", "code", "status", "return_pct", F.array_join("failure_reasons", ";").alias("reasons"))


def failure_summary(picks: DataFrame) -> DataFrame:
    """One row on all failures."""
    f, r = failures(picks), F.col("return_pct")
    negative = F.when(r < 0, r)
    return f.agg(
        F.count(F.lit(1)).alias("failure_count"),
        F.count(negative).alias("negative_pick_count"),
        F.count_if(F.col("status") != "ok").alias("missing_count"),
        F.count_if(F.col("shape_status") == "failed_breakout").alias("failed_breakout_count"),
        F.count_if(F.col("max_drawdown_pct") <= DRAWDOWN).alias("severe_drawdown_count"),
        rounded(F.avg(negative)).alias("average_negative_return_pct"),
        rounded(F.min(r)).alias("worst_return_pct"),
    )


def failure_dimensions(picks: DataFrame, samples: int = 3) -> DataFrame:
    """Failures by thirteen dimensions at once: each failure is unpivoted to its labels (a blank one is unknown, an empty list none), then one aggregation;
    for the samples they stay one row until a batch has picked its few worst codes of each label.

    Returns dimension, label, failure_count, evaluated_failure_count, average and worst return, and the codes of the worst.
    """
    f = failures(picks).withColumn("_order", _worst_first())
    one = lambda d, c: F.struct(F.lit(d).alias("dimension"), F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", "unknown").otherwise(F.trim(F.col(c).cast("string"))).alias("label"))
    none = F.array(F.lit("none"))
    each = lambda d, c: F.transform(F.when(F.size(c) > 0, F.col(c)).otherwise(none), lambda x: F.struct(F.lit(d).alias("dimension"), x.alias("label")))
    cells = F.concat(F.array(*[one(d, c) for d, c in SINGLE.items()]), *[each(d, c) for d, c in MANY.items()])
    long = f.select("return_pct", F.explode(cells).alias("e")).select("return_pct", "e.dimension", "e.label")
    by = ["dimension", "label"]
    stats = long.groupBy(*by).agg(F.count(F.lit(1)).alias("failure_count"), F.count("return_pct").alias("evaluated_failure_count"), rounded(F.avg("return_pct")).alias("average_return_pct"), rounded(F.min("return_pct")).alias("worst_return_pct"))
    return stats.join(_sample_codes(f, cells, samples), by, "left")


def signal_action() -> Column:
    """What a signal's figures ask for."""
    avg, win, rate = F.col("average_return_pct"), F.col("win_rate"), F.col("failure_count") / F.col("pick_count") * 100
    return F.when(avg.isNull() | win.isNull(), "insufficient_data").when((avg > 0) & (win >= 50) & (rate < 50), "prefer").when((avg < 0) | (win < 50) | (rate >= 50), "avoid").otherwise("watch")


def signal_stats(picks: DataFrame, by: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Each signal (of each group): counts, failure rate, returns, strategies, codes of the worst picks, and its action."""
    rows = complete(picks).withColumn("_order", F.struct(F.col("return_pct").isNull().alias("none"), F.coalesce("return_pct", F.lit(0.0)).alias("r"), "strategy", "rank"))
    long = rows.select("strategy", "code", "return_pct", "_order", failed().alias("_failed"), F.explode("event_signals").alias("signal"))
    long = staged(long, "signals")
    keys = [*(by or []), "signal"]
    r = F.col("return_pct")
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pick_count"),
        F.count(r).alias("evaluated_pick_count"),
        F.count_if("_failed").alias("failure_count"),
        rounded(F.count_if("_failed") / F.count(F.lit(1)) * 100).alias("failure_rate"),
        rounded(F.avg(r)).alias("average_return_pct"),
        rounded(F.avg(F.when(r > 0, 100.0).when(r.isNotNull(), 0.0))).alias("win_rate"),
        rounded(F.max(r)).alias("best_return_pct"),
        rounded(F.min(r)).alias("worst_return_pct"),
        F.array_join(F.sort_array(F.collect_set("strategy")), ",").alias("strategies"),
    )
    out = with_medians(long, keys, stats, {"median_return_pct": "return_pct"}).withColumn("median_return_pct", rounded("median_return_pct"))
    names = [c for c in stats.columns if c not in ("win_rate", "best_return_pct", "worst_return_pct", "strategies")]
    out = out.select(*names, "median_return_pct", "win_rate", "best_return_pct", "worst_return_pct", "strategies")
    return out.join(_sample_codes(long, F.array(F.struct(*keys)), samples), keys, "left").withColumn("action", signal_action())


def suggestion_value(signal: Column) -> Column:
    """A signal as a strategy's event tag."""
    prefix, label = F.substring_index(signal, ":", 1), F.trim(F.substring(signal, F.instr(signal, ":") + 1, 1 << 20))
    out = F.when(F.instr(signal, ":") == 0, signal)
    for kind, word in (("risk", "风险"), ("catalyst", "催化"), ("post", "后验")):
        out = out.when(prefix == kind, F.concat(F.lit(f"{word}:"), label))
    return out.otherwise(label)


def strategy_suggestions(picks: DataFrame) -> DataFrame:
    """Per strategy the event tags to prefer and to avoid, best and worst first, by its own picks; strategies without any are left out."""
    named = picks.withColumn("strategy", F.when(F.coalesce("strategy", F.lit("")) == "", "unknown").otherwise(F.col("strategy")))
    s = signal_stats(named, ["strategy"]).where(F.col("action").isin("prefer", "avoid") & (F.col("evaluated_pick_count") > 0))
    order = F.struct((-F.col("average_return_pct")).alias("a"), "signal", suggestion_value(F.col("signal")).alias("value"))
    tags = lambda action: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == action, order))), lambda x: x["value"])), ",")
    out = s.groupBy("strategy").agg(tags("prefer").alias("preferred_event_tags"), tags("avoid").alias("avoided_event_tags"), F.count(F.lit(1)).alias("evidence"))
    return out.where("preferred_event_tags <> '' or avoided_event_tags <> ''")
