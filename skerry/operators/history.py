"""Run and source histories, breadth, data quality, reconciliation and incremental upkeep (AGG-13 to AGG-18, JOIN-14, SET-02, INC-03 to INC-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from ..sources.keyed import latest_rows
from .places import By, few_numbered, numbered


def run_history(runs: DataFrame, recent: int = 5) -> DataFrame:
    """Per strategy: runs, picks, means, last run, and the newest run ids (runs: strategy, run_id, created, picks)."""
    g = runs.groupBy("strategy").agg(F.count(F.lit(1)).alias("run_count"), F.sum("picks").cast("long").alias("pick_count"), rounded(F.avg("picks")).alias("average_picks"), F.max("created").cast("string").alias("last_run"))
    place = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("created"), F.desc("run_id")))
    new = runs.withColumn("_p", place).where(F.col("_p") <= recent)
    ids = new.groupBy("strategy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "run_id"))), lambda x: x["run_id"].cast("string")), ",").alias("recent_runs"))
    return g.join(ids, "strategy")


def source_history(runs: DataFrame) -> DataFrame:
    """Per source: error, degradation and fallback rates, stability score and status (runs: source, errors, degraded, fallback)."""
    g = runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("run_count"), F.avg(F.when(F.col("errors") > 0, 1.0).otherwise(0.0)).alias("_e"), F.avg(F.when(F.col("degraded") > 0, 1.0).otherwise(0.0)).alias("_d"), F.avg(F.when(F.col("fallback"), 1.0).otherwise(0.0)).alias("_f")
    )
    e, d, f = F.col("_e"), F.col("_d"), F.col("_f")
    status = F.when(f > 0, "fallback").when((e >= 0.5) | (d >= 0.5), "degraded").when((e > 0) | (d > 0), "watch").otherwise("ok")
    return g.select("source", "run_count", rounded(e).alias("error_rate"), rounded(d).alias("degradation_rate"), rounded(f).alias("fallback_rate"), rounded(F.greatest(F.lit(0.0), 100 - e * 45 - d * 35 - f * 30), 1).alias("stability_score"), status.alias("status"))


def breadth(s: DataFrame) -> DataFrame:
    """One row on a whole snapshot: size, share of risers, mean and median change, median amount, share of hot volume (AGG-15)."""
    share = lambda c: rounded(F.avg(F.when(c, 1.0).when(c.isNotNull(), 0.0)))
    return s.agg(F.count(F.lit(1)).alias("rows"), share(F.col("change_pct") > 0).alias("up_ratio"), rounded(F.avg("change_pct")).alias("mean_change"), rounded(F.median("change_pct")).alias("median_change"), rounded(F.median("amount")).alias("median_amount"), share(F.col("volume_ratio") >= 2).alias("hot_volume"))


def factor_leaders(scored: DataFrame, factors: list[str]) -> DataFrame:
    """Per factor the mean and the leading code (AGG-16): unpivoted, one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"factor_{f}_score").alias("score")) for f in factors]))
    rows = scored.select("code", each.alias("e"))
    return rows.groupBy("e.factor").agg(rounded(F.avg("e.score")).alias("mean"), F.max_by("code", F.struct("e.score", -F.col("code"))).alias("leader"))


def label_distribution(s: DataFrame, label: Column, top: int = 6) -> DataFrame:
    g = s.groupBy(F.coalesce(label, F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return few_numbered(g, [By("n", descending=True), By("label")], top)


def field_quality(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Per field missing, non-positive and present counts, and repeated keys, in one pass (AGG-17, AGG-18)."""
    cells = []
    for f in fields:
        cells += [F.count_if(F.col(f).isNull()).alias(f"_m_{f}"), F.count_if(F.col(f) <= 0).alias(f"_z_{f}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated"), *cells)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_m_{f}").alias("missing"), F.col(f"_z_{f}").alias("non_positive")) for f in fields]))
    return one.select("rows", "repeated", each.alias("e")).select("e.field", "rows", "e.missing", "e.non_positive", "repeated", rounded(1 - F.col("e.missing") / F.col("rows")).alias("coverage"))


def reconcile_sources(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes and overlap of two sources' keys (JOIN-14)."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(F.count("_a").alias("left_keys"), F.count("_b").alias("right_keys"), both.alias("overlap"), rounded(both / F.count(F.lit(1))).alias("jaccard"))


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Upsert: an incoming row replaces the one with its keys (SET-02, INC-06); of several incoming ones that with the greatest order counts, then the greatest by its other columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_rows(both, keys, ["_new", *(order or [])]).drop("_new")


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Each key's status: added, removed, updated or unchanged; missing equals missing (INC-03)."""
    n = new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_n"))
    j = old.select(*keys, *values, F.lit(True).alias("_o")).join(n, keys, "full")
    same = F.lit(True)
    for v in values:
        a, b = F.col(v), F.col(f"_n_{v}")
        same = same & F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    return j.select(*keys, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "unchanged").otherwise("updated").alias("status"))


def changed_factors(old: DataFrame, new: DataFrame, last: int = 60) -> DataFrame:
    """Codes whose fingerprint of the last so many factors changed, and must be rebuilt (INC-04, HSH-01)."""

    def prints(f: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
        rows = f.withColumn("_p", place).where(F.col("_p") <= last)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", rounded("adj_factor", 6).alias("f")))), lambda x: F.concat_ws(":", x["date"].cast("string"), x["f"].cast("string"))), ",")
        return rows.groupBy("code").agg(F.sha2(text, 256).alias(name))

    j = prints(old, "a").join(prints(new, "b"), "code", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("code")


def rebuilt(bars: DataFrame, old: DataFrame, new: DataFrame, last: int = 60) -> DataFrame:
    """The last bars, as many as fingerprints look at, of every code whose factors changed, adjusted anew by the new ones (INC-04)."""
    from .bars import adjust, last_n

    changed = changed_factors(old, new, last)
    return last_n(adjust(bars.join(changed, "code", "left_semi"), new.join(changed, "code", "left_semi")), last)


def calendar_gaps(bars: DataFrame, most: int = 2) -> DataFrame:
    """Codes that miss more than so many of the days on which anything traded, between their first and last bar (INC-05)."""
    days = bars.select("date").distinct()
    place = numbered(days, [By("date")], "_i")
    g = bars.join(place, "date").groupBy("code").agg(F.count(F.lit(1)).alias("bars"), (F.max("_i") - F.min("_i") + 1).alias("days"))
    return g.withColumn("missing", F.col("days") - F.col("bars")).where(F.col("missing") > most)
