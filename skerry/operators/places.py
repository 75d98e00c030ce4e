"""Places, running sums and percentile ranks over all rows, with no partition that holds them all (WIN-30, SRT-01, SRT-04).

Rows are cut into parts of about equal size at split points taken from a bounded sample of the order's keys. A part knows how much comes before it from one
sum for each part; within it a window does the rest. Rows with equal keys are always in one part, so ties are whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged

PART_ROWS = 250_000
MOST_PARTS = 4096
SAMPLES_A_PART = 16


@dataclass(frozen=True)
class By:
    """One key of an order. Texts can only ascend, as no expression turns them round."""

    column: str
    descending: bool = False
    nulls_last: bool = True

    @property
    def sort(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    @property
    def ascending(self) -> Column:
        """A value that ascends as the order does, nulls apart."""
        c = F.col(f"`{self.column}`")
        flag = F.when(c.isNull(), 1 if self.nulls_last else 0).otherwise(0 if self.nulls_last else 1)
        return F.struct(flag.alias("at"), (-c if self.descending else c).alias("of"))


def split_points(rows: DataFrame, keys: Sequence[By], parts: int) -> tuple[Column, list]:
    """(key, points): the order's key as a struct, and parts - 1 values of it between parts of about equal size.

    The sample has a fixed number of rows for each part and is drawn by a hash of the key, so that it is the same in every run.
    """
    key = F.struct(*[k.ascending.alias(f"k{i}") for i, k in enumerate(keys)])
    if parts <= 1:
        return key, []
    drawn = rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(parts * SAMPLES_A_PART)
    in_order = drawn.agg(F.sort_array(F.collect_list("k"))).first()[0]
    return key, [in_order[len(in_order) * i // parts] for i in range(1, parts)]


def _part(key: Column, points: list, schema) -> Column:
    """The number of split points that aren't beyond the key, by halving."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < _literal(points[middle], schema), below(low, middle)).otherwise(below(middle + 1, high))

    return below(0, len(points))


def _literal(row, schema) -> Column:
    cells = []
    for value, field in zip(row, schema.fields):
        at, of = value
        cells.append(F.struct(F.lit(at).alias("at"), F.lit(of).cast(field.dataType["of"].dataType).alias("of")).alias(field.name))
    return F.struct(*cells)


def running(rows: DataFrame, keys: Sequence[By], amount: Column, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A staged table's rows with the sum of amount over all rows before each, in the order of keys.

    Of rows with equal keys one is before another in no particular order. The driver gets a sample of the keys and a sum for each part.
    """
    n = rows.count()
    parts = max(1, min(-(-n // part_rows), MOST_PARTS))
    key, points = split_points(rows, keys, parts)
    schema = rows.select(key.alias("k")).schema["k"].dataType
    placed = rows.withColumn("_part", _part(key, points, schema))
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy(*[k.sort for k in keys]).rowsBetween(Window.unboundedPreceding, -1))
    bases, total = [0] * parts, 0
    if parts > 1:
        sums = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.sum(amount)).collect()}
        for part in range(parts):
            bases[part] = total
            total += sums.get(part) or 0
    base = F.element_at(F.array(*[F.lit(b) for b in bases]), F.col("_part") + 1)
    return placed.withColumn(name, F.coalesce(own, F.lit(0)) + base).drop("_part")


def numbered(df: DataFrame, keys: Sequence[By], name: str = "rank", part_rows: int = PART_ROWS) -> DataFrame:
    """df with each row's place in the order of keys, from 1. df is staged, as it is read for its keys and for its rows."""
    rows = staged(df.drop(name) if name not in [k.column for k in keys] else df.withColumnRenamed(name, "_was"), "placed")
    keys = [By("_was", k.descending, k.nulls_last) if k.column == name else k for k in keys]
    out = running(rows, keys, F.lit(1), name, part_rows).withColumn(name, (F.col(name) + 1).cast("int"))
    return out.drop("_was")


def few_numbered(df: DataFrame, keys: Sequence[By], most: int, name: str = "rank") -> DataFrame:
    """The first rows in the order of keys, at most so many, with their places. Each task keeps its first ones; one window sees what the limit leaves."""
    order = [k.sort for k in keys]
    first = df.drop(name).orderBy(*order).limit(most)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def medians(rows: DataFrame, by: Sequence[str], value: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The exact median of a staged table's values in each group (by..., median), however large a group is (AGG-02, AGG-07).

    Equal values are counted first; the places of a group's values come from sums over parts, and its one or two middle values are picked by their places. No task holds a group's values.
    """
    counts = staged(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    placed = running(counts, [*[By(b) for b in by], By("_value")], F.col("_n"), "_before", part_rows)
    groups = placed.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min("_before").alias("_start"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"p.`{b}`").eqNullSafe(F.col(f"g.`{b}`"))
    met = placed.alias("p").join(groups.alias("g"), same).select(*[F.col(f"p.`{b}`").alias(b) for b in by], "_value", (F.col("_before") - F.col("_start")).alias("_from"), "_n", "_all")
    at = lambda place: F.max(F.when((F.col("_from") <= place) & (place < F.col("_from") + F.col("_n")), F.col("_value")))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return met.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def with_medians(rows: DataFrame, by: Sequence[str], out: DataFrame, values: dict[str, str]) -> DataFrame:
    """out (one row for each group of by, or one row) with the exact median of each of values: name -> column of a staged table's rows.

    A sketch of bounded size tells bounds a little below and above each group's middle. Values between them are counted singly, all others together, so that no
    hash table holds a group's values; a place within these counts is exact. Should a sketch's bounds miss a middle, medians sorts all values.
    """
    for name, value in values.items():
        found = _near_middle(rows, by, value)
        if found.where("_all > 0 and median is null").limit(1).count():
            found = medians(rows, by, value)
        own = found.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("median").alias(name))
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
        out = out.join(own, same, "left").drop(*[f"_by{i}" for i in range(len(by))])
    return out


def _near_middle(rows: DataFrame, by: Sequence[str], value: str, few: int = 10_000, accuracy: int = 10_000) -> DataFrame:
    """(by..., _all, median): NULL medians where the bounds missed. The bounds are a thousandth of a group apart from its middle, ten times what the sketch may err."""
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull()).select(*by, v.alias("_v"))
    sketch = F.percentile_approx("_v", F.array(F.lit(0.499), F.lit(0.501)), F.lit(accuracy))
    bounds = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_q"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_n") <= few
    low, high = F.when(small, F.col("_least")).otherwise(F.col("_q")[0]), F.when(small, F.col("_most")).otherwise(F.col("_q")[1])
    bounds = staged(bounds.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], low.alias("_low"), high.alias("_high")), "median-bounds")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    side = F.when(F.col("_v") < F.col("_low"), 0).when(F.col("_v") <= F.col("_high"), 1).otherwise(2)
    met = known.join(bounds, same).select(*by, side.alias("_side"), F.when(side == 1, F.col("_v")).alias("_v"))
    counts = met.groupBy(*by, "_side", "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, "_side", "_v", (upto - F.col("_n")).alias("_from"), upto.alias("_to"), F.sum("_n").over(group).alias("_all"))
    at = lambda place: F.max(F.when((F.col("_side") == 1) & (F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))
    middle = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    return staged(placed.groupBy(*by).agg(F.max("_all").alias("_all"), middle.alias("median")), "medians")


def percentile_ranks(rows: DataFrame, ranked: dict[str, tuple[Column, bool, float]], part_rows: int = PART_ROWS) -> DataFrame:
    """A staged table's rows with a column for each of ranked: name -> (value, whether lower is better, what missing values get).

    The rank is the mean place of the value's ties over the number of values, times 100. Equal values are counted first, in tasks and then by one shuffle, so a value that a third of
    all rows hold is one row when it is placed; rows get their value's rank by a join on the value.
    """
    names = list(ranked)
    cells = [F.struct(F.lit(i).alias("metric"), (-v if lower else v).cast("double").alias("value")) for i, (v, lower, _) in enumerate(ranked.values())]
    counts = rows.select(F.explode(F.array(*cells)).alias("c")).where("c.value is not null").groupBy("c.metric", "c.value").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "value-counts")
    totals = {r[0]: r[1] for r in counts.groupBy("metric").agg(F.sum("n")).collect()}
    starts = [sum(totals.get(j, 0) for j in range(i)) for i in range(len(names))]
    placed = running(counts, [By("metric"), By("value")], F.col("n"), "before", part_rows)
    for i, (name, (value, lower, missing)) in enumerate(ranked.items()):
        score = (F.col("before") - starts[i] + (F.col("n") + 1) / 2) / float(totals.get(i, 1)) * 100
        own = placed.where(F.col("metric") == i).select(F.col("value").alias("_value"), score.alias("_score"))
        rows = rows.withColumn("_key", (-value if lower else value).cast("double"))
        rows = rows.join(own, F.col("_key") == F.col("_value"), "left").withColumn(name, F.coalesce("_score", F.lit(float(missing)))).drop("_key", "_value", "_score")
    return rows
