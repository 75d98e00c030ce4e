"""Pattern similarity: distances of vectors and windows, dynamic time warping, and top-k search (PAT-01 to PAT-09, SRT-06)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rounded
from .bars import by_date, over
from .places import By, few_numbered

WARPED_AT_ONCE = 1024  # rows


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def lp(a: Column, b: Column, p: str) -> Column:
    """l1 and l2 per element, linf as it is (PAT-04)."""
    d = pairs(a, b, lambda x, y: F.abs(x - y))
    n = F.size(a)
    return {"l1": total(d) / n, "l2": F.sqrt(total(F.transform(d, lambda x: x * x))) / n, "linf": F.array_max(d)}[p]


def similarity(d: Column, alpha: float = 1.0) -> Column:
    return F.exp(-alpha * d)


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    d = norm(a) * norm(b)
    return F.when(d > 0, total(pairs(a, b, lambda x, y: x * y)) / d).otherwise(0.0)


def pearson(a: Column, b: Column) -> Column:
    """0 where either is constant (PAT-05)."""
    n = F.size(a)
    sx, sy = total(F.transform(a, lambda x: x.cast("double"))), total(F.transform(b, lambda x: x.cast("double")))
    sxy, sxx, syy = total(pairs(a, b, lambda x, y: x * y)), total(pairs(a, a, lambda x, y: x * y)), total(pairs(b, b, lambda x, y: x * y))
    d = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(d > 1e-18, (n * sxy - sx * sy) / F.sqrt(d)).otherwise(0.0)


def ranks(a: Column) -> Column:
    """Average ranks of a short vector."""
    return F.transform(a, lambda x: (F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / 2.0))


def spearman(a: Column, b: Column) -> Column:
    return pearson(ranks(a), ranks(b))


def windows(bars: DataFrame, n: int, step: int | None = None) -> DataFrame:
    """Every step-th window of n closes of each symbol, each against its own first close."""
    step = step or max(n // 15, 1)
    rows = bars.withColumn("w", F.collect_list("close").over(over(n))).withColumn("_rn", F.row_number().over(by_date()))
    rows = rows.where((F.col("_rn") >= n) & ((F.col("_rn") - n) % step == 0))
    return rows.select("code", F.col("date").alias("end"), F.transform("w", lambda x: x / F.element_at("w", 1) - 1).alias("w"))


def dtw(a: Column, b: Column) -> Column:
    """Time-warping distance of two arrays, in Arrow batches; no built-in expression follows the path. Arrays of a column are of one length."""

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(warped(np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)))

    return run(a, b)


def warped(x: np.ndarray, y: np.ndarray, band: float = 0.2) -> np.ndarray:
    """Banded time-warping distance of each row of x to that row of y (or to its only row), by its shortest path, per step of the path.

    A row is a series of numbers, or of points whose distance is Euclidean. The loop is over diagonals, whose cells don't depend on each other; some hundred rows, which a processor's
    cache holds, are worked on at once. Of equally short ways the diagonal one is taken, then the one from above.
    """
    x, y = np.atleast_2d(x), np.atleast_2d(y)
    x, y = (a[:, :, None] if a.ndim == 2 else a for a in (x, y))
    (rows, n), m = x.shape[:2], y.shape[1]
    width = max(int(np.ceil(band * max(n, m))), abs(n - m), 1)
    out = np.empty(rows)
    for at in range(0, rows, WARPED_AT_ONCE):
        part = slice(at, at + WARPED_AT_ONCE)
        out[part] = _warped(*(np.ascontiguousarray(a.transpose(1, 2, 0)) for a in (x[part], y if len(y) == 1 else y[part])), width)
    return out


def _warped(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """The same for (points, features, rows): neighbouring rows lie side by side, and only cells within the band are looked at."""
    n, m, rows = len(x), len(y), x.shape[2]
    # the two diagonals before and the next one: shortest ways to cells (i, d - i), by i, and their steps
    far, near, here = (np.full((n + 2, rows), np.inf) for _ in range(3))
    far_steps, near_steps, steps = (np.zeros((n + 2, rows)) for _ in range(3))
    far[0] = 0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m, -((width - d) // 2)), min(n, d - 1, (d + width) // 2)
        cells, before = slice(low, high + 1), slice(low - 1, high)
        apart = x[before] - y[d - high - 1 : d - low][::-1]
        cost = np.sqrt(np.multiply(apart, apart, out=apart).sum(axis=1))
        across, above, beside = far[before], near[before], near[cells]
        count = np.where(beside < above, near_steps[cells], near_steps[before])
        way = np.minimum(above, beside)
        np.add(np.where(across <= way, far_steps[before], count), 1, out=steps[cells])
        np.add(np.minimum(across, way), cost, out=here[cells])
        here[low - 1] = here[high + 1] = np.inf
        far, near, here = near, here, far
        far_steps, near_steps, steps = near_steps, steps, far_steps
    return near[n] / near_steps[n]


def feature_columns(bars: DataFrame) -> DataFrame:
    """Shape, change and trend of every bar against its symbol's first close (PAT-01, WIN-27): nine columns, first to last bar.

    Change is 0 on the first bar; its mean and population deviation run from the first bar on; the slope is that of a line through up to five closes, 0 for one.
    """
    whole = by_date().rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(whole)
    base = F.when(first == 0, 1.0).otherwise(first)
    rows = bars.withColumns({"_base": base, **{f"_{k}": F.lag("close", k).over(by_date()) for k in range(1, 5)}})
    rows = rows.withColumn("_change", F.coalesce(F.col("close") / F.col("_1") - 1, F.lit(0.0)))
    low, high = F.least("open", "close"), F.greatest("open", "close")
    c, c1, c2, c3, c4 = (F.col(x) for x in ("close", "_1", "_2", "_3", "_4"))
    # least squares over evenly spaced points, in closed form
    slope = F.when(c4.isNotNull(), (2 * (c - c4) + (c1 - c3)) / 10).when(c3.isNotNull(), (3 * (c - c3) + (c1 - c2)) / 10).when(c2.isNotNull(), (c - c2) / 2).when(c1.isNotNull(), c - c1).otherwise(0.0)
    return rows.withColumns(
        {
            "close_return": F.col("close") / F.col("_base") - 1,
            "body": (F.col("close") - F.col("open")) / F.col("_base"),
            "upper_shadow": (F.col("high") - high) / F.col("_base"),
            "lower_shadow": (low - F.col("low")) / F.col("_base"),
            "amplitude": (F.col("high") - F.col("low")) / F.col("_base"),
            "log_volume": F.log1p(F.greatest(F.col("volume"), F.lit(0.0))),
            "pct_change_mean": F.avg("_change").over(whole),
            "pct_change_std": F.stddev_pop("_change").over(whole),
            "trend_slope": slope,
        }
    ).drop("_base", "_change", "_1", "_2", "_3", "_4")


def bound(value: Column, then) -> Column:
    """then of a value that is computed once; inside a lambda an expression of its own is computed anew for every element."""
    return F.transform(F.array(value), then)[0]


def normalized(a: Column, method: str = "zscore", most: float | None = 5.0) -> Column:
    """A window's values by their own mean and population deviation, range, or quartiles, and then clipped (PAT-02); a spread of 0 counts as 1.

    What all values share is bound once, so that the work grows with the window and not with its square.
    """
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)

    def by(x: Column, middle: Column, spread) -> Column:
        return bound(middle, lambda m: bound(one(spread(m)), lambda d: F.transform(x, lambda v: (v - m) / d)))

    def quantile(s: Column, q: float) -> Column:
        at = (F.size(s) - 1) * q
        low, high = F.element_at(s, (F.floor(at) + 1).cast("int")), F.element_at(s, (F.ceil(at) + 1).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def scaled(x: Column) -> Column:
        if method == "zscore":
            return by(x, total(x) / F.size(x), lambda m: F.sqrt(total(F.transform(x, lambda u: (u - m) * (u - m))) / F.size(x)))
        if method == "minmax":
            return by(x, F.array_min(x), lambda m: F.array_max(x) - m)
        return bound(F.sort_array(x), lambda s: by(x, quantile(s, 0.5), lambda m: quantile(s, 0.75) - quantile(s, 0.25)))

    x = F.transform(a, lambda v: v.cast("double"))
    if method not in ("zscore", "minmax", "robust", "none"):
        raise ValueError(f"unknown normalisation {method}")
    out = x if method == "none" else bound(x, scaled)
    return out if most is None else F.transform(out, lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most)))


def search(bars: DataFrame, query: list[float], metric: str = "pearson", per_symbol: int = 20, top: int = 10) -> DataFrame:
    """The windows of closes most like a query of closes alone: the best of each symbol, then of all. The query is a literal; windows are looked at where they are. Whole bars are searched by pattern_search."""
    q = F.array(*[F.lit(float(x) / query[0] - 1) for x in query])
    w = windows(bars, len(query))
    score = {"pearson": lambda: (pearson(F.col("w"), q) + 1) / 2, "spearman": lambda: (spearman(F.col("w"), q) + 1) / 2, "cosine": lambda: cosine(F.col("w"), q), "l1": lambda: similarity(lp(F.col("w"), q, "l1")), "l2": lambda: similarity(lp(F.col("w"), q, "l2")), "linf": lambda: similarity(lp(F.col("w"), q, "linf")), "dtw": lambda: similarity(dtw(F.col("w"), q))}
    if metric not in score:
        raise ValueError(f"unknown metric {metric}")
    rows = w.withColumn("similarity", rounded(score[metric](), 6))
    order = [F.desc("similarity"), F.asc("end")]
    own = rows.withColumn("_p", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("_p") <= per_symbol)
    return few_numbered(own, [By("similarity", descending=True), By("end"), By("code")], top).select("rank", "code", "end", "similarity")
