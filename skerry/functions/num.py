"""Numeric column semantics: missing is NULL, never NaN; clips keep NULL; ratios by zero are NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A double, or NULL for what isn't a number (NUM-01); percent signs and thousands separators are dropped."""
    x = F.regexp_replace(F.trim(col(c).cast("string")), "[%,]", "")
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def rounded(c: Column | str, places: int = 4) -> Column:
    """Half-even rounding of the scaled binary value, the form that agrees across engines (NUM-05)."""
    scale = float(10**places)
    return F.rint(col(c) * scale) / scale


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL (NUM-03)."""
    x = col(c)
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def whole_number(c: Column | str) -> Column:
    """The number without its fraction, or NULL (NUM-02)."""
    x = number(c)
    return F.when(F.abs(x) < 9e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))


def truth(c: Column | str) -> Column:
    """Whether a text says yes (1, true, yes, on); NULL for blanks (NUM-02)."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.when(x != "", x.isin("1", "true", "yes", "on"))


def bounded(c: Column | str, low: float, high: float) -> Column:
    """A number within bounds, or NULL (NUM-02)."""
    return clip(number(c), low, high)


def text_list(c: Column | str, most: int = 80) -> Column:
    """The items of an array, trimmed and cut, without blanks; an empty array for NULL (NUM-02)."""
    items = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.substring(F.trim(x), 1, most))
    return F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.when(col(b) != 0, col(a) / col(b))


def or_else(c: Column | str, value: float) -> Column:
    return F.coalesce(col(c), F.lit(float(value)))


def log_of(c: Column | str) -> Column:
    """log10 of at least 1 (NUM-04)."""
    return F.log10(F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(1.0))))


def rank_score(c: Column, lower_is_better: bool, missing: float, by: list[str] | None = None) -> Column:
    """Percentile rank times 100 with average ties within groups, or within a frame known to be small; missing values get a score of their own.

    Over all rows of a frame of any size, operators.places.percentile_ranks gives the same.
    """
    part = Window.partitionBy(*[F.col(x) for x in by or []])
    order = c.asc_nulls_last() if not lower_is_better else c.desc_nulls_last()
    rank = F.rank().over(part.orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(x) for x in by or []], c))
    known = F.count(c).over(part)
    return F.when(c.isNull(), float(missing)).otherwise((rank + (ties - 1) / 2.0) / known * 100)
