"""Search for windows of bars like a query's: nine features of each window, normalised in it, resampled to one length and compared in three groups (PAT-01 to PAT-09, JOIN-13, SRT-06).

A symbol's last bars are one small group; an Arrow task describes and compares the windows of many symbols at once and gives out each symbol's best only. (As Column
expressions over arrays the same took 13 s instead of 2 for 18,000 windows.) Arrays are (windows, ...) to whoever reads them, but windows lie side by side in memory. Time warping is exact; windows
that the groups compared so far rule out aren't compared any further.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import last_n
from .pattern import warped
from .places import By, few_numbered

# fixed values: the features of a window by group, the groups' weights, and the settings of a search
GROUPS = {
    "price": ("close_return", "body", "upper_shadow", "lower_shadow", "amplitude"),
    "volume": ("log_volume",),
    "stat": ("pct_change_mean", "pct_change_std", "trend_slope"),
}
WEIGHTS = {"price": 0.75, "volume": 0.15, "stat": 0.10}
MIN_BARS, POINTS, CLIP, WARP, LOOKBACK, PER_SYMBOL, TOP = 20, 32, 5.0, 0.2, 200, 20, 20

FEATURES = tuple(f for group in GROUPS.values() for f in group)
PLACES = {g: slice(FEATURES.index(names[0]), FEATURES.index(names[-1]) + 1) for g, names in GROUPS.items()}  # a group's features are neighbours
METRICS = ("euclidean", "manhattan", "chebyshev", "pearson", "spearman", "cosine", "dtw")
COLUMNS = ("open", "high", "low", "close", "volume")
CHUNK = 64
CELLS = 1 << 20  # numbers of windows' features at once


def filled(bars: DataFrame) -> DataFrame:
    """Bars with a close; other prices that are missing are the close, a missing volume is 0 (PRJ-04)."""
    has = lambda c: F.col(c).cast("double") if c in bars.columns else F.lit(None).cast("double")
    close = F.col("close").cast("double")
    prices = [F.coalesce(has(c), close).alias(c) for c in ("open", "high", "low")]
    return bars.where("close is not null").select("code", "date", *prices, close.alias("close"), F.coalesce(has("volume"), F.lit(0.0)).alias("volume"))


def _side_by_side(windows: int, *sizes: int) -> np.ndarray:
    """An empty (windows, ...) whose windows are neighbours in memory, so that work on all windows runs along it."""
    return np.moveaxis(np.empty((*sizes, windows)), -1, 0)


def features(bars: np.ndarray) -> np.ndarray:
    """(windows, bars, 5) -> (windows, bars, 9): the features of each window against its first close (PAT-01, WIN-27).

    The change is 0 on the first bar and after a close of 0; its mean and population deviation run from the first bar on; the slope is that of a line through up to five closes, 0 for one.
    """
    o, h, low, c, v = (bars[:, :, i] for i in range(5))
    w, n = c.shape
    base = np.where(c[:, :1] == 0, 1.0, c[:, :1])
    change = np.zeros((w, n), order="F")
    np.divide(c[:, 1:] - c[:, :-1], c[:, :-1], out=change[:, 1:], where=c[:, :-1] != 0)
    mean, spread, means, devs = np.zeros(w), np.zeros(w), np.zeros((w, n), order="F"), np.zeros((w, n), order="F")
    for i in range(n):
        off = change[:, i] - mean
        mean = mean + off / (i + 1)
        spread = spread + off * (change[:, i] - mean)
        means[:, i], devs[:, i] = mean, np.sqrt(spread / (i + 1))
    slope = np.zeros((w, n), order="F")
    for i in range(1, n):
        back = [c[:, i - k] for k in range(min(i, 4) + 1)]
        if i == 1:
            slope[:, i] = back[0] - back[1]
        elif i == 2:
            slope[:, i] = (back[0] - back[2]) / 2
        elif i == 3:
            slope[:, i] = (3 * (back[0] - back[3]) + (back[1] - back[2])) / 10
        else:
            slope[:, i] = (2 * (back[0] - back[4]) + (back[1] - back[3])) / 10
    out = _side_by_side(w, n, len(FEATURES))
    for k, feature in enumerate([c / base - 1, (c - o) / base, (h - np.maximum(o, c)) / base, (np.minimum(o, c) - low) / base, (h - low) / base, np.log1p(np.maximum(v, 0)), means, devs, slope]):
        out[:, :, k] = feature
    return out


def normalised(x: np.ndarray, method: str = "zscore", most: float | None = CLIP) -> np.ndarray:
    """Each feature by its own values in the window: mean and population deviation, range, or quartiles; then clipped (PAT-02). A spread of 0 counts as 1."""
    high, low = x.max(axis=1, keepdims=True), x.min(axis=1, keepdims=True)
    if method == "zscore":
        flat = high == low
        centre = np.where(flat, high, x.mean(axis=1, keepdims=True))  # a constant feature is its own mean, whatever its sum rounds to
        spread = np.where(flat, 0.0, x.std(axis=1, keepdims=True))
    elif method == "minmax":
        centre, spread = low, high - low
    elif method == "robust":
        first, centre, third = np.quantile(x, (0.25, 0.5, 0.75), axis=1, keepdims=True)
        spread = third - first
    elif method == "none":
        centre, spread = 0.0, np.ones(1)
    else:
        raise ValueError(f"unknown normalisation {method}")
    out = (x - centre) / np.where(spread == 0, 1.0, spread)
    return out if most is None else np.clip(out, -most, most)


def resampled(x: np.ndarray, points: int = POINTS) -> np.ndarray:
    """(windows, bars, ...) at so many evenly spaced points from the first bar to the last, between neighbours on a line (PAT-03)."""
    n = x.shape[1]
    if n == points:
        return x
    at = np.arange(points) * (n - 1) / max(points - 1, 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = _side_by_side(len(x), points, *x.shape[2:])
    for i, (j, part) in enumerate(zip(low, at - low)):
        out[:, i] = x[:, j] + (x[:, min(j + 1, n - 1)] - x[:, j]) * part
    return out


def matrices(bars: np.ndarray, points: int = POINTS, method: str = "zscore") -> np.ndarray:
    """(windows, bars, 5) -> (windows, points, 9), ready to be compared."""
    return resampled(normalised(features(bars), method), points)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along the points, ties by their mean."""
    a, b = x[:, :, None], x[:, None, :]
    return (a > b).sum(axis=2) + ((a == b).sum(axis=2) + 1) / 2


def group_similarity(metric: str, x: np.ndarray, q: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """How like each window's group of features (windows, points, k) is to the query's (points, k), from 0 to 1 (PAT-04 to PAT-07)."""
    points = q.shape[0]
    if metric in ("pearson", "spearman"):
        sums = np.zeros(len(x))
        for k in range(q.shape[1]):
            a, b = x[:, :, k], q[None, :, k]
            flat = (a.max(axis=1) == a.min(axis=1)) | (b.max() == b.min())
            if metric == "spearman":
                a, b = _ranks(a), _ranks(b)
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean()
            norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum())
            sums += np.where(flat | (norm == 0), 0.0, np.clip((a * b).sum(axis=1) / np.where(norm == 0, 1.0, norm), -1, 1))
        return (sums / q.shape[1] + 1) / 2
    if metric == "cosine":
        norm = np.sqrt((x * x).sum(axis=(1, 2)) * (q * q).sum())
        return (np.where(norm == 0, 0.0, np.clip((x * q).sum(axis=(1, 2)) / np.where(norm == 0, 1.0, norm), -1, 1)) + 1) / 2
    if metric == "dtw":
        return np.exp(-alpha * warped(x, q[None], WARP))
    apart = np.abs(x - q)
    distance = {"euclidean": lambda: np.sqrt((apart * apart).sum(axis=(1, 2))) / points, "manhattan": lambda: apart.sum(axis=(1, 2)) / points, "chebyshev": lambda: apart.max(axis=(1, 2))}[metric]()
    return np.exp(-alpha * distance)


def total_similarity(metric: str, x: np.ndarray, q: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each group, and of all by the groups' weights (PAT-08)."""
    parts = {g: group_similarity(metric, x[:, :, at], q[:, at]) for g, at in PLACES.items()}
    return parts, sum(WEIGHTS[g] * part for g, part in parts.items())


def _envelope(a: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each feature within the band of each point: (windows, points, k)."""
    sides = ((0, 0), (band, band), (0, 0))
    view = lambda fill: np.lib.stride_tricks.sliding_window_view(np.pad(a, sides, constant_values=fill), 2 * band + 1, axis=1)
    return view(np.inf).min(axis=3), view(-np.inf).max(axis=3)


def _least_mean(nearest: np.ndarray, band: int) -> np.ndarray:
    """The least mean of a path over points that far from what they may be aligned with.

    The path visits all points, some of them again: up to twice the band each, and with no more steps than a path along the sides. Its mean is least if the nearest points are those visited again.
    """
    points = nearest.shape[1]
    nearest = np.sort(nearest, axis=1)
    sums, steps, left = nearest.sum(axis=1), points, points - 1
    least = sums / steps
    for k in range(points):
        again = min(2 * band, left)
        if again == 0:
            break
        sums, steps, left = sums + nearest[:, k] * again, steps + again, left - again
        least = np.minimum(least, sums / steps)
    return least


def envelope_bound(x: np.ndarray, q: np.ndarray, band: int) -> np.ndarray:
    """A lower bound of a group's time-warping distance for each step of the path (Keogh's): each point of a window is at least as far from any point it may be aligned with as
    from the query's envelope within the band, and each point of the query from the window's envelope."""
    best = np.zeros(len(x))
    for a, b in ((x, q[None]), (q[None], x)):
        low, high = _envelope(b, band)
        out = np.maximum(a - high, 0) + np.maximum(low - a, 0)
        best = np.maximum(best, _least_mean(np.sqrt((out * out).sum(axis=2)), band))
    return best


def nearest_bound(x: np.ndarray, q: np.ndarray, band: int) -> np.ndarray:
    """The same from the distance to the nearest point within the band: closer, and dearer by a distance for each cell of the band."""
    points = q.shape[0]
    rows, columns = np.full((len(x), points), np.inf), np.full((len(x), points), np.inf)
    for off in range(-band, band + 1):
        i = np.arange(max(0, -off), min(points, points - off))
        apart = np.sqrt(((x[:, i] - q[i + off]) ** 2).sum(axis=2))
        rows[:, i] = np.minimum(rows[:, i], apart)
        columns[:, i + off] = np.minimum(columns[:, i + off], apart)
    return np.maximum(_least_mean(rows, band), _least_mean(columns, band))


def warp_ceiling(x: np.ndarray, q: np.ndarray, bound=envelope_bound, warp: float = WARP) -> np.ndarray:
    """What a window's similarity by time warping can't exceed, by a bound of each group's distance."""
    band = max(1, ceil(warp * q.shape[0]))
    return sum(WEIGHTS[g] * np.exp(-bound(x[:, :, at], q[:, at], band)) for g, at in PLACES.items())


def best_by_warping(x: np.ndarray, q: np.ndarray, most: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, -1 where it wasn't taken; whether it was): exact for all windows that can be among the best most and reach least.

    Windows are taken in the order of their ceilings by envelopes, some at a time, until the next ceiling is below the last of the best found; of these, those whose ceiling by nearest points is not. A search doesn't use it: over
    many windows the ceilings cost more than the warping itself.
    """
    ceiling = warp_ceiling(x, q)
    order = np.argsort(-ceiling, kind="stable")
    found, taken = np.full(len(x), -1.0), np.zeros(len(x), bool)
    at, size = 0, most
    while at < len(x):
        part = order[at : at + size]
        at, size = at + size, CHUNK
        bar = max(least, np.partition(found, -most)[-most] if len(found) >= most else -1.0) - 2e-6  # similarities are compared by six digits
        part = part[ceiling[part] >= bar]
        if not len(part):
            break
        part = part[warp_ceiling(x[part], q, nearest_bound) >= bar]
        if len(part):
            found[part], taken[part] = total_similarity("dtw", x[part], q)[1], True
    return found, taken


def reaching_by_warping(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, -1 where it wasn't taken; whether it was): exact for all windows that can reach least. A window is dropped as soon as its groups so far, and all that is left of the weights, are below that."""
    live, total, left = np.arange(len(x)), np.zeros(len(x)), sum(WEIGHTS.values())
    for g, at in PLACES.items():
        own = np.moveaxis(np.moveaxis(x, 0, -1)[:, at, live], -1, 0)
        total = total + WEIGHTS[g] * group_similarity("dtw", own, q[:, at])
        left -= WEIGHTS[g]
        may = total + left >= least - 2e-6  # similarities are compared by six digits
        live, total = live[may], total[may]
        if not len(live):
            break
    found, taken = np.full(len(x), -1.0), np.zeros(len(x), bool)
    found[live], taken[live] = total, True
    return found, taken


def _table(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    group = group.sort_by("date")
    return group, np.column_stack([group[c].to_numpy() for c in COLUMNS])


def _runs(codes: pa.ChunkedArray) -> np.ndarray:
    """Where each run of one code ends."""
    return pc.run_end_encode(codes.combine_chunks()).run_ends.to_numpy()


def _whole_symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by code, in tables that cut no code's rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        ends = _runs(rows["code"])
        cut = int(ends[-2]) if len(ends) > 1 else 0
        if cut or (held and held[0]["code"][0].as_py() != rows["code"][0].as_py()):
            yield pa.concat_tables([*held, rows.slice(0, cut)]).combine_chunks()
            held = []
        held.append(rows.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _scan(batches: Iterable[pa.RecordBatch], q: np.ndarray, n: int, step: int, metric: str, points: int, method: str, most: int, top: int | None) -> Iterator[pa.RecordBatch]:
    """Bars sorted by code and date -> each symbol's best windows, with how many windows it has and how many were compared in full. With top, windows that can't be among so many best of all need not be."""
    best_so_far = np.empty(0)
    for rows in _whole_symbols(batches):
        ends = _runs(rows["code"])
        firsts = np.concatenate([[0], ends[:-1]])
        many = np.maximum((ends - firsts - n) // step + 1, 0)
        symbol = np.repeat(np.arange(len(ends)), many)
        windows = len(symbol)
        if not windows:
            continue
        starts = firsts[symbol] + (np.arange(windows) - np.repeat(np.cumsum(many) - many, many)) * step
        bars = np.stack([rows[c].to_numpy() for c in COLUMNS])
        least = best_so_far[0] if top is not None and len(best_so_far) == top else -1.0
        whole, taken, parts = np.empty(windows), np.ones(windows, bool), {g: np.full(windows, np.nan) for g in GROUPS}
        size = max(CELLS // (len(FEATURES) * max(n, points)), 1)
        for a in range(0, windows, size):
            at = slice(a, a + size)
            own = _side_by_side(len(starts[at]), n, len(COLUMNS))
            for i in range(n):
                own[:, i] = bars[:, starts[at] + i].T
            x = matrices(own, points, method)
            if metric == "dtw":
                whole[at], taken[at] = reaching_by_warping(x, q, least)
            else:
                found, whole[at] = total_similarity(metric, x, q)
                for g in GROUPS:
                    parts[g][at] = found[g]
        shown = np.rint(whole * 1e6) / 1e6
        best = np.lexsort((starts, -shown, symbol))
        place = np.arange(windows) - np.repeat(np.cumsum(many) - many, many)
        best = best[(place < most) & taken[best]]
        if top is not None:
            best_so_far = np.sort(np.concatenate([best_so_far, shown[best]]))[-top:]
        columns = {"code": rows["code"].take(pa.array(starts[best])), "start": rows["date"].take(pa.array(starts[best])), "end": rows["date"].take(pa.array(starts[best] + n - 1))}
        for g in GROUPS:
            columns[f"{g}_similarity"] = pa.array(np.rint(parts[g][best] * 1e6) / 1e6, from_pandas=True)
        compared = np.bincount(symbol[taken], minlength=len(ends))
        columns |= {"similarity": pa.array(shown[best]), "windows": pa.array(many[symbol[best]].astype(np.int64)), "compared": pa.array(compared[symbol[best]].astype(np.int64))}
        yield from pa.table(columns).to_batches()


def query_bars(query: Sequence) -> np.ndarray:
    """A query's bars in their order (dicts or rows of a bar's columns, or closes alone) as (1, bars, 5); those without a close are left out."""
    out = []
    for b in query:
        b = {"close": b} if isinstance(b, (int, float)) else b.asDict() if hasattr(b, "asDict") else b
        close = b.get("close")
        if close is not None:
            out.append([float(close if b.get(c) is None else b[c]) for c in COLUMNS[:4]] + [float(b.get("volume") or 0)])
    if len(out) < MIN_BARS:
        raise ValueError(f"a query needs {MIN_BARS} bars, not {len(out)}")
    return np.array([out])


def scanned(
    bars: DataFrame, query: Sequence, metric: str = "euclidean", per_symbol: int = PER_SYMBOL, lookback: int = LOOKBACK, step: int | None = None, points: int = POINTS, method: str = "zscore", top: int | None = None
) -> DataFrame:
    """The best windows of each symbol: code, start, end, the groups' and the whole similarity (six digits), windows and compared.

    Windows of the query's length start at every step-th of a symbol's last bars, from the first of these on; symbols with fewer bars have none. Ties go by start.
    With top, what can't be among so many best of all symbols may be left out: a task compares windows by time warping only as far as they may reach the last of the best that it has found.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; there are {', '.join(METRICS)}")
    asked = query_bars(query)
    n = asked.shape[1]
    q = matrices(asked, points, method)[0]
    step = max(n // 15, 1) if step is None else max(step, 1)
    # an explicit number of parts, as the few bytes of a symbol's bars say nothing of the work on them
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = last_n(filled(bars).repartition(parts, "code"), lookback).sortWithinPartitions("code", F.asc_nulls_last("date"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"code {kind['code']}, start {kind['date']}, end {kind['date']}, " + ", ".join(f"{g}_similarity double" for g in GROUPS) + ", similarity double, windows long, compared long"
    return rows.mapInArrow(lambda batches: _scan(batches, q, n, step, metric, points, method, per_symbol, top), schema)


def search(
    bars: DataFrame,
    query: Sequence,
    metric: str = "euclidean",
    per_symbol: int = PER_SYMBOL,
    top: int = TOP,
    lookback: int = LOOKBACK,
    step: int | None = None,
    points: int = POINTS,
    method: str = "zscore",
    codes: Sequence | None = None,
    exclude: Sequence | None = None,
) -> DataFrame:
    """The windows of bars most like a query of at least 20 bars: rank, code, start, end, the similarity of each group (null by time warping) and in all, by their weights (PAT-09).

    Ties go by code, then by start.
    """
    if top <= 0:
        raise ValueError("top must be positive")
    if codes is not None:
        bars = bars.where(F.col("code").isin(*codes))
    if exclude:
        bars = bars.where(~F.col("code").isin(*exclude))
    rows = scanned(bars, query, metric, per_symbol, lookback, step, points, method, top).drop("windows", "compared")
    return few_numbered(rows, [By("similarity", descending=True), By("code"), By("start")], top).select("rank", "code", "start", "end", *[f"{g}_similarity" for g in GROUPS], "similarity")


def window_features(bars: DataFrame, n: int) -> DataFrame:
    """Raw features of each symbol's last window of n bars, a row for each bar: code, date, and the nine (PAT-01, WIN-27)."""
    place, many = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))), F.count(F.lit(1)).over(Window.partitionBy("code"))
    rows = filled(bars).withColumns({"_p": place, "_n": many}).where((F.col("_p") <= n) & (F.col("_n") >= n)).drop("_p", "_n")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def described(group: pa.Table) -> pa.Table:
        group, own = _table(group)
        found = features(own[None])[0]
        return pa.table({"code": group["code"], "date": group["date"]} | {f: found[:, i] for i, f in enumerate(FEATURES)})

    return rows.groupBy("code").applyInArrow(described, f"code {kind['code']}, date {kind['date']}, " + ", ".join(f"{f} double" for f in FEATURES))
