"""DuckDB SQL for the searches of feature windows."""

from __future__ import annotations

from .catalog_more import QUERY_BARS
from .operators.pattern_search import CLIP, FEATURES, GROUPS, LOOKBACK, PER_SYMBOL, POINTS, TOP, WEIGHTS
from .oracle import BARS, SQL, n, r4
from .oracle_more import r6

N = len(QUERY_BARS)
STEP = max(N // 15, 1)
SLOPE = "CASE WHEN c4 IS NOT NULL THEN (2 * (close - c4) + (c1 - c3)) / 10 WHEN c3 IS NOT NULL THEN (3 * (close - c3) + (c1 - c2)) / 10 WHEN c2 IS NOT NULL THEN (close - c2) / 2 WHEN c1 IS NOT NULL THEN close - c1 ELSE 0 END"


def _features(rows: str, by: str, order: str) -> str:
    """CTEs: feat has the rows' nine features against the first bar of each group."""
    w = f"PARTITION BY {by} ORDER BY {order}"
    return f"""f0 AS (SELECT *, first_value(close) OVER w AS base, coalesce(close / lag(close) OVER w - 1, 0) AS chg, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3, lag(close, 4) OVER w AS c4 FROM {rows} WINDOW w AS ({w})),
feat AS (SELECT *, close / base - 1 AS close_return, (close - open) / base AS body, (high - greatest(open, close)) / base AS upper_shadow, (least(open, close) - low) / base AS lower_shadow, (high - low) / base AS amplitude,
  ln(1 + greatest(volume, 0)) AS log_volume, avg(chg) OVER g AS pct_change_mean, stddev_pop(chg) OVER g AS pct_change_std, {SLOPE} AS trend_slope FROM f0 WINDOW g AS ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _group(k: str) -> str:
    ends, at = [], 0
    for g, names in GROUPS.items():
        at += len(names)
        ends.append((at, g))
    return "CASE " + " ".join(f"WHEN {k} <= {e} THEN '{g}'" for e, g in ends) + " END"


# of each window and group, from points a and b: by feature first, where a metric is a mean over features
POINTWISE = {
    "euclidean": f"exp(-sqrt(sum((a - b) * (a - b))) / {POINTS})",
    "manhattan": f"exp(-sum(abs(a - b)) / {POINTS})",
    "chebyshev": "exp(-max(abs(a - b)))",
    "cosine": "(CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN greatest(least(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 1), -1) ELSE 0 END + 1) / 2",
}
CORR = "CASE WHEN max(a) = min(a) OR max(b) = min(b) THEN 0 ELSE greatest(least(corr(a, b), 1), -1) END"
RANKED = "rank() OVER (PARTITION BY code, s, k ORDER BY {0}) + (count(*) OVER (PARTITION BY code, s, k, {0}) - 1) / 2.0::DOUBLE"


def _search(metric: str) -> str:
    asked = ", ".join(f"({i}, " + ", ".join(f"{float(b[c])}::DOUBLE" for c in ("open", "high", "low", "close", "volume")) + ")" for i, b in enumerate(QUERY_BARS))
    points = ", ".join(f"({j}, {(low := min(int(at := (N - 1) * j / (POINTS - 1)), N - 2))}, {at - low!r}::DOUBLE)" for j in range(POINTS))
    if metric in POINTWISE:
        groups = f"SELECT code, s, {_group('k')} AS grp, {POINTWISE[metric]} AS sim FROM met GROUP BY 1, 2, 3"
    else:
        met = "met" if metric == "pearson" else f"(SELECT code, s, k, {RANKED.format('a')} AS a, {RANKED.format('b')} AS b FROM met)"
        groups = f"SELECT code, s, {_group('k')} AS grp, (avg(c) + 1) / 2 AS sim FROM (SELECT code, s, k, {CORR} AS c FROM {met} GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"
    part = lambda g: f"max(CASE WHEN grp = '{g}' THEN sim END)"
    whole = " + ".join(f"{n(w)} * {part(g)}" for g, w in WEIGHTS.items())
    return f"""WITH {BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars QUALIFY back <= {LOOKBACK}),
y AS (SELECT code, date, open, high, low, close, volume, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY code) AS cnt FROM x),
wins AS (SELECT h.code, h.rn AS s, y.rn - h.rn AS i, y.open, y.high, y.low, y.close, y.volume FROM y h JOIN y ON y.code = h.code AND y.rn BETWEEN h.rn AND h.rn + {N - 1} WHERE h.rn % {STEP} = 0 AND h.rn + {N} <= h.cnt
  UNION ALL SELECT -1, 0, * FROM (VALUES {asked}) q(i, open, high, low, close, volume)),
{_features('wins', 'code, s', 'i')},
long AS (SELECT code, s, i, unnest(range(1, {len(FEATURES) + 1})) AS k, unnest([{', '.join(FEATURES)}]) AS v FROM feat),
st AS (SELECT code, s, k, CASE WHEN max(v) = min(v) THEN max(v) ELSE avg(v) END AS m, CASE WHEN max(v) = min(v) THEN 0 ELSE stddev_pop(v) END AS sd FROM long GROUP BY 1, 2, 3),
z AS (SELECT code, s, k, i, greatest(least((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, {n(CLIP)}), -{n(CLIP)}) AS z FROM long JOIN st USING (code, s, k)),
z1 AS (SELECT *, lead(z) OVER (PARTITION BY code, s, k ORDER BY i) AS nxt FROM z),
r AS (SELECT code, s, k, j, z + (nxt - z) * fr AS p FROM z1 JOIN (VALUES {points}) t(j, lo, fr) ON i = lo),
met AS (SELECT r.code, r.s, r.k, r.p AS a, q.p AS b FROM r JOIN r q ON q.code = -1 AND q.k = r.k AND q.j = r.j WHERE r.code <> -1),
g AS ({groups}),
t AS (SELECT code, s, {', '.join(f"{r6(part(p))} AS {p}_similarity" for p in GROUPS)}, {r6(whole)} AS similarity FROM g GROUP BY 1, 2),
own AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY code ORDER BY similarity DESC, s) <= {PER_SYMBOL}),
dated AS (SELECT own.*, a.date AS start, b.date AS "end" FROM own JOIN y a ON a.code = own.code AND a.rn = s JOIN y b ON b.code = own.code AND b.rn = s + {N - 1})
SELECT row_number() OVER (ORDER BY similarity DESC, code, start) AS rank, code, start::VARCHAR AS start, "end"::VARCHAR AS "end", {', '.join(f'{p}_similarity' for p in GROUPS)}, similarity FROM dated QUALIFY rank <= {TOP}"""


SQL.update(
    {
        "pattern_search_topk": _search("euclidean"),
        **{f"pattern_search_{m}": _search(m) for m in ("manhattan", "chebyshev", "pearson", "spearman", "cosine")},
        "pattern_window_features": f"""WITH {BARS}, last30 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY code) AS cnt FROM bars QUALIFY back <= 30 AND cnt >= 30), {_features('last30', 'code', 'date')}
SELECT code, date::VARCHAR AS date, {', '.join(f'{r4(f)} AS {f}' for f in FEATURES)} FROM feat""",
    }
)
