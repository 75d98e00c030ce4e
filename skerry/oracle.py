"""DuckDB SQL for the registered queries; common parts are put together from named pieces."""

from __future__ import annotations

BARS = """bars AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2)"""
FACTORS = "factors AS (SELECT code, date, 1 + 0.1::DOUBLE * (year(date) - 1992) AS adj_factor FROM bars WHERE day(date) <= 20)"
MEMBERS = """members AS (SELECT s_suppkey AS code, n_name AS industry, concat_ws(',', r_name, 'group ' || left(n_name, 1)) AS concepts FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
W = "PARTITION BY code ORDER BY date"


def frame(n: int, back: int = 0) -> str:
    return f"({W} ROWS BETWEEN {n - 1 + back} PRECEDING AND " + (f"{back} PRECEDING)" if back else "CURRENT ROW)")


def r4(x: str) -> str:
    return f"(round_even(({x}) * 10000, 0) / 10000)"


def full(f: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {f}({c}) OVER {frame(n)} END"


QUOTES = f"""quotes AS (SELECT *, CASE WHEN prev <> 0 THEN (close - prev) / prev * 100 END AS change_pct, CASE WHEN base <> 0 THEN volume / base END AS volume_ratio
  FROM (SELECT *, lag(close) OVER ({W}) AS prev, avg(volume) OVER {frame(20, 1)} AS base, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1)"""
SNAP = f"""{BARS}, {MEMBERS}, {QUOTES}, snap AS (
  SELECT q.code, s_name AS name, close AS price, change_pct, amount, amount * 100 AS total_mv, s_acctbal / 100 AS pe_ratio, abs(s_acctbal) / 1000 AS pb_ratio, volume_ratio, volume / 20 AS turnover_rate, industry, concepts, date
  FROM quotes q LEFT JOIN supplier ON s_suppkey = q.code LEFT JOIN members m ON m.code = q.code)"""
FLOW = """flows AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, """ + ", ".join(
    f"sum(CASE WHEN tier = '{t}' AND side = '{s}' THEN x ELSE 0 END) AS {s}_{t}_amount" for s in ("buy", "sell") for t in ("sm", "md", "lg", "elg")
) + """ FROM (SELECT *, CASE WHEN l_quantity <= 10 THEN 'sm' WHEN l_quantity <= 20 THEN 'md' WHEN l_quantity <= 35 THEN 'lg' ELSE 'elg' END AS tier, CASE WHEN l_linestatus = 'F' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice / 1e4 AS x FROM lineitem) GROUP BY 1, 2),
flow AS (SELECT *, buy_lg_amount - sell_lg_amount + (buy_elg_amount - sell_elg_amount) AS main_net_inflow, buy_sm_amount - sell_sm_amount + (buy_md_amount - sell_md_amount) AS retail_net_inflow FROM flows)"""
STREAK = f"""streaks AS (SELECT *, sum(1 - stop) OVER (PARTITION BY code, island ORDER BY date) AS main_inflow_streak FROM (
  SELECT *, sum(stop) OVER ({W}) AS island FROM (SELECT *, CASE WHEN main_net_inflow > 0 THEN 0 ELSE 1 END AS stop FROM flow)))"""
TIERS = "((buy_sm_amount + buy_md_amount + buy_lg_amount + buy_elg_amount + sell_sm_amount + sell_md_amount + sell_lg_amount + sell_elg_amount) / 2)"
DIVERGE = f"""diverge AS (SELECT f.*, CAST(sum(CAST(main_net_inflow AS DECIMAL(28, 6))) OVER (PARTITION BY f.code ORDER BY f.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS main_net_inflow_5d,
  coalesce(CASE WHEN traded > 0 THEN traded END, CASE WHEN {TIERS} > 0 THEN {TIERS} END) AS turnover_amount, close_pct,
  coalesce(close_pct > 0 AND main_net_inflow < 0, false) AS price_up_flow_out, coalesce(close_pct < 0 AND main_net_inflow > 0, false) AS price_down_flow_in
  FROM streaks f LEFT JOIN (SELECT code, date, close / lag(close) OVER ({W}) - 1 AS close_pct, close * volume / 10000 AS traded FROM bars) b USING (code, date))"""


def ewm(series: str, alpha: str) -> str:
    """The last value of an exponential average; with init, so that one element is fine."""
    return f"list_reduce({series}, lambda a, x: a * (1 - {alpha}) + x * {alpha})"


def ewms(series: str, alpha: str) -> str:
    """All values of an exponential average."""
    return f"list_transform(range(1, len({series}) + 1), lambda i: list_reduce({series}[1:i], lambda a, x: a * (1 - {alpha}) + x * {alpha}))"


INPUTS = f"""inputs AS (SELECT *, (close - min(low) OVER {frame(9)}) / CASE WHEN max(high) OVER {frame(9)} - min(low) OVER {frame(9)} = 0 THEN 1 ELSE max(high) OVER {frame(9)} - min(low) OVER {frame(9)} END * 100 AS rsv,
  max(high) OVER {frame(4)} AS h4, min(low) OVER {frame(4)} AS l4 FROM bars),
series AS (SELECT code, count(*) AS n, list(close ORDER BY date) AS closes, list(rsv ORDER BY date) AS rsvs, list((h4 - close) / CASE WHEN h4 - l4 = 0 THEN 1 ELSE h4 - l4 END * 100 - 90 ORDER BY date) AS v1, list((close - l4) / CASE WHEN h4 - l4 = 0 THEN 1 ELSE h4 - l4 END * 100 ORDER BY date) AS v3 FROM inputs GROUP BY code)"""
A12, A26, A9, A10 = "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 27)", "(2.0::DOUBLE / 10)", "(2.0::DOUBLE / 11)"
MACD = f"""macd0 AS (SELECT code, n, closes, {ewms('closes', A12)} AS e12, {ewms('closes', A26)} AS e26 FROM series),
macd1 AS (SELECT code, n, list_transform(range(1, n + 1), lambda i: e12[i] - e26[i]) AS diffs FROM macd0),
macd2 AS (SELECT code, n, diffs[n] AS diff, {ewm('diffs', A9)} AS dea FROM macd1),
macd AS (SELECT *, CASE WHEN n < 35 THEN 'neutral' WHEN diff > dea AND diff > 0 THEN 'bullish' WHEN diff < dea AND diff < 0 THEN 'bearish' ELSE 'neutral' END AS macd_status FROM macd2)"""
THIRD, SIXTH, QUARTER = "(1.0::DOUBLE / 3)", "(1.0::DOUBLE / 6)", "(1.0::DOUBLE / 4)"
KDJ = f"""kdj0 AS (SELECT code, n, {ewms('rsvs', THIRD)} AS ks FROM series),
kdj1 AS (SELECT code, n, ks[n] AS k, ks[n - 1] AS pk, {ewm('ks', THIRD)} AS d, CASE WHEN n > 1 THEN {ewm('ks[1:n - 1]', THIRD)} END AS pd FROM kdj0),
kdj AS (SELECT code, {r4('k')} AS kdj_k, {r4('d')} AS kdj_d, {r4('3 * k - 2 * d')} AS kdj_j, {r4('3 * pk - 2 * pd')} AS prev_kdj_j, {r4('pk')} AS pk, {r4('pd')} AS pd FROM kdj1)"""
LONG = "(" + " + ".join(full("avg", "close", n) for n in (14, 28, 57, 114)) + ") / 4"
MA = f"""ma AS (SELECT *, coalesce(ma5 >= ma20 AND ma20 >= ma60, false) AS ma_bullish, coalesce(close >= ma20, false) AS price_above_ma20 FROM (
  SELECT *, {", ".join(f"{r4(full('avg', 'close', n))} AS ma{n}" for n in (5, 20, 60))} FROM bars))"""
CHANGE60 = f"""c60 AS (SELECT *, CASE WHEN base60 > 0 THEN {r4('(close / base60 - 1) * 100')} END AS change_60d FROM (SELECT *, coalesce(lag(close, 60) OVER ({W}), first_value(close) OVER ({W})) AS base60 FROM bars))"""
RSI = f"""rsi AS (SELECT *, CASE WHEN v <= 35 THEN 'oversold' WHEN v >= 70 THEN 'overbought' ELSE 'neutral' END AS rsi_status FROM (SELECT *, CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS v FROM (
  SELECT *, {full('avg', 'g', 14)} AS gain, {full('avg', 'l', 14)} AS loss FROM (SELECT *, CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END AS g, CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END AS l FROM (SELECT *, close - lag(close) OVER ({W}) AS dd FROM bars)))))"""
SIGNAL = f"""sig0 AS (SELECT m.code, c.change_60d, ma_bullish, price_above_ma20, macd_status, rsi_status FROM ma m JOIN c60 c USING (code, date) JOIN rsi r USING (code, date) JOIN macd USING (code) QUALIFY row_number() OVER (PARTITION BY m.code ORDER BY m.date DESC) = 1),
sig AS (SELECT *, {r4('''greatest(0, least(100, 50 + CASE WHEN ma_bullish THEN 14 ELSE 0 END + CASE WHEN price_above_ma20 THEN 10 ELSE 0 END + CASE macd_status WHEN 'bullish' THEN 12 WHEN 'bearish' THEN -12 ELSE 0 END
  + CASE WHEN change_60d BETWEEN 0 AND 35 THEN least(change_60d * 0.35::DOUBLE, 12) WHEN change_60d > 60 THEN -least((change_60d - 60) * 0.2::DOUBLE, 12) WHEN change_60d < -25 THEN -least(abs(change_60d + 25) * 0.25::DOUBLE, 10) ELSE 0 END
  + CASE rsi_status WHEN 'oversold' THEN 4 WHEN 'overbought' THEN -6 ELSE 0 END))''')} AS signal_score FROM sig0)"""


def rank(x: str, lower: bool, missing: float) -> str:
    order = "DESC NULLS LAST" if lower else "ASC NULLS LAST"
    return f"(CASE WHEN ({x}) IS NULL THEN {missing}::DOUBLE ELSE (rank() OVER (ORDER BY ({x}) {order}) + (count(*) OVER (PARTITION BY ({x})) - 1) / 2.0::DOUBLE) / count({x}) OVER () * 100 END)"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def above(x: str, start: float) -> str:
    return f"greatest(({x}) - ({start}::DOUBLE), 0)"


def n(x: float) -> str:
    return f"{float(x)}::DOUBLE"


C, V, TR = "coalesce(change_pct, 0)", "coalesce(volume_ratio, 1)", "coalesce(turnover_rate, 0)"
PE, PB = "CASE WHEN pe_ratio > 0 AND pe_ratio < 500 THEN pe_ratio END", "CASE WHEN pb_ratio > 0 AND pb_ratio < 50 THEN pb_ratio END"
FACTOR = {
    "value": clip(f"(50 * {n(.35)} + {rank(PE, True, 25)} * {n(.65)}) * {n(.55)} + {rank(PB, True, 25)} * {n(.45)}", 0, 100),
    "liquidity": rank("CASE WHEN amount > 0 THEN log10(greatest(amount, 1)) END", False, 20),
    "size": rank("CASE WHEN total_mv > 0 THEN log10(greatest(total_mv, 1)) END", False, 35),
    "momentum": clip(f"50 * {n(.35)} + {clip(f'60 + {C} * 5 - {above(C, 5)} * 10 - {above(f'-{C}', 2)} * 3', 5, 100)} * {n(.65)}", 5, 100),
    "reversal": clip(f"100 - abs({C} + 3) * 13 - {above(f'-{C}', 8)} * 10 - {above(C, 1)} * 8", 5, 100),
    "activity": clip(f"(50 * {n(.45)} + {clip(f'100 - abs({V} - 2) * 15 - {above(V, 5)} * 8', 5, 100)} * {n(.55)}) * {n(.55)} + {clip(f'CASE WHEN {TR} > 0 THEN 100 - abs({TR} - 4) * 8 - {above(TR, 12)} * 5 ELSE 40 END', 5, 100)} * {n(.45)}", 0, 100),
    "stability": clip(f"78 - least(abs({C}), 10) * 3 - {above(C, 7)} * 5 - {above(TR, 10)} * 2 - {above(V, 5)} * 4 - CASE WHEN pe_ratio <= 0 THEN 18 ELSE 0 END", 0, 100),
}


def scored(source: str, weights: dict[str, float], factors: dict[str, str] | None = None, tag: str = "") -> str:
    """CTEs fac and ranked (with a tag): rounded factors, screen_score and rank."""
    factors = FACTOR | (factors or {})
    total = sum(weights.values())
    by = " + ".join(f"f_{k} * {n(v / total)}" for k, v in weights.items())
    order = ", ".join(f"factor_{k}_score DESC NULLS LAST" for k, _ in sorted(weights.items(), key=lambda x: (-x[1], x[0])))
    return f"""fac0{tag} AS (SELECT *, {", ".join(f"{x} AS f_{k}" for k, x in factors.items())} FROM {source}),
fac{tag} AS (SELECT *, {r4(clip(by, 0, 100))} AS screen_score, {", ".join(f"{r4('f_' + k)} AS factor_{k}_score" for k in factors)} FROM fac0{tag}),
ranked{tag} AS (SELECT *, row_number() OVER (ORDER BY screen_score DESC NULLS LAST, {order}, code ASC) AS rank FROM fac{tag})"""


DEFAULT = {"value": 0.25, "liquidity": 0.125, "stability": 0.125, "momentum": 0.275, "activity": 0.225}


def _waterfall() -> str:
    steps = [("exclude_st", "NOT coalesce(regexp_matches(name, 'ST|退'), false)"), ("amount_min", "amount >= 30000"), ("price_min", "price >= 1000"), ("price_max", "price <= 2600"), ("pe_ttm_min", "pe_ratio >= 0"), ("volume_ratio_min", "volume_ratio >= 0.5"), ("change_pct_max", "change_pct <= 30")]
    case = " ".join(f"WHEN NOT coalesce({c}, false) THEN {i + 1}" for i, (_, c) in enumerate(steps))
    names = ", ".join(f"({i + 1}, '{x}')" for i, (x, _) in enumerate(steps))
    return f"""WITH {SNAP}, marked AS (SELECT code, CASE {case} ELSE {len(steps) + 1} END AS step FROM snap),
counts AS (SELECT step, count(*) AS removed FROM marked GROUP BY step),
few AS (SELECT step, string_agg(code::VARCHAR, ',' ORDER BY code) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY code) AS rn FROM marked) WHERE rn <= 3 GROUP BY step),
rows AS (SELECT s.step, s.label, coalesce(removed, 0) AS removed, coalesce(samples, '') AS samples, (SELECT count(*) FROM snap) AS total FROM (VALUES {names}) s(step, label) LEFT JOIN counts USING (step) LEFT JOIN few USING (step)),
sums AS (SELECT *, total - coalesce(sum(removed) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows)
SELECT step::BIGINT AS step, label, before::BIGINT AS before, (before - removed)::BIGINT AS after, removed::BIGINT AS removed, CASE WHEN before > 0 THEN round_even(removed / before * 1000000, 0) / 10000 ELSE 0 END AS removed_pct, samples,
CASE WHEN before <= 0 OR removed <= 0 THEN '' WHEN before = removed THEN label || ' eliminated all remaining candidates; inspect threshold or data availability.' WHEN removed / before >= 0.9::DOUBLE THEN label || ' removed over 90% of remaining candidates; consider reviewing this threshold.' ELSE '' END AS suggestion FROM sums"""


def _adjusted(by: str) -> str:
    return f"""WITH {BARS}, {FACTORS}, latest AS (SELECT code, arg_max(adj_factor, date) AS latest FROM factors GROUP BY code),
filled AS (SELECT b.*, first_value(adj_factor IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM bars b LEFT JOIN factors USING (code, date))
SELECT code, date::VARCHAR AS date, {", ".join(f"{r4(f'{c} * ({by})')} AS {c}" for c in ("open", "high", "low", "close"))} FROM filled LEFT JOIN latest USING (code)"""


SQL: dict[str, str] = {
    "bars_from_trades": f"WITH {BARS} SELECT code, date::VARCHAR AS date, {', '.join(f'{r4(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'amount'))} FROM bars",
    "bars_adjusted_qfq": _adjusted("f / latest"),
    "bars_adjusted_hfq": _adjusted("f"),
    "bars_last_n_asof": f"WITH {BARS} SELECT code, date::VARCHAR AS date, {r4('close')} AS close, {r4('volume')} AS volume FROM bars WHERE date <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 5",
    "snapshot_latest": f"WITH {SNAP} SELECT code, name, date::VARCHAR AS date, {', '.join(f'{r4(c)} AS {c}' for c in ('price', 'change_pct', 'amount', 'total_mv', 'pe_ratio', 'pb_ratio', 'volume_ratio', 'turnover_rate'))}, industry, concepts FROM snap",
    "snapshot_three_way_join": f"SELECT s_suppkey, coalesce(n_name, split_part(s_name, '#', 1)) AS label, r_name, {r4('s_acctbal * 1000')} AS amount FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "filter_numeric_bounds": f"WITH {SNAP} SELECT code, {r4('price')} AS price, {r4('pe_ratio')} AS pe_ratio, {r4('change_pct')} AS change_pct FROM snap WHERE price BETWEEN 1000 AND 2500 AND pe_ratio BETWEEN 0 AND 60 AND change_pct BETWEEN -60 AND 60",
    "filter_regex_exclude": f"WITH {SNAP} SELECT code, CASE WHEN code % 11 = 0 THEN NULL ELSE name END AS name FROM snap WHERE code % 7 <> 0",
    "filter_bool_flavours": f"WITH {SNAP} SELECT code, 'true' AS flavour FROM snap WHERE code % 3 = 0 UNION ALL SELECT code, 'false' FROM snap WHERE code % 3 = 1 UNION ALL SELECT code, 'not true' FROM snap WHERE code % 3 <> 0",
    "filter_whitelist": f"WITH {BARS}, {INPUTS}, {MACD} SELECT code, macd_status FROM macd WHERE macd_status IN ('bullish', 'neutral')",
    "filter_waterfall": _waterfall(),
    "sma_5_20_60": f"WITH {BARS}, {MA} SELECT code, date::VARCHAR AS date, ma5, ma20, ma60, ma_bullish, price_above_ma20 FROM ma",
    "boll_20": f"WITH {BARS}, x AS (SELECT code, date, avg(close) OVER {frame(20)} AS m, coalesce(stddev_pop(close) OVER {frame(20)}, 0) AS s FROM bars) SELECT code, date::VARCHAR AS date, {r4('m')} AS boll_mid, {r4('m + 2 * s')} AS boll_upper, {r4('m - 2 * s')} AS boll_lower FROM x",
    "zg_long": f"WITH {BARS} SELECT code, date::VARCHAR AS date, {r4(LONG)} AS zg_long FROM bars",
    "atr_20": f"WITH {BARS}, x AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM (SELECT *, lag(close) OVER ({W}) AS prev FROM bars)) SELECT code, date::VARCHAR AS date, CASE WHEN close > 0 THEN {r4(f'avg(tr) OVER {frame(20)} / close * 100')} END AS atr_20_pct FROM x",
    "volatility_20": f"WITH {BARS}, x AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bars) SELECT code, date::VARCHAR AS date, {r4(f'CASE WHEN count(r) OVER {frame(19)} >= 2 THEN stddev_samp(r) OVER {frame(19)} * sqrt(252::DOUBLE) * 100 END')} AS volatility_20d_pct FROM x",
    "shape_20d": f"""WITH {BARS}, {MA}, x AS (SELECT *, max(high) OVER {frame(20)} AS h, min(low) OVER {frame(20)} AS l, max(high) OVER {frame(20, 1)} AS b, avg(volume) OVER {frame(20, 1)} AS v FROM ma)
SELECT code, date::VARCHAR AS date, {r4('b')} AS prev_high_20d, CASE WHEN l > 0 THEN {r4('(h / l - 1) * 100')} END AS range_20d_pct, CASE WHEN b > 0 THEN {r4('(close / b - 1) * 100')} END AS breakout_20d_pct, CASE WHEN v > 0 THEN {r4('volume / v')} END AS volume_ratio_20d, CASE WHEN open > 0 THEN {r4('(close / open - 1) * 100')} END AS body_pct, CASE WHEN ma20 > 0 THEN {r4('(close / ma20 - 1) * 100')} END AS pullback_to_ma20_pct FROM x""",
    "rsi_14": f"WITH {BARS}, {RSI} SELECT code, date::VARCHAR AS date, {r4('v')} AS rsi14, rsi_status FROM rsi",
    "change_60d": f"WITH {BARS}, {CHANGE60} SELECT code, date::VARCHAR AS date, change_60d FROM c60",
    "max_drawdown_20": f"""WITH {BARS}, x AS (SELECT code, date, list(close) OVER {frame(20)} AS c FROM bars)
SELECT code, date::VARCHAR AS date, {r4('least(0, list_min(list_transform(range(1, len(c) + 1), lambda i: c[i] / list_max(c[1:i]) - 1))) * 100')} AS max_drawdown_20d_pct FROM x""",
    "consolidation_days_20": f"""WITH {BARS}, x AS (SELECT code, date, row_number() OVER ({W}) - 1 AS n, list(high) OVER {frame(20, 1)} AS h, list(low) OVER {frame(20, 1)} AS l FROM bars)
SELECT code, date::VARCHAR AS date, CASE WHEN n > 0 THEN coalesce(list_max(list_filter(range(2, 21), lambda d: d <= n AND (list_max(h[-d:]) / list_min(l[-d:]) - 1) * 100 <= 80)), 0)::BIGINT END AS consolidation_days_20d FROM x""",
    "ema_12_26_macd": f"WITH {BARS}, {INPUTS}, {MACD} SELECT code, n::BIGINT AS bars, macd_status, {r4('diff')} AS macd_diff, {r4('dea')} AS macd_dea FROM macd",
    "kdj_9_3_3": f"WITH {BARS}, {INPUTS}, {KDJ} SELECT code, kdj_k, kdj_d, kdj_j, prev_kdj_j, coalesce(pk <= pd AND kdj_k > kdj_d, false) AS kdj_golden_cross FROM kdj",
    "zg_short": f"""WITH {BARS}, {INPUTS}, z0 AS (SELECT code, n, {ewms('closes', A10)} AS z FROM series), z1 AS (SELECT code, n, {r4(ewm('z', A10))} AS zg_short FROM z0),
lg AS (SELECT code, {r4(LONG)} AS zg_long, {r4('close')} AS c FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, zg_short, zg_long, coalesce(zg_short > zg_long, false) AS zg_short_above_long, coalesce(c > zg_long, false) AS close_above_zg_long, CASE WHEN n < 114 OR zg_long IS NULL THEN 'zg_insufficient_bars' ELSE '' END AS indicator_quality_flags FROM z1 JOIN lg USING (code)""",
    "brick_turn_up": f"""WITH {BARS}, {INPUTS}, b0 AS (SELECT code, n, closes, {ewms('v1', QUARTER)} AS a, {ewms('v3', SIXTH)} AS b4 FROM series), b1 AS (SELECT *, {ewms('b4', SIXTH)} AS b5 FROM b0),
b2 AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN b5[i] - a[i] > 4 THEN b5[i] - a[i] - 4 ELSE 0 END) AS bricks FROM b1), b3 AS (SELECT code, closes[n] AS c0, closes[n - 1] AS c1, bricks[n] AS x, bricks[n - 1] AS y, bricks[n - 2] AS z FROM b2),
z0 AS (SELECT code, {ewms('closes', A10)} AS z FROM series), z1 AS (SELECT code, {ewm('z', A10)} AS zs FROM z0), lg AS (SELECT code, {LONG} AS zl FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, {r4('x')} AS brick, coalesce(y < z, false) AND coalesce(x > y, false) AND coalesce(x - y >= z - y, false) AND coalesce(zs > zl, false) AND coalesce((c0 - c1) / c1 * 100 <= 5, false) AS brick_turn_up FROM b3 JOIN z1 USING (code) JOIN lg USING (code)""",
    "indicator_last_bar": f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(volume) OVER ({W}) AS pv, {r4(f'avg(close) OVER {frame(20)} - 2 * coalesce(stddev_pop(close) OVER {frame(20)}, 0)')} AS lo, {r4(f'avg(close) OVER {frame(20)} + 2 * coalesce(stddev_pop(close) OVER {frame(20)}, 0)')} AS hi FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)
SELECT code, {r4('(close - pc) / pc * 100')} AS daily_change_pct, {r4(f'({r4("high")} - {r4("low")}) / {r4("pc")} * 100')} AS daily_amplitude_pct, coalesce(volume > pv, false) AS volume_above_prev, coalesce({r4('close')} < lo, false) AS close_below_boll_lower, coalesce({r4('close')} > hi, false) AS close_above_boll_upper FROM x""",
    "daily_quality": f"WITH {BARS} SELECT code, count(*) AS daily_data_points, 100.0::DOUBLE - CASE WHEN count(*) < 30 THEN 35 WHEN count(*) < 60 THEN 15 ELSE 0 END AS daily_quality_score, CASE WHEN count(*) < 30 THEN 'short_history_lt30' WHEN count(*) < 60 THEN 'short_history_lt60' ELSE '' END AS daily_quality_flags FROM bars GROUP BY code",
    "signal_score": f"WITH {BARS}, {INPUTS}, {MACD}, {MA}, {CHANGE60}, {RSI}, {SIGNAL} SELECT * FROM sig",
    "flow_derive": f"WITH {FLOW} SELECT code, date::VARCHAR AS date, {r4('main_net_inflow')} AS main_net_inflow, {r4('retail_net_inflow')} AS retail_net_inflow FROM flow",
    "flow_rolling": f"WITH {FLOW} SELECT code, date::VARCHAR AS date, {', '.join(f'{r4(f"CAST(sum(CAST(main_net_inflow AS DECIMAL(28, 6))) OVER {frame(k)} AS DOUBLE)")} AS main_net_inflow_{k}d' for k in (5, 10, 20))} FROM flow",
    "flow_streak": f"WITH {FLOW}, {STREAK} SELECT code, date::VARCHAR AS date, main_inflow_streak::BIGINT AS main_inflow_streak FROM streaks",
    "flow_zscore": f"WITH {FLOW}, x AS (SELECT *, {full('avg', 'main_net_inflow', 20)} AS m, {full('stddev_samp', 'main_net_inflow', 20)} AS s FROM flow) SELECT code, date::VARCHAR AS date, {r4('CASE WHEN s > 0 THEN (main_net_inflow - m) / s END')} AS main_net_inflow_zscore_20d FROM x",
    "flow_divergence": f"WITH {BARS}, {FLOW}, {STREAK}, {DIVERGE} SELECT code, date::VARCHAR AS date, {r4('turnover_amount')} AS turnover_amount, CASE WHEN turnover_amount > 0 THEN {r4('main_net_inflow / turnover_amount')} END AS main_net_inflow_rate, price_up_flow_out, price_down_flow_in FROM diverge",
    "flow_conditions": f"WITH {BARS}, {FLOW}, {STREAK}, {DIVERGE} SELECT code, date::VARCHAR AS date, main_inflow_streak::BIGINT AS main_inflow_streak, {r4('main_net_inflow_5d')} AS main_net_inflow_5d FROM diverge WHERE main_inflow_streak >= 2 AND main_net_inflow_5d > 0 AND NOT price_up_flow_out AND main_net_inflow / turnover_amount >= 0.1",
    **{f"factor_{k}": f"WITH {SNAP}, {scored('snap', DEFAULT)} SELECT code, factor_{k}_score FROM fac" for k in FACTOR},
    "screen_snapshot_only": f"WITH {SNAP}, pool AS (SELECT * FROM snap WHERE price >= 500 AND pe_ratio >= 0), {scored('pool', {'value': 0.34, 'stability': 0.2, 'liquidity': 0.14, 'momentum': 0.1, 'activity': 0.1, 'reversal': 0.06, 'size': 0.06})} SELECT rank, code, screen_score FROM ranked WHERE rank <= 20",
    "risk_overlay": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, p AS (SELECT *, (CASE WHEN change_pct >= 8 THEN 4 WHEN change_pct <= -7 THEN 3.5::DOUBLE ELSE 0 END + CASE WHEN volume_ratio >= 6 THEN 3 ELSE 0 END + CASE WHEN turnover_rate >= 15 THEN 3 ELSE 0 END + CASE WHEN pe_ratio <= 0 THEN 3 ELSE 0 END + CASE WHEN pb_ratio >= 8 THEN 2 ELSE 0 END)::DOUBLE AS risk_points,
concat_ws(';', CASE WHEN change_pct >= 8 THEN 'single_day_chase_risk' END, CASE WHEN change_pct <= -7 THEN 'single_day_breakdown_risk' END, CASE WHEN volume_ratio >= 6 THEN 'abnormal_volume_ratio' END, CASE WHEN turnover_rate >= 15 THEN 'high_turnover' END, CASE WHEN pe_ratio <= 0 THEN 'negative_or_invalid_pe' END, CASE WHEN pb_ratio >= 8 THEN 'high_pb' END) AS risk_flags FROM ranked),
q AS (SELECT *, {r4('least(risk_points, 12)')} AS risk_penalty, {r4('least(risk_points / 12 * 100, 100)')} AS risk_score, CASE WHEN risk_points >= 12 * 0.66::DOUBLE THEN 'high' WHEN risk_points >= 12 * 0.33::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level FROM p), s AS (SELECT *, {r4('screen_score - risk_penalty')} AS final_score FROM q)
SELECT row_number() OVER (ORDER BY final_score DESC, rank) AS rank, code, risk_points, risk_penalty, risk_score, risk_level, risk_flags, final_score FROM s""",
    "portfolio_overlay": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, p AS (SELECT *, least(greatest(row_number() OVER (PARTITION BY industry ORDER BY screen_score DESC, rank) - 1, 0) * 4, 12)::DOUBLE AS portfolio_penalty FROM ranked), s AS (SELECT *, {r4('screen_score - portfolio_penalty')} AS final_score FROM p)
SELECT row_number() OVER (ORDER BY final_score DESC, rank) AS rank, code, industry AS bucket, portfolio_penalty, final_score FROM s""",
    "scorecard_delta": f"""WITH {SNAP}, {scored('snap', DEFAULT)} SELECT code, {r4('''CASE WHEN factor_value_score >= 75 AND factor_stability_score >= 65 THEN 2.4::DOUBLE ELSE 0 END + CASE WHEN factor_momentum_score >= 72 AND factor_activity_score >= 65 THEN 1.8::DOUBLE ELSE 0 END + CASE WHEN factor_reversal_score >= 75 AND change_pct < 0 THEN 1.2::DOUBLE ELSE 0 END - CASE WHEN factor_activity_score >= 90 AND factor_stability_score < 45 THEN 2.5::DOUBLE ELSE 0 END - CASE WHEN volume_ratio >= 5 THEN 1.2::DOUBLE ELSE 0 END''')} AS score_delta,
concat_ws(';', CASE WHEN factor_value_score >= 75 AND factor_stability_score >= 65 THEN 'value_quality' END, CASE WHEN factor_momentum_score >= 72 AND factor_activity_score >= 65 THEN 'capital_confirmed' END, CASE WHEN factor_reversal_score >= 75 AND change_pct < 0 THEN 'controlled_reversal' END) AS score_tags, concat_ws(';', CASE WHEN factor_activity_score >= 90 AND factor_stability_score < 45 THEN 'hot_money_instability' END, CASE WHEN volume_ratio >= 5 THEN 'volume_spike' END) AS score_flags FROM ranked""",
    "llm_blend": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, p AS (SELECT *, code % 4 <> 0 AS known, CASE WHEN code % 4 <> 0 AND code % 5 <> 0 THEN (code * 37 % 101)::DOUBLE END AS llm FROM ranked),
q AS (SELECT *, {r4('count(*) FILTER (known) OVER () / count(*) OVER ()')} AS llm_coverage, row_number() OVER (ORDER BY known DESC, CASE WHEN known THEN code * 11 % 1009 END, rank) AS place, 100.0::DOUBLE / count(*) OVER () AS step FROM p),
s AS (SELECT *, {r4('CASE WHEN llm_coverage >= 0.6 THEN screen_score * 0.6::DOUBLE + coalesce(llm, 100.0::DOUBLE - (place - 1) * step) * 0.4::DOUBLE ELSE screen_score END')} AS final_score FROM q)
SELECT row_number() OVER (ORDER BY final_score DESC, CASE WHEN llm_coverage >= 0.6 THEN place ELSE rank END) AS rank, code, llm_coverage, final_score FROM s""",
    "keyword_events": "SELECT doc_id, concat_ws(';', CASE WHEN contains(text, 'the ') OR contains(text, 'The ') THEN 'greeting' END, CASE WHEN contains(text, '@') OR contains(text, '+1') THEN 'contact' END, CASE WHEN contains(text, 'password') OR contains(text, 'token') THEN 'secret' END, CASE WHEN contains(text, '|') THEN 'list' END) AS tags FROM documents",
    "normalize_code": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 6, '0') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 6, '0') WHEN 2 THEN '' ELSE CASE WHEN length(o_orderkey::VARCHAR) = 6 THEN o_orderkey::VARCHAR ELSE right('000000' || '1' || o_orderkey::VARCHAR, 6) END END AS code, lpad(o_orderkey::VARCHAR, 6, '0') || CASE WHEN regexp_matches(lpad(o_orderkey::VARCHAR, 6, '0'), '^(4|8|920)') THEN '.BJ' WHEN regexp_matches(lpad(o_orderkey::VARCHAR, 6, '0'), '^(6|9|5)') THEN '.SH' ELSE '.SZ' END AS listed FROM orders",
    "label_merge": f"WITH {MEMBERS} SELECT code, concat_ws(',', industry, concepts) AS labels FROM members",
    "json_props": "SELECT event_type, count(k) AS known, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}
