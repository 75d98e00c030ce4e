"""DuckDB SQL for the queries of catalog_more."""

from __future__ import annotations

from .oracle import BARS, C, CHANGE60, DEFAULT, DIVERGE, FACTOR, FLOW, INPUTS, KDJ, MA, MACD, MEMBERS, QUOTES, RSI, SIGNAL, SNAP, SQL, STREAK, TR, V, W, above, clip, frame, n, r4, scored

BOARDS = f"""{MEMBERS}, boards AS (SELECT code, 'industry' AS board_type, industry AS board FROM members WHERE industry IS NOT NULL
  UNION SELECT code, 'concept', trim(unnest(string_split(concepts, ','))) FROM members WHERE concepts <> '')"""
LAST_FLOW = f"lastflow AS (SELECT code, date, {r4(f'CAST(sum(CAST(main_net_inflow AS DECIMAL(28, 6))) OVER {frame(5)} AS DOUBLE)')} AS main_net_inflow_5d FROM flow QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)"
HEAT = f"""heat AS (SELECT event_type AS board, CAST(ts AS DATE) AS seen, least(100, {r4('avg(value)')}) AS heat FROM events GROUP BY 1, 2),
last5 AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY seen DESC) AS p FROM heat WHERE heat BETWEEN 0 AND 100 QUALIFY p <= 5),
t0 AS (SELECT board, count(*) AS observations, arg_min(heat, seen) AS f, arg_max(heat, seen) AS l, max(CASE WHEN p = 2 THEN heat END) AS pr, max(heat) AS hot, avg(CASE WHEN heat >= 60 THEN 100.0::DOUBLE ELSE 0 END) AS per FROM last5 GROUP BY board),
t1 AS (SELECT board, observations, hot, {r4('l')} AS latest, {r4('l - f')} AS trend, {r4('greatest(coalesce(pr - l, 0), 0)')} AS cooling, {r4('per')} AS persistence FROM t0),
trends AS (SELECT *, CASE WHEN cooling >= 5 THEN 'cooling' WHEN trend >= 5 THEN 'warming' WHEN persistence >= 66.6667 AND hot > 0 THEN 'persistent_hot' WHEN trend <= -5 THEN 'weakening' ELSE 'flat' END AS state FROM t1)"""
EVAL = f"""{BARS}, {QUOTES}, ev AS (SELECT o_orderkey AS run_id, o_orderpriority AS strategy, o_orderdate AS created, l_suppkey AS code, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice / l_quantity END AS entry, l_returnflag AS sector, l_linestatus AS side, l_tax AS tax, l_discount AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT ev.*, CASE WHEN entry > 0 AND q.close IS NOT NULL THEN (q.close / entry - 1) * 100 - 10 / 100.0::DOUBLE END AS return_pct, CASE WHEN q.close IS NULL THEN 'missing' WHEN NOT coalesce(entry > 0, false) THEN 'bad_entry_price' ELSE 'ok' END AS status FROM ev LEFT JOIN quotes q USING (code))"""
STATS = f"""count(return_pct) AS pick_count, {r4('avg(return_pct)')} AS average_return_pct, {r4('median(return_pct)')} AS median_return_pct, {r4('avg(CASE WHEN return_pct > 0 THEN 100.0::DOUBLE WHEN return_pct IS NOT NULL THEN 0 END)')} AS win_rate"""
TAGS = "list_filter([CASE WHEN tax > 0.04 THEN 'taxed' END, CASE WHEN discount > 0.05 THEN 'discounted' END, CASE WHEN side = 'F' THEN 'filled' END], lambda x: x IS NOT NULL)"
FAIL = "avg(CASE WHEN return_pct <= -5 THEN 100.0::DOUBLE WHEN return_pct IS NOT NULL THEN 0 END)"
BATCHES = "old AS (SELECT code, date, close, volume FROM bars WHERE date < DATE '1998-06-01'), new AS (SELECT code, date, CASE WHEN day(date) = 3 THEN close + 1 ELSE close END AS close, volume FROM bars WHERE date >= DATE '1998-01-01')"
VECS = "v AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
D = "list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))"


def r6(x: str) -> str:
    return f"(round_even(({x}) * 1000000, 0) / 1000000)"


SQL.update(
    {
        "board_membership": f"WITH {BOARDS} SELECT * FROM boards",
        "board_flow_rank": f"""WITH {FLOW}, {BOARDS}, {LAST_FLOW}, g AS (SELECT board_type, board, count(main_net_inflow_5d) AS stock_count, {r4('coalesce(sum(CAST(main_net_inflow_5d AS DECIMAL(28, 6))), 0)::DOUBLE')} AS total, {r4('sum(CAST(main_net_inflow_5d AS DECIMAL(28, 6)))::DOUBLE / count(main_net_inflow_5d)')} AS mean, max(date)::VARCHAR AS as_of FROM boards JOIN lastflow USING (code) GROUP BY 1, 2)
SELECT board_type, board, row_number() OVER (PARTITION BY board_type ORDER BY total DESC, board) AS rank, stock_count, total, mean, as_of FROM g QUALIFY rank <= 10""",
        "board_flow_top_stocks": f"WITH {FLOW}, {BOARDS}, {LAST_FLOW} SELECT board_type, board, row_number() OVER (PARTITION BY board_type, board ORDER BY main_net_inflow_5d DESC NULLS LAST, code) AS rank, code, main_net_inflow_5d FROM boards JOIN lastflow USING (code) QUALIFY rank <= 3",
        "board_heat_trend": f"WITH {HEAT} SELECT board, observations, latest, trend, cooling, persistence, state FROM trends",
        "hotspot_rank": f"""WITH {HEAT}, h AS (SELECT *, {r4('latest + 0.35::DOUBLE * greatest(trend, 0) + 0.05::DOUBLE * persistence - 0.6::DOUBLE * cooling')} AS hot_score, CASE WHEN state IN ('weakening', 'cooling') AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 8 AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 5 THEN '分歧放量' WHEN latest >= 75 AND trend >= 8 AND persistence >= 50 THEN '加速主升' WHEN state = 'persistent_hot' OR persistence >= 66.6667 THEN '确认扩散' WHEN trend >= 5 AND observations >= 2 THEN '确认扩散' ELSE '初次异动' END AS stage FROM trends)
SELECT row_number() OVER (ORDER BY hot_score DESC, board) AS rank, board, hot_score, stage FROM h QUALIFY rank <= 10""",
        "board_heat_score": f"""WITH {SNAP}, g AS (SELECT industry AS board, avg(change_pct) AS c FROM snap GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY c DESC NULLS LAST, board) AS rank FROM g)
SELECT board, rank, {r4('greatest(0, least(100, 50 + coalesce(c / 100 * 6, 0) + greatest(0, 12 - least(rank, 12))))')} AS heat FROM h""",
        "stock_roles": f"""WITH {SNAP}, s0 AS (SELECT code, industry AS board, {r4('change_pct / 10')} AS change_pct, {r4('amount')} AS amount, {r4('''greatest(0, least(100, 35 + greatest(-18, least(32, coalesce(change_pct / 10, 0) * 2.7::DOUBLE)) + CASE WHEN amount > 0 THEN greatest(0, least(18, (log10(amount * 1000) - 6) / 4 * 18)) ELSE 0 END + greatest(0, least(14, coalesce(turnover_rate, 0) * 1.1::DOUBLE)) + greatest(0, least(12, coalesce(volume_ratio, 0) * 3)) + CASE WHEN change_pct > 0 THEN greatest(0, least(12, (log10(change_pct * 1e6) - 5) / 4 * 12)) WHEN change_pct < 0 THEN -greatest(0, least(8, (log10(-change_pct * 1e6) - 5) / 4 * 8)) ELSE 0 END + CASE WHEN change_pct / 10 >= 5 THEN 8 ELSE 0 END + least(8, (code % 5) * 2.5::DOUBLE) + least(8, (code % 6) * 2)))''')} AS hot_stock_score FROM snap),
s1 AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY hot_stock_score DESC, change_pct DESC NULLS LAST, amount DESC NULLS LAST, code DESC) AS rank, max(hot_stock_score) OVER (PARTITION BY board) AS top FROM s0)
SELECT board, code, rank, hot_stock_score, CASE WHEN rank = 1 AND hot_stock_score >= 70 THEN '核心龙头' WHEN rank <= 3 AND hot_stock_score >= greatest(68, top - 8) AND coalesce(change_pct, 0) >= 5 THEN '核心龙头' WHEN hot_stock_score >= 62 AND coalesce(change_pct, 0) >= 3 THEN '助攻' WHEN hot_stock_score >= 48 AND coalesce(change_pct, 0) >= 0 THEN '补涨' WHEN hot_stock_score >= 38 THEN '后排' ELSE '掉队' END AS role FROM s1""",
        "timeline_route": f"""WITH ev AS (SELECT event_type AS topic, ts AS seen, 's' || (user_id % 3) AS source, 't' || (user_id % 20) AS title, {r4('value')} AS impact, (user_id % 7)::VARCHAR AS code FROM events),
dd AS (SELECT topic, CAST(seen AS DATE) AS day, source, title, arg_max(impact, seen) AS impact, max(seen) AS seen, arg_max(code, seen) AS code FROM ev GROUP BY 1, 2, 3, 4)
SELECT topic, day::VARCHAR AS day, count(*) AS events, arg_max(title, row(impact, seen, source, title)) AS lead, max(impact) AS impact, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM dd GROUP BY 1, 2""",
        "eval_returns": f"WITH {EVAL} SELECT run_id, code, {r4('entry')} AS entry, {r4('return_pct')} AS return_pct, status FROM e",
        "eval_summary": f"WITH {EVAL} SELECT count(DISTINCT run_id) AS run_count, count(*) AS total_count, count(*) FILTER (status = 'missing') AS missing_count, {STATS} FROM e",
        "eval_portfolio": f"WITH {EVAL}, r AS (SELECT strategy, run_id, avg(return_pct) AS x FROM e GROUP BY 1, 2) SELECT strategy, count(x) AS portfolio_count, {r4('avg(x)')} AS average_return_pct, {r4('min(x)')} AS worst_return_pct, {r4('max(x)')} AS best_return_pct FROM r GROUP BY 1",
        "eval_by_label": f"WITH {EVAL} SELECT CASE WHEN sector = 'N' THEN 'unknown' ELSE sector END AS label, {STATS} FROM e GROUP BY 1",
        "eval_by_multi_label": f"WITH {EVAL}, x AS (SELECT return_pct, unnest(CASE WHEN len({TAGS}) > 0 THEN {TAGS} ELSE ['none'] END) AS label FROM e) SELECT label, {STATS} FROM x GROUP BY 1",
        "eval_event_signals": f"""WITH {EVAL}, x AS (SELECT return_pct, strategy, unnest({TAGS}) AS signal FROM e), g AS (SELECT signal, {STATS}, {r4(FAIL)} AS failure_rate, {r4('max(return_pct)')} AS best_return_pct, {r4('min(return_pct)')} AS worst_return_pct, count(DISTINCT strategy) AS strategy_count FROM x GROUP BY 1)
SELECT *, CASE WHEN pick_count < 3 THEN 'collect_more' WHEN average_return_pct > 0 AND win_rate >= 55 THEN 'promote' WHEN average_return_pct < 0 AND failure_rate >= 40 THEN 'demote' ELSE 'watch' END AS action FROM g""",
        "eval_holding_period": f"WITH {EVAL}, x AS (SELECT return_pct, floor((epoch(TIMESTAMP '1999-01-01 12:00:00') - epoch(created)) / 86400) AS dd FROM e) SELECT CASE WHEN dd <= 1 THEN '0-1d' WHEN dd <= 5 THEN '2-5d' WHEN dd <= 20 THEN '6-20d' ELSE '>20d' END AS label, {STATS} FROM x GROUP BY 1",
        "eval_failure_review": f"WITH {EVAL}, f AS (SELECT * FROM e WHERE return_pct <= -5 OR status <> 'ok'), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS label, return_pct FROM f" for c in ("strategy", "sector", "side", "status")) + f") SELECT dimension, label, count(*) AS failure_count, {r4('avg(return_pct)')} AS average_return_pct FROM x GROUP BY 1, 2",
        "eval_shape_status": f"""WITH {EVAL}, {MA}, sh AS (SELECT code, CASE WHEN b > 0 THEN {r4('(close / b - 1) * 100')} END AS br, CASE WHEN ma20 > 0 THEN {r4('(close / ma20 - 1) * 100')} END AS pb FROM (SELECT *, max(high) OVER {frame(20, 1)} AS b FROM ma) QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
x AS (SELECT return_pct, CASE WHEN br >= -1.5 THEN CASE WHEN return_pct IS NULL THEN 'breakout_pending' WHEN return_pct >= 3 THEN 'breakout_follow_through' WHEN return_pct <= -3 THEN 'failed_breakout' ELSE 'breakout_unconfirmed' END WHEN pb BETWEEN -3 AND 6 THEN CASE WHEN return_pct IS NULL THEN 'pullback_pending' WHEN return_pct > 0 THEN 'pullback_rebound' ELSE 'pullback_failed' END ELSE 'unknown' END AS label FROM e JOIN sh USING (code)) SELECT label, {STATS} FROM x GROUP BY 1""",
        "performance_history": f"""WITH {EVAL}, g AS (SELECT strategy, count(DISTINCT run_id) AS run_count, count(*) AS total_count, count(*) FILTER (status = 'missing') AS missing_count, {STATS} FROM e GROUP BY 1), s AS (SELECT strategy, string_agg(status || '=' || n, ';' ORDER BY status) AS status_counts FROM (SELECT strategy, status, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT g.*, status_counts, CASE WHEN average_return_pct IS NULL THEN 'insufficient_data' WHEN average_return_pct >= 2 AND win_rate >= 60 THEN 'strong' WHEN average_return_pct > 0 AND win_rate >= 50 THEN 'positive' WHEN average_return_pct < 0 AND win_rate < 50 THEN 'negative' ELSE 'mixed' END AS outcome,
CASE WHEN pick_count > 0 THEN round_even(greatest(0, least(100, 50 + average_return_pct * 2 + (win_rate - 50) * 0.5::DOUBLE - missing_count / pick_count * 20)) * 10, 0) / 10 END AS performance_score FROM g JOIN s USING (strategy)""",
        "eval_price_path": f"""WITH {EVAL}, sfx AS (SELECT code, date, count(*) OVER w AS days, last_value(close) OVER w AS fin, min(low) OVER w AS lo, max(high) OVER w AS hi FROM bars WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run_id, e.code, {r4('entry')} AS entry, days AS path_days, CASE WHEN entry > 0 THEN {r4('(fin / entry - 1) * 100')} END AS path_end_pct, least(CASE WHEN entry > 0 THEN {r4('(lo / entry - 1) * 100')} END, 0) AS path_drawdown_pct, greatest(CASE WHEN entry > 0 THEN {r4('(hi / entry - 1) * 100')} END, 0) AS path_runup_pct
FROM (SELECT *, CAST(created AS DATE) AS cd FROM e) e ASOF LEFT JOIN sfx ON e.code = sfx.code AND e.cd <= sfx.date""",
        "eval_windows": f"WITH {EVAL}, x AS (SELECT e.*, unnest([30, 365, 2000]) AS window_days FROM e) SELECT window_days::BIGINT AS window_days, strategy, {STATS} FROM x WHERE date_diff('day', CAST(created AS DATE), DATE '1999-01-01') <= window_days GROUP BY 1, 2",
        "run_history": f"""WITH n AS (SELECT l_orderkey, count(*) AS picks FROM lineitem GROUP BY 1), r AS (SELECT o_orderpriority AS strategy, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS created, coalesce(picks, 0) AS picks FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT strategy, count(*) AS run_count, sum(picks)::BIGINT AS pick_count, {r4('avg(picks)')} AS average_picks, max(created)::VARCHAR AS last_run, array_to_string((list(run_id ORDER BY created DESC, run_id DESC))[1:5], ',') AS recent_runs FROM r GROUP BY 1""",
        "source_history": f"""WITH g AS (SELECT o_orderpriority AS source, count(*) AS run_count, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS e, avg(CASE WHEN o_totalprice > 400000 THEN 1.0::DOUBLE ELSE 0 END) AS d, avg(CASE WHEN o_totalprice < 2000 THEN 1.0::DOUBLE ELSE 0 END) AS f FROM orders GROUP BY 1)
SELECT source, run_count, {r4('e')} AS error_rate, {r4('d')} AS degradation_rate, {r4('f')} AS fallback_rate, round_even(greatest(0, 100 - e * 45 - d * 35 - f * 30) * 10, 0) / 10 AS stability_score, CASE WHEN f > 0 THEN 'fallback' WHEN e >= 0.5 OR d >= 0.5 THEN 'degraded' WHEN e > 0 OR d > 0 THEN 'watch' ELSE 'ok' END AS status FROM g""",
        "market_breadth": f"WITH {SNAP} SELECT count(*) AS rows, {r4('avg(CASE WHEN change_pct > 0 THEN 1.0::DOUBLE WHEN change_pct IS NOT NULL THEN 0 END)')} AS up_ratio, {r4('avg(change_pct)')} AS mean_change, {r4('median(change_pct)')} AS median_change, {r4('median(amount)')} AS median_amount, {r4('avg(CASE WHEN volume_ratio >= 2 THEN 1.0::DOUBLE WHEN volume_ratio IS NOT NULL THEN 0 END)')} AS hot_volume FROM snap",
        "candidate_profile": f"WITH {SNAP}, {scored('snap', DEFAULT)} " + " UNION ALL ".join(f"SELECT '{k}' AS factor, {r4(f'avg(factor_{k}_score)')} AS mean, arg_max(code, row(factor_{k}_score, -code)) AS leader FROM fac" for k in ("value", "liquidity", "momentum", "size")),
        "label_distribution": f"WITH {SNAP}, g AS (SELECT coalesce(industry, 'unknown') AS label, count(*) AS n FROM snap GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, label) AS rank, label, n FROM g QUALIFY rank <= 6",
        "snapshot_quality": "WITH l AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax FROM lineitem), t AS (SELECT count(*) AS rows, count(*) - count(DISTINCT l_orderkey) AS repeated FROM l), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} <= 0) AS non_positive FROM l" for c in ("tax", "l_discount", "l_quantity")) + f") SELECT field, rows, missing, non_positive, repeated, {r4('1 - missing / rows')} AS coverage FROM x, t",
        "source_reconciliation": f"WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k) SELECT count(x) AS left_keys, count(y) AS right_keys, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS overlap, {r4('count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*)')} AS jaccard FROM j",
        "upsert_keep_last": f"WITH {BARS}, {BATCHES} SELECT code, date::VARCHAR AS date, {r4('close')} AS close, {r4('volume')} AS volume FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE date < DATE '1998-01-01')",
        "reconcile_diff": f"WITH {BARS}, {BATCHES} SELECT CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' WHEN abs(o.close - n.close) <= 1e-6 AND abs(o.volume - n.volume) <= 1e-6 THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM old o FULL JOIN new n ON o.code = n.code AND o.date = n.date GROUP BY 1",
        "factor_change_rebuild": f"""WITH {BARS}, f AS (SELECT code, date, 1 + 0.1::DOUBLE * (year(date) - 1992) AS a, CASE WHEN code % 5 = 0 AND year(date) >= 2001 THEN (1 + 0.1::DOUBLE * (year(date) - 1992)) * 1.5::DOUBLE ELSE 1 + 0.1::DOUBLE * (year(date) - 1992) END AS adj FROM bars WHERE day(date) <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS p FROM f), c AS (SELECT DISTINCT code FROM p WHERE p <= 60 AND a <> adj),
j AS (SELECT b.code, b.date, close, first_value(adj IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled, arg_max(adj, CASE WHEN adj IS NOT NULL THEN b.date END) OVER (PARTITION BY b.code) AS latest, row_number() OVER (PARTITION BY b.code ORDER BY b.date DESC) AS rn FROM bars b LEFT JOIN f ON f.code = b.code AND f.date = b.date WHERE b.code IN (SELECT code FROM c))
SELECT code, date::VARCHAR AS date, {r4('close * (filled / latest)')} AS close FROM j WHERE rn <= 60""",
        "calendar_gaps": f"WITH {BARS}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)), g AS (SELECT code, count(*) AS bars, max(i) - min(i) + 1 AS days FROM bars JOIN dd USING (date) GROUP BY 1) SELECT code, bars, days, days - bars AS missing FROM g WHERE days - bars > 2",
        "pattern_lp": f"WITH {VECS} SELECT vec_id, {r6(f'list_sum({D}) / len(x)')} AS l1, {r6(f'sqrt(list_sum(list_transform({D}, lambda z: z * z))) / len(x)')} AS l2, {r6(f'list_max({D})')} AS linf FROM v",
        "pattern_cosine": f"WITH {VECS} SELECT vec_id, {r6('list_cosine_similarity(x, y)')} AS cosine FROM v",
        "pattern_pearson": f"WITH {VECS}, u AS (SELECT vec_id, unnest(x) AS a, unnest(y) AS b FROM v) SELECT vec_id, {r6('corr(a, b)')} AS pearson FROM u GROUP BY 1",
    }
)


C60 = "coalesce(change_60d, 0)"
DAY = clip(f"60 + {C} * 5 - {above(C, 5)} * 10 - {above(f'-{C}', 2)} * 3", 5, 100)
TREND = clip(f"55 + {C60} * {n(.9)} - {above(C60, 45)} * {n(.8)} - {above(f'-{C60}', 20)} * {n(.7)}", 5, 100)
DAILY = {
    "momentum": clip(f"((50 * {n(.35)} + {DAY} * {n(.65)}) * {n(.6)} + {TREND} * {n(.4)}) * {n(.7)} + {clip('coalesce(signal_score, 50)', 0, 100)} * {n(.3)} + CASE macd_status WHEN 'bullish' THEN 6 WHEN 'bearish' THEN -8 ELSE 0 END", 5, 100),
    "reversal": clip(f"100 - abs({C} + 3) * 13 - {above(f'-{C}', 8)} * 10 - {above(C, 1)} * 8 + CASE rsi_status WHEN 'oversold' THEN 10 WHEN 'overbought' THEN -14 ELSE 0 END - {above(C60, 35)} * {n(.5)} - {above(f'-{C60}', 35)} * {n(.8)}", 5, 100),
    "stability": clip(
        f"78 - least(abs({C}), 10) * 3 - {above(C, 7)} * 5 - {above(TR, 10)} * 2 - {above(V, 5)} * 4 - CASE WHEN pe_ratio <= 0 THEN 18 ELSE 0 END + (coalesce(signal_score, 50) - 50) * {n(.12)}"
        f" - coalesce(CASE WHEN vol IS NOT NULL THEN {above('vol', 45)} END, 0) * {n(.45)} - coalesce({above('-dd', 12)}, 0) * {n(1.2)} - coalesce(CASE WHEN atr IS NOT NULL THEN {above('atr', 6)} END, 0) * 2 - {above('-quality', -80)} * {n(.35)}",
        0,
        100,
    ),
}
WITH_FLOW = DAILY | {"activity": clip(f"CASE WHEN main_net_inflow_5d IS NOT NULL THEN ({FACTOR['activity']}) * {n(.6)} + {clip('50 + greatest(-500, least(500, main_net_inflow_5d)) / 20 + greatest(0, least(10, coalesce(main_inflow_streak, 0))) * 2', 5, 100)} * {n(.4)} ELSE {FACTOR['activity']} END", 0, 100)}


def last_of(name: str, columns: str, source: str = "bars") -> str:
    return f"{name} AS (SELECT code, {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1)"


FEATURES = f"""{INPUTS}, {MACD}, {KDJ}, {MA}, {CHANGE60}, {RSI}, {SIGNAL},
moves AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr, list(close) OVER {frame(20)} AS cs FROM bars),
{last_of('lastmove', f"{r4(f'CASE WHEN count(r) OVER {frame(19)} >= 2 THEN stddev_samp(r) OVER {frame(19)} * sqrt(252::DOUBLE) * 100 END')} AS vol, {r4(f'avg(tr) OVER {frame(20)} / close * 100')} AS atr, {r4('least(0, list_min(list_transform(range(1, len(cs) + 1), lambda i: cs[i] / list_max(cs[1:i]) - 1))) * 100')} AS dd", 'moves')},
qual AS (SELECT code, 100 - CASE WHEN count(*) < 30 THEN 35 WHEN count(*) < 60 THEN 15 ELSE 0 END AS quality FROM bars GROUP BY code),
feats AS (SELECT * FROM sig JOIN kdj USING (code) JOIN lastmove USING (code) JOIN qual USING (code))"""
WEIGHTS_D = {"momentum": 0.32, "stability": 0.22, "activity": 0.18, "liquidity": 0.28}
WEIGHTS_F = {"reversal": 0.3, "momentum": 0.25, "activity": 0.25, "stability": 0.2}
PASS_D = "signal_score >= 40 AND kdj_j <= 90 AND atr <= 200"
SQL.update(
    {
        "screen_daily": f"WITH {SNAP}, {FEATURES}, pool AS (SELECT * FROM snap JOIN feats USING (code) WHERE {PASS_D}), {scored('pool', WEIGHTS_D, DAILY)} SELECT rank, code, screen_score, signal_score, kdj_j FROM ranked WHERE rank <= 15",
        "screen_daily_flow": f"""WITH {SNAP}, {FEATURES}, {FLOW}, {STREAK}, {DIVERGE}, {last_of('lf', 'main_net_inflow_5d, main_inflow_streak, price_up_flow_out', 'diverge')}, pool AS (SELECT * FROM snap JOIN feats USING (code) JOIN lf USING (code) WHERE kdj_j <= 95 AND main_net_inflow_5d >= 0 AND NOT price_up_flow_out), {scored('pool', WEIGHTS_F, WITH_FLOW)}
SELECT rank, code, screen_score, {r4('main_net_inflow_5d')} AS main_net_inflow_5d FROM ranked WHERE rank <= 15""",
        "screen_top_n_vs_full_pool": f"""WITH {SNAP}, {FEATURES}, {scored('snap', WEIGHTS_D, None, '_p')}, few AS (SELECT snap.* FROM snap JOIN ranked_p USING (code) WHERE rank <= 30), pool_a AS (SELECT * FROM few JOIN feats USING (code) WHERE {PASS_D}), pool_b AS (SELECT * FROM snap JOIN feats USING (code) WHERE {PASS_D}),
{scored('pool_a', WEIGHTS_D, DAILY, '_a')}, {scored('pool_b', WEIGHTS_D, DAILY, '_b')}, a AS (SELECT code FROM ranked_a WHERE rank <= 15), b AS (SELECT code FROM ranked_b WHERE rank <= 15)
SELECT coalesce(a.code, b.code) AS code, (a.code IS NOT NULL)::BIGINT AS pruned, (b.code IS NOT NULL)::BIGINT AS whole FROM a FULL JOIN b ON a.code = b.code""",
        "factor_theme_heat": f"""WITH {SNAP}, {HEAT}, x AS (SELECT code, coalesce(latest, 50) AS s, coalesce(trend, 0) AS t, coalesce(observations, 0) AS o, coalesce(persistence, 0) AS p, coalesce(cooling, 0) AS c FROM snap LEFT JOIN trends ON trends.board = ['click', 'view', 'purchase', 'signup', 'none'][code % 5 + 1]),
y AS (SELECT code, s + CASE WHEN o >= 2 THEN least(greatest(t, 0) * {n(.8)}, 10) - least(greatest(-t, 0) * {n(.8)}, 12) ELSE 0 END + least(greatest(p - 60, 0) * {n(.08)}, 6) - least(c * {n(.6)}, 10) AS v FROM x)
SELECT code, {r4(clip(f"v - {above('v', 88)} * {n(.5)}", 0, 100))} AS factor_theme_heat_score FROM y""",
        "factor_topic_alignment": f"""WITH {SNAP} SELECT code, CASE WHEN code % 4 = 0 THEN 50 WHEN code % 4 = 1 THEN 50 + 25 + 5 ELSE 50 - 12 END::DOUBLE AS factor_topic_alignment_score FROM snap""",
    }
)

KEY = "regexp_replace(regexp_replace(replace(lower(trim({})), '人工智能', 'ai'), '概念|板块|行业|产业|主题|指数', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def topics(asked: str, candidates: str, top: int) -> str:
    """The best topics of each query, by every pair: asked gives query, candidates give topic, heat and alias."""
    return f"""WITH c AS ({candidates}), q AS ({asked}),
k AS (SELECT query, topic, heat, {KEY.format('query')} AS qk, {KEY.format('alias')} AS ak FROM c, q), o AS (SELECT *, len(list_intersect(list_distinct(string_split(qk, '')), list_distinct(string_split(ak, '')))) / len(list_distinct(list_concat(string_split(qk, ''), string_split(ak, '')))) AS ov FROM k),
s AS (SELECT query, topic, heat, CASE WHEN qk = '' OR ak = '' THEN 0 WHEN qk = ak THEN 1 WHEN length(ak) >= 2 AND contains(qk, ak) THEN {n(.82)} + {n(.08)} * length(ak) / length(qk) WHEN length(qk) >= 2 AND contains(ak, qk) THEN {n(.78)} + {n(.1)} * length(qk) / length(ak) WHEN ov >= 0.45 THEN {n(.42)} + {n(.28)} * ov ELSE 0 END AS v FROM o),
b AS (SELECT query, topic, {r4('max(v)')} AS confidence, max(heat) AS heat FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, heat DESC, topic DESC) AS rank FROM b WHERE confidence >= 0.3)
SELECT query, rank, topic, confidence, rank = 1 AND confidence >= 0.55 AS canonical FROM r WHERE rank <= {top}"""


SQL["topic_resolution"] = topics("SELECT unnest(['nation 1 板块', 'NATION_12', 'nati', 'tonian', '']) AS query", "SELECT n_name AS topic, n_nationkey AS heat, unnest([n_name, 'the ' || n_name]) AS alias FROM nation", 5)
