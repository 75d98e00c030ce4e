"""DuckDB SQL for the queries of catalog_extra."""

from __future__ import annotations

from .operators.analyzers import ADVICE, TREND
from .oracle import BARS, DEFAULT, FLOW, MEMBERS, SNAP, SQL, TIERS, W, clip, n, r4, scored
from .oracle_more import HEAT, VECS, r6

KINDS = "['click', 'view', 'purchase', 'signup', 'none']"
RAW = "CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' ' WHEN 2 THEN user_id::VARCHAR || '%' WHEN 3 THEN '1' ELSE event_type END"
STAGE = """CASE WHEN state IN ('weakening', 'cooling') AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 8 AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 5 THEN '分歧放量'
WHEN latest >= 75 AND trend >= 8 AND persistence >= 50 THEN '加速主升' WHEN state = 'persistent_hot' OR persistence >= 66.6667 THEN '确认扩散' WHEN trend >= 5 AND observations >= 2 THEN '确认扩散' ELSE '初次异动' END"""
FIELDS = ("price", "change_pct", "amount", "pe_ratio", "pb_ratio", "volume_ratio", "turnover_rate", "industry")


def _clipped(x: str) -> str:
    return f"greatest(least({x}, 2.0::DOUBLE), -2.0::DOUBLE)"


def _points(c: str, table: dict[str, float]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {n(v)}" for k, v in table.items()) + f" ELSE {n(0)} END"


ADVISED = "trim([" + ", ".join(f"'{x}'" for x in (*ADVICE, " 买入 ", "?")) + "][code % 11 + 1])"
TRENDING = "[" + ", ".join(f"'{x}'" for x in (*TREND, "?")) + "][code % 5 + 1]"
DEEP = f"""coalesce(CASE WHEN code % 3 <> 0 THEN (code * 7 % 101 - 50) * {n(0.2)} END, 0) + coalesce(CASE WHEN code % 4 <> 0 THEN (code * 13 % 101 - 50) * {n(0.12)} END, 0) + {_points(ADVISED, ADVICE)} + {_points(TRENDING, TREND)} - least((code % 5) * {n(2)}, 6)"""


SQL.update(
    {
        "pattern_spearman": f"""WITH {VECS}, u AS (SELECT vec_id, unnest(x) AS a, unnest(y) AS b FROM v), k AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY a) + (count(*) OVER (PARTITION BY vec_id, a) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY vec_id ORDER BY b) + (count(*) OVER (PARTITION BY vec_id, b) - 1) / 2.0::DOUBLE AS b FROM u)
SELECT vec_id, {r6('corr(a, b)')} AS spearman FROM k GROUP BY 1""",
        "pattern_features": f"""WITH {BARS}, x AS (SELECT *, first_value(close) OVER w AS base, coalesce(close / lag(close) OVER w - 1, 0) AS chg, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3, lag(close, 4) OVER w AS c4 FROM bars WINDOW w AS ({W}))
SELECT code, date::VARCHAR AS date, {r4('close / base - 1')} AS close_return, {r4('(close - open) / base')} AS body, {r4('(high - greatest(open, close)) / base')} AS upper_shadow, {r4('(least(open, close) - low) / base')} AS lower_shadow, {r4('(high - low) / base')} AS amplitude,
{r4('ln(1 + greatest(volume, 0))')} AS log_volume, {r4('avg(chg) OVER g')} AS pct_change_mean, {r4('stddev_pop(chg) OVER g')} AS pct_change_std, {r4('CASE WHEN c4 IS NOT NULL THEN (2 * (close - c4) + (c1 - c3)) / 10 WHEN c3 IS NOT NULL THEN (3 * (close - c3) + (c1 - c2)) / 10 WHEN c2 IS NOT NULL THEN (close - c2) / 2 WHEN c1 IS NOT NULL THEN close - c1 ELSE 0 END')} AS trend_slope FROM x WINDOW g AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "pattern_normalized": f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY 1)
SELECT vec_id, {r4('sum(i * ' + _clipped('(v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END') + ')')} AS zscore, {r4('sum(i * ' + _clipped('(v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END') + ')')} AS minmax, {r4('sum(i * ' + _clipped('(v - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END') + ')')} AS robust FROM u JOIN s USING (vec_id) GROUP BY 1""",
        "field_coverage": f"WITH {SNAP} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS known, count(*) AS total, {r4(f'count({f}) / count(*) * 100')} AS coverage_pct FROM snap" for f in FIELDS),
        "hotspot_stage": f"WITH {HEAT} SELECT board, state, {STAGE} AS stage FROM trends",
        "rejection_summary": f"WITH w AS ({SQL['filter_waterfall']}) SELECT step, label || ' removed ' || removed || ' (' || before || '->' || after || ')' AS summary FROM w WHERE removed > 0 ORDER BY step LIMIT 8",
        "loose_values": f"WITH e AS (SELECT event_id, {RAW} AS raw, try_cast(replace(trim({RAW}), '%', '') AS DOUBLE) AS x FROM events) SELECT event_id, trunc(x)::BIGINT AS whole, CASE WHEN trim(raw) <> '' THEN lower(trim(raw)) IN ('1', 'true', 'yes', 'on') END AS said, CASE WHEN x IS NOT NULL THEN greatest(0, least(50, x)) END AS bounded FROM e",
        "text_lists": f"WITH {MEMBERS} SELECT code, array_to_string(list_filter(list_transform(string_split(concepts, ','), lambda x: substr(trim(x), 1, 5)), lambda x: x <> ''), '|') AS items FROM members",
        "day_keys": "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') ELSE ' ' END AS raw, o_orderdate FROM orders) SELECT o_orderkey, CASE WHEN trim(raw) <> '' THEN strftime(o_orderdate, '%Y%m%d') END AS day_key, CASE WHEN trim(raw) <> '' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS iso_day FROM o",
        "board_best": f"WITH {HEAT} SELECT board, seen::VARCHAR AS at, heat FROM heat QUALIFY row_number() OVER (PARTITION BY board ORDER BY heat DESC, seen DESC) = 1",
        "trend_attach": f"""WITH {HEAT}, {MEMBERS}, named AS (SELECT code, {KINDS}[code % 5 + 1] AS board FROM members UNION SELECT code, {KINDS}[code % 3 + 1] FROM members),
best AS (SELECT code, t.* FROM named JOIN trends t USING (board) QUALIFY row_number() OVER (PARTITION BY code ORDER BY observations DESC, latest DESC, abs(trend) DESC, board DESC) = 1)
SELECT m.code, observations AS board_heat_observations, latest AS board_heat_latest, trend AS board_heat_trend, state AS board_heat_state FROM members m LEFT JOIN best b ON b.code = m.code""",
        "map_merge": f"""WITH {MEMBERS}, a AS (SELECT code, CASE WHEN code % 2 = 0 THEN '' ELSE industry END AS industry, concepts, CASE WHEN code % 4 <> 0 THEN (code::DOUBLE * 3) % 50 END AS industry_rank, CASE WHEN code % 5 <> 0 THEN (code::DOUBLE * 7) % 50 END AS heat, CASE WHEN code % 6 <> 0 THEN (code::DOUBLE * 11) % 50 END AS trend FROM members WHERE code % 3 <> 0),
b AS (SELECT code, 'other' AS industry, concepts FROM members WHERE code % 7 <> 0)
SELECT code, CASE WHEN coalesce(a.industry, '') <> '' THEN a.industry ELSE coalesce(b.industry, '') END AS industry, CASE WHEN a.code IS NULL THEN 'new,' || b.concepts WHEN b.code IS NULL THEN a.concepts ELSE a.concepts || ',new' END AS concepts,
least(industry_rank, CASE WHEN b.code IS NOT NULL THEN 9.0::DOUBLE END) AS industry_rank, greatest(heat, CASE WHEN b.code IS NOT NULL THEN 20.0::DOUBLE END) AS heat, CASE WHEN b.code IS NOT NULL AND (trend IS NULL OR abs(trend) < 25) THEN -25.0::DOUBLE ELSE trend END AS trend FROM a FULL JOIN b USING (code)""",
        "flag_counts": f"WITH {SNAP}, f AS (SELECT 'up' AS flag FROM snap WHERE change_pct > 0 UNION ALL SELECT 'loss' FROM snap WHERE pe_ratio < 0 UNION ALL SELECT 'busy' FROM snap WHERE turnover_rate > 1) SELECT flag, count(*) AS n FROM f GROUP BY 1",
        "field_impacts": """WITH g AS (SELECT o_orderpriority AS strategy, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1), e AS (SELECT strategy, 'volume' AS field FROM g WHERE n % 2 = 0 UNION ALL SELECT strategy, 'turnover' FROM g WHERE n % 3 = 0 UNION ALL SELECT strategy, 'industry' FROM g WHERE total > 0)
SELECT field, count(*) AS strategy_count, string_agg(strategy, ',' ORDER BY strategy) AS strategies FROM e GROUP BY 1""",
        "sub_scores": f"WITH {SNAP}, {scored('snap', DEFAULT)} SELECT code, {r4(clip(f'f_value * {n(0.5)} + f_liquidity * {n(0.25)} + f_stability * {n(0.25)}', 0, 100))} AS snapshot_score, {r4(clip(f'f_momentum * {n(0.55)} + f_activity * {n(0.45)}', 0, 100))} AS tech_score FROM fac",
        "deep_overlay": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, x AS (SELECT code, rank, {r4(f'screen_score + CASE WHEN code % 6 <> 0 THEN {DEEP} ELSE 0 END')} AS final_score FROM ranked)
SELECT row_number() OVER (ORDER BY final_score DESC, rank) AS rank, code, final_score FROM x""",
        "external_overlay": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, x AS (SELECT code, rank, CASE WHEN rank > 40 THEN 'skipped' WHEN code % 3 <> 0 THEN 'completed' ELSE '' END AS external_status,
concat_ws(';', CASE WHEN code % 2 = 0 THEN 'high_pb' END, CASE WHEN code % 6 = 1 THEN 'early' END, CASE WHEN code % 3 <> 0 THEN 'late' END, CASE WHEN code % 3 <> 0 AND code % 2 <> 0 THEN 'high_pb' END) AS risk_flags,
{r4(f'screen_score + CASE WHEN code % 3 <> 0 THEN (code % 9 - 4) / {n(2)} ELSE 0 END')} AS final_score FROM ranked)
SELECT row_number() OVER (ORDER BY final_score DESC, rank) AS rank, code, external_status, risk_flags, final_score FROM x""",
        "hotspot_quality": f"""WITH q AS (SELECT c_custkey, c_custkey % 4 = 0 AS no_topic, c_custkey % 11 = 0 AS stale, c_custkey % 8 = 0 AS resolved, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 100 END AS age,
concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'heat' END, CASE WHEN c_custkey % 4 = 0 THEN 'canonical_topic' END, CASE WHEN c_custkey % 5 = 0 THEN 'source' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'stocks' END) AS missing FROM customer)
SELECT c_custkey, missing, CASE WHEN stale THEN 'stale' WHEN no_topic AND NOT resolved THEN 'failed' WHEN missing <> '' THEN 'partial' ELSE 'available' END AS quality_status,
{r4(f'CASE WHEN age > 24 THEN greatest({n(0.65)} * {n(0.5)}, {n(0.65)} - least(age / {n(240)}, {n(0.25)})) ELSE {n(0.65)} END')} AS confidence FROM q""",
        "risk_lists": f"""WITH {SNAP}, {scored('snap', DEFAULT)}, p AS (SELECT *, CASE WHEN change_pct >= 8 THEN 4 WHEN change_pct <= -7 THEN 3.5::DOUBLE ELSE 0 END + CASE WHEN volume_ratio >= 6 THEN 3 ELSE 0 END + CASE WHEN turnover_rate >= 15 THEN 3 ELSE 0 END + CASE WHEN pe_ratio <= 0 THEN 3 ELSE 0 END + CASE WHEN pb_ratio >= 2 THEN 2 ELSE 0 END
+ CASE WHEN code % 3 <> 0 THEN least((code % 5) * {n(1.25)}, 4) ELSE 0 END + {n(3)} AS risk_points,
concat_ws(';', CASE WHEN change_pct >= 8 THEN 'single_day_chase_risk' END, CASE WHEN change_pct <= -7 THEN 'single_day_breakdown_risk' END, CASE WHEN volume_ratio >= 6 THEN 'abnormal_volume_ratio' END, CASE WHEN turnover_rate >= 15 THEN 'high_turnover' END, CASE WHEN pe_ratio <= 0 THEN 'negative_or_invalid_pe' END, CASE WHEN pb_ratio >= 2 THEN 'high_pb' END,
CASE WHEN code % 3 <> 0 AND code % 5 <> 0 THEN 'warned' END, 'deep', CASE WHEN NOT coalesce(pb_ratio >= 2, false) THEN 'high_pb' END) AS risk_flags FROM ranked),
s AS (SELECT *, {r4(f"screen_score - {r4('least(risk_points, 12)')}")} AS final_score FROM p)
SELECT row_number() OVER (ORDER BY final_score DESC, rank) AS rank, code, risk_points, risk_flags, final_score FROM s""",
        "eval_path_summary": f"SELECT count(path_drawdown_pct) AS path_pick_count, " + ", ".join(f"{r4(f'{f}(path_{c}_pct)')} AS {x}_max_{c}_pct" for c in ("drawdown", "runup") for f, x in (("avg", "average"), ("median", "median"))) + f" FROM ({SQL['eval_price_path']})",
        "daily_quality_fetched": f"""WITH q AS ({SQL['daily_quality']}), x AS (SELECT *, code % 4 <> 0 AND code % 3 = 0 AS old, CASE WHEN code % 4 <> 0 THEN code % 6 ELSE 0 END AS errors FROM q)
SELECT code, daily_data_points, greatest(daily_quality_score - CASE WHEN old THEN 25 ELSE 0 END - least(errors * 5, 20), 0)::DOUBLE AS daily_quality_score, concat_ws(';', nullif(daily_quality_flags, ''), CASE WHEN old THEN 'stale_cache' END, CASE WHEN errors > 0 THEN 'fallback_errors' END) AS daily_quality_flags FROM x""",
        "flow_without_bars": f"WITH {FLOW} SELECT code, date::VARCHAR AS date, {r4(f'CASE WHEN {TIERS} > 0 THEN {TIERS} END')} AS turnover_amount, NULL::BOOLEAN AS price_up_flow_out, NULL::BOOLEAN AS price_down_flow_in FROM flow",
    }
)
