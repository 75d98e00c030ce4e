"""DuckDB SQL for the queries of catalog_review."""

from __future__ import annotations

from .operators.review import KINDS, MANY, SINGLE
from .oracle import BARS, DIVERGE, FLOW, QUOTES, SNAP, SQL, STREAK, TIERS, W, r4  # noqa: F401
from .oracle_more import EVAL, topics

EACH = "list_filter([{}], lambda x: x IS NOT NULL)"
REVIEWED = f"""{BARS}, {QUOTES}, rv0 AS (SELECT o_orderkey AS run_id, o_orderpriority AS strategy, l_suppkey AS code, l_linenumber AS rank, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice / l_quantity END AS entry,
  CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END AS llm_sector, l_linestatus AS llm_theme, CASE l_linenumber WHEN 1 THEN 'failed_breakout' WHEN 2 THEN 'breakout_unconfirmed' WHEN 3 THEN 'pullback_rebound' ELSE '' END AS shape_status,
  CASE WHEN l_linenumber = 6 THEN 'missing' ELSE 'ok' END AS path_status, -l_quantity / 4 AS dd, {EACH.format("CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_linenumber % 2 = 0 THEN 'even' END")} AS llm_tags, {EACH.format("CASE WHEN l_tax > 0.04 THEN 'taxed' END")} AS llm_catalysts,
  {EACH.format("CASE WHEN l_quantity > 40 THEN 'big' END, CASE WHEN l_tax > 0.07 THEN 'dear' END")} AS llm_risks, {EACH.format("CASE WHEN l_discount > 0.08 THEN 'high_discount' END")} AS risk_flags, {EACH.format("CASE WHEN l_linenumber > 5 THEN 'late' END")} AS post_analysis_tags, []::VARCHAR[] AS portfolio_flags, []::VARCHAR[] AS shape_tags
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rv1 AS (SELECT rv0.*, CASE WHEN entry > 0 AND q.close IS NOT NULL THEN (q.close / entry - 1) * 100 END AS r, CASE WHEN q.close IS NULL THEN 'missing' WHEN NOT coalesce(entry > 0, false) THEN 'bad_entry_price' ELSE 'ok' END AS status FROM rv0 LEFT JOIN quotes q USING (code)),
rv2 AS (SELECT *, {' || '.join(f"list_transform({c}, lambda x: '{k}:' || x)" for k, c in KINDS.items())} AS event_signals,
  {EACH.format("CASE WHEN status <> 'ok' THEN 'quote_status:' || status END, CASE WHEN r < 0 THEN 'negative_return' END, CASE WHEN r <= -5 THEN 'large_loss' END, CASE WHEN shape_status IN ('failed_breakout', 'breakout_unconfirmed') THEN 'shape_status:' || shape_status END, CASE WHEN dd <= -8 THEN 'path_drawdown_breach' END, CASE WHEN path_status <> 'ok' THEN 'path_status:' || path_status END")} AS own FROM rv1),
rv AS (SELECT *, CASE WHEN len(own) > 0 THEN own || list_transform(risk_flags, lambda x: 'risk_flag:' || x) || list_transform(llm_risks, lambda x: 'llm_risk:' || x) ELSE [] END AS failure_reasons FROM rv2)"""
ORDER = "row(r IS NULL, coalesce(r, 0), {}strategy, rank, code)"


def _samples(rows: str, by: str, order: str, most: int) -> str:
    return f"""worst AS (SELECT {by}, code, min({order}) AS o FROM {rows} GROUP BY ALL), few AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY o, code::VARCHAR) AS p FROM worst QUALIFY p <= {most}),
told AS (SELECT {by}, string_agg(code::VARCHAR, ',' ORDER BY p) AS sample_codes FROM few GROUP BY ALL)"""


def _signals(by: str) -> str:
    keys = f"{by}signal"
    return f"""sg AS (SELECT strategy, code, rank, r, len(failure_reasons) > 0 AS failed, unnest(event_signals) AS signal FROM rv), {_samples('sg', keys, 'row(r IS NULL, coalesce(r, 0), strategy, rank)', 5)},
st AS (SELECT {keys}, count(*) AS pick_count, count(r) AS evaluated_pick_count, count(*) FILTER (failed) AS failure_count, {r4('count(*) FILTER (failed) / count(*) * 100')} AS failure_rate, {r4('avg(r)')} AS average_return_pct, {r4('median(r)')} AS median_return_pct,
  {r4('avg(CASE WHEN r > 0 THEN 100.0::DOUBLE WHEN r IS NOT NULL THEN 0 END)')} AS win_rate, {r4('max(r)')} AS best_return_pct, {r4('min(r)')} AS worst_return_pct, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM sg GROUP BY ALL),
acted AS (SELECT st.*, sample_codes, CASE WHEN average_return_pct IS NULL OR win_rate IS NULL THEN 'insufficient_data' WHEN average_return_pct > 0 AND win_rate >= 50 AND failure_count / pick_count * 100 < 50 THEN 'prefer' WHEN average_return_pct < 0 OR win_rate < 50 OR failure_count / pick_count * 100 >= 50 THEN 'avoid' ELSE 'watch' END AS action FROM st LEFT JOIN told USING ({keys}))"""


DIMENSIONS = " UNION ALL ".join(
    [f"SELECT '{d}' AS dimension, CASE WHEN trim({c}) = '' THEN 'unknown' ELSE {c} END AS label, code, r, status, strategy, rank FROM failed" for d, c in SINGLE.items()]
    + [f"SELECT '{d}', unnest(CASE WHEN len({c}) > 0 THEN {c} ELSE ['none'] END), code, r, status, strategy, rank FROM failed" for d, c in MANY.items()]
)
VALUE = "CASE split_part(signal, ':', 1) WHEN 'risk' THEN '风险:' WHEN 'catalyst' THEN '催化:' WHEN 'post' THEN '后验:' ELSE '' END || substr(signal, instr(signal, ':') + 1)"

TOPICS = f"""{SNAP}, nat AS (SELECT n_nationkey AS k, n_name AS topic FROM nation),
boards AS (SELECT topic, k, 'industry' AS source, (k % 7 - 3)::DOUBLE AS change_pct, k + 1 AS rank, 50 + k % 4 * 5 + k % 3 AS heat FROM nat WHERE k % 3 > 0 UNION ALL SELECT topic, k, 'concept', (k % 7 - 3)::DOUBLE, k + 1, 50 + k % 4 * 5 FROM nat WHERE k % 3 = 0),
heat AS (SELECT topic AS board, CAST(ts AS DATE) AS seen, least(100, {r4('avg(value)')}) AS heat FROM events JOIN nat ON user_id % 20 = k GROUP BY 1, 2),
last5 AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY seen DESC) AS p FROM heat WHERE heat BETWEEN 0 AND 100 QUALIFY p <= 5),
t0 AS (SELECT board, count(*) AS observations, arg_min(heat, seen) AS f, arg_max(heat, seen) AS l, max(CASE WHEN p = 2 THEN heat END) AS pr, max(heat) AS hot, avg(CASE WHEN heat >= 60 THEN 100.0::DOUBLE ELSE 0 END) AS per FROM last5 GROUP BY board),
t1 AS (SELECT board, observations, hot, {r4('l')} AS latest, {r4('l - f')} AS trend, {r4('greatest(coalesce(pr - l, 0), 0)')} AS cooling, {r4('per')} AS persistence FROM t0),
trends AS (SELECT *, CASE WHEN cooling >= 5 THEN 'cooling' WHEN trend >= 5 THEN 'warming' WHEN persistence >= 66.6667 AND hot > 0 THEN 'persistent_hot' WHEN trend <= -5 THEN 'weakening' ELSE 'flat' END AS state FROM t1),
stk AS (SELECT topic, code, {r4('change_pct / 10')} AS change_pct, {r4('amount')} AS amount FROM snap JOIN nat ON industry = topic WHERE k % 8 <> 3),
scored AS (SELECT *, {r4('''greatest(0, least(100, 35 + greatest(-18, least(32, coalesce(change_pct, 0) * 2.7::DOUBLE)) + CASE WHEN amount > 0 THEN greatest(0, least(18, (log10(amount) - 6) / 4 * 18)) ELSE 0 END + least(14, (code % 12) * 1.1::DOUBLE) + least(12, (code % 4) * 3)
  + CASE WHEN code % 9 > 4 THEN greatest(0, least(12, (log10((code % 9 - 4) * 1e6) - 5) / 4 * 12)) WHEN code % 9 < 4 THEN -greatest(0, least(8, (log10((4 - code % 9) * 1e6) - 5) / 4 * 8)) ELSE 0 END + CASE WHEN code % 10 = 0 THEN 8 ELSE 0 END + least(8, (code % 5) * 2.5::DOUBLE) + least(8, (code % 6) * 2)))''')} AS hot_stock_score FROM stk),
placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY hot_stock_score DESC, change_pct DESC NULLS LAST, amount DESC NULLS LAST, code DESC) AS place, max(hot_stock_score) OVER (PARTITION BY topic) AS best FROM scored),
roled AS (SELECT *, CASE WHEN place = 1 AND hot_stock_score >= 70 THEN '核心龙头' WHEN place <= 3 AND hot_stock_score >= greatest(68, best - 8) AND coalesce(change_pct, 0) >= 5 THEN '核心龙头' WHEN hot_stock_score >= 62 AND coalesce(change_pct, 0) >= 3 THEN '助攻' WHEN hot_stock_score >= 48 AND coalesce(change_pct, 0) >= 0 THEN '补涨' WHEN hot_stock_score >= 38 THEN '后排' ELSE '掉队' END AS role FROM placed)"""
STAGE = """CASE WHEN state IN ('weakening', 'cooling') AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 8 AND (latest < 60 OR trend <= -5) THEN '降温退潮' WHEN cooling >= 5 THEN '分歧放量'
WHEN latest >= 75 AND trend >= 8 AND persistence >= 50 THEN '加速主升' WHEN state = 'persistent_hot' OR persistence >= 66.6667 THEN '确认扩散' WHEN trend >= 5 AND observations >= 2 THEN '确认扩散' ELSE '初次异动' END"""
JUDGED = "said AS (SELECT s_nationkey AS run_id, s_suppkey AS code, s_acctbal, s_suppkey % 5 <> 0 AND s_nationkey % 5 <> 3 AS named FROM supplier)"

SQL.update(
    {
        "eval_failure_summary": f"""WITH {REVIEWED} SELECT count(*) AS failure_count, count(*) FILTER (r < 0) AS negative_pick_count, count(*) FILTER (status <> 'ok') AS missing_count, count(*) FILTER (shape_status = 'failed_breakout') AS failed_breakout_count, count(*) FILTER (dd <= -8) AS severe_drawdown_count,
{r4('avg(CASE WHEN r < 0 THEN r END)')} AS average_negative_return_pct, {r4('min(r)')} AS worst_return_pct FROM rv WHERE len(failure_reasons) > 0""",
        "eval_failure_dimensions": f"""WITH {REVIEWED}, failed AS (SELECT * FROM rv WHERE len(failure_reasons) > 0), x AS ({DIMENSIONS}), {_samples('x', 'dimension, label', ORDER.format("CASE WHEN r IS NULL THEN status ELSE '' END, "), 3)},
g AS (SELECT dimension, label, count(*) AS failure_count, count(r) AS evaluated_failure_count, {r4('avg(r)')} AS average_return_pct, {r4('min(r)')} AS worst_return_pct FROM x GROUP BY ALL) SELECT g.*, sample_codes FROM g LEFT JOIN told USING (dimension, label)""",
        "eval_signal_review": f"WITH {REVIEWED}, {_signals('')} SELECT * FROM acted",
        "eval_strategy_suggestions": f"""WITH {REVIEWED}, {_signals('strategy, ')}, v AS (SELECT *, {VALUE} AS value FROM acted WHERE action IN ('prefer', 'avoid') AND evaluated_pick_count > 0)
SELECT strategy, coalesce(string_agg(value, ',' ORDER BY average_return_pct DESC, signal) FILTER (action = 'prefer'), '') AS preferred_event_tags, coalesce(string_agg(value, ',' ORDER BY average_return_pct DESC, signal) FILTER (action = 'avoid'), '') AS avoided_event_tags, count(*) AS evidence FROM v GROUP BY strategy""",
        "eval_medians_spread": f"WITH {EVAL} SELECT strategy, {r4('median(return_pct)')} AS median_return_pct FROM e WHERE return_pct IS NOT NULL GROUP BY 1",
        "flow_snapshot_asof": f"""WITH {BARS}, {FLOW}, {STREAK}, {DIVERGE} SELECT code, date::VARCHAR AS as_of, main_inflow_streak::BIGINT AS main_inflow_streak, {r4('main_net_inflow')} AS main_net_inflow, {r4('main_net_inflow_5d')} AS main_net_inflow_5d, {r4('main_net_inflow / turnover_amount')} AS main_net_inflow_rate, price_up_flow_out, price_down_flow_in
FROM diverge WHERE date <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""",
        "flow_given_main": f"""WITH {FLOW}, t AS (SELECT *, CASE WHEN code % 3 = 0 AND day(date) = 5 THEN 7.5::DOUBLE END AS told FROM flow), u AS (SELECT *, bool_or(told IS NOT NULL) OVER (PARTITION BY code) AS has FROM t)
SELECT code, date::VARCHAR AS date, {r4('CASE WHEN has THEN told ELSE main_net_inflow END')} AS main_net_inflow FROM u""",
        "hotspot_discover": f"""WITH {TOPICS}, j AS (SELECT b.topic, b.source, b.change_pct, b.rank AS board_rank, coalesce(t.latest, b.heat) AS latest, coalesce(t.observations, 0) AS observations, coalesce(t.trend, 0) AS trend, coalesce(t.cooling, 0) AS cooling, coalesce(t.persistence, 0) AS persistence, coalesce(t.state, '') AS state FROM boards b LEFT JOIN trends t ON t.board = b.topic),
f AS (SELECT *, row_number() OVER (ORDER BY latest + greatest(trend, 0) * 0.35::DOUBLE + persistence * 0.05::DOUBLE - cooling * 0.6::DOUBLE DESC, latest DESC, change_pct DESC, trend DESC, board_rank, topic) AS rank FROM j QUALIFY rank <= 12),
led AS (SELECT *, bool_or(role = '核心龙头') OVER (PARTITION BY topic) AS core, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN role = '核心龙头' THEN 0 ELSE 1 END, place) AS p FROM roled),
l AS (SELECT topic, max(n) AS stock_count, string_agg('S' || code, ',' ORDER BY p) AS leaders FROM led WHERE p <= 3 AND (role = '核心龙头' OR NOT core) GROUP BY topic)
SELECT rank, topic, source, {r4('latest')} AS heat_score, trend, observations, {STAGE} AS stage, coalesce(stock_count, 0) AS stock_count, coalesce(leaders, '') AS leaders, CASE WHEN stock_count IS NULL THEN 'stocks,leader_stocks' ELSE '' END AS missing_fields FROM f LEFT JOIN l USING (topic)""",
        "hotspot_detail": f"WITH {TOPICS} SELECT topic, place, code, 'S' || code AS name, hot_stock_score, role FROM roled WHERE place <= 4 AND topic IN (SELECT topic FROM nat WHERE k <= 5)",
        "judged_ranking": f"""WITH {JUDGED}, c AS (SELECT run_id, count(*) FILTER (named) / count(*) AS share FROM said GROUP BY 1)
SELECT run_id, code, CASE WHEN named THEN {r4('greatest(0, least(100, s_acctbal / 50))')} END AS llm_score, CASE WHEN named THEN least(1, code % 120)::DOUBLE END AS llm_confidence, CASE WHEN named THEN CASE WHEN code % 3 = 0 THEN 'banks' ELSE '' END END AS llm_sector, CASE WHEN named THEN 'big' END AS llm_risks, {r4('share')} AS llm_coverage FROM said JOIN c USING (run_id)""",
        "judged_problems": f"""WITH {JUDGED}, r AS (SELECT DISTINCT run_id FROM said WHERE code % 5 <> 0)
SELECT run_id, 'no_json_found' AS problem, 1 AS n FROM r WHERE run_id % 5 = 3 UNION ALL SELECT run_id, unnest(['non_object_item', 'unknown_code:999999']), 1 FROM r WHERE run_id % 5 <> 3
UNION ALL SELECT run_id, 'duplicate_code:' || lpad(code::VARCHAR, 6, '0'), 1 FROM said WHERE named AND code % 7 = 0""",
    }
)

SQL["topic_resolution_many"] = topics(
    "SELECT DISTINCT p_name || ' ' || replace(p_brand, '#', '概') AS query FROM part",
    "SELECT topic, heat, unnest(list_distinct([topic] || aliases)) AS alias FROM (SELECT p_type || ' ' || p_name AS topic, max(p_size) AS heat, list_distinct(flatten(list([p_name, p_brand || '-' || p_type]))) AS aliases FROM part GROUP BY 1)",
    3,
)
