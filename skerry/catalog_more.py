"""More registered queries: boards, hotspots, evaluation, histories, quality, upkeep and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _picks, _scored, big, day, query, r4
from .functions.num import rounded
from .operators import bars as B
from .operators import boards as BO
from .operators import evaluate as E
from .operators import flow
from .operators import history as H
from .operators import scoring
from .operators import pattern as P
from .operators import pattern_search as PS
from .operators.places import By, numbered
from .sources import bindings as D
from .sources.bindings import table

NOW = "1999-01-01 12:00:00"


@query
def board_membership(spark, d):
    return BO.membership(D.membership(spark, d)).select("code", "board_type", "board")


def _flow_last(spark, d):
    f = B.last_bars(flow.rolling(flow.derive(D.moneyflow(spark, d))))
    return f.select("code", "date", rounded("main_net_inflow_5d").alias("main_net_inflow_5d"))


@query
def board_flow_rank(spark, d):
    r = BO.flow_rank(_flow_last(spark, d), BO.membership(D.membership(spark, d)), "main_net_inflow_5d")
    return r.select("board_type", "board", *big("rank", "stock_count"), "total", "mean", day("as_of"))


@query
def board_flow_top_stocks(spark, d):
    return BO.top_stocks(_flow_last(spark, d), BO.membership(D.membership(spark, d)), "main_net_inflow_5d").select("board_type", "board", *big("rank"), "code", "main_net_inflow_5d")


def _heat(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("board"), F.to_date("ts").alias("at")).agg(F.least(F.lit(100.0), rounded(F.avg("value"))).alias("heat"))


@query
def board_heat_trend(spark, d):
    return BO.heat_trends(_heat(spark, d)).select("board", *big("observations"), "latest", "trend", "cooling", "persistence", "state")


@query
def hotspot_rank(spark, d):
    return BO.hotspots(BO.heat_trends(_heat(spark, d))).select(*big("rank"), "board", "hot_score", "stage")


@query
def board_heat_score(spark, d):
    s = D.snapshot(spark, d)
    g = s.groupBy(F.col("industry").alias("board")).agg(F.avg("change_pct").alias("c"))
    g = numbered(g, [By("c", descending=True), By("board")])
    return g.select("board", *big("rank"), BO.heat_score(F.col("c") / 100, F.col("rank")).alias("heat"))


def _stocks(spark, d):
    s = D.snapshot(spark, d)
    c = F.col("change_pct") / 10
    score = BO.stock_score(c, F.col("amount") * 1000, F.col("turnover_rate"), F.col("volume_ratio"), F.col("change_pct") * 1e6, c >= 5, F.col("code") % 5, F.col("code") % 6)
    return s.select("code", F.col("industry").alias("board"), rounded(c).alias("change_pct"), rounded("amount").alias("amount"), score.alias("hot_stock_score"))


@query
def stock_roles(spark, d):
    return BO.roles(_stocks(spark, d)).select("board", "code", *big("rank"), "hot_stock_score", "role")


@query
def timeline_route(spark, d):
    e = table(spark, d, "events")
    ev = e.select(F.col("event_type").alias("topic"), F.col("ts").alias("at"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), F.concat(F.lit("t"), F.col("user_id") % 20).alias("title"), rounded("value").alias("impact"), F.array((F.col("user_id") % 7).cast("string")).alias("codes"))
    return BO.timeline_route(ev).select("topic", day("day"), *big("events"), "lead", "impact", "codes")


def _evaluated(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    q = D.quotes(D.bars(spark, d)).select("code", "date", F.col("close").alias("price"))
    picks = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("created"), F.col("l_suppkey").alias("code"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"), F.col("l_returnflag").alias("sector"), F.col("l_linestatus").alias("side"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
    )
    return E.returns(picks, q, 10.0)


@query
def eval_returns(spark, d):
    return _evaluated(spark, d).select("run_id", "code", *r4("entry", "return_pct"), "status")


@query
def eval_summary(spark, d):
    return E.summary(_evaluated(spark, d))


@query
def eval_portfolio(spark, d):
    return E.portfolios(_evaluated(spark, d))


@query
def eval_by_label(spark, d):
    return E.by_label(_evaluated(spark, d), F.when(F.col("sector") == "N", " ").otherwise(F.col("sector")))


def _tags():
    return F.filter(F.array(F.when(F.col("tax") > 0.04, F.lit("taxed")), F.when(F.col("discount") > 0.05, F.lit("discounted")), F.when(F.col("side") == "F", F.lit("filled"))), lambda x: x.isNotNull())


@query
def eval_by_multi_label(spark, d):
    return E.by_labels(_evaluated(spark, d), _tags())


@query
def eval_event_signals(spark, d):
    return E.event_signals(_evaluated(spark, d), _tags())


@query
def eval_holding_period(spark, d):
    return E.by_label(_evaluated(spark, d), E.holding_period(F.col("created"), F.lit(NOW).cast("timestamp")))


@query
def eval_failure_review(spark, d):
    return E.failures(_evaluated(spark, d), ["strategy", "sector", "side", "status"])


@query
def eval_shape_status(spark, d):
    b = B.last_bars(B.shape(B.averages(B.recent(D.bars(spark, d), 21)))).select("code", "breakout_20d_pct", "pullback_to_ma20_pct")
    rows = _evaluated(spark, d).join(b, "code").withColumn("shape", E.shape_status())
    return E.by_label(rows, F.col("shape"))


@query
def performance_history(spark, d):
    return E.strategies(_evaluated(spark, d))


@query
def eval_price_path(spark, d):
    picks = _evaluated(spark, d).select("run_id", "code", "created", "entry")
    return E.price_path(picks, D.bars(spark, d)).select("run_id", "code", rounded("entry").alias("entry"), "path_days", "path_end_pct", "path_drawdown_pct", "path_runup_pct")


@query
def eval_windows(spark, d):
    """One evaluation per window of days, by one pass over picks exploded by a literal list."""
    rows = _evaluated(spark, d).select("*", F.explode(F.array(*[F.lit(n) for n in (30, 365, 2000)])).alias("window_days"))
    now = F.lit(NOW).cast("timestamp")
    inside = rows.where(F.datediff(now, F.col("created")) <= F.col("window_days"))
    return E.rolled(inside.select("window_days", "strategy", "return_pct"), ["window_days", "strategy"]).withColumn("window_days", F.col("window_days").cast("long"))


@query
def run_history(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("picks"))
    runs = o.join(n, o["o_orderkey"] == n["l_orderkey"], "left").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("created"), F.coalesce("picks", F.lit(0)).alias("picks"))
    return H.run_history(runs)


@query
def source_history(spark, d):
    o = table(spark, d, "orders")
    return H.source_history(o.select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("errors"), F.when(F.col("o_totalprice") > 400000, 1).otherwise(0).alias("degraded"), (F.col("o_totalprice") < 2000).alias("fallback")))


@query
def market_breadth(spark, d):
    return H.breadth(D.snapshot(spark, d))


@query
def candidate_profile(spark, d):
    return H.factor_leaders(_scored(spark, d), ["value", "liquidity", "momentum", "size"])


@query
def label_distribution(spark, d):
    return H.label_distribution(D.snapshot(spark, d), F.col("industry")).select(*big("rank"), "label", "n")


@query
def snapshot_quality(spark, d):
    o = table(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    return H.field_quality(o, ["tax", "l_discount", "l_quantity"], "l_orderkey")


@query
def source_reconciliation(spark, d):
    return H.reconcile_sources(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def _batches(spark, d):
    b = D.bars(spark, d).select("code", "date", "close", "volume")
    old = b.where("date < date '1998-06-01'")
    new = b.where("date >= date '1998-01-01'").withColumn("close", F.when(F.dayofmonth("date") == 3, F.col("close") + 1).otherwise(F.col("close")))
    return old, new


@query
def upsert_keep_last(spark, d):
    return H.keep_last(*_batches(spark, d), ["code", "date"]).select("code", day(), *r4("close", "volume"))


@query
def reconcile_diff(spark, d):
    old, new = _batches(spark, d)
    return H.diff(old, new, ["code", "date"], ["close", "volume"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def factor_change_rebuild(spark, d):
    f = D.factors(D.bars(spark, d))
    changed = f.withColumn("adj_factor", F.when((F.col("code") % 5 == 0) & (F.year("date") >= 2001), F.col("adj_factor") * 1.5).otherwise(F.col("adj_factor")))
    return H.rebuilt(D.bars(spark, d), f, changed).select("code", day(), *r4("close"))


@query
def calendar_gaps(spark, d):
    return H.calendar_gaps(D.bars(spark, d)).select("code", "bars", *big("days", "missing"))


@query
def pattern_lp(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.alias("a"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = a.join(b, "vec_id")
    return j.select("vec_id", *[rounded(P.lp(F.col("embedding"), F.col("other"), p), 6).alias(p) for p in ("l1", "l2", "linf")])


def _pairs(spark, d):
    e = table(spark, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query
def pattern_cosine(spark, d):
    return _pairs(spark, d).select("vec_id", rounded(P.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query
def pattern_pearson(spark, d):
    return _pairs(spark, d).select("vec_id", rounded(P.pearson(F.col("embedding"), F.col("other")), 6).alias("pearson"))


QUERY = [100, 101, 103, 102, 105, 107, 106, 108, 111, 110, 112, 115, 113, 116, 118, 117, 120, 122, 121, 124]


# whole bars: the closes of QUERY, opened at the close before, with shadows and volumes of different lengths
QUERY_BARS = [
    {"open": QUERY[max(i - 1, 0)], "high": max(c, QUERY[max(i - 1, 0)]) + i % 3, "low": min(c, QUERY[max(i - 1, 0)]) - i % 2, "close": c, "volume": 20 + 7 * (i % 5)} for i, c in enumerate(QUERY)
]


@query
def pattern_closes_topk(spark, d):
    return P.search(D.bars(spark, d), QUERY, "pearson").select(*big("rank"), "code", day("end"), "similarity")


def _similar(spark, d, metric):
    found = PS.search(D.bars(spark, d), QUERY_BARS, metric)
    shown = [f"{g}_similarity" for g in PS.GROUPS] if metric != "dtw" else []
    return found.select(*big("rank"), "code", day("start"), day("end"), *shown, "similarity")


@query
def pattern_search_topk(spark, d):
    return _similar(spark, d, "euclidean")


@query
def pattern_search_manhattan(spark, d):
    return _similar(spark, d, "manhattan")


@query
def pattern_search_chebyshev(spark, d):
    return _similar(spark, d, "chebyshev")


@query
def pattern_search_pearson(spark, d):
    return _similar(spark, d, "pearson")


@query
def pattern_search_spearman(spark, d):
    return _similar(spark, d, "spearman")


@query
def pattern_search_cosine(spark, d):
    return _similar(spark, d, "cosine")


@query
def pattern_dtw(spark, d):
    return _similar(spark, d, "dtw")


@query
def pattern_window_features(spark, d):
    """The features of each symbol's last 30 bars against the first of them."""
    return PS.window_features(D.bars(spark, d), 30).select("code", day(), *r4(*PS.FEATURES))


@query
def factor_theme_heat(spark, d):
    t = BO.heat_trends(_heat(spark, d))
    t = t.select("board", F.col("latest").alias("board_heat_score"), F.col("trend").alias("board_heat_trend_score"), F.col("observations").alias("board_heat_observations"), F.col("persistence").alias("board_heat_persistence_score"), F.col("cooling").alias("board_heat_cooling_score"))
    boards = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "none")])
    s = D.snapshot(spark, d).withColumn("board", boards[(F.col("code") % 5).cast("int")])
    return scoring.score(s.join(t, "board", "left")).select("code", "factor_theme_heat_score")


@query
def factor_topic_alignment(spark, d):
    """Codes without a route, with one that names their industry, and with one that doesn't."""
    kind = F.col("code") % 4
    route = F.when(kind == 0, F.lit(None)).when(kind == 1, F.concat(F.regexp_replace("industry", " ", "_"), F.lit(":+1.20%:rank=3 | x"))).otherwise("elsewhere:+2%:rank=1")
    s = D.snapshot(spark, d).withColumn("board_heat_summary", route).withColumn("industry", F.regexp_replace("industry", " ", "_")).withColumn("board_heat_score", F.lit(70.0))
    return scoring.score(s).select("code", "factor_topic_alignment_score")


@query
def topic_resolution(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("topic"), F.array(F.concat(F.lit("the "), F.col("n_name"))).alias("aliases"), F.col("n_nationkey").cast("double").alias("heat"))
    asked = spark.createDataFrame([("nation 1 板块",), ("NATION_12",), ("nati",), ("tonian",), ("",)], "query string")
    return BO.resolve_topics(asked, n).select("query", *big("rank"), "topic", "confidence", "canonical")
