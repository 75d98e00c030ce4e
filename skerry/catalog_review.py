"""Queries of reviews, hotspot discovery, judges' answers and exact medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import big, day, query, r4
from .catalog_more import _evaluated, _stocks
from .functions.num import rounded
from .operators import boards as BO
from .operators import evaluate as E
from .operators import flow
from .operators import hotspots as HS
from .operators import review as RV
from .operators.places import medians
from .sources import bindings as D
from .sources import envelopes as EN
from .sources.bindings import table
from .sources.staged import staged


def _reviewed(spark, d):
    """Line items as evaluated picks, with labels, flags and shapes made of their other columns."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    q = D.quotes(D.bars(spark, d)).select("code", "date", F.col("close").alias("price"))
    n, qty, disc, tax = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    some = lambda *xs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in xs]))
    picks = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("l_suppkey").alias("code"),
        n.alias("rank"),
        F.when(n == 7, 0.0).otherwise(F.col("l_extendedprice") / qty).alias("entry"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("llm_sector"),
        F.col("l_linestatus").alias("llm_theme"),
        F.when(n == 1, "failed_breakout").when(n == 2, "breakout_unconfirmed").when(n == 3, "pullback_rebound").otherwise("").alias("shape_status"),
        F.when(n == 6, "missing").otherwise("ok").alias("path_status"),
        (-qty / 4).alias("max_drawdown_pct"),
        some((disc > 0.05, "discounted"), (n % 2 == 0, " even "), (n % 2 == 0, "even")).alias("llm_tags"),
        some((tax > 0.04, "taxed")).alias("llm_catalysts"),
        some((qty > 40, "big"), (qty > 40, "big"), (tax > 0.07, "dear")).alias("llm_risks"),
        some((disc > 0.08, "high_discount")).alias("risk_flags"),
        some((n > 5, "late")).alias("post_analysis_tags"),
    )
    return E.returns(picks, q)


@query
def eval_failure_summary(spark, d):
    return RV.failure_summary(_reviewed(spark, d))


@query
def eval_failure_dimensions(spark, d):
    return RV.failure_dimensions(_reviewed(spark, d))


@query
def eval_signal_review(spark, d):
    return RV.signal_stats(_reviewed(spark, d))


@query
def eval_strategy_suggestions(spark, d):
    return RV.strategy_suggestions(_reviewed(spark, d))


@query
def eval_medians_spread(spark, d):
    """Exact medians of all strategies' returns, with no group in one task."""
    return medians(staged(_evaluated(spark, d).select("strategy", "return_pct"), "returns"), ["strategy"], "return_pct").select("strategy", rounded("median").alias("median_return_pct"))


@query
def flow_snapshot_asof(spark, d):
    s = flow.snapshot(D.moneyflow(spark, d), D.bars(spark, d), "1997-06-30")
    return s.select("code", day("as_of"), *big("main_inflow_streak"), "main_net_inflow", "main_net_inflow_5d", "main_net_inflow_rate", "price_up_flow_out", "price_down_flow_in")


@query
def flow_given_main(spark, d):
    """Codes whose rows tell their main inflow on some day keep it; the others' is derived."""
    f = D.moneyflow(spark, d)
    told = F.when((F.col("code") % 3 == 0) & (F.dayofmonth("date") == 5), 7.5)
    return flow.derive(f.withColumn("main_net_inflow", told)).select("code", day(), *r4("main_net_inflow"))


def _topics(spark, d):
    """Nations as boards from two sources, their trends by events of the first twenty, their suppliers as stocks."""
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("topic"))
    key = F.col("n_nationkey")
    boards = nation.select("topic", F.explode(F.array(F.lit("concept"), F.lit("industry"))).alias("source"), key)
    boards = boards.select("topic", "source", (key % 7 - 3).cast("double").alias("change_pct"), (key + 1).alias("rank"), (50.0 + key % 4 * 5 + F.when(F.col("source") == "industry", key % 3).otherwise(0)).alias("heat"))
    e = table(spark, d, "events").join(nation, F.col("user_id") % 20 == key)
    history = e.groupBy(F.col("topic").alias("board"), F.to_date("ts").alias("at")).agg(F.least(F.lit(100.0), rounded(F.avg("value"))).alias("heat"))
    s = _stocks(spark, d).join(nation, F.col("board") == F.col("topic")).where(key % 8 != 3)
    c = F.col("code")
    stocks = s.select("topic", "code", F.concat(F.lit("S"), c).alias("name"), "change_pct", "amount", (c % 12).cast("double").alias("turnover_rate"), (c % 4).cast("double").alias("volume_ratio"), ((c % 9 - 4) * 1e6).alias("net_inflow"), (c % 10 == 0).alias("is_limit_up"), (c % 5).alias("active_days"), (c % 6).alias("evidence_count"))
    return boards, BO.heat_trends(history), stocks


@query
def hotspot_discover(spark, d):
    out = HS.discover(*_topics(spark, d), top=12)
    return out.select(*big("rank"), "topic", "source", "heat_score", "trend", *big("observations"), "stage", *big("stock_count"), "leaders", "missing_fields")


@query
def hotspot_detail(spark, d):
    boards, _, stocks = _topics(spark, d)
    return HS.detail(boards.where("rank <= 6"), stocks, 4).select("topic", *big("place"), "code", "name", "hot_stock_score", "role")


def _answers(spark, d):
    """Judges' answers on each nation's suppliers: a list, an object with a ranking, or one with words around it; some codes come twice, one isn't asked for, one item is a number."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("code"), "s_acctbal")
    c = F.col("code")
    item = F.struct(
        F.concat(F.when(c % 2 == 0, "SH").otherwise(""), F.lpad(c.cast("string"), 6, "0")).alias("code"),
        (F.col("s_acctbal") / 50).alias("llm_score"),
        F.concat((c % 120).cast("string"), F.lit("")).alias("confidence"),
        F.when(c % 3 == 0, "banks").alias("industry"),
        F.array(F.lit(" big "), F.lit("big"), F.lit("")).alias("risk_flags"),
    )
    rows = s.where(c % 5 != 0).select("run_id", F.explode(F.sequence(F.lit(0), F.when(c % 7 == 0, 1).otherwise(0))).alias("again"), c, item.alias("item"))
    texts = rows.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("again", "code", F.to_json("item").alias("j")))), lambda x: x["j"]), ",").alias("j"))
    listed = F.concat(F.lit('[17, {"code": "999999"}, '), F.col("j"), F.lit("]"))
    ranked = F.concat(F.lit('{"market_view": "flat", "ranked": '), listed, F.lit("}"))
    k = F.col("run_id") % 5
    text = F.when(k == 0, listed).when(k == 1, ranked).when(k == 2, F.concat(F.lit("Here it is:\n```json\n"), ranked, F.lit("\n```\nDone."))).when(k == 3, "I can't tell.").otherwise(ranked)
    return s.select("run_id", "code"), texts.select("run_id", text.alias("response"))


@query
def judged_ranking(spark, d):
    picks, answers = _answers(spark, d)
    typed, _ = EN.typed_ranking(EN.judged_items(answers), picks)
    return typed.select("run_id", "code", rounded("llm_score").alias("llm_score"), "llm_confidence", "llm_sector", F.array_join("llm_risks", ",").alias("llm_risks"), rounded("llm_coverage").alias("llm_coverage"))


@query
def judged_problems(spark, d):
    picks, answers = _answers(spark, d)
    _, problems = EN.typed_ranking(EN.judged_items(answers), picks)
    return problems.groupBy("run_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def topic_resolution_many(spark, d):
    """Names of parts with their brands, asked for among names of parts with their kinds, which go by several names."""
    p = table(spark, d, "part")
    asked = p.select(F.concat_ws(" ", "p_name", F.translate("p_brand", "#", "概念")).alias("query"))
    topics = p.select(F.concat_ws(" ", "p_type", "p_name").alias("topic"), F.array(F.col("p_name"), F.concat_ws("-", "p_brand", "p_type")).alias("alias"), F.col("p_size").alias("size"))
    topics = topics.groupBy("topic").agg(F.array_distinct(F.flatten(F.collect_list("alias"))).alias("aliases"), F.max("size").cast("double").alias("heat"))
    return BO.resolve_topics(asked, topics, 3).select("query", *big("rank"), "topic", "confidence", "canonical")
