"""Queries of small functions, map merges, pattern features and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import WATERFALL, _picks, big, day, query, r4
from .catalog_more import _evaluated, _heat, _pairs
from .functions import num, text
from .operators import analyzers as A
from .operators import boards as BO
from .operators import bars as B
from .operators import evaluate as E
from .operators import filters, flow
from .operators import pattern as P
from .operators import ranking
from .operators import scoring as SC
from .sources import bindings as D
from .sources.bindings import table


@query
def pattern_spearman(spark, d):
    return _pairs(spark, d).select("vec_id", num.rounded(P.spearman(F.col("embedding"), F.col("other")), 6).alias("spearman"))


@query
def pattern_features(spark, d):
    names = ("close_return", "body", "upper_shadow", "lower_shadow", "amplitude", "log_volume", "pct_change_mean", "pct_change_std", "trend_slope")
    return P.feature_columns(D.bars(spark, d)).select("code", day(), *r4(*names))


@query
def pattern_normalized(spark, d):
    """Sums of the places' numbers times the normalised values, which tell the values' order as well."""
    e = table(spark, d, "embeddings")

    def told(method):
        values = P.normalized(F.col("embedding"), method, 2.0)
        return num.rounded(F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 4).alias(method)

    return e.select("vec_id", *[told(m) for m in ("zscore", "minmax", "robust")])


@query
def field_coverage(spark, d):
    """How many symbols have each field of the snapshot."""
    s = D.snapshot(spark, d)
    fields = ("price", "change_pct", "amount", "pe_ratio", "pb_ratio", "volume_ratio", "turnover_rate", "industry")
    counts = s.agg(F.count(F.lit(1)).alias("total"), *[F.count(f).alias(f) for f in fields])
    return counts.select("total", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields]))).select("col.field", F.col("col.n").alias("known"), "total", num.rounded(F.col("col.n") / F.col("total") * 100).alias("coverage_pct"))


@query
def hotspot_stage(spark, d):
    return BO.heat_trends(_heat(spark, d)).select("board", "state", BO.stage().alias("stage"))


@query
def rejection_summary(spark, d):
    return filters.rejections(D.snapshot(spark, d), WATERFALL).select(*big("step"), "summary")


@query
def loose_values(spark, d):
    """Loose texts as whole numbers, yes or no, and bounded numbers."""
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("yes")).when(F.col("event_id") % 5 == 1, F.lit(" ")).when(F.col("event_id") % 5 == 2, F.concat(F.col("user_id").cast("string"), F.lit("%"))).when(F.col("event_id") % 5 == 3, F.lit("1")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", num.whole_number(raw).alias("whole"), num.truth(raw).alias("said"), num.bounded(raw, 0, 50).alias("bounded"))


@query
def text_lists(spark, d):
    c = D.membership(spark, d).select("code", F.split("concepts", ",").alias("items"))
    return c.select("code", F.array_join(num.text_list(F.transform("items", lambda x: F.concat(F.lit("  "), x)), 5), "|").alias("items"))


@query
def day_keys(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, iso).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit(" "))
    return table(spark, d, "orders").select(F.col("o_orderkey"), text.day_key(raw).alias("day_key"), text.iso_day(raw).alias("iso_day"))


@query
def board_best(spark, d):
    h = _heat(spark, d).withColumn("at", F.col("at").cast("string"))
    return BO.best_of(h, "board", [F.desc("heat"), F.desc("at")]).select("board", "at", "heat")


def _map(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "none")])
    m = D.membership(spark, d)
    summary = F.concat(kinds[(F.col("code") % 5).cast("int")], F.lit(":+1.20%:rank=3 | "), kinds[(F.col("code") % 3).cast("int")], F.lit(":-2%"))
    return m.select("code", summary.alias("board_heat_summary"))


@query
def trend_attach(spark, d):
    t = BO.attach_trends(_map(spark, d), BO.heat_trends(_heat(spark, d)))
    return t.select("code", "board_heat_observations", "board_heat_latest", "board_heat_trend", "board_heat_state")


@query
def map_merge(spark, d):
    m = D.membership(spark, d)
    n = F.col("code").cast("double")
    rank, heat, trend = (F.when(F.col("code") % k != 0, (n * f) % 50) for k, f in ((4, 3), (5, 7), (6, 11)))
    first = m.where("code % 3 <> 0").select("code", F.when(F.col("code") % 2 == 0, "").otherwise(F.col("industry")).alias("industry"), "concepts", rank.alias("industry_rank"), heat.alias("heat"), trend.alias("trend"))
    second = m.where("code % 7 <> 0").select("code", F.lit("other").alias("industry"), F.concat(F.lit("new,"), "concepts").alias("concepts"), F.lit(9.0).alias("industry_rank"), F.lit(20.0).alias("heat"), F.lit(-25.0).alias("trend"))
    return BO.merge_maps(first, second)


@query
def flag_counts(spark, d):
    from .functions.text import flags_of

    s = D.snapshot(spark, d).select(flags_of([(F.coalesce(F.col("change_pct") > 0, F.lit(False)), "up"), (F.coalesce(F.col("pe_ratio") < 0, F.lit(False)), "loss"), (F.coalesce(F.col("turnover_rate") > 1, F.lit(False)), "busy")]).alias("flags"))
    return BO.flag_counts(s, "flags")


@query
def field_impacts(spark, d):
    """Order priorities as strategies, with the fields that orders of them lack."""
    o = table(spark, d, "orders")
    lacks = F.array_compact(F.array(F.when(F.col("n") % 2 == 0, "volume"), F.when(F.col("n") % 3 == 0, "turnover"), F.when(F.col("total") > 0, "industry")))
    g = o.groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return BO.field_impacts(g.select("strategy", lacks.alias("missing")))


@query
def sub_scores(spark, d):
    return SC.sub_scores(D.snapshot(spark, d)).select("code", "snapshot_score", "tech_score")


@query
def deep_overlay(spark, d):
    """Picks with every advice and trend, blanks around them, unknown words and missing scores."""
    c = F.col("code").cast("long")
    said = F.array(*[F.lit(x) for x in (*A.ADVICE, " 买入 ", "?")])[(c % 11).cast("int")]
    trend = F.array(*[F.lit(x) for x in (*A.TREND, "?")])[(c % 5).cast("int")]
    picks = _picks(spark, d).withColumns(
        {
            "deep_status": F.when(c % 6 != 0, "completed").otherwise("failed"),
            "deep_signal_score": F.when(c % 3 != 0, c * 7 % 101),
            "deep_sentiment_score": F.when(c % 4 != 0, c * 13 % 101),
            "deep_advice": said,
            "deep_trend": trend,
            "deep_flags": F.array_repeat(F.lit("flag"), (c % 5).cast("int")),
        }
    )
    return A.analyze(picks, ["dsa"]).select(*big("rank"), "code", "final_score")


@query
def external_overlay(spark, d):
    picks = _picks(spark, d).withColumn("risk_flags", F.when(F.col("code") % 2 == 0, "high_pb"))
    item = lambda part, seq, delta, flags: picks.where(part).select(F.lit(seq).cast("long").alias("seq"), "code", delta.alias("score_delta"), flags.alias("risk_flags"))
    items = item("code % 3 <> 0", 2, (F.col("code") % 9 - 4) / 2.0, F.array(F.lit("late"), F.lit("high_pb"))).unionByName(item("code % 6 = 1", 1, F.lit(None).cast("double"), F.array(F.lit(" early "), F.lit(""))))
    out = A.analyze(picks, ["external_http"], {"external_http": {"items": items, "most": 40}})
    return out.select(*big("rank"), "code", "external_status", "risk_flags", "final_score")


@query
def hotspot_quality(spark, d):
    c, none = F.col("c_custkey"), F.array().cast("array<string>")
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.when(c % 4 != 0, F.col("c_mktsegment")).alias("canonical_topic"),
        F.when(c % 5 != 0, "em").otherwise("").alias("source"),
        (c % 3).alias("stock_count"),
        F.when(c % 2 == 0, F.array(F.lit("one"))).otherwise(none).alias("leaders"),
        F.when(c % 7 == 0, F.array(F.lit("heat"), F.lit("heat"))).alias("missing_fields"),
        F.when(c % 8 == 0, F.array(F.lit("x"))).otherwise(none).alias("resolver_candidates"),
        (c % 11 == 0).alias("stale"),
        BO.stale_confidence(F.lit(0.65), F.when(c % 9 != 0, c % 100)).alias("confidence"),
    )
    return BO.hotspot_quality(rows).select("c_custkey", F.array_join("missing_fields", ",").alias("missing"), "quality_status", "confidence")


@query
def risk_lists(spark, d):
    """Risk by another profile, with what a judge and a deep analysis warn of."""
    c = F.col("code").cast("long")
    warned = F.array_repeat(F.lit("warned"), (c % 5).cast("int"))
    picks = _picks(spark, d).withColumns({"llm_risks": F.when(c % 3 != 0, F.array_append(warned, "")), "deep_flags": F.array(F.lit("deep"), F.lit("high_pb"))})
    out = ranking.risk_overlay(picks, profile={"high_pb": 2.0, "llm_risk_points": 1.25})
    return out.select(*big("rank"), "code", "risk_points", "risk_flags", "final_score")


@query
def eval_path_summary(spark, d):
    picks = _evaluated(spark, d).select("run_id", "code", "created", "entry")
    return E.path_summary(E.price_path(picks, D.bars(spark, d)))


@query
def daily_quality_fetched(spark, d):
    fetched = D.membership(spark, d).where("code % 4 <> 0").select("code", (F.col("code") % 3 == 0).alias("daily_stale"), (F.col("code") % 6).cast("int").alias("source_errors"))
    return B.quality(D.bars(spark, d), fetched).select("code", "daily_data_points", "daily_quality_score", "daily_quality_flags")


@query
def flow_without_bars(spark, d):
    f = flow.against_bars(flow.derive(D.moneyflow(spark, d)), None)
    return f.select("code", day(), *r4("turnover_amount"), "price_up_flow_out", "price_down_flow_in")
