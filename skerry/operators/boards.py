"""Boards: membership, money-flow ranking, heat, hotspots and roles (SET-01, JOIN-05, AGG-01, AGG-21, SRT-05, HOT-01 to HOT-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clip, rounded
from ..functions.text import labels, match_score, topic_key
from ..sources.staged import staged
from .places import By, few_numbered


def membership(m: DataFrame) -> DataFrame:
    """(code, board_type, board) from industry and concept labels, once each, without blanks."""
    industry = m.select("code", F.lit("industry").alias("board_type"), F.trim("industry").alias("board")).where("board <> ''")
    concept = m.select("code", F.lit("concept").alias("board_type"), F.explode(labels(F.col("concepts"))).alias("board"))
    return industry.unionByName(concept).distinct()


def flow_rank(flows: DataFrame, members: DataFrame, metric: str, top: int = 10) -> DataFrame:
    """Boards by the sum of a metric of their stocks, the top of each type; a sum of nothing is 0. Sums are exact in units of 1e-6, so that neither they nor means depend on the order of rows."""
    total = F.sum(F.col(metric).cast("decimal(28,6)")).cast("double")
    g = members.join(flows, "code").groupBy("board_type", "board").agg(
        F.count(metric).alias("stock_count"), rounded(F.coalesce(total, F.lit(0.0))).alias("total"), rounded(total / F.count(metric)).alias("mean"), F.max("date").alias("as_of")
    )
    place = F.row_number().over(Window.partitionBy("board_type").orderBy(F.desc("total"), "board"))
    return g.withColumn("rank", place).where(F.col("rank") <= top)


def top_stocks(flows: DataFrame, members: DataFrame, metric: str, top: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("board_type", "board").orderBy(F.desc_nulls_last(metric), "code"))
    return members.join(flows, "code").withColumn("rank", place).where(F.col("rank") <= top).select("board_type", "board", "rank", "code", metric)


def heat_score(change: Column, rank: Column) -> Column:
    bonus = F.when(rank > 0, F.greatest(F.lit(0.0), 12 - F.least(rank.cast("double"), F.lit(12.0)))).otherwise(0.0)
    return rounded(clip(50 + F.coalesce(change * 6, F.lit(0.0)) + bonus, 0, 100))


def heat_trends(history: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Trend, cooling, persistence and state of each board from its last five observations (board, at, heat)."""
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("at")))
    last = history.where(F.col("heat").between(0, 100)).withColumn("_p", place).where("_p <= 5")
    g = last.groupBy("board").agg(
        F.count(F.lit(1)).alias("observations"), F.min_by("heat", "at").alias("_first"), F.max_by("heat", "at").alias("_latest"), F.max(F.when(F.col("_p") == 2, F.col("heat"))).alias("_prev"), F.max("heat").alias("_hot"), F.avg(F.when(F.col("heat") >= 60, 100.0).otherwise(0.0)).alias("_persist")
    )
    trend, cooling = F.col("_latest") - F.col("_first"), F.greatest(F.coalesce(F.col("_prev") - F.col("_latest"), F.lit(0.0)), F.lit(0.0))
    state = F.when(F.col("cooling") >= threshold, "cooling").when(F.col("trend") >= threshold, "warming").when((F.col("persistence") >= 66.6667) & (F.col("_hot") > 0), "persistent_hot").when(F.col("trend") <= -threshold, "weakening").otherwise("flat")
    g = g.withColumns({"latest": rounded("_latest"), "trend": rounded(trend), "cooling": rounded(cooling), "persistence": rounded("_persist")}).withColumn("state", state)
    return g.select("board", "observations", "latest", "trend", "cooling", "persistence", "state")


def stage() -> Column:
    """A hotspot's stage from state, trend, cooling, persistence, latest, observations (HOT-03)."""
    weak = (F.col("latest") < 60) | (F.col("trend") <= -5)
    return (
        F.when(F.col("state").isin("weakening", "cooling") & weak, "降温退潮")
        .when((F.col("cooling") >= 8) & weak, "降温退潮")
        .when(F.col("cooling") >= 5, "分歧放量")
        .when((F.col("latest") >= 75) & (F.col("trend") >= 8) & (F.col("persistence") >= 50), "加速主升")
        .when((F.col("state") == "persistent_hot") | (F.col("persistence") >= 66.6667), "确认扩散")
        .when((F.col("trend") >= 5) & (F.col("observations") >= 2), "确认扩散")
        .otherwise("初次异动")
    )


def hotspots(trends: DataFrame, top: int = 10) -> DataFrame:
    """Boards with their stage, by heat with trend and persistence for and cooling against them (SRT-07)."""
    key = F.col("latest") + 0.35 * F.greatest(F.col("trend"), F.lit(0.0)) + 0.05 * F.col("persistence") - 0.6 * F.col("cooling")
    rows = trends.withColumn("hot_score", rounded(key)).withColumn("stage", stage())
    return few_numbered(rows, [By("hot_score", descending=True), By("board")], top)


def stock_score(change: Column, amount: Column, turnover: Column, ratio: Column, inflow: Column, limit_up: Column | None = None, active: Column | None = None, evidence: Column | None = None) -> Column:
    """A constituent's strength, with bonuses for a limit-up, days of activity and pieces of evidence where they are known (HOT-04)."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    size = F.when(amount > 0, clip((F.log10(amount) - 6) / 4 * 18, 0, 18)).otherwise(0.0)
    money = F.when(inflow > 0, clip((F.log10(inflow) - 5) / 4 * 12, 0, 12)).when(inflow < 0, -clip((F.log10(-inflow) - 5) / 4 * 8, 0, 8)).otherwise(0.0)
    score = 35 + clip(z(change) * 2.7, -18, 32) + size + clip(z(turnover) * 1.1, 0, 14) + clip(z(ratio) * 3, 0, 12) + money
    if limit_up is not None:
        score = score + F.when(limit_up, 8.0).otherwise(0.0)
    for c, each in ((active, 2.5), (evidence, 2.0)):
        if c is not None:
            score = score + clip(z(c.cast("double").cast("long").cast("double")) * each, 0, 8)
    return rounded(clip(score, 0, 100))


def roles(stocks: DataFrame) -> DataFrame:
    """Roles within each board by score and place (HOT-05); needs board, code, hot_stock_score, change_pct, amount."""
    w = Window.partitionBy("board")
    place = F.row_number().over(w.orderBy(F.desc("hot_stock_score"), F.desc_nulls_last("change_pct"), F.desc_nulls_last("amount"), F.desc("code")))
    rows = stocks.withColumn("rank", place).withColumn("_top", F.max("hot_stock_score").over(w))
    s, c = F.col("hot_stock_score"), F.coalesce("change_pct", F.lit(0.0))
    role = (
        F.when((F.col("rank") == 1) & (s >= 70), "核心龙头")
        .when((F.col("rank") <= 3) & (s >= F.greatest(F.lit(68.0), F.col("_top") - 8)) & (c >= 5), "核心龙头")
        .when((s >= 62) & (c >= 3), "助攻")
        .when((s >= 48) & (c >= 0), "补涨")
        .when(s >= 38, "后排")
        .otherwise("掉队")
    )
    return rows.withColumn("role", role).drop("_top")


def timeline_route(events: DataFrame) -> DataFrame:
    """Per topic and day: the lead event by impact, and all its codes in order (AGG-24); events has topic, at, source, title, impact, codes."""
    dedup = events.groupBy("topic", F.to_date("at").alias("day"), "source", "title").agg(F.max_by(F.struct("impact", "at", "codes"), "at").alias("e"))
    lead = F.max_by("title", F.struct("e.impact", "e.at", "source", "title"))
    return dedup.groupBy("topic", "day").agg(F.count(F.lit(1)).alias("events"), lead.alias("lead"), F.max("e.impact").alias("impact"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e.codes")))), ",").alias("codes"))


LEAST_OVERLAP = 45  # percent of characters that two keys must share to match, if neither holds the other


def _grams(key: Column, size: int) -> Column:
    """The different runs of so many characters of a key; none of a shorter one."""
    n = F.length(key)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(key, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def matching_keys(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, k): of all pairs of a query's key (q) and a topic's key (k) at least those that match_score gives more than 0, by equi-joins on runs of characters.

    Sets of characters that overlap enough share one of each set's rarest few. A key that holds the other one holds the rarest of its pairs of characters. How rare a run is, is counted over both
    sides.
    """
    q = queries.select(F.col("q").alias("key"), F.lit("q").alias("side")).where("key <> ''").distinct()
    k = keys.select(F.col("k").alias("key"), F.lit("k").alias("side")).where("key <> ''").distinct()
    both = staged(q.unionByName(k), "topic-keys")

    def ranked(size: int) -> DataFrame:
        grams = both.select("key", "side", F.explode(_grams(F.col("key"), size)).alias("g"))
        often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
        place = F.row_number().over(Window.partitionBy("key", "side").orderBy("often", "g"))
        return staged(grams.join(often, "g").withColumns({"p": place, "n": F.count(F.lit(1)).over(Window.partitionBy("key", "side"))}).drop("often"), "topic-grams")

    side = lambda df, s, name: df.where(F.col("side") == s).select("g", F.col("key").alias(name))
    chars, pairs = ranked(1), ranked(2)
    prefix = chars.where(F.col("p") <= F.col("n") - F.expr(f"(n * {LEAST_OVERLAP} + 99) div 100") + 1)
    rarest = pairs.where("p = 1")
    met = [side(prefix, "q", "q").join(side(prefix, "k", "k"), "g"), side(rarest, "q", "q").join(side(pairs, "k", "k"), "g"), side(pairs, "q", "q").join(side(rarest, "k", "k"), "g")]
    return met[0].unionByName(met[1]).unionByName(met[2]).select("q", "k").distinct()


def resolve_topics(queries: DataFrame, candidates: DataFrame, top: int = 5, least: float = 0.3, sure: float = 0.55) -> DataFrame:
    """The best candidates of each query (query) among topics (topic, aliases, heat), and which one it stands for (HOT-08).

    Only keys that can match are scored, so that queries may be as many as topics; least must be above 0.
    """
    keyed = staged(candidates.select("topic", "heat", F.explode(F.array_distinct(F.concat(F.array("topic"), "aliases"))).alias("alias")).select("topic", "heat", topic_key(F.col("alias")).alias("k")), "topics")
    asked = staged(queries.select("query").distinct().withColumn("q", topic_key(F.col("query"))), "asked")
    score = asked.join(matching_keys(asked, keyed), "q").join(keyed, "k").withColumn("confidence", match_score(F.col("q"), F.col("k")))
    heat = candidates.groupBy("topic").agg(F.max("heat").alias("heat"))
    best = score.groupBy("query", "topic").agg(rounded(F.max("confidence")).alias("confidence")).where(F.col("confidence") >= least).join(heat, "topic")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), F.desc("heat"), F.desc("topic")))
    return best.withColumn("rank", place).where(F.col("rank") <= top).withColumn("canonical", (F.col("rank") == 1) & (F.col("confidence") >= sure))


def best_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order (SET-03); the order should tell rows apart."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def summary_boards(summary: Column) -> Column:
    """The boards that a heat summary names: what comes before the first colon of each part."""
    parts = F.transform(F.split(F.coalesce(summary, F.lit("")), r"\|"), lambda p: F.trim(F.substring_index(F.trim(p), ":", 1)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def attach_trends(mapping: DataFrame, trends: DataFrame) -> DataFrame:
    """mapping (code, board_heat_summary, ...) with the trend of that of its summary's boards which was seen most, then is hottest, then moves most (JOIN-11)."""
    named = mapping.select("code", F.explode(summary_boards(F.col("board_heat_summary"))).alias("board"))
    met = named.join(trends.select("board", "observations", "latest", "trend", "persistence", "cooling", "state"), "board")
    best = met.groupBy("code").agg(F.max(F.struct("observations", "latest", F.abs("trend").alias("move"), "board", "trend", "persistence", "cooling", "state")).alias("b"))
    fields = [F.col(f"b.{c}").alias(f"board_heat_{c}") for c in ("observations", "latest", "trend", "persistence", "cooling", "state")]
    return mapping.join(best.select("code", *fields), "code", "left")


def merge_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two maps (code, industry, concepts, industry_rank, heat, trend) as one (SET-06).

    The first industry that isn't blank, the union of concepts in order, the least rank, the greatest heat, the trend that moves most.
    """
    a, b = (m.select("code", *[F.col(c).alias(f"{s}_{c}") for c in ("industry", "concepts", "industry_rank", "heat", "trend")]) for m, s in ((first, "a"), (second, "b")))
    j = a.join(b, "code", "full")
    labels = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    moves = F.coalesce(F.abs("b_trend") > F.abs("a_trend"), F.col("a_trend").isNull())
    return j.select(
        "code",
        F.coalesce(F.when(F.col("a_industry") != "", F.col("a_industry")), F.when(F.col("b_industry") != "", F.col("b_industry")), F.lit("")).alias("industry"),
        F.array_join(F.array_union(labels(F.col("a_concepts")), labels(F.col("b_concepts"))), ",").alias("concepts"),
        F.least("a_industry_rank", "b_industry_rank").alias("industry_rank"),
        F.greatest("a_heat", "b_heat").alias("heat"),
        F.when(moves, F.col("b_trend")).otherwise(F.col("a_trend")).alias("trend"),
    )


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    """How often each flag of a column of flags, joined by semicolons, occurs (AGG-23)."""
    return rows.select(F.explode(F.split(F.col(flags), ";")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def field_impacts(coverage: DataFrame) -> DataFrame:
    """By missing field, how many strategies (strategy, missing array) it holds up, and which, most first (AGG-20)."""
    each = coverage.select("strategy", F.explode("missing").alias("field"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("strategy_count"), F.array_join(F.sort_array(F.collect_list("strategy")), ",").alias("strategies"))


def hotspot_quality(df: DataFrame) -> DataFrame:
    """missing_fields completed by what a hotspot lacks, and its quality_status (HOT-10).

    Takes canonical_topic, source, stock_count, leaders, missing_fields, resolver_candidates (arrays) and stale; a null counts as blank, none or false.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.array_size(c), F.lit(0)) == 0
    no_stocks = (F.coalesce("stock_count", F.lit(0)) <= 0) & none("leaders")
    lacks = F.array_compact(F.array(F.when(blank("canonical_topic"), "canonical_topic"), F.when(blank("source"), "source"), F.when(no_stocks, "stocks")))
    out = df.withColumn("missing_fields", F.array_distinct(F.concat(F.coalesce("missing_fields", F.array().cast("array<string>")), lacks)))
    unknown = F.array_contains("missing_fields", "canonical_topic") & none("resolver_candidates")
    status = F.when(F.coalesce("stale", F.lit(False)), "stale").when(unknown, "failed").when(~none("missing_fields"), "partial").otherwise("available")
    return out.withColumn("quality_status", status)


def stale_confidence(base: Column, age_hours: Column) -> Column:
    """The confidence of an old answer: whole for a day, then less by age, never below half."""
    less = F.greatest(base * 0.5, base - F.least(age_hours / 240.0, F.lit(0.25)))
    return rounded(F.when(age_hours > 24, less).otherwise(base))
