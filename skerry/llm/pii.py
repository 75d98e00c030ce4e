"""Personal data: fixed patterns, and bootstrapped contextual extraction on top of them.

What the fixed patterns find are seed entities. The two words before an entity are a lexical pattern; patterns and the
values they introduce form a graph that is scored iteratively. Candidates are words and runs of digit groups. Values that only confident patterns
introduce, and that have the shape of the pattern's kind, are further identifiers. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
# The kinds' patterns, written so that a scan takes linear time: what can't match from the start of a run of its first
# letters can't match from within it, unless a match ended there (\G); and nothing repeated is ever given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_GROUPS = r"[(+]*+[0-9]++(?:[().,:/+-]++[0-9]++)*+"
RUN = rf"(?<!\S){_GROUPS}(?:\)?+[\x20-]++{_GROUPS})*+\)?+(?=[().,:;!?-]*+(?!\S))"
ADDRESS = r"[0-9]+[^0-9a-z]+[0-9]+[^0-9a-z]+[0-9]+[^0-9a-z]+[0-9]+"
LEFT = 64
SPAN = "struct<start:int,kind:int,stop:int,context:string,value:string>"
MIN_SUPPORT = 3
CONFIDENCE = 0.75
ROUNDS = 3


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        x = F.substring(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.coalesce(F.try_to_number(part(p), F.lit("999")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits_of(s)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(s)).between(10, 15)
    return F.lit(True)


def context_of(gap: Column) -> Column:
    """The last two words before a span, in lower case, digits as 0; fewer where the text or the last span is near."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.substring(gap, -LEFT, LEFT), r"(\S*\s+\S+|\S*)\s*$", 1), "[0-9]", "0"))


def located(text: Column, pattern: str, hint: str, keep, kind: int) -> Column:
    """The kept matches of a pattern as spans in code points: gaps and matches take turns, so their lengths add up."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        stop = start + F.length(p["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), context_of(p["g"]).alias("context"), F.lower(p["m"]).alias("value"))
        return F.struct(stop.alias("at"), F.when(keep(p["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(hint), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    each = [located(text, PATTERNS[k], HINTS[k], lambda m, k=k: valid(k, m), i) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def candidate_spans(text: Column) -> Column:
    """Other words that hold an at sign, six digits or four numbers, and runs of digit groups that have the shape of a kind."""
    words = located(text, CANDIDATE, r"@|[0-9]", lambda m: (F.length(digits_of(m)) >= 6) | m.rlike(r"\S@\S") | F.lower(m).rlike(ADDRESS), -1)
    runs = located(text, RUN, r"[0-9]", lambda m: F.length(digits_of(m)).between(7, 19) | m.rlike(ADDRESS), -1)
    # a word that is a run as well, but for punctuation after it, is a candidate once
    alone = F.filter(words, lambda w: ~F.exists(runs, lambda r: (r["start"] == w["start"]) & (r["stop"] <= w["stop"])))
    return F.concat(alone, runs)


def shaped(kind: Column, value: Column) -> Column:
    """Whether a value looks like one of the kind, though the fixed pattern doesn't take it."""
    n = F.length(digits_of(value))
    return (
        F.when(kind == 0, value.rlike(r"[a-z0-9]@[a-z0-9]"))
        .when(kind == 1, value.rlike(ADDRESS))
        .when(kind == 2, n.between(12, 19) & ~value.rlike("[a-z]"))
        .otherwise(n.between(7, 15) & ~value.rlike("[a-z]"))
    )


def graph_scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (context, kind, confidence) and of values (value, kind, score) on the graph of edges (context, value, kind).

    Seeds (edges with a kind) score 1. A pattern's confidence in a kind is the sum of its values' scores over one more than its
    values, if at least three score half or more; a value's score is the chance that not all its patterns err.
    """
    edges = stage(edges.distinct(), "pii-edges")
    sizes = edges.select("context", "value").distinct().groupBy("context").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= MIN_SUPPORT)
    sizes = stage(sizes, "pii-contexts")
    seeds = edges.where("kind >= 0").select("value", "kind").distinct()
    links = stage(edges.select("context", "value").distinct().join(sizes, "context"), "pii-links")
    scores = seeds.withColumn("score", F.lit(1.0))
    patterns = None
    for _ in range(rounds):
        held = links.join(scores, "value").groupBy("context", "kind", "values").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= 0.5).alias("n"))
        patterns = stage(held.where(F.col("n") >= MIN_SUPPORT).select("context", "kind", (F.col("s") / (F.col("values") + 1)).alias("confidence")), "pii-patterns")
        new = links.join(patterns, "context").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))).alias("score"))
        scores = new.join(seeds, ["value", "kind"], "left_anti").unionByName(seeds.withColumn("score", F.lit(1.0)))
        scores = stage(scores, "pii-values")
    return patterns, scores


def find_pii(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Spans of personal data in documents (doc_id, text): doc_id, base and spans, arrays of (start, kind, stop) by start and kind.

    start and stop count code points, stop exclusive; kind is a place in KINDS. Base spans of different kinds may overlap; those that the method adds overlap no base
    span. Null and empty texts have none; repeated rows have the same; a null doc_id is kept. carry=True adds row, a struct of all of docs' columns, whatever their
    names; otherwise other columns are not looked at. An empty table gives an empty one.
    """
    mine = F.coalesce(F.col("text"), F.lit(""))
    columns = ["doc_id", "row"] if carry else ["doc_id"]
    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", *whole, base_spans(mine).alias("base"), candidate_spans(mine).alias("_other"))
    clear = F.filter("_other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    rows = stage(rows.withColumn("_other", clear).withColumn("_uid", F.monotonically_increasing_id()), "pii-spans")
    held = rows.where(F.size("base") + F.size("_other") > 0).select("_uid", F.explode(F.concat("base", "_other")).alias("s"))
    patterns, scores = graph_scores(held.where("s.context <> ''").select("s.context", "s.value", "s.kind"))
    sure = patterns.where(F.col("confidence") >= CONFIDENCE)
    known = scores.where(F.col("score") >= CONFIDENCE).select("value", "kind")
    free = held.where("s.kind < 0").select("_uid", "s.context", "s.value", "s.start", "s.stop")
    added = free.join(sure, "context").join(known, ["value", "kind"]).where(shaped(F.col("kind"), F.col("value")))
    # a span that patterns of several kinds introduce goes to the most confident
    best = added.groupBy("_uid", "start", "stop").agg(F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind"))).alias("kind"))
    more = best.groupBy("_uid").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("_all"))
    # of a run and a word within it, the wider one stays
    wider = lambda s: F.exists("_all", lambda o: (o["start"] <= s["start"]) & (o["stop"] >= s["stop"]) & (o["stop"] - o["start"] > s["stop"] - s["start"]))
    more = more.select("_uid", F.filter("_all", lambda s: ~wider(s)).alias("_more"))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    out = rows.join(more, "_uid", "left").withColumn("base", bare).withColumn("spans", F.array_sort(F.concat(F.col("base"), F.coalesce("_more", none))))
    return out.select(*columns, "base", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names what they cover together."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, names[s["kind"]])).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by [KIND], and n_chars, if there is such a column, counted anew; all rows and columns stay.

    Null and empty texts stay as they are; repeated rows stay repeated and are treated alike; no other column is touched, whatever its name. An empty table gives an
    empty one.
    """
    text = F.col("row").getField("text")
    found = find_pii(docs, carry=True).select("row", "spans", redacted(text, F.col("spans")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row").getField("n_chars"))
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
