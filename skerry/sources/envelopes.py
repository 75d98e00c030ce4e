"""JSON of any shape by VARIANT: lists, items or data envelopes, maps from codes, and judges' answers with text around them (SRC-20, JSN-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import bounded
from ..functions.text import normalize_code, safe_text


def _exploded(rows: DataFrame, column: str) -> DataFrame:
    """rows with pos, key and value of each element of a variant column; rows whose variant holds none are left out."""
    return rows.sparkSession.sql(f"SELECT t.*, e.pos, e.key, e.value FROM {{t}} t, LATERAL variant_explode(t.`{column}`) e", t=rows)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def context_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """(code, row) for each object in a column of JSON texts, row as a variant, in whatever of three shapes a text is.

    A list of objects, an object whose items (or else data) are such a list, or a map from codes to objects or texts; a map's object keeps its own code, if it has one, and a text is the
    row's text. What is no object is left out, and so are texts that aren't JSON.
    """
    v = documents.select(F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    inner = F.coalesce(*[F.when(_is(F.try_variant_get("v", f"$.{k}", "variant"), "ARRAY"), F.try_variant_get("v", f"$.{k}", "variant")) for k in ("items", "data")])
    listed = v.withColumn("l", F.when(_is(F.col("v"), "ARRAY"), F.col("v")).when(_is(F.col("v"), "OBJECT"), inner))
    items = _exploded(listed.where("l is not null").select("l"), "l").where(_is(F.col("value"), "OBJECT")).select(F.try_variant_get("value", "$.code", "string").alias("code"), F.col("value").alias("row"), F.lit(None).cast("string").alias("text"))
    mapped = _exploded(listed.where("l is null").where(_is(F.col("v"), "OBJECT")).select("v"), "v")
    own = F.coalesce(F.try_variant_get("value", "$.code", "string"), F.col("key"))
    objects = mapped.where(_is(F.col("value"), "OBJECT")).select(own.alias("code"), F.col("value").alias("row"), F.lit(None).cast("string").alias("text"))
    texts = mapped.where(_is(F.col("value"), "STRING")).select(F.col("key").alias("code"), F.lit(None).cast("variant").alias("row"), F.try_variant_get("value", "$", "string").alias("text"))
    return items.unionByName(objects).unionByName(texts).withColumn("code", normalize_code(F.col("code")))


def read_context(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """code, text and the named fields, as texts, of a context file: CSV, JSON lines, or JSON in one of context_rows' shapes."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
        return df.select(normalize_code(has("code")).alias("code"), has("text").alias("text"), *[has(f).alias(f) for f in fields])
    whole = not path.endswith(".jsonl")
    if whole and not path.endswith(".json"):
        raise ValueError(f"no context format: {path}")
    lines = spark.read.text(path, wholetext=whole)
    rows = context_rows(lines if whole else lines.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")))
    cell = lambda f: F.coalesce(F.try_variant_get("row", f"$.{f}", "string"), F.lit(""))
    return rows.select("code", F.coalesce("text", cell("text")).alias("text"), *[cell(f).alias(f) for f in fields])


def judged_items(responses: DataFrame, run: str = "run_id", text: str = "response") -> DataFrame:
    """(run, pos, code, item, problem) of each element of judges' answers, which are lists or objects with a list named ranked, with any text around them.

    problem is empty_response, no_json_found or ranked_not_list for an answer without items, and non_object_item or duplicate_code:<code> for an item that doesn't count.
    """
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    found = F.try_parse_json(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)([\[{].*[\]}])", 1))
    rows = responses.select(F.col(run).alias(run), blank.alias("blank"), found.alias("v"))
    rows = rows.withColumn("l", F.when(_is(F.col("v"), "ARRAY"), F.col("v")).when(_is(F.col("v"), "OBJECT"), F.coalesce(F.try_variant_get("v", "$.ranked", "variant"), F.when(F.lit(True), F.parse_json(F.lit("[]"))))))
    wrong = F.when(F.col("blank"), "empty_response").when(F.col("v").isNull(), "no_json_found").when(~_is(F.col("l"), "ARRAY"), "ranked_not_list")
    bad = rows.withColumn("problem", wrong).where("problem is not null").select(run, F.lit(-1).alias("pos"), F.lit("").alias("code"), F.lit(None).cast("variant").alias("item"), "problem")
    items = _exploded(rows.where(_is(F.col("l"), "ARRAY")).select(run, "l"), "l").select(run, "pos", F.col("value").alias("item"))
    items = items.withColumn("code", normalize_code(F.coalesce(F.try_variant_get("item", "$.code", "string"), F.lit(""))))
    from pyspark.sql import Window

    objects = _is(F.col("item"), "OBJECT")
    place = F.row_number().over(Window.partitionBy(run, "code", objects).orderBy("pos"))
    problem = F.when(~objects, "non_object_item").when(place > 1, F.concat(F.lit("duplicate_code:"), "code")).otherwise("")
    return items.select(run, "pos", "code", "item", problem.alias("problem")).unionByName(bad.select(run, "pos", "code", "item", "problem"))


def typed_ranking(items: DataFrame, candidates: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(picks, problems): the candidates (run, code) with what the judges' items say of them as typed columns, and all that is wrong with the items.

    Candidates that no item names have null columns and come last; coverage is the share of a run's candidates that are named. An item of another code is unknown_code:<code>.
    """
    known = candidates.select(run, normalize_code(F.col("code").cast("string")).alias("code")).distinct()
    good = items.where("problem = ''")
    met = good.join(known.withColumn("_known", F.lit(True)), [run, "code"], "left")
    said = lambda f, most: safe_text(F.try_variant_get("item", f"$.{f}", "string"), most)
    listed = lambda f: F.array_distinct(F.filter(F.transform(F.coalesce(F.try_variant_get("item", f"$.{f}", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    fields = {
        "seq": F.col("pos"),
        "llm_score": bounded(F.try_variant_get("item", "$.llm_score", "string"), 0, 100),
        "llm_confidence": bounded(F.try_variant_get("item", "$.confidence", "string"), 0, 1),
        "llm_sector": F.coalesce(*[F.when(said(f, 40) != "", said(f, 40)) for f in ("sector", "industry", "sector_label")], F.lit("")),
        "llm_theme": said("theme", 100),
        "ranking_reason": said("reason", 180),
        "llm_risks": listed("risk_flags"),
        "llm_tags": listed("tags"),
    }
    typed = met.where("_known").select(run, "code", *[c.alias(n) for n, c in fields.items()])
    picks = candidates.withColumn("_code", normalize_code(F.col("code").cast("string"))).join(typed.withColumnRenamed("code", "_code"), [run, "_code"], "left")
    coverage = picks.groupBy(run).agg((F.count("seq") / F.count(F.lit(1))).alias("llm_coverage"))
    unknown = met.where("_known is null and code <> ''").select(run, "pos", F.concat(F.lit("unknown_code:"), "code").alias("problem"))
    return picks.drop("_code").join(coverage, run), items.where("problem <> ''").select(run, "pos", "problem").unionByName(unknown)
