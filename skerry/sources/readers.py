"""File sources and sinks: snapshots under any spelling of columns, label maps, JSON-line histories, atomic tables (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import number
from ..functions.text import labels, normalize_code, safe_text

# fixed values: column spellings of a snapshot, first match wins
SPELLINGS = {
    "code": ("code", "股票代码", "代码"),
    "name": ("name", "股票名称", "名称"),
    "price": ("price", "最新价"),
    "change_pct": ("change_pct", "涨跌幅"),
    "amount": ("amount", "成交额"),
    "total_mv": ("total_mv", "总市值"),
    "circ_mv": ("circ_mv", "流通市值"),
    "pe_ratio": ("pe_ratio", "动态市盈率", "市盈率-动态"),
    "pb_ratio": ("pb_ratio", "市净率"),
    "volume_ratio": ("volume_ratio", "量比"),
    "turnover_rate": ("turnover_rate", "换手率"),
    "industry": ("industry", "所属行业"),
    "concepts": ("concepts", "概念题材"),
}
TEXT = ("name", "industry", "concepts")


def first_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def normalize_snapshot(df: DataFrame) -> DataFrame:
    """Standard columns, numbers as doubles, rows without a positive price dropped (PRJ-01, PRJ-02)."""
    out = []
    for target, names in SPELLINGS.items():
        found = first_column(df, names)
        if found is None:
            continue
        c = F.col(f"`{found}`")
        out.append((normalize_code(c) if target == "code" else safe_text(c) if target in TEXT else number(c)).alias(target))
    return df.select(*out).where(F.col("price") > 0)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that aren't there or hold nothing, by one aggregation (FLT-14)."""
    there = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first().asDict() if there else {}
    return [c for c in required if not counts.get(c)]


def first_complete(spark: SparkSession, sources, required: list[str]) -> tuple[DataFrame, str, list[str]]:
    """The first source (name, reader) whose table has all required columns; with its name and why others were passed over (SRC-06)."""
    errors = []
    for name, read in sources:
        try:
            df = normalize_snapshot(read(spark))
            lacking = missing_columns(df, required)
        except Exception as e:  # a source that can't be read is one to pass over
            errors.append(f"{name}: {type(e).__name__}")
            continue
        if not lacking:
            return df, name, errors
        errors.append(f"{name}: lacks {', '.join(lacking)}")
    raise ValueError("no source is complete: " + "; ".join(errors))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(code, industry, concepts) from CSV or JSON lines; codes normalised, blank ones dropped (SRC-15)."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.json(path)
    code, industry, concepts = (first_column(df, SPELLINGS[k]) for k in ("code", "industry", "concepts"))
    out = df.select(normalize_code(F.col(code)).alias("code"), safe_text(F.col(industry)).alias("industry") if industry else F.lit("").alias("industry"), F.array_join(labels(F.col(concepts)), ",").alias("concepts") if concepts else F.lit("").alias("concepts"))
    return out.where("code <> '' and code <> '000000'")


HEAT = "board string, generated_at timestamp, max_board_heat_score double, broken string"


def read_heat_history(spark: SparkSession, path: str) -> DataFrame:
    """Heat records of a JSON-lines history; malformed lines and heats out of 0 to 100 are skipped (SRC-18)."""
    df = spark.read.schema(HEAT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    good = df.where("broken is null and board is not null and max_board_heat_score between 0 and 100")
    return good.select("board", F.col("generated_at").alias("at"), F.col("max_board_heat_score").alias("heat"))


def write_runs(runs: DataFrame, picks: DataFrame, path: str) -> None:
    """Runs and their picks as JSON lines, told apart by their type (SNK-05)."""
    a = runs.select(F.to_json(F.struct(F.lit("run").alias("type"), "*")).alias("value"))
    b = picks.select(F.to_json(F.struct(F.lit("pick").alias("type"), "*")).alias("value"))
    a.unionByName(b).write.mode("overwrite").text(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df holds, by Spark's commit protocol (SNK-01)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
