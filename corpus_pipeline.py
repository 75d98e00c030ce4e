"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Every stage works on all that its predecessor kept, and its decisions take effect: toxic documents go; of near duplicates
the one with the smallest id stays; documents with benchmark passages go; personal data is replaced by its kind; what is left is
packed along a space-filling curve.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import stage, table
from skerry.llm.decontam import contaminated, drop_contaminated
from skerry.llm.ngram_join import keep_first
from skerry.llm.packing import pack_along_curve
from skerry.llm.pii import redact_pii
from skerry.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't call toxic.

    Null and empty texts are scored as texts without words; repeated rows go or stay together; rows with a null id are judged but teach nothing;
    columns of any name come back as they were. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    kept = toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; texts without words stay. See keep_first for nulls, ties, repeats and names."""
    return keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item; null and empty texts stay. See contaminated and drop_contaminated for ties, repeats and names."""
    return drop_contaminated(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null. See redact_pii for repeats, empty tables and names."""
    return redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their token ids; null and empty texts are the one id at the end. See pack_along_curve for the rest."""
    return pack_along_curve(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# Models, components and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
