"""Hilbert-order sharding: rows sorted along a curve through their metadata, cut into even runs.

Neighbours on the curve are close in every metadata dimension, so each run covers a small box
and min/max statistics of its file prune on any of the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordered, stage, with_bases
from .hilbert import hilbert_index

BITS = 8


def category(col: Column) -> Column:
    """A category's cell: equal values share one; null is a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("\x00null"))), F.lit(1 << BITS)).cast("int")


def log_scale(col: Column, per_octave: int = 8) -> Column:
    """A size's cell on a logarithmic scale."""
    cell = F.floor(F.log2(F.greatest(col.cast("double"), F.lit(1.0))) * per_octave)
    return F.least(cell, F.lit((1 << BITS) - 1)).cast("int")


def linear(col: Column, low: int, high: int) -> Column:
    """A number's cell between the column's least and greatest value; null is in cell 0."""
    cell = F.floor((col.cast("double") - low) / F.lit(float(max(high - low, 1))) * ((1 << BITS) - 1))
    return F.coalesce(cell, F.lit(0)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 40, partitions: int | None = None) -> DataFrame:
    """Put documents (doc_id, text, lang, source) into shards of even row counts along the curve.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, curve (the index), shard and slot.
    Shards' counts differ by one at most; slots in a shard are gapless from 0. Null text has no bytes;
    null doc_id, lang and source are values like others; repeated rows get a slot each; other columns of
    docs are not looked at; an empty table gives an empty result. Only sizes, checksums and curve indices are sorted, never texts.
    """
    bytes_of = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 16).alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        category(F.col("lang")).alias("_lang"),
        category(F.col("source")).alias("_source"),
    )
    thin = stage(thin, "shard-sizes")
    low, high, total = thin.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    curve = hilbert_index([F.col("_lang"), F.col("_source"), log_scale(F.col("size")), linear(F.col("doc_id"), low or 0, high or 0)], BITS)
    thin = thin.select("doc_id", "size", "text_crc32", curve.alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("_tie"))
    placed = ordered(thin, ["curve", "_tie", "doc_id", "text_crc32", "size"], "shard-order", partitions)
    placed, _ = with_bases(placed, F.lit(1), "_base")
    rank = F.col("_base") + F.col("_pos")
    n = max(total, 1)
    shard = F.expr(f"(_base + _pos) * {shards}L div {n}L")
    first = F.expr(f"(((_base + _pos) * {shards}L div {n}L) * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), (rank - first).cast("long").alias("slot"))
