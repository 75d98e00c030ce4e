"""The registered queries opN_<name> of this subpackage, over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .decontam import contaminated
from .divergence import source_divergence
from .html_blocks import main_text
from .hpylm import PitmanYorModel, score_texts
from .merkle import merkle_manifest, tampered_rows
from .mpegts import read_media, store_media
from .ngram_join import near_duplicates
from .packing import pack_along_curve
from .pii import KINDS, find_pii, spans_text
from .sharding import hilbert_shards
from .toxicity import in_fold, toxicity
from .urlfilter import judge_urls
from .warc import read_archives, write_archives


def op1_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(folds=7) == 2
    model = PitmanYorModel(docs.where(~held_out))
    out = score_texts(docs, model, taught=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    # a lambda's second parameter would be the place in the array, even one with a default
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op8_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (in_fold() == 0).alias("held_out"), "score", "predicted")


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(stage(store_media(table(spark, sf_dir, "documents")), "media"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), changed=tampered_rows())


def op13_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_seekable": op1_warc_seekable,
    "op2_redirect_equivalence": op2_redirect_equivalence,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_curve_packing": op4_curve_packing,
    "op5_adaptive_prefix_join": op5_adaptive_prefix_join,
    "op6_hierarchical_pitman_yor": op6_hierarchical_pitman_yor,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_class_kneser_ney": op8_class_kneser_ney,
    "op9_simhash_windows": op9_simhash_windows,
    "op10_transport_stream": op10_transport_stream,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_flat_blocks": op13_flat_blocks,
}
