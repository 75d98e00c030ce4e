"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks, verified by exact weighted-shingle similarity.

Windows are laid where a shingle of a document meets one of an item (a window without one has similarity 0). Fingerprints of 64 bits are cut into four blocks; any two within a distance of
11 differ by at most two bits in one of them, so an item that is looked up under all values that near to its own meets every such window. Windows whose words differ at one end may be as similar as
asked and lie beyond that radius: for them there is an exact supplement. A window as similar as asked holds at least that share of an item's shingles, so it holds one of the item's
rarest few, and meets it by those. All candidates are compared exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHINGLE = 5
SIMILARITY = 0.75
BITS = 64
RADIUS = 11
BLOCKS = 4
WIDTH = BITS // BLOCKS
BROADCAST_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles in their order; fewer words than that make one shingle, none make none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))
    one = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n >= size, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column) -> Column:
    """64 bits: the sign, over all words with their repeats, of each bit of their hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("bigint")).cast("int") * 2 - 1)
        return F.call_function("shiftleft", F.when(votes > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), b)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def blocks_of(fingerprint: Column) -> Column:
    """(block, value) of the blocks that a fingerprint is cut into."""
    cut = [F.struct(F.lit(i).alias("block"), F.call_function("shiftrightunsigned", fingerprint, F.lit(i * WIDTH)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint")).alias("value")) for i in range(BLOCKS)]
    return F.array(*cut)


def probes(radius: int = RADIUS) -> Column:
    """Masks of up to radius // BLOCKS bits of a block: two fingerprints within the radius differ by no more in one of their blocks."""
    masks = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(WIDTH), n)]
    return F.array(*[F.lit(m).cast("bigint") for m in masks])


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(wk, ik) of all windows (wk, wfp) and items (ik, fp) whose fingerprints are within the radius, by the block index."""
    left = windows.select("wk", "wfp", F.explode(blocks_of(F.col("wfp"))).alias("b")).select("wk", "wfp", "b.block", "b.value")
    right = items.select("ik", "fp", F.explode(blocks_of(F.col("fp"))).alias("b")).select("ik", "fp", "b.block", F.explode(F.transform(probes(radius), lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    met = left.join(right, ["block", "value"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= radius)
    return met.select("wk", "ik").distinct()


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of all shingles of two lists of hashes."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Windows of docs (doc_id, text) that repeat an item of benchmark (item_id, text).

    Returns, for each document and item, doc_id, item_id, the best window's start (in words, from 0), words, distance
    and similarity (at least as given). Words are compared without case and punctuation, by shingles of five; an item of fewer words is one shingle, as is a window of its size. Null and
    empty texts and items match nothing; an item whose id is null is an item like others. Rows with equal doc_id (null included) and text count once. Other columns are not
    looked at; empty tables give an empty result.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = stage(items.select("item_id", F.size("w").alias("m"), "w", shingles_of(F.col("w")).alias("sh"), simhash(F.col("w")).alias("fp"), _identity("item_id", F.array_join("w", " ")).alias("ik")), "benchmark-items")
    short = [r[0] for r in items.where(F.col("m") < SHINGLE).select("m").distinct().collect()]  # four lengths at most
    places = stage(items.select("m", F.posexplode("sh").alias("at", "h")).distinct(), "benchmark-shingles")
    n_places = places.count()

    texts = docs.select("doc_id", "text").where("text is not null").withColumn("k", _identity("doc_id", F.col("text")))
    split = texts.select("doc_id", "k", words_of(F.col("text")).alias("w"))
    marks = F.array(*[F.struct(F.lit(s).alias("size"), _grams(F.col("w"), s).alias("hs")) for s in [SHINGLE, *sorted(short)]])
    if short:
        cut = split.select("doc_id", "k", "w", F.explode(marks).alias("g")).select("doc_id", "k", "w", F.posexplode("g.hs").alias("pos", "h"))
    else:
        cut = split.select("doc_id", "k", "w", F.posexplode(_grams(F.col("w"), SHINGLE)).alias("pos", "h"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("w") - F.col("m")))
    if n_places <= BROADCAST_SHINGLES:
        # the count is checked: the benchmark's shingles go to the documents
        found = cut.join(F.broadcast(places), "h").select("doc_id", "k", "m", start.alias("start"), "w")
    else:
        # beyond that, thin rows meet by shuffle and the words of documents that were hit are fetched again
        thin = cut.select("doc_id", "k", "pos", "h").join(places, "h").select("k", "pos", "at", "m").distinct()
        found = thin.join(split, "k").select("doc_id", "k", "m", start.alias("start"), "w")
    windows = found.select("doc_id", "k", "m", "start", F.slice("w", F.col("start") + 1, F.col("m")).alias("w"))
    windows = stage(windows.groupBy("doc_id", "k", "m", "start").agg(F.first("w").alias("w")), "windows")
    # equal windows are fingerprinted and compared once
    same = F.sha2(F.array_join("w", " "), 256)
    kinds = windows.select(same.alias("wk"), "w").groupBy("wk").agg(F.first("w").alias("w"))
    kinds = stage(kinds.select("wk", shingles_of(F.col("w")).alias("wsh"), simhash(F.col("w")).alias("wfp")), "window-kinds")
    rare = rarest(items, similarity)
    if n_places <= BROADCAST_SHINGLES:
        rare = F.broadcast(rare)
    beyond = kinds.select("wk", F.explode(F.array_distinct("wsh")).alias("h")).join(rare, "h").select("wk", "ik")
    near = within_radius(kinds, items).unionByName(beyond).distinct()
    checked = near.join(kinds, "wk").join(items.select("ik", "item_id", "fp", "sh"), "ik")
    checked = checked.withColumn("similarity", weighted_similarity(F.col("wsh"), F.col("sh"))).where(F.col("similarity") >= similarity)
    checked = checked.select("wk", "item_id", F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))).cast("int").alias("distance"), "similarity")
    hits = windows.select("doc_id", "k", "start", "m", same.alias("wk")).join(checked, "wk")
    best = F.min_by(F.struct("start", F.col("m").alias("words"), "distance", "similarity"), F.struct(-F.col("similarity"), F.col("start"), F.col("m")))
    return hits.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.words", "b.distance", "b.similarity")


def _identity(number: str, text: Column) -> Column:
    """What tells (number, text) apart, by a digest: equal digests of different texts needn't be reckoned with."""
    return F.sha2(F.concat(F.coalesce(F.col(number).cast("string"), F.lit("-")), F.lit(":"), text), 256)


def rarest(items: DataFrame, similarity: float) -> DataFrame:
    """(ik, h): of each item (ik, sh) so many shingles, those in the fewest items first, that no window of the similarity is without all of them."""
    each = items.select("ik", F.size("sh").alias("n"), F.explode("sh").alias("h"))
    common = each.groupBy("h").agg(F.count_distinct("ik").alias("items"))
    place = F.row_number().over(Window.partitionBy("ik").orderBy("items", "h"))
    spare = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9)
    return each.join(common, "h").withColumn("place", place).where(F.col("place") <= spare + 1).select("ik", "h").distinct()


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of so many words, as an item of that size or more would have them."""
    if size < SHINGLE:
        return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents without findings, with all their columns; rows with a null id stay only if no null id was found.

    Rows of one id go or stay together; null and empty texts stay; columns of any name are left alone. Empty tables give empty ones, and no findings leave all.
    """
    bad = found.select("doc_id").distinct().alias("bad")
    return docs.alias("docs").join(bad, F.col("docs.doc_id").eqNullSafe(F.col("bad.doc_id")), "left_anti")
