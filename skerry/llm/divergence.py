"""Source divergence audit: how far apart the sources of a language are, by joint histograms of their term counts.

For each pair of sources the distinct (count, count) combinations are tallied with their multiplicities, the implied ones with zeros
among them, and the divergence is evaluated once for each combination.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage, text_or_empty

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD_TERMS = 400_000
PIECE_BYTES = 4 << 20
HELD_PAIRS = 4_000_000

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    data = data.translate(_LETTERS)
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split(b" ")
        at = end


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over what the task has seen since it last gave out its counts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [t for t in n if t]
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    since = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for lang, source, text in zip(*(batch.column(i).slice(at, 64).to_pylist() for i in range(3))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in _pieces(text.encode()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                since += len(n) - before
                if since > HELD_TERMS:
                    yield from out()
                    since = 0
    yield from out()


def _joint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, [(source, n)] sorted by source) of each term -> (lang, s, t, a, b, n): how many of the task's terms occur a > 0 times in s and b > 0 times in t."""

    def tallied(langs: pa.Array, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(lists.offsets.to_numpy())
        cells = lists.flatten()
        keyed = pa.table({"lang": langs.take(pa.array(np.repeat(np.arange(len(langs)), sizes))), "source": cells.field(0), "n": cells.field(1)})
        lang_code, source_code = (keyed[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        counts, count_code = np.unique(keyed["n"].to_numpy(), return_inverse=True)
        # an item is a source of a language with a count; a pair of items is one number
        of = (lang_code.indices.to_numpy().astype(np.int64) * len(source_code.dictionary) + source_code.indices.to_numpy()) * len(counts) + count_code
        kinds, item = np.unique(of, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        found = []
        for g in np.unique(sizes[sizes > 1]).tolist():
            members = item[starts[sizes == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            found.append((members[:, i] * len(kinds) + members[:, j]).ravel())
        if not found:
            return
        pairs, many = np.unique(np.concatenate(found), return_counts=True)
        a, b = kinds[pairs // len(kinds)], kinds[pairs % len(kinds)]
        source = lambda x: source_code.dictionary.take(pa.array(x // len(counts) % len(source_code.dictionary)))
        lang = lang_code.dictionary.take(pa.array(a // len(counts) // len(source_code.dictionary)))
        yield pa.RecordBatch.from_arrays([lang, source(a), source(b), pa.array(counts[a % len(counts)]), pa.array(counts[b % len(counts)]), pa.array(many.astype(np.int64))], names=["lang", "s", "t", "a", "b", "n"])

    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
        work = np.cumsum(sizes * (sizes - 1) // 2)
        at = 0
        while at < batch.num_rows:
            done = work[at - 1] if at else 0
            end = max(int(np.searchsorted(work, done + HELD_PAIRS, side="right")), at + 1)
            part = batch.slice(at, end - at)
            yield from tallied(part.column(0), part.column(1))
            at = end


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for all longs."""
    return F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so squares fit in a long."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Compare the sources of each language of docs (text, lang, source) by the terms that at least so many of the language's rows hold.

    Terms are runs of ASCII letters and characters beyond ASCII, with A-Z folded. Returns lang, source, part, item, value and rank: part `pair` has every other source of the
    language with the divergence summed over all kept terms, part `term` the terms in which the source exceeds its language most, at most top of them. Nulls in
    text, lang and source are empty strings; a group without terms, or in a language without kept ones, takes part (its values are 0 where nothing is kept). Repeated rows
    count each. Ties go by the item's bytes. Other columns are not looked at; an empty table gives an empty result.

    Tasks sum counts before the one shuffle of terms; a term's list has an entry for each of its language's sources. Pairs of sources are as many as the result's rows; nothing
    comes to the driver.
    """
    ship(docs.sparkSession)
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    each = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
    kept = stage(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "total", "by"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    cells = kept.select("lang", "term", "total", F.explode("by").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.select("lang", "source", zero("source_n"), zero("v"), zero("lang_n")), "source-groups")

    pair = _pairs(kept, cells, groups)
    p, q = share(F.col("n"), F.col("source_n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    ahead = cells.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    term = ahead.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", place).unionByName(term.withColumn("rank", place).where(F.col("rank") <= top))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value for all ordered pairs of a language's sources."""
    met = kept.select("lang", "by").mapInArrow(_joint, "lang string, s string, t string, a long, b long, n long")
    joint = stage(met.groupBy("lang", "s", "t", "a", "b").agg(F.sum("n").alias("n")), "joint-counts")
    alone = cells.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("source_n").alias(f"{x}_n"), *more) for x, more in (("s", ["v"]), ("t", [])))
    both = a.join(b, "lang").where("s < t")
    # cells with a zero: what a source has in all, less what meets the other source
    corner = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("v").alias("n"))
    cell = lambda a, b, n: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), n.alias("n"))
    none, n = F.lit(0), F.col("n")
    parts = [
        both.select("lang", "s", "t", corner.alias("z")),
        both.join(alone.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", F.explode(F.array(cell(F.col("c"), none, n), cell(none, none, -n))).alias("z")),
        both.join(alone.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", F.explode(F.array(cell(none, F.col("c"), n), cell(none, none, -n))).alias("z")),
        joint.select("lang", "s", "t", F.explode(F.array(cell(F.col("a"), none, -n), cell(none, F.col("b"), -n), cell(none, none, n))).alias("z")),
    ]
    zeros = parts[0]
    for more in parts[1:]:
        zeros = zeros.unionByName(more)
    zeros = zeros.groupBy("lang", "s", "t", "z.a", "z.b").agg(F.sum("z.n").alias("n")).where("n <> 0")
    known = joint.unionByName(zeros).join(both, ["lang", "s", "t"])
    f = apart(share(F.col("a"), F.col("s_n"), F.col("v")), share(F.col("b"), F.col("t_n"), F.col("v")))
    sums = known.groupBy("lang", "s", "t").agg(F.sum(f * F.col("n")).alias("value"))
    sums = stage(both.join(sums, ["lang", "s", "t"], "left").select("lang", "s", "t", F.coalesce("value", F.lit(0)).alias("value")), "divergences")
    way = lambda x, y: sums.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value")
    return way("s", "t").unionByName(way("t", "s"))
