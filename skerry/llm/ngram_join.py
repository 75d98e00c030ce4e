"""Near-duplicate join on word shingles by adaptive multi-match prefixes.

Each set of shingles, in the order of their hashes, is cut to a prefix so long that any two sets of the asked similarity
share l of their prefixes' shingles, not just one. Shingles in many prefixes are never joined on: a pair that shares k of
them still shares l - k others, so a document's number of such costly shingles lowers the number of matches its pairs must show. Documents with so many that nothing else
must match (copies in large groups) have their prefixes lengthened to the whole set, cut anew by how rare shingles are among them, and are compared by pivots: what
shares a costly shingle is compared to one of the shingle's documents, and pairs that this leaves in different
components are compared one by one. Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ship, stage, unstage
from .components import connected_components
from .shingles import shingle_sets

MOST = 20
LENGTHEN, EXTRA = 0.4, 60
BATCH_BYTES = 2 << 20
BROADCAST_IDS = 500_000
FLUSH = 2_000_000
SALTS = 16


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n can have with one so similar."""
    return -(-n * percent // 100)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set of n: enough for one match, and then longer in proportion and by a constant."""
    one = n - required(n, percent) + 1
    return np.minimum(n, one + (one * LENGTHEN).astype(np.int64) + EXTRA)


def matches(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that the prefixes of a set of n and of a similar one share at least."""
    return prefix_size(n, percent) - n + required(n, percent)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .packing import parts_of

    for batch in batches:
        yield from parts_of(batch, BATCH_BYTES)


def _sets(percent: int, size: int, bits: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's key and text -> key, class (two codes of the set), set size and the prefix (for the first row of a class that this task sees)."""
    seen: set[tuple[int, int]] = set()
    low, top = (1 << bits) - 1, 1 << 63
    for part in _parts(batches):
        codes, n = shingle_sets(part.column(1), size)
        ends = np.cumsum(n)
        prefix = prefix_size(n, percent)
        ones, twos, prefixes = [], [], []
        for a, b, p in zip((ends - n).tolist(), ends.tolist(), prefix.tolist()):
            c = xxhash.xxh3_128_intdigest(codes[a:b].tobytes(), seed=b - a)
            c = (c & low) - (top if bits == 64 else 0), (c >> 64) - top
            ones.append(c[0])
            twos.append(c[1])
            prefixes.append(codes[a : a + p].tobytes() if b > a and c not in seen else None)
            seen.add(c)
        if len(seen) > 1_000_000:
            seen.clear()
        key = [part.column(i) for i in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([*key, pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(n, pa.int64()), pa.array(prefixes, pa.binary())], names=["doc_id", "h1", "h2", "cid", "c2", "n", "prefix"])


def _postings(most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, prefix) -> (token, cid, 0); of a shingle in more classes than most, as far as this task sees, only so many go on that it shows, and each class tells its number of others: (cid, cid, that).

    A class may come several times (each task that met its text gave it a prefix): its repeats count once here, so that what goes on are different classes.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def out() -> Iterator[pa.RecordBatch]:
        tokens, cids = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((cids, tokens))
        tokens, cids = tokens[order], cids[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cids[1:] != cids[:-1])])
        tokens, cids = tokens[fresh], cids[fresh]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(tokens)]])))
        posted = place <= most
        kept, left = np.unique(cids[~posted], return_counts=True)
        tokens, cids = tokens[posted], cids[posted]
        order = np.argsort(cids, kind="stable")  # a class's rows together, as they compress better
        tokens, cids = np.concatenate([tokens[order], kept]), np.concatenate([cids[order], kept])
        many = np.concatenate([np.zeros(len(tokens) - len(kept), np.int32), left.astype(np.int32)])
        for at in range(0, len(tokens), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in (tokens, cids, many)], names=["token", "cid", "many"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prefixes = part.column(1).to_pylist()
            sizes = np.fromiter(map(len, prefixes), np.int64, len(prefixes)) // 8
            held.append((np.frombuffer(b"".join(prefixes), np.int64), np.repeat(part.column(0).to_numpy(), sizes)))
            waiting += len(held[-1][0])
            if waiting >= FLUSH:
                yield from out()
                waiting = 0
    if held:
        yield from out()


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, set) -> (token, cid, n)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = part.column(1).to_pylist()
            sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], names=["token", "cid", "n"])


def _tallied(cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cids, many = np.unique(cids, return_counts=True)
    return cids, many.astype(np.int32)


def _group(most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (token, cid, many) -> (0, cid, cid) for pairs in short lists, (a number, cid, null) for so many costly shingles. At most a short list is held."""
    tokens, cids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_token, last = None, None

    def pairs(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), 1 << 18):
            a, b = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b)], names=["many", "u", "v"])

    def costly(cids: np.ndarray, many: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        many = np.ones(len(cids), np.int32) if many is None else many
        yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(cids), pa.nulls(len(cids), pa.int64())], names=["many", "u", "v"])

    def settle(tokens: np.ndarray, cids: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(tokens)]]))
        for g in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
            members = cids[starts[sizes == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            yield from pairs(members[:, i].ravel(), members[:, j].ravel())
        long = np.repeat(sizes > most, sizes)
        if long.any():
            yield from costly(*_tallied(cids[long]))

    for batch in batches:
        t, c, many = (batch.column(i).to_numpy() for i in range(3))
        if many.any():
            yield from costly(c[many > 0], many[many > 0])
            t, c = t[many == 0], c[many == 0]
        if not len(t):
            continue
        if long_token is not None:
            n = int((t == long_token).sum())  # tokens come sorted
            more = np.unique(c[:n])
            more = more[more > last] if last is not None else more
            if len(more):
                yield from costly(more)
                last = more[-1]
            t, c = t[n:], c[n:]
            if not len(t):
                continue
            long_token = None
        tokens, cids = np.concatenate([tokens, t]), np.concatenate([cids, c])
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cids[1:] != cids[:-1])])
        tokens, cids = tokens[new], cids[new]
        cut = int(len(tokens) - (tokens == tokens[-1]).sum())
        if cut:
            yield from settle(tokens[:cut], cids[:cut])
        tokens, cids = tokens[cut:], cids[cut:]
        if len(tokens) > most:
            yield from costly(cids)
            long_token, last = int(tokens[0]), cids[-1]
            tokens, cids = tokens[:0], cids[:0]
    if len(tokens):
        yield from settle(tokens, cids)


def _whole_sets(size: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        codes, n = shingle_sets(part.column(1), size)
        ends = np.cumsum(n)
        sets = [codes[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["cid", "set"])


def _verify(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["u", "v"])


class NgramJoin:
    """The join over documents (doc_id, text); components() gives its result. bits is the length of a class's first code (tests make it short)."""

    def __init__(self, docs: DataFrame, percent: int = 75, size: int = 5, bits: int = 64):
        self.spark, self.percent, self.size = docs.sparkSession, percent, size
        ship(self.spark)
        self.texts = keyed(docs)
        rows = stage(self.texts.mapInArrow(lean("join", lambda b: _sets(percent, size, bits, b)), "doc_id long, h1 long, h2 long, cid long, c2 long, n long, prefix binary"), "prefixes")
        self.rows, self.classes = rows, self._classed(rows)
        while (clash := self.classes.where("c2 <> other").select("cid", "other")).limit(1).count():
            # different sets of one code: all get another, until none are left
            again = self.rows.join(clash, "cid", "left").withColumn("cid", F.when(F.col("other").isNull(), F.col("cid")).otherwise(F.xxhash64("cid", "c2")))
            again = stage(again.select(*self.rows.columns), "prefixes")
            unstage(self.rows, self.classes)
            self.rows, self.classes = again, self._classed(again)

    def _classed(self, rows: DataFrame) -> DataFrame:
        """A row for each code: the least and the greatest second code (equal, where one set has the code), size, least doc_id, and the key of one row."""
        least = [F.min("c2").alias("c2"), F.max("c2").alias("other"), F.min("n").alias("n"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h1", "h2")).alias("key")]
        return stage(rows.where("n > 0").groupBy("cid").agg(*least), "classes")

    def _info(self, found: DataFrame) -> DataFrame:
        """Per class with costly shingles or partners: size, matches that pairs owe, the least that any partner's size makes of it, and the number of costly shingles."""
        percent = self.percent

        @F.pandas_udf("struct<l:long,least:long>")
        def owed(n):
            import pandas as pd

            n = n.to_numpy()
            low = required(n, percent)  # the smallest partner
            # matches() needn't be monotone to the last one; a step down for rounding keeps it on the safe side
            return pd.DataFrame({"l": matches(n, percent), "least": np.minimum(matches(n, percent), matches(low, percent)) - 2})

        h = found.where("many > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("many").alias("h"))
        info = self.classes.select("cid", "n").join(h, "cid", "left").withColumn("o", owed("n"))
        return stage(info.select("cid", "n", "o.l", "o.least", F.coalesce("h", F.lit(0)).alias("h")), "owed")

    def _near_sizes(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _whole(self, asked: DataFrame) -> DataFrame:
        """Whole sets (cid, set) of some classes, made anew from the texts of these alone."""
        size = self.size
        asked = stage(self.classes.join(asked, "cid", "left_semi").select("cid", "key.*"), "asked")
        few = asked.count() <= BROADCAST_IDS
        of = F.broadcast(asked) if few else asked
        wanted = self.texts.alias("t").join(of.alias("a"), _same_key("t", "a")).select("cid", "text")
        return stage(wanted.mapInArrow(lean("join", lambda b: _whole_sets(size, b)), "cid long, set binary").dropDuplicates(["cid"]), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(x, y) of those of the pairs (u, v, x, y) whose whole sets are similar."""
        percent = self.percent
        both = pairs.join(sets.select(F.col("cid").alias("u"), F.col("set").alias("a")), "u")
        both = both.join(sets.select(F.col("cid").alias("v"), F.col("set").alias("b")), "v").select("x", "y", "a", "b")
        return stage(both.mapInArrow(lean("join", lambda b: _verify(percent, b)), "u long, v long"), "links")

    def class_components(self) -> DataFrame:
        """The components of classes (node, component), by enough verified links to connect all that is connected."""
        posted = self.rows.where("prefix is not null").select("cid", "prefix").mapInArrow(lean("join", lambda b: _postings(MOST, b)), "token long, cid long, many int")
        found = posted.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(lean("join", lambda b: _group(MOST, b)), "many int, u long, v long")
        found = stage(found, "matches")
        info = self._info(found)
        pairs = found.where("many = 0").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
        a, b = (info.select(F.col("cid").alias(s), *[F.col(c).alias(s + c) for c in ("n", "l", "h")]) for s in ("u", "v"))
        owed = F.greatest(F.lit(1), F.least("ul", "vl") - F.least("uh", "vh"))
        near = pairs.join(a, "u").join(b, "v").where(self._near_sizes(F.col("un"), F.col("vn")) & (F.col("c") >= owed)).select("u", "v", F.col("u").alias("x"), F.col("v").alias("y"))
        near = stage(near, "pairs")
        members = info.where("h >= least").select("cid")
        sets = self._whole(near.select(F.col("u").alias("cid")).unionByName(near.select(F.col("v").alias("cid"))).unionByName(members).distinct())
        links = self._verified(near, sets)
        unstage(found, near)

        lists = self._lengthened(sets.join(members, "cid", "left_semi"))
        unstage(info)
        stars = self._verified(self._stars(lists), sets)
        comps = connected_components(links.unionByName(stars))
        rest = self._verified(self._rest(lists, comps), sets)  # links between components
        merged = connected_components(rest).select(F.col("node").alias("component"), F.col("component").alias("to"))
        unstage(lists, sets, links, stars, rest)
        alone = merged.join(comps.select("node"), F.col("component") == F.col("node"), "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
        return comps.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(alone)

    def _lengthened(self, sets: DataFrame) -> DataFrame:
        """For classes whose prefixes are all costly shingles: prefixes of whole sets, the rarest among these classes first.

        Shingles of one of them alone match nothing (lone of n). Returns token, cid, n, lone, the token's rank in the class and salt, by which long lists are dealt.
        """
        percent = self.percent
        tokens = sets.mapInArrow(lean("join", _tokens), "token long, cid long, n long")
        rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        order = Window.partitionBy("cid").orderBy("df", "token")
        # a shingle of one class alone comes before all others of the class: their number is what ranks start from
        ranked = tokens.join(rare.where("df > 1"), "token").withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("cid")))
        ranked = ranked.withColumn("lone", F.col("n") - F.col("shared")).withColumn("rank", F.col("rank") + F.col("lone"))
        one = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
        kept = ranked.where(F.col("rank") <= one).withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
        return stage(kept.select("token", "cid", "n", "lone", "rank", "salt"), "costly-lists")

    def _can_meet(self, n: Column, rank: Column, m: Column, rank_m: Column) -> Column:
        """Whether two classes whose first common shingle has these ranks can still share enough. (A later common shingle may say no: the first has a row too.)"""
        return (F.least(n - rank, m - rank_m) + 1) * (100 + self.percent) >= (n + m) * self.percent

    def _stars(self, lists: DataFrame) -> DataFrame:
        """Each list's pivot with the list's members. The pivot has the smallest share of lone shingles, so copies are likely close to it."""
        pivots = lists.groupBy("token").agg(F.min(F.struct(F.col("lone") / F.col("n"), F.xxhash64("cid"), "cid", "n", "rank")).alias("p"))
        pivots = pivots.select("token", F.col("p.cid").alias("pc"), F.col("p.n").alias("pn"), F.col("p.rank").alias("pr"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pairs = lists.join(pivots, ["token", "salt"]).where((F.col("pc") != F.col("cid")) & self._can_meet(F.col("n"), F.col("rank"), F.col("pn"), F.col("pr")))
        pairs = pairs.select(F.least("cid", "pc").alias("u"), F.greatest("cid", "pc").alias("v")).distinct()
        return stage(pairs.select("u", "v", F.col("u").alias("x"), F.col("v").alias("y")), "stars")

    def _rest(self, lists: DataFrame, comps: DataFrame) -> DataFrame:
        """All pairs of a list across components that can meet: the exact way for what the pivots left. Members of a list's largest component aren't paired among themselves."""
        marked = lists.join(comps.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        marked = stage(marked, "marked-lists")
        sizes = marked.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
        mixed = sizes.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "main")
        mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = stage(marked.join(mixed, ["token", "salt"]), "mixed-lists")
        a = left.where("component <> main").select("token", F.col("cid").alias("u"), F.col("n").alias("un"), F.col("component").alias("uc"), F.col("rank").alias("ur"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        b = left.select("token", "salt", F.col("cid").alias("v"), F.col("n").alias("vn"), F.col("component").alias("vc"), F.col("rank").alias("vr"), "main")
        once = (F.col("vc") == F.col("main")) | (F.col("u") < F.col("v"))
        pairs = a.join(b, ["token", "salt"]).where((F.col("uc") != F.col("vc")) & once & self._near_sizes(F.col("un"), F.col("vn")) & self._can_meet(F.col("un"), F.col("ur"), F.col("vn"), F.col("vr")))
        pairs = stage(pairs.select("u", "v", F.col("uc").alias("x"), F.col("vc").alias("y")).distinct(), "rest")
        unstage(marked, left)
        return pairs

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), and h1 and h2 of the row's key."""
        comps = self.class_components().select(F.col("node").alias("cid"), "component")
        classes = self.classes.join(comps, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
        to = stage(classes.join(least, "component").select("cid", "component_id"), "class-components")
        out = self.rows.select("doc_id", "h1", "h2", "cid", "n").join(to, "cid", "left")
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "h1", "h2")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text: what tells rows apart, but for repeated ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))


def _same_key(a: str, b: str) -> Column:
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("h1", "h2")]
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & same[0] & same[1]


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """Link documents (doc_id, text) whose shingle sets have a Jaccard similarity of at least percent / 100.

    Returns doc_id, n_shingles and component_id, a row per row. Documents without words have empty sets, link with nothing and are
    their own component; one of fewer words than a shingle is one shingle. Equal sets always link; they are one class, compared once. Rows with a null id take part, but give no component its
    name (a component of null ids only has a null name). Repeated rows get equal results. Other columns are not looked at. An empty table
    gives an empty result.
    """
    return NgramJoin(docs, percent, size).components().select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """One document of each component, that with the smallest id, with all columns of docs; documents without words stay as well.

    Of repeated rows with that id and equal texts one stays; null texts are equal to each other. Rows are told apart by their id and two hashes of their text. No column of docs
    is touched, whatever its name. An empty table gives an empty one.
    """
    found = NgramJoin(docs, percent, size).components()
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h1", "h2").distinct()
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), whole.alias("row"))
    first = rows.alias("t").join(kept.alias("a"), _same_key("t", "a"), "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    return first.select("row.*")
