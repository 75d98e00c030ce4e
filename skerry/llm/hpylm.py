"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Every word before (and a text's start) is a context with a restaurant of its own. All have one parent, the restaurant of words without
context, whose customers are the contexts' tables and whose base is uniform. A sweep seats the customers of every dish of
every restaurant anew, one after another, given the tables of the sweep before: seats of different dishes don't depend on each other then, so
pairs are dealt over buckets and are seated there. The values of frequent words and contexts are looked up; a pair with a seldom word lies in that word's bucket, one with
a seldom context only in the context's, and what is known of a seldom one goes to its bucket. So only pairs of two seldom ones have to ask for a value.
A dish with one customer has one table, so only pairs seen twice or more are seated. Scores average the predictive probabilities of the samples after the first sweep.

Pairs travel and lie as packed arrays, a row for each bucket and some millions of tokens: a dictionary of the words in it (frequent ones by their place in the list of them) and places in that.
A text asks for each different pair of its row once, and probabilities come back in the order in which they were asked for. Texts are scored in a few rounds, so that only one round's
questions and answers lie on disk at a time.
"""

from __future__ import annotations

import gc
import secrets
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, process_cache, ship, shuffle_partitions, stage, unstage
from .packing import parts_of
from .shingles import mixed, word_hashes

END = 0x5EED00  # the end token's code, and the context of a text's first word
D0, THETA0 = 0.7, 20.0
D1, THETA1 = 0.8, 1.0
SWEEPS, BURN = 3, 1
LARGE = 200_000  # frequent words, whose values (as words and as contexts) every worker looks up
SAMPLE_BYTES = 32 << 20  # of text, from which they are chosen: what is chosen decides where a pair lies, not its score
BUCKET_BYTES = 16 << 20  # of text, about two million tokens
BATCH_BYTES = 2 << 20
FLUSH = 2_200_000
ROUNDS, ROUND_BYTES = 2, 16 << 20  # of scored texts, as many at most, of so many bytes at least
SEED = 11
WORD, CONTEXT = 0, 1  # what a code is
HOME, ASKED, SELDOM = 0, 1, 2  # rows of texts
SINGLES, SEATS, TALLY = 0, 1, 2  # rows of buckets


def sparing(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A group's function that gives its memory back at its end; the next task of the worker may be another step's."""
    if run.__code__.co_argcount == 1:
        return lambda group: _spared(run, group)
    return lambda left, right: _spared(run, left, right)


def _spared(run: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    try:
        return run(*tables)
    finally:
        give_back()


def coded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token codes (a hash of each word, and then an end), and the texts' lengths."""
    words, counts = word_hashes(part.column(1))
    return np.insert(words, np.cumsum(counts), np.uint64(END)), counts + 1


# fixed values: the multipliers of the public 64-bit xxHash
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def pair_codes(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two longs."""
    one, two, three, four, five = PRIMES
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    code = np.full(len(context), 42, np.uint64)
    for x in (context, token):
        code = code + five + np.uint64(8)
        code ^= turned(x * two, 31) * one
        code = turned(code, 27) * one + four
        code = (code ^ (code >> np.uint64(33))) * two
        code = (code ^ (code >> np.uint64(29))) * three
        code ^= code >> np.uint64(32)
    return code


def packed(x: np.ndarray) -> bytes:
    """An array, whole numbers in as few bytes each as the largest needs, all first bytes, all second ones and so on, compressed."""
    if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
        x = x.astype(np.min_scalar_type(int(x.max())))
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode().ljust(4) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    """What was packed."""
    kind = np.dtype(b[:4].decode().strip())
    raw = np.frombuffer(pa.decompress(b[12:], int.from_bytes(b[4:12], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, len(raw) // kind.itemsize).T).view(kind).ravel()


def packed_codes(codes: np.ndarray, frequent: np.ndarray) -> bytes:
    """Codes, ascending frequent ones and then ascending others: places in the list of frequent ones, and hashes."""
    hot = int(among(codes, frequent).sum())
    first = packed(steps(np.searchsorted(frequent, codes[:hot])))
    return len(first).to_bytes(8, "little") + first + packed(steps(codes[hot:]))


def unpacked_codes(b: bytes, frequent: np.ndarray) -> np.ndarray:
    """What was packed with the same list."""
    size = int.from_bytes(b[:8], "little")
    first, rest = unpacked(b[8 : 8 + size]), unpacked(b[8 + size :])
    return np.concatenate([frequent[np.cumsum(first, dtype=np.int64)], np.cumsum(rest, dtype=np.uint64)])


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different codes and each code's place in them; by hashing, as most are repeated."""
    found = pa.array(codes).dictionary_encode()
    values = found.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[found.indices.to_numpy()]


def frequent_first(codes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The order in which ascending codes are packed."""
    return np.argsort(~among(codes, frequent), kind="stable")


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes' buckets."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def own_bucket(code: str, buckets: int) -> Column:
    """bucket_of as a column."""
    return F.shiftright(F.shiftrightunsigned(code, 32) * F.lit(buckets), 32).cast("int")


class Pairs:
    """The distinct pairs of some texts' tokens, in order of their buckets: n and slot (each token's pair), and a slice for each bucket."""

    def __init__(self, tokens: np.ndarray, frequent: np.ndarray, buckets: int):
        codes, places = distinct(np.append(tokens, np.uint64(END)))
        order, u = frequent_first(codes, frequent), len(codes)
        rank = np.empty(u, np.int64)
        rank[order] = np.arange(u)
        self.codes, places = codes[order], rank[places]
        # texts end with END, so a text's first word has it before
        keys, slot, n = np.unique(np.concatenate([places[-1:], places[:-2]]) * u + places[:-1], return_inverse=True, return_counts=True)
        ctx, word = keys // u, keys % u
        self.seldom, self.home = ~among(self.codes, frequent), bucket_of(self.codes, buckets)
        bucket = np.where(self.seldom[word], self.home[word], np.where(self.seldom[ctx], self.home[ctx], bucket_of(pair_codes(self.codes[ctx], self.codes[word]), buckets)))
        bucket = bucket.astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        self.ctx, self.word, self.n = ctx[order], word[order], n[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.slot = rank[slot]
        self.ends = np.cumsum(np.bincount(bucket, minlength=buckets))

    def slices(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, its pairs, which codes they have, places of contexts and of words among these)."""
        place = np.zeros(len(self.codes), np.int64)
        for b in np.flatnonzero(np.diff(self.ends, prepend=0)).tolist():
            at = slice(int(self.ends[b - 1]) if b else 0, int(self.ends[b]))
            if 64 * (at.stop - at.start) < len(self.codes):
                own = np.unique(np.concatenate([self.ctx[at], self.word[at]]))
            else:
                mark = np.zeros(len(self.codes), bool)
                mark[self.ctx[at]] = mark[self.word[at]] = True
                own = np.flatnonzero(mark)
            place[own] = np.arange(len(own))
            yield b, at, own, place[self.ctx[at]], place[self.word[at]]


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as their differences; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Tuples as a batch with the columns of a Spark schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


COUNTED = "bucket int, codes binary, ctx binary, word binary, n binary"


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (code, n) of words."""
    for batch in batches:
        for part in parts_of(batch, BATCH_BYTES):
            codes, n = np.unique(coded(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])


def _count(path: str, buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> distinct pairs of some millions of tokens at a time, a row for each bucket."""
    held: list[np.ndarray] = []
    frequent = _frequent(path)

    def out() -> pa.RecordBatch:
        pairs = Pairs(np.concatenate(held), frequent, buckets)
        held.clear()
        return _rows(COUNTED, [(b, packed_codes(pairs.codes[own], frequent), packed(steps(c)), packed(w), packed(pairs.n[at])) for b, at, own, c, w in pairs.slices()])

    for batch in batches:
        for part in parts_of(batch, BATCH_BYTES):
            held.append(coded(part)[0])
            if sum(map(len, held)) >= FLUSH:
                yield out()
    if held:
        yield out()


GATHERED = "kind int, bucket int, role int, code long, c long, single long, t long, codes binary, ctx binary, word binary, n binary, tables binary, sat binary"


def _tallies(bucket: int, codes: np.ndarray, places: np.ndarray, role: int, *weights: np.ndarray | None) -> pa.RecordBatch:
    """Sums by code of c, single and t, as rows of a bucket."""
    sums = [None if w is None else np.bincount(places, w, len(codes)).astype(np.int64) for w in weights]
    some = np.flatnonzero(np.bincount(places, minlength=len(codes)))
    size, none = len(some), lambda k: pa.nulls(len(some), k)
    numbers = [none(pa.int64()) if x is None else pa.array(x[some]) for x in sums]
    ints = [pa.array(np.full(size, x, np.int32)) for x in (TALLY, bucket, role)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(codes[some].view(np.int64)), *numbers, *[none(pa.binary())] * 6], names=[x.split()[0] for x in GATHERED.split(", ")])


def _gather(path: str) -> Callable[[pa.Table], pa.Table]:
    """A bucket's rows of COUNTED -> its pairs seen once, those seen more often, and what it knows of words and contexts."""

    def run(group: pa.Table) -> pa.Table:
        bucket, frequent = group["bucket"][0].as_py(), _frequent(path)
        cols = {k: [unpacked(x) for x in group[k].to_pylist()] for k in ("ctx", "word", "n")}
        owns = [unpacked_codes(x, frequent) for x in group["codes"].to_pylist()]
        codes = np.unique(np.concatenate(owns))
        order, u, keys = frequent_first(codes, frequent), len(codes), []
        rank = np.empty(u, np.int64)
        rank[order] = np.arange(u)
        for own, c, w in zip(owns, cols["ctx"], cols["word"]):
            to = rank[np.searchsorted(codes, own)]
            keys.append(to[np.cumsum(c, dtype=np.int64)] * u + to[w])
        codes = codes[order]
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(cols["n"])).astype(np.int64)
        ctx, word = keys // u, keys % u
        once = n == 1
        rows = []
        for kind, these in ((SINGLES, once), (SEATS, ~once)):
            mark = np.zeros(u, bool)
            mark[ctx[these]] = mark[word[these]] = True
            place = np.cumsum(mark) - 1
            ones = packed(np.ones(these.sum(), np.uint8))
            more = [packed(n[these]), ones, packed(np.zeros(these.sum(), np.uint8))] if kind == SEATS else [None] * 3
            rows.append((kind, bucket, None, None, None, None, None, packed_codes(codes[mark], frequent), packed(steps(place[ctx[these]])), packed(place[word[these]]), *more))
        told = [_tallies(bucket, codes, x, role, n, once, ~once) for role, x in ((WORD, word), (CONTEXT, ctx))]
        return pa.Table.from_batches([_rows(GATHERED, rows), *told])

    return run


class RowDraws:
    """Random numbers of rows, each from its own key: a row's numbers don't depend on what rows come with it."""

    def __init__(self, sweep: int, *keys: np.ndarray):
        code = mixed(np.full(len(keys[0]), (SEED << 32) + sweep + 1, np.uint64))
        for key in keys:
            code = mixed(code * np.uint64(3) + key.view(np.uint64))
        self.keys, self.step = code, 0

    def random(self, rows: np.ndarray) -> np.ndarray:
        """The next number of each of the rows, from 0 to below 1. Rows that are asked for drop out one by one and never come back, so a row's steps are its own."""
        self.step += 1
        return (mixed(self.keys[rows] + np.uint64(self.step * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator | RowDraws) -> np.ndarray:
    """Tables that so many customers of one dish take, one after another: a new one by weight new, an old one by its customers less the discount.

    The next customer who may open a table is drawn at the present chance, which only falls until a table opens, and opens one by the chance's
    share that is left (thinning, which is exact for any number of customers).
    """
    draw = rng.random if isinstance(rng, RowDraws) else lambda rows: rng.random(len(rows))
    tables = np.minimum(customers, 1)
    live = np.flatnonzero(customers > 1)
    at = np.ones(len(live))
    while len(live):
        a, c, dt = new[live], customers[live], discount * tables[live]
        total = a + at - dt
        with np.errstate(divide="ignore"):
            jump = np.floor(np.log1p(-draw(live)) / np.log1p(-np.clip(a / total, 1e-18, 1.0))) + 1  # how many customers until one may open a table
        to = at + np.maximum(jump, 1)  # the customer number to, after to - 1 others
        inside = to <= c
        live, to, a, dt, total = live[inside], to[inside], a[inside], dt[inside], total[inside]
        tables[live] += draw(live) * (a + to - 1 - dt) < total
        more = to < customers[live]
        live, at = live[more], to[more]
    return tables


def _root(sweep: int, weight: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the column t: tables of the root for the customers of a word, none for a context."""
    for batch in batches:
        if batch.num_rows:
            code = batch.column("code").to_numpy()
            customers = np.where(batch.column("role").to_numpy() == WORD, batch.column("customers").to_numpy(), 0)
            t = seat(customers, np.full(len(code), weight), D0, RowDraws(sweep, code))
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)) if k == "t" else batch.column(k) for k in batch.schema.names], names=batch.schema.names)


def _bounded(table: DataFrame, by: str, most: int) -> Column:
    """Which rows are the most frequent ones: all down to some level of column by, no more than so many, whatever the table's size."""
    level = F.floor(F.log2(F.greatest(F.col(by), F.lit(1))) * 8)
    down, taken = None, 0
    for step, n in sorted(table.groupBy(level.alias("l")).count().collect(), reverse=True):
        if taken + n > most:
            break
        down, taken = step, taken + n
    return level >= F.lit(down) if down is not None else F.lit(False)


def _lookup(path: str) -> dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The frequent words' and contexts' sorted codes and values, read once a worker process."""
    held = process_cache("hpylm")
    if held.get("path") != path:
        held.update(path=path, table=_by_role(_read(path)))
    return held["table"]


def _read(path: str) -> pa.Table:
    fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pa.dataset.dataset(name, format="parquet", filesystem=fs).to_table()


def _by_role(table: pa.Table) -> dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Sorted codes and values of words and of contexts, of rows (role, code, values ...)."""
    out = {}
    for role in (WORD, CONTEXT):
        rows = table.filter(pc.equal(table["role"], role)) if table.num_columns and table.num_rows else None
        codes = np.zeros(0, np.uint64) if rows is None else rows["code"].to_numpy().view(np.uint64)
        order = np.argsort(codes)
        out[role] = codes[order], {} if rows is None else {k: rows[k].to_numpy()[order] for k in rows.column_names if k not in ("role", "code", "bucket", "flush")}
    return out


def _values(codes: np.ndarray, role: int, name: str, default: float, *tables: dict) -> np.ndarray:
    """A value of each code as the tables tell, or else the default."""
    out = np.full(len(codes), default, np.float64)
    for table in tables:
        known, values = table[role]
        if len(known) and name in values:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[at] == codes
            out[hit] = values[name][at[hit]]
    return out


VALUES = "bucket int, role int, a binary, b binary, c binary"


def _pack_values(group: pa.Table) -> pa.Table:
    """A bucket's seldom words and contexts (bucket, role, code, n_c, v0, ...) -> a row of each: codes, counts, and values of all samples."""
    rows, names = [], sorted(k for k in group.column_names if k.startswith("v"))
    for role, (codes, values) in _by_role(group).items():
        if len(codes):
            rows.append((group["bucket"][0].as_py(), role, packed(steps(codes)), packed(values["n_c"]), packed(np.concatenate([values[k] for k in names]))))
    return pa.Table.from_batches([_rows(VALUES, rows)])


def _unpack_values(rows: list[dict]) -> dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]:
    """A bucket's rows of VALUES as _by_role gives them."""
    out: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]] = {role: (np.zeros(0, np.uint64), {}) for role in (WORD, CONTEXT)}
    for row in rows:
        codes, values = np.cumsum(unpacked(row["a"]), dtype=np.uint64), unpacked(row["c"])
        samples = len(values) // len(codes)
        out[row["role"]] = codes, {"n_c": unpacked(row["b"]), **{f"v{i}": x for i, x in enumerate(values.reshape(samples, len(codes)))}}
    return out


def _tell(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What other buckets ask of a bucket (role, code, bucket), and its rows of VALUES -> the asked values; nothing for what isn't known."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _unpack_values(right.to_pylist()), []
        for role, (codes, values) in known.items():
            asks = left.filter(pc.equal(left["role"], role))
            if asks.num_rows and len(codes):
                asked = asks["code"].to_numpy().view(np.uint64)
                hit = among(asked, codes)
                at = np.searchsorted(codes, asked[hit])
                cols = {k: pa.array(x[at]) for k, x in values.items()}
                for k in ("bucket", "role", "code"):
                    cols[k] = asks[k].combine_chunks().filter(pa.array(hit))
                out.append(pa.Table.from_arrays([cols[f.name] for f in schema], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _frequent(path: str) -> np.ndarray:
    """The frequent words' sorted codes, read once a worker process."""
    held = process_cache("hpylm")
    if held.get("frequent_path") != path:
        held.update(frequent_path=path, frequent=np.sort(_read(path)["code"].to_numpy().view(np.uint64)))
    return held["frequent"]


ASKS = "bucket int, role int, code long"


def _asks(bucket: int, role: int, codes: np.ndarray, places: np.ndarray, here: np.ndarray) -> pa.RecordBatch:
    """What a bucket has to ask for: the codes at places whose values aren't here."""
    mark = np.zeros(len(codes), bool)
    mark[places] = True
    rest = codes[mark & ~here].view(np.int64)
    ints = [pa.array(np.full(len(rest), x, np.int32)) for x in (bucket, role)]
    return pa.RecordBatch.from_arrays([*ints, pa.array(rest)], names=["bucket", "role", "code"])


def _seldom(path: str, buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets' rows -> what they have to ask for."""
    for batch in batches:
        for row in batch.to_pylist():
            codes = unpacked_codes(row["codes"], _frequent(path))
            here = among(codes, _frequent(path)) | (bucket_of(codes, buckets) == row["bucket"])
            for role, places in ((WORD, unpacked(row["word"])), (CONTEXT, np.cumsum(unpacked(row["ctx"]), dtype=np.int64))):
                yield _asks(row["bucket"], role, codes, places, here)


def _sweep(path: str, frequent_path: str, sweep: int, counts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's pairs with the values of its seldom words and contexts -> the same pairs seated anew, and tables by word and by context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, frequent = (_lookup(path), _by_role(right)), _frequent(frequent_path)
        out = []
        for row in left.to_pylist():
            codes, word, n = unpacked_codes(row["codes"], frequent), unpacked(row["word"]), unpacked(row["n"])
            ctx = np.cumsum(unpacked(row["ctx"]), dtype=np.int64)
            now, opens = (_values(codes, role, "value", np.nan, *tables) for role in (WORD, CONTEXT))
            weight, signed = opens[ctx] * now[word], codes.view(np.int64)
            if np.isnan(weight).any():
                raise ValueError("a pair's word or context is unknown")
            t = seat(n.astype(np.int64), weight, D1, RowDraws(sweep, signed[word], signed[ctx]))
            sat = unpacked(row["sat"]).astype(np.int64) + (t if counts else 0)
            keep = [row[k] for k in ("codes", "ctx", "word", "n")]
            out.append(_rows(GATHERED, [(SEATS, row["bucket"], None, None, None, None, None, *keep, packed(t), packed(sat))]))
            out.extend(_tallies(row["bucket"], codes, x.astype(np.int64), role, None, None, t) for role, x in ((WORD, word), (CONTEXT, ctx)))
        return pa.Table.from_batches(out, _rows(GATHERED, []).schema)

    return run


class PitmanYorModel:
    """What docs taught: words (word, c, r0, ...: the root's probability, a sample each), contexts (ctx, total, s0, ...: the root's weight), pairs (code, n, c, p)."""

    def __init__(self, docs: DataFrame, sweeps: int = SWEEPS, burn: int = BURN):
        """Learn from docs (doc_id, text): all of them, whole texts."""
        ship(docs.sparkSession)
        self.samples = sweeps - burn
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = buckets = max(shuffle_partitions(docs.sparkSession), int(size) // BUCKET_BYTES)
        share = int(2**31 * min(1.0, SAMPLE_BYTES / max(size, 1)))
        sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(2**31)) < share).mapInArrow(lean("hpylm", _words), "code long, n long")
        sampled = stage(sample.groupBy("code").agg(F.sum("n").alias("n")), "sampled")
        self.frequent = stage(sampled.where(_bounded(sampled, "n", LARGE)).select("code"), "frequent")
        unstage(sampled)
        path = self.frequent._staged_path
        gathered = stage(texts.mapInArrow(lean("hpylm", lambda b: _count(path, buckets, b)), COUNTED).groupBy("bucket").applyInArrow(sparing(_gather(path)), GATHERED), "gathered", ["kind"])
        sums = [F.sum(k).alias(k) for k in ("c", "single", "t")]
        tally = gathered.where(F.col("kind") == TALLY).groupBy("role", "code").agg(*sums).withColumn("seated", F.col("t") > 0)
        tally = tally.join(F.broadcast(self.frequent.withColumn("often", F.lit(True))), "code", "left").withColumn("often", F.coalesce("often", F.lit(False)))
        tally = told = first = stage(tally, "tally")
        unstage_kind(gathered, TALLY)
        self.n, self.v = (int(x or 0) for x in tally.where(F.col("role") == WORD).agg(F.sum("c"), F.count(F.lit(1))).first())
        base = 1 / (self.v + 1)
        seats, seldom = gathered, None
        self.floors: list[float] = []
        tables0 = float(self.v)
        # contexts without seats never change, nor do words that are one customer of the root
        still = ~F.col("seated") & ((F.col("role") == CONTEXT) | (F.col("single") == 1))
        alone = tally.where(still & (F.col("role") == WORD)).count()
        tally = tally.where(~still)
        lone = []
        for sweep in range(sweeps + 1):
            sample = sweep - burn - 1
            # a word's customers in the root are its tables in all contexts; a context's tables are those of all its words
            if sweep == 0:
                rows = tally.withColumn("customers", F.col("single") + F.col("t"))
            else:
                served = seats.where(F.col("kind") == TALLY).groupBy("role", "code").agg(F.sum("t").alias("_t"))
                rows = tally.where("seated").join(served, ["role", "code"]).withColumn("customers", F.col("single") + F.col("_t")).drop("_t")
                rows = rows.unionByName(tally.where("not seated").withColumn("customers", F.col("single")))
            weight = float((THETA0 + D0 * tables0) * base)
            rooted = stage(rows.mapInArrow(lambda b, s=sweep, w=weight: _root(s, w, b), rows.schema), "rooted")
            if told is not first:
                unstage(told)
            customers0, tables0 = (float((x or 0) + alone) for x in rooted.where(F.col("role") == WORD).agg(F.sum("customers"), F.sum("t")).first())
            floor = (THETA0 + D0 * tables0) * base / (THETA0 + customers0)
            root = (F.col("customers") - F.lit(D0) * F.col("t")) / F.lit(THETA0 + customers0) + F.lit(floor)
            opens = F.lit(THETA1) + F.lit(D1) * F.col("customers")
            tally, told = rooted.drop("customers"), rooted
            if sample >= 0:
                self.floors.append(floor)
                lone.append((1 - D0) / (THETA0 + customers0) + floor)
                share = F.when(F.col("role") == WORD, root).otherwise(opens / (F.lit(THETA1) + F.col("c")))
                tally = rooted.withColumn(f"v{sample}", share.cast("float")).drop("customers")
            if sweep < sweeps:
                # only those with seats, of pairs seen twice or more
                now = rooted.where("seated").select("role", "code", F.when(F.col("role") == WORD, root).otherwise(opens).alias("value"), "often")
                top = stage(now.where("often").drop("often"), "often")
                rest = now.where("not often").drop("often")
                these = seats.where(F.col("kind") == SEATS)
                if seldom is None:
                    seldom = stage(these.select("bucket", "codes", "ctx", "word").mapInArrow(lean("hpylm", lambda b: _seldom(path, buckets, b)), ASKS), "seldom")
                given = rest.withColumn("bucket", own_bucket("code", buckets)).unionByName(seldom.join(rest, ["role", "code"]))
                anew = these.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(sparing(_sweep(top._staged_path, path, sweep, sweep >= burn)), GATHERED)
                after = stage(anew, "seats", ["kind"])
                unstage(top)
                if seats is gathered:
                    unstage_kind(gathered, SEATS)
                else:
                    unstage(seats)
                seats = after
                del now, rest, these, given, anew
            rows = served = None
            _free(docs)
        idle = (F.lit(THETA1) + F.lit(D1) * F.col("single")) / (F.lit(THETA1) + F.col("c"))
        idle = first.where(still).withColumns({f"v{i}": F.when(F.col("role") == WORD, F.lit(x)).otherwise(idle).cast("float") for i, x in enumerate(lone)})
        self.entities = stage(tally.drop("single", "t", "seated").unionByName(idle.drop("single", "t", "seated")), "entities")
        unstage(first, told, *([seldom] if seldom is not None else []))
        unstage_kind(seats, TALLY)
        keep = ("bucket", "codes", "ctx", "word", "n", "sat")
        self.states = gathered.where(F.col("kind") == SINGLES).select(*keep).unionByName(seats.where(F.col("kind") == SEATS).select(*keep))
        _free(docs)

    def _entities(self, role: int, code: str, count: str, value: str) -> DataFrame:
        return self.entities.where(F.col("role") == role).select(F.col("code").alias(code), F.col("c").alias(count), *[F.col(f"v{i}").alias(f"{value}{i}") for i in range(self.samples)])

    @property
    def words(self) -> DataFrame:
        return self._entities(WORD, "word", "c", "r")

    @property
    def contexts(self) -> DataFrame:
        return self._entities(CONTEXT, "ctx", "total", "s")

    @property
    def pairs(self) -> DataFrame:
        """All pairs as rows; scores don't need them."""
        samples, path = self.samples, self.frequent._staged_path
        every = self.states.mapInArrow(lambda b: _unfolded(path, samples, b), "ctx long, word long, n long, kept double").join(self.words, "word").join(self.contexts, "ctx")
        own = F.col("kept") / (F.lit(THETA1) + F.col("total"))
        return every.select(pair_code("ctx", "word").alias("code"), "n", "c", (own + self.backed_off()).cast("float").alias("p"))

    def backed_off(self) -> Column:
        """The part of a probability that comes from the root, averaged over samples, of rows joined to words and contexts; nulls: an unknown word or context."""
        total = F.lit(0.0)
        for s, floor in enumerate(self.floors):
            total = total + F.coalesce(F.col(f"s{s}").cast("double"), F.lit(1.0)) * F.coalesce(F.col(f"r{s}").cast("double"), F.lit(floor))
        return total / F.lit(float(self.samples))


def _state(frequent: np.ndarray, samples: int, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of states: codes, places of contexts and words, customers, and customers less the tables' discounts, averaged over samples."""
    codes, word = unpacked_codes(row["codes"], frequent), unpacked(row["word"])
    ctx = np.cumsum(unpacked(row["ctx"]), dtype=np.int64)
    if row["n"] is None:
        return codes, ctx, word, np.ones(len(word), np.int64), np.full(len(word), 1 - D1)
    n = unpacked(row["n"]).astype(np.int64)
    return codes, ctx, word, n, n - D1 * unpacked(row["sat"]) / samples


def _unfolded(path: str, samples: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, ctx, word, n, kept = _state(_frequent(path), samples, row)
            yield pa.RecordBatch.from_arrays([pa.array(codes[ctx].view(np.int64)), pa.array(codes[word].view(np.int64)), pa.array(n), pa.array(kept)], names=["ctx", "word", "n", "kept"])


def unstage_kind(staged: DataFrame, kind: int) -> None:
    """Delete the rows of one kind of a table staged by kind."""
    context = staged.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{staged._staged_path}/kind={kind}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pair_code(ctx: str, word: str) -> Column:
    """A 64-bit code of a pair of codes."""
    return F.xxhash64(ctx, word)


def _free(df: DataFrame) -> None:
    """Let Spark delete shuffle files that nothing reads any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


TEXTS = "kind int, flush long, bucket int, role int, code long, a binary, b binary, c binary, d binary"


def _ask(path: str, frequent_path: str, buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, taught) -> of some millions of tokens at a time: the texts as numbers of pairs, their distinct pairs by bucket, and the pairs' seldom words and contexts."""
    table, frequent = _lookup(path), _frequent(frequent_path)
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        tokens, lengths, ids, null, taught = (np.concatenate(x) for x in zip(*held))
        held.clear()
        flush, pairs = secrets.randbits(62), Pairs(tokens, frequent, buckets)
        known = np.zeros(len(pairs.n), np.uint8)
        known[pairs.slot[np.repeat(taught, lengths)]] = 1
        rows = [(HOME, flush, None, None, None, packed(ids), packed(null.astype(np.uint8)), packed(lengths), packed(pairs.slot))]
        rest, top = [], {role: among(pairs.codes, codes) for role, (codes, _) in table.items()}
        for b, at, own, c, w in pairs.slices():
            codes, delivered = pairs.codes[own], pairs.seldom[own] & (pairs.home[own] == b)
            rows.append((ASKED, flush, b, None, None, packed_codes(codes, frequent), packed(steps(c)), packed(w), packed(known[at])))
            rest.extend(_asks(b, role, codes, x, delivered | top[role][own]) for role, x in ((WORD, w), (CONTEXT, c)))
        yield _rows(TEXTS, rows)
        seldom = pa.Table.from_batches(rest).combine_chunks()
        size, none = seldom.num_rows, lambda k: pa.nulls(size, k)
        if size:
            cols = [pa.array(np.full(size, SELDOM, np.int32)), none(pa.int64()), *[seldom[k].chunk(0) for k in ("bucket", "role", "code")], *[none(pa.binary())] * 4]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in TEXTS.split(", ")])

    waiting = 0
    for batch in batches:
        for part in parts_of(batch, BATCH_BYTES):
            tokens, lengths = coded(part)
            ids = part.column(0)
            held.append((tokens, lengths, pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            waiting += len(tokens)
            if waiting >= FLUSH:
                yield from out()
                waiting = 0
    if held:
        yield from out()


ANSWERS = "flush long, bucket int, p binary, c binary"


def _answer(path: str, frequent_path: str, samples: int, floors: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's pairs, and what texts ask of it with the values of seldom words and contexts -> each asked pair's probability and its word's count, in the order asked."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told, own = pc.is_valid(right["code"]), pc.and_(pc.is_null(right["flush"]), pc.is_null(right["code"]))
        asks = right.filter(pc.is_valid(right["flush"])).select(["flush", "bucket", "a", "b", "c", "d"]).to_pylist()
        if not asks:
            return pa.Table.from_batches([_rows(ANSWERS, [])])
        values = [k for k in right.column_names if k == "n_c" or k.startswith("v")]
        tables = _lookup(path), _unpack_values(right.filter(own).select(["role", "a", "b", "c"]).to_pylist()), _by_role(right.filter(told).select(["role", "code", *values]))
        frequent = _frequent(frequent_path)
        owns = [unpacked_codes(r["a"], frequent) for r in asks]
        codes = np.unique(np.concatenate(owns))
        u = len(codes)
        count, total = (_values(codes, role, "n_c", 0, *tables) for role in (WORD, CONTEXT))
        roots = [_values(codes, WORD, f"v{s}", floor, *tables) for s, floor in enumerate(floors)]
        shares = [_values(codes, CONTEXT, f"v{s}", 1.0, *tables) for s in range(samples)]
        keys, kept = [np.zeros(0, np.int64)], [np.zeros(0)]
        for row in left.to_pylist():
            own, ctx, word, _, k = _state(frequent, samples, row)
            to = np.minimum(np.searchsorted(codes, own), u - 1)
            here = codes[to] == own
            both = here[ctx] & here[word]
            keys.append(to[ctx[both]] * u + to[word[both]])
            kept.append(k[both])
        keys, kept = np.concatenate(keys), np.concatenate(kept)
        order = np.argsort(keys)
        keys, kept = keys[order], kept[order]
        rows = []
        for r, own in zip(asks, owns):
            to = np.searchsorted(codes, own)
            ctx, word = to[np.cumsum(unpacked(r["b"]), dtype=np.int64)], to[unpacked(r["c"])]
            key = ctx * u + word
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            if (unpacked(r["d"]).astype(bool) & ~hit).any():
                raise ValueError("a text that the model was said to know has a pair that it doesn't know")
            p = sum(s[ctx] * x[word] for s, x in zip(shares, roots)) / samples
            p[hit] += kept[at[hit]] / (THETA1 + total[ctx[hit]])
            rows.append((r["flush"], r["bucket"], packed(p.astype(np.float32)), packed(count[word].astype(np.int64))))
        return pa.Table.from_batches([_rows(ANSWERS, rows)])

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _total(base_log: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Texts as numbers of pairs, and all buckets' answers -> a row for each text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        home = left.to_pylist()[0]
        ids, null, lengths, slot = (unpacked(home[k]) for k in "abcd")
        answers = sorted(right.select(["bucket", "p", "c"]).to_pylist(), key=lambda r: r["bucket"])
        p, c = (np.concatenate([unpacked(r[k]).astype(np.float64) for r in answers]) for k in "pc")
        lengths = lengths.astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x[slot], begins) for x in ((c > 0).astype(np.int64), np.log10(c + 1) - base_log, np.log10(p))]
        ids = pa.array(ids.astype(np.int64), pa.int64(), mask=null.astype(bool))
        return pa.Table.from_arrays([ids, pa.array(lengths), *[pa.array(x) for x in sums]], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score_texts(docs: DataFrame, model: PitmanYorModel, frequent: int = LARGE, taught: Column | None = None, rounds: int | None = None) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, base_score and score (log10), whole texts.

    Some millions of tokens at a time ask the model's buckets for each of their distinct pairs once. The most frequent words and contexts (a fixed number at most,
    however large the corpus) are looked up there; all others meet the model by a shuffle. All texts are scored, a share of them in each round (by a hash; ROUNDS shares of larger tables), whose tables
    are deleted before the next. Rows where taught holds were among the model's texts (a wrong taught raises). Null and empty texts
    are one end token; repeated rows are scored each; null ids are kept; other columns are not looked at; an empty table gives an empty
    result, and a model of no texts is uniform.
    """
    ship(docs.sparkSession)
    known = model.entities.withColumnRenamed("c", "n_c")
    top, rest = known.where("often").drop("often"), known.where("not often")
    if frequent < LARGE:
        top, rest = top.where(_bounded(top, "n_c", frequent)), known
    top = stage(top, "often")
    delivered = rest.drop("often").withColumn("bucket", own_bucket("code", model.buckets))
    delivered = stage(delivered.groupBy("bucket").applyInArrow(_pack_values, VALUES), "values")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(False) if taught is None else F.coalesce(taught, F.lit(False))).alias("taught"))
    if rounds is None:
        rounds = min(ROUNDS, 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ROUND_BYTES)
    scores = None
    for i in range(rounds):
        share = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i) if rounds > 1 else rows
        done = _round(share, model, delivered, top._staged_path)
        scores = done if scores is None else scores.unionByName(done)
        _free(docs)
    unstage(top, delivered)
    return scores


def _round(rows: DataFrame, model: PitmanYorModel, delivered: DataFrame, path: str) -> DataFrame:
    """The scores of some texts, as a staged table."""
    buckets, samples, floors, frequent_path = model.buckets, model.samples, model.floors, model.frequent._staged_path
    base_log = float(np.log10(model.n + model.v + 1))
    asked = stage(rows.mapInArrow(lean("hpylm", lambda b: _ask(path, frequent_path, buckets, b)), TEXTS), "asked", ["kind"])
    seldom = asked.where(F.col("kind") == SELDOM).select("bucket", "role", "code", own_bucket("code", buckets).alias("own"))
    told = ", ".join(["bucket int", "role int", "code long", "n_c long", *[f"v{i} float" for i in range(samples)]])
    kinds = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}
    tell = _tell(pa.schema([(k, kinds[t]) for k, t in map(str.split, told.split(", "))]))
    seldom = stage(seldom.groupBy("own").cogroup(delivered.groupBy("bucket")).applyInArrow(tell, told), "seldom-values")
    asks = asked.where(F.col("kind") == ASKED).select("flush", "bucket", "a", "b", "c", "d").unionByName(seldom, allowMissingColumns=True).unionByName(delivered, allowMissingColumns=True)
    answers = stage(model.states.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(sparing(_answer(path, frequent_path, samples, floors)), ANSWERS), "answers")
    unstage_kind(asked, ASKED)
    unstage_kind(asked, SELDOM)
    unstage(seldom)
    del asks, seldom
    _free(rows)
    home = asked.where(F.col("kind") == HOME).select("flush", "a", "b", "c", "d")
    scores = stage(home.groupBy("flush").cogroup(answers.groupBy("flush")).applyInArrow(sparing(_total(base_log)), SCORES), "scores")
    unstage(asked, answers)
    return scores
