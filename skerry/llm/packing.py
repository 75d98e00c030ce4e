"""Packing along a space-filling curve.

Hashed document vectors are projected to three dimensions; documents are range-sorted by the Hilbert index of
their projection and laid end to end, so that each sequence holds neighbours. Documents are cut where a
sequence is full, so that only the very last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered, process_cache, ship, stage, with_bases
from .hilbert import hilbert_index

DIMS, BITS = 3, 10
HASHED = 1024
SEED = 7
MEMO = 300_000
MEMO_CHARS = 64
BATCH_BYTES = 8 << 20


LATIN = "\u0250"


class ChunkTokenizer:
    """Token ids of whole texts, as little-endian bytes of unsigned numbers.

    The vocabulary lower-cases, and its tokens never span white space or pass from letters to signs, so a text's ids are those of
    its chunks between ASCII white space, and a chunk's those of its letters and of the signs behind them. Ids of
    short pieces are remembered in two generations of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        ids = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "~^`=<>"}
        self.sign, self.sign_id = next((c, i[0]) for c, i in ids.items() if len(i) == 1)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks by one call, with a sign between them that has one id; chunks that hold it are encoded by themselves."""
        together = [c for c in chunks if self.sign not in c]
        text = f" {self.sign} ".join(together)
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(ids == self.sign_id).tolist()
        found = dict(zip(together, [ids[a:b].tobytes() for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)])]))
        if len(ends) != max(len(together) - 1, 0):
            raise ValueError("the vocabulary doesn't keep signs apart")
        for c in chunks:
            if c not in found:
                found[c] = np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, self.kind).tobytes()
        return [found[c] for c in chunks]

    @staticmethod
    def cut(chunk: str) -> tuple[str, str]:
        """Letters and the signs behind them; other chunks stay whole. Only Latin letters, whose lower case and normal form are plain."""
        core = chunk.rstrip(".,;:!?|%&*$#")
        if core.isalpha() and max(core) < LATIN:
            return core.lower(), chunk[len(core) :]
        return chunk, ""

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, remembered or not."""
        if len(self.pieces) > MEMO:
            self.pieces, self.older = {}, self.pieces
        if len(self.chunks) > MEMO:
            self.chunks = {}
        memo, pieces, older = self.chunks, self.pieces, self.older
        out = list(map(memo.get, chunks))
        new = [i for i, ids in enumerate(out) if ids is None]
        cut = [self.cut(chunks[i]) for i in new]
        missing, large = [], {"": b""}
        for p in {p for pair in cut for p in pair if p and p not in pieces}:
            if p in older:
                pieces[p] = older[p]
            else:
                missing.append(p)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            for p, ids in zip(part, self.encode(part)):
                (pieces if len(p) <= MEMO_CHARS else large)[p] = ids
        for i, (a, b) in zip(new, cut):
            out[i] = (pieces[a] if a in pieces else large[a]) + (pieces[b] if b in pieces else large[b])
            if len(chunks[i]) <= MEMO_CHARS:
                memo[chunks[i]] = out[i]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and the number of each text's. Null texts have none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        known = self.learn(words.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(known), self.kind)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        at = words.indices.to_numpy()
        each = sizes[at]
        before = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - before[:-1], each) + np.arange(before[-1])]
        edges = lists.offsets.to_numpy()
        return ids, np.diff(before[edges - edges[0]])


def tokenizer_at(path: str) -> ChunkTokenizer:
    """One a worker process, so that what it remembers lasts over tasks."""
    held = process_cache("tokenizer")
    if path not in held:
        held[path] = ChunkTokenizer(path)
    return held[path]


@cache
def projection(size: int) -> np.ndarray:
    """Each id's hashed feature (bucket and sign) through a Gaussian projection: float32 [size, DIMS]."""
    rng = np.random.default_rng(SEED)
    gauss = rng.standard_normal((HASHED, DIMS), dtype=np.float32)
    mixed = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(mixed >> np.uint64(63), -1, 1).astype(np.float32)
    return gauss[(mixed >> np.uint64(40)).astype(np.int64) % HASHED] * sign[:, None]


def _vectors(path: str, end_id: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tok = tokenizer_at(path)
    table = projection(max(tok.tokenizer.get_vocab_size(), end_id + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), *[(f"x{i}", pa.int32()) for i in range(DIMS)]])

    def pack(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = tok.ids(part.column(1))
        ids = np.insert(ids, np.cumsum(sizes), end_id)
        sizes = sizes + 1
        starts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(table[ids], starts, axis=0)
        place = 1 / (1 + np.exp(-6 * sums / sizes[:, None]))
        cells = np.minimum((place * (1 << BITS)).astype(np.int32), (1 << BITS) - 1)
        edges = np.concatenate([starts, [len(ids)]]).astype(np.int32) * tok.kind.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(ids, tok.kind))])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), packed, *[pa.array(cells[:, i]) for i in range(DIMS)]], schema=schema)

    for batch in batches:
        for part in parts_of(batch, BATCH_BYTES):
            yield pack(part)


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (key, text) with so many bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row in its part."""
    total = 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_tokens"), pa.array(before, pa.int64()), batch.column("_part")], names=["uid", "doc_tokens", "before", "_part"])


def _pieces(length: int, kind: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve", "ids"]
    types = [pa.int64()] * 8 + [pa.binary()]

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, ids, at, curve in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "at", "curve")]):
            tokens = np.frombuffer(ids, kind).astype("<u4")
            start, total = 0, len(tokens)
            while start < total:
                sequence, offset = divmod(at + start, length)
                piece = tokens[start : start + length - offset].tobytes()
                yield doc_id, start, len(piece) // 4, zlib.crc32(piece), total, sequence, offset, curve, piece
                start += len(piece) // 4

    for batch in batches:
        rows = list(rows_of(batch))
        for a in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2000]), types)], names=names)


def pack_along_curve(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of so many tokens; tokenizer is the path of a word-bounded vocabulary.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve (the Hilbert index) and ids
    (the piece's tokens as little-endian unsigned 32-bit numbers). Every document ends in end_id, so empty and null texts are one token. Sequences are full, but for the last,
    which is padded by whoever writes it. Null ids and repeated rows are documents like others; ties on the curve
    are ordered by a hash. Other columns are not looked at. An empty table gives no pieces. The order needs a shuffle of thin
    rows only; ids are shuffled once, to meet their places.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = ", ".join(f"x{i} int" for i in range(DIMS))
    ids = rows.mapInArrow(lambda batches: _vectors(tokenizer, end_id, batches), f"doc_id long, doc_tokens long, ids binary, {fields}")
    ids = stage(ids.withColumn("uid", F.monotonically_increasing_id()), "token-ids")
    curve = hilbert_index([F.col(f"x{i}") for i in range(DIMS)], BITS)
    thin = ids.select("uid", "doc_tokens", curve.alias("curve"), F.xxhash64("uid").alias("_tie"))
    placed = ordered(thin, ["curve", "_tie", "uid"], "packing-order", partitions, lambda df: df.select("uid", "doc_tokens", "_part").mapInArrow(_running, "uid long, doc_tokens long, before long, _part int"))
    placed, _ = with_bases(placed, F.col("doc_tokens"), "_base")
    places = placed.select("uid", (F.col("_base") + F.col("before")).alias("at"))
    laid = ids.join(places.hint("shuffle_hash"), "uid").select("doc_id", "ids", "at", curve.alias("curve"))
    kind = ChunkTokenizer(tokenizer).kind.str
    return laid.mapInArrow(
        lambda batches: _pieces(length, kind, batches),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long, ids binary",
    )
