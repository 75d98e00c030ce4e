"""Word shingles of whole texts in bulk: vectorised over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = powers(BASE, CHUNK), powers(INVERSE, CHUNK)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes that aren't ASCII white space, A-Z folded) of all texts, and the number of words of each text.

    Words are hashed by sums of bytes times powers, taken between running sums, and then mixed; lengths go in too.
    """
    data = [t.encode() if t else b"" for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data], dtype=np.int64)])
    raw = FOLD[np.frombuffer(b"\n".join([*data, b""]), np.uint8)]
    space = SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    begins, ends = edge[::2], edge[1::2]
    # powers repeat after 65,536 bytes: a word is hashed from its own start, so that its place doesn't count
    sums = np.zeros(len(raw) + 1, np.uint64)
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    values *= np.resize(_POWERS, len(raw))
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * _INVERSES[begins % CHUNK]
    across = np.flatnonzero(begins // CHUNK != (ends - 1) // CHUNK)
    for i in across.tolist():  # the few words over the end of the powers
        h, n = 0, ends[i] - begins[i]
        for k, byte in enumerate(raw[begins[i] : ends[i]].tolist()):
            h += (byte + 1) * pow(BASE, k, 1 << 64)
        hashes[i] = np.uint64(h & (1 << 64) - 1)
    hashes = mixed(hashes + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts = np.diff(np.searchsorted(begins, offsets))
    return hashes, counts


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one text after another, and each set's size.

    A text of fewer words is one shingle as a whole; one without words has none.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    first = (np.cumsum(counts) - counts)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    span = np.minimum(counts, size)[owner]
    code = np.zeros(len(owner), np.uint64)
    for k in range(size):
        at = np.minimum(first + k, max(len(words) - 1, 0))
        step = mixed(code * np.uint64(3) + words[at] + np.uint64(k + 1)) if len(words) else code
        code = np.where(k < span, step, code)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[keep], np.bincount(owner[keep], minlength=len(counts))
