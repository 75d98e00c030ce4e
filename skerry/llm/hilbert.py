"""Hilbert-curve index as a DataFrame expression, from a state table built by rule."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def state_table(dims: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(digit, next state) of every state and cell of the dims-dimensional curve.

    A state is an entry corner and a main direction of the curve in a cube. Both follow from the
    Gray code: cell number w of the cube is visited in Gray order, rotated and reflected by the state.
    """
    mask = (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(w: int) -> int:
        return w ^ (w >> 1)

    rank = {gray(w): w for w in range(mask + 1)}

    def ones(w: int) -> int:
        return 0 if not w & 1 else 1 + ones(w >> 1)

    def enter(w: int) -> int:
        return 0 if w == 0 else gray((w - 1) // 2 * 2)

    def along(w: int) -> int:
        return 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims

    names = {(0, 0): 0}
    digits: list[int] = []
    following: list[int] = []
    queue = [(0, 0)]
    for corner, main in queue:
        for cell in range(mask + 1):
            w = rank[turn(cell ^ corner, dims - (main + 1) % dims)]
            state = (corner ^ turn(enter(w), main + 1), (main + along(w) + 1) % dims)
            if state not in names:
                names[state] = len(names)
                queue.append(state)
            digits.append(w)
            following.append(names[state])
    return tuple(digits), tuple(following)


def hilbert_value(coords: list[int], bits: int) -> int:
    """The index of one point, in Python; for tests and small uses."""
    dims = len(coords)
    digits, following = state_table(dims)
    h = s = 0
    for level in range(bits - 1, -1, -1):
        cell = sum(((x >> level) & 1) << i for i, x in enumerate(coords))
        h, s = (h << dims) | digits[(s << dims) + cell], following[(s << dims) + cell]
    return h


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """The index (long) of points whose coordinates are whole numbers of so many bits; dims * bits is 62 at most."""
    dims = len(coords)
    if dims * bits > 62:
        raise ValueError("dims * bits must not exceed 62")
    digits, following = state_table(dims)
    digit = F.array(*[F.lit(x).cast("long") for x in digits])
    after = F.array(*[F.lit(x) for x in following])
    levels = F.array(*[F.lit(x) for x in range(bits - 1, -1, -1)])

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for i, x in enumerate(coords):
            cell = cell + F.call_function("shiftright", x.cast("int"), level).bitwiseAND(F.lit(1)) * F.lit(1 << i)
        at = acc["s"] * F.lit(1 << dims) + cell
        return F.struct((acc["h"] * F.lit(1 << dims) + digit[at]).alias("h"), after[at].alias("s"))

    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step, lambda acc: acc["h"])
