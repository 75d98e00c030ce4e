"""Distributed connected components: forests made in tasks, and rounds that join and shorten them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage, unstage

HELD_NODES = 300_000
OUT_ROWS = 1 << 16


def _forest(batches: Iterable[pa.RecordBatch], kind: pa.DataType, ordered: bool) -> Iterator[pa.RecordBatch]:
    """(u, v) -> (u, v, foreign): each node of these edges with the least node that it reaches by them.

    Rows of one u come together where ordered is set; a node that came as no u of its own here is foreign then. At most
    HELD_NODES nodes are held; what comes later starts another forest, which loses no connection.
    """
    parent: dict = {}
    own: set = set()

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(x, r, not ordered or x not in own) for x in parent if (r := root(x)) != x]
        for at in range(0, len(rows), OUT_ROWS):
            u, v, foreign = zip(*rows[at : at + OUT_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind), pa.array(foreign)], names=["u", "v", "foreign"])
        parent.clear()
        own.clear()

    last = None
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(parent) >= HELD_NODES and not (ordered and u == last):
                yield from out()
            last = u
            own.add(u)
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield from out()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph: edges has u and v, of one orderable type (long or string).

    Returns node and component (the component's least node), for nodes that are on an edge to
    another node. Loops, repeated edges and null ends are dropped; an empty table gives an empty one. Tasks turn their edges into forests without a shuffle;
    a round gathers each node's parents and then gives each node the least parent of each of its parents, by an equi-join that AQE may split where very many
    nodes have one parent. Rounds end when every node has one parent and no parent has one itself. Each is staged in the shared
    folder, and only a count comes to the driver.
    """
    ship(edges.sparkSession)
    kind = pa.string() if dict(edges.dtypes)["u"] == "string" else pa.int64()
    schema = f"u {dict(edges.dtypes)['u']}, v {dict(edges.dtypes)['u']}, foreign boolean"
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    tied = stage(edges.mapInArrow(lambda b: _forest(b, kind, False), schema), name)
    while True:
        near = tied.repartition("u").sortWithinPartitions("u").select("u", "v")
        forest = stage(near.mapInArrow(lambda b: _forest(b, kind, True), schema), name)
        unstage(tied)
        above = forest.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v"))
        tied = stage(forest.join(above, forest["v"] == above["_u"], "left").select("u", F.coalesce("_v", "v").alias("v"), (F.col("foreign") | F.col("_v").isNotNull()).alias("foreign")), name)
        unstage(forest)
        if not tied.where("foreign").limit(1).count():
            break
    return tied.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tied.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
