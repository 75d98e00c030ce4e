"""Merkle manifest of a dataset: a tree of digests for each language, one over their roots, and every row's proof.

Leaves are dealt in aligned blocks of 4096. A block's hex digests are one contiguous matrix, hashed level by level in rows of eight nodes;
siblings are slices found by index arithmetic. Blocks' roots are the leaves of the next table, until each tree has one node.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered, ship, stage, with_bases

FANOUT = 8
STEPS = 4
BLOCK = FANOUT**STEPS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, idx long, n long, digest string"
PATH = "tree string, idx long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(text: Column | None = None) -> Column:
    """SHA-256 over doc_id, source, lang, n_chars and text, each as its UTF-8 length, a colon and the value; `-` for a null."""
    cells = []
    for f in FIELDS:
        value = (text if f == "text" and text is not None else F.col(f)).cast("string")
        cells.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*cells), 256)


def folded_case(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_rows(folds: int = 3) -> Column:
    """Rows whose CRC of the decimal id is a multiple of folds; none with a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """The digests as one contiguous matrix of hex bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _levels(leaves: np.ndarray, n: int) -> list[np.ndarray]:
    """A block's levels from its leaves to its root: so many as a whole block has if its tree has more blocks, else until one node is left."""
    levels = [leaves]
    while len(levels) <= STEPS if n > BLOCK else len(levels[-1]) > 1:
        nodes = levels[-1]
        full = len(nodes) // FANOUT
        hashed = [sha256(row).hexdigest() for row in nodes[: full * FANOUT].reshape(full, FANOUT * HEX)]
        if len(nodes) % FANOUT:
            hashed.append(sha256(nodes[full * FANOUT :].tobytes()).hexdigest())
        levels.append(np.frombuffer("".join(hashed).encode(), np.uint8).reshape(-1, HEX))
    return levels


def _siblings(levels: list[np.ndarray], i: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after leaf i's ancestor in its run, level by level below the block's root."""
    out = []
    for nodes in levels[:-1]:
        start = i - i % FANOUT
        out.append((nodes[start:i].tobytes(), nodes[i + 1 : start + FANOUT].tobytes()))
        i //= FANOUT
    return out


def _in_order(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("idx")


def _root(key: tuple, nodes: pa.Table) -> pa.Table:
    """A block's nodes -> its root as a node of the next table."""
    n = nodes["n"][0].as_py()
    top = _levels(_matrix(_in_order(nodes)["digest"]), n)[-1]
    return pa.table({"tree": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-n // BLOCK)], "digest": [top.tobytes().decode()]})


def _paths(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """A block's nodes and its root's path -> each node's path."""
    nodes = _in_order(nodes)
    levels = _levels(_matrix(nodes["digest"]), nodes["n"][0].as_py())
    lefts, rights = above["lefts"][0].as_py(), above["rights"][0].as_py()
    paths = [_siblings(levels, i) for i in range(len(nodes))]
    return pa.table(
        {
            "tree": nodes["tree"],
            "idx": nodes["idx"],
            "lefts": pa.array([[a.decode() for a, _ in p] + lefts for p in paths], pa.list_(pa.string())),
            "rights": pa.array([[b.decode() for _, b in p] + rights for p in paths], pa.list_(pa.string())),
            "subroot": pa.array(above["subroot"].to_pylist() * len(nodes), pa.string()),
            "root": pa.array(above["root"].to_pylist() * len(nodes), pa.string()),
        }
    )


def _proofs(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
    """A block's leaves and its root's path -> each leaf's proof, and the root that its present digest folds to."""
    leaves = _in_order(leaves)
    levels = _levels(_matrix(leaves["digest"]), leaves["n"][0].as_py())
    upper = [(a.encode(), b.encode()) for a, b in zip(above["lefts"][0].as_py(), above["rights"][0].as_py())]
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    proofs, folded = [], []
    for i, present in enumerate(leaves["present"].to_pylist()):
        path, proof, digest = _siblings(levels, i) + upper, sha256(), present.encode()
        for left, right in path:
            proof.update(left)
            proof.update(right)
            digest = sha256(left + digest + right).hexdigest().encode()
        proofs.append(proof.hexdigest())
        folded.append(digest.decode())
    n = len(leaves)
    return pa.table({"doc_id": leaves["doc_id"], "leaf": leaves["digest"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def _block() -> Column:
    return F.floor(F.col("idx") / BLOCK).cast("long").alias("block")


def _raised(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, idx, n, digest), each with the roots of the one before's blocks, until all trees have one node."""
    tables = [nodes]
    while tables[-1].where("n > 1").limit(1).count():
        blocks = tables[-1].select("tree", "idx", "n", "digest").groupBy("tree", _block())
        tables.append(stage(blocks.applyInArrow(_root, NODE), "merkle-roots"))
    return tables


def _below(nodes: DataFrame, above: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Each block of nodes with its root's path, through make."""
    return nodes.groupBy("tree", _block()).cogroup(above.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(make, schema)


def _descended(tables: list[DataFrame], above: DataFrame, last: Callable, schema: str) -> DataFrame:
    """From the paths of the last table's nodes, one for each tree, down to what last makes of the first table's."""
    for nodes in reversed(tables[1:-1]):
        above = stage(_below(nodes, above, _paths, PATH), "merkle-paths")
    return _below(tables[0], above, last, schema)


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their place in the order of keys, from 0."""
    placed, _ = with_bases(ordered(rows, keys, name), F.lit(1), "_base")
    return placed.withColumn("_row", F.col("_base") + F.col("_pos")).drop("_base", "_pos", "_part")


def merkle_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Digests of all rows of docs (doc_id, source, lang, n_chars, text), hashed to a root for each lang and one over all, with proofs.

    Returns a row for each row: doc_id, leaf, subroot, root, proof_sha256 (over the siblings on the way up), folded_root (from the present leaf and the original
    siblings) and verified. Rows where changed holds are folded from their text with A-Z in lower case; without it every row is folded as it is. Nulls
    are `-` in a leaf; a null lang has a tree of its own, ordered first; rows with a null doc_id come first in their tree. Rows of one
    id are ordered by leaf, so repeated rows are leaves with equal digests and differ in their proofs. Empty texts are empty values; texts of any length are hashed whole. A single row is its own root,
    with the proof of nothing. Other columns are not looked at; an empty table gives an empty result.

    Only digests are shuffled. A task holds one block of 4096 nodes, whatever the size of a tree; the driver gets one count for each part of the order.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree")
    leaf = leaf_digest()
    present = leaf if changed is None else F.when(changed, leaf_digest(folded_case(F.col("text")))).otherwise(leaf)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree, leaf.alias("digest"), F.nullif(present, leaf).alias("other"), F.monotonically_increasing_id().alias("salt"))
    placed = _numbered(stage(leaves, "merkle-leaves"), ["tree", "doc_id", "digest", "salt"], "merkle-order")
    trees = _numbered(placed.groupBy("tree").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")), ["tree"], "merkle-trees").withColumnRenamed("_row", "at")
    trees = stage(trees, "merkle-trees")
    nodes = placed.join(trees, "tree").select("tree", (F.col("_row") - F.col("first")).alias("idx"), "n", "digest", "doc_id", F.coalesce("other", "digest").alias("present"))
    nodes = stage(nodes, "merkle-nodes")

    lower = _raised(nodes)
    n_trees = trees.count()
    roots = lower[-1].select("tree", "digest").join(trees.select("tree", "at"), "tree")
    top = stage(roots.select(F.lit("").alias("tree"), F.col("at").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "digest", F.col("tree").alias("of")), "merkle-subroots")
    upper = _raised(top)
    none = F.array().cast("array<string>")
    summit = upper[-1].select("tree", "idx", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ways = stage(_descended(upper, summit, _paths, PATH), "merkle-paths")
    own = ways.select("idx", "lefts", "rights", "root").join(top.select("idx", F.col("digest").alias("subroot"), F.col("of").alias("tree")), "idx")
    above = stage(own.select("tree", F.lit(0).cast("long").alias("idx"), "lefts", "rights", "subroot", "root"), "merkle-paths")
    return _descended(lower, above, _proofs, PROOF)
