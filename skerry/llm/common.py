"""Shared pieces: the shared folder, staged tables and a global order."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where it is unset, the warehouse, or an own folder if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        alone = spark.sparkContext.master.startswith("local") and "local-cluster" not in spark.sparkContext.master
        base = "file://" + tempfile.mkdtemp(prefix="skerry-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skerry-staged"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for operators with Python functions."""
    context = spark.sparkContext
    if getattr(context, "_skerry_shipped", None):
        return
    target = f"{tempfile.mkdtemp(prefix='skerry-')}/skerry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._skerry_shipped = True


_caches: dict[str, dict] = {}


def process_cache(owner: str) -> dict:
    """What a worker process remembers for one operator; another operator's task drops it, so that caches don't add up."""
    if owner not in _caches:
        _caches.clear()
        give_back()
        _caches[owner] = {}
    return _caches[owner]


def give_back() -> None:
    """Return the memory that a worker process holds without using it; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(owner: str, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that drops other operators' caches first and gives its memory back at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache(owner)
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage and makes what follows independent of executors that get lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ordered(df: DataFrame, keys: list[str], name: str, partitions: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Range-partition and sort df by keys, as a staged table with the position of each row.

    The table gets the columns _part and _pos (the row's place in its part). keys should end in
    columns that tell rows apart, so that no key is too heavy for a part. then may add columns that depend
    on the order of rows in a part.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = placed.withColumn("_at", at)
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    placed = placed.withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    return stage(then(placed) if then else placed, name)


def with_bases(placed: DataFrame, amount: Column, to: str) -> tuple[DataFrame, int]:
    """Add the total of amount over all earlier parts of an ordered() table; also give the grand total.

    The driver gets one row for each part, so the broadcast is bounded by the number of parts.
    """
    spark = placed.sparkSession
    sums = sorted((r[0], int(r[1])) for r in placed.groupBy("_part").agg(F.sum(amount)).collect())
    rows, total = [], 0
    for part, amount_in_part in sums:
        rows.append((part, total))
        total += amount_in_part
    bases = spark.createDataFrame(rows, f"_part int, {to} long")
    return placed.join(F.broadcast(bases), "_part"), total


def unstage(*staged: DataFrame) -> None:
    """Delete tables of stage() that nothing will read any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
