"""A table kept by key: upserts rewrite only the buckets that a batch touches, and every commit is a version of its own (SNK-02, SNK-04, SNK-08, INC-06, INC-09, SET-02).

    <path>/data/v<version>-<unique>/kb=<bucket>/*.parquet    rows, by the hash of their key
    <path>/manifest/<version>.json                          which folder holds each bucket, with its rows and range of dates

A manifest is created once and never changed, so a reader keeps the version that it opened, and a job that dies leaves files that no manifest names. Two writers
of one version: the second can't create the manifest and fails. The manifest is as long as there are buckets.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staged import staged

SPREAD = 8  # files of a large bucket


class StaleTable(Exception):
    """The table is older than asked, or isn't there."""


class KeyedTable:
    """A table at path with one row for each key.

    order names columns that tell which of two rows of a key is the later one: an incoming row with a lower order than the kept one is late and changes nothing. Without order, or where it is
    equal, the incoming row replaces the kept one. Within a batch the greatest order counts, then the greatest of the other columns, so that ties don't depend on the order of rows.
    dated is a column whose range is told for each bucket. buckets is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), order: Sequence[str] = (), dated: str | None = None, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        head = self.head()
        self.keys, self.order, self.dated, self.buckets = (head["keys"], head["order"], head["dated"], head["buckets"]) if head else (list(keys), list(order), dated, buckets)
        if not self.keys:
            raise ValueError(f"{path} is no table yet: name its keys")

    # manifests

    def _hadoop(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, version: int) -> dict | None:
        """The manifest of a version, or None if there is none or it was never finished."""
        lines = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        fs, at = self._hadoop(f"{self.path}/manifest/{version:012d}.json")
        if not fs.exists(at):
            return None
        size = fs.getFileStatus(at).getLen()
        stream, held = fs.open(at), self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
        lines.copyBytes(stream, held, int(min(max(size, 1), 1 << 16)), True)
        try:
            return json.loads(bytes(held.toByteArray()).decode())
        except ValueError:
            return None

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def head(self) -> dict | None:
        """The newest finished manifest."""
        return next((m for v in reversed(self.versions()) if (m := self.manifest(v))), None)

    def _create(self, manifest: dict) -> None:
        fs, at = self._hadoop(f"{self.path}/manifest/{manifest['version']:012d}.json")
        if fs.exists(at) and self.manifest(manifest["version"]) is None:
            fs.delete(at, False)  # the remains of a writer that died
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # reading

    def read(self, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """The rows of a version (the newest, if none is named). Buckets without a date in the range aren't opened."""
        found = self.head() if version is None else self.manifest(version)
        if not found:
            raise StaleTable(f"{self.path} has no version {'' if version is None else version}")
        df = self._rows(found, [b for b, s in found["parts"].items() if (since is None or s["most"] is None or s["most"] >= since) and (until is None or s["least"] is None or s["least"] <= until)])
        if found["dated"]:
            day = F.col(found["dated"]).cast("string")
            df = df.where(F.lit(True) if since is None else day >= since).where(F.lit(True) if until is None else day <= until)
        return df

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{manifest['parts'][b]['folder']}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names]) if paths else self.spark.createDataFrame([], schema)

    def stats(self, version: int | None = None) -> DataFrame:
        """(bucket, folder, rows, least, most, written) of a version."""
        found = (self.head() if version is None else self.manifest(version)) or {"parts": {}, "written": 0.0}
        rows = [(int(b), s["folder"], s["rows"], s["least"], s["most"], found["written"]) for b, s in sorted(found["parts"].items(), key=lambda x: int(x[0]))]
        return self.spark.createDataFrame(rows, "bucket int, folder string, rows long, least string, most string, written double")

    def age(self) -> float:
        """Seconds since the newest version."""
        head = self.head()
        return time.time() - head["written"] if head else float("inf")

    def fresh(self, most: float, required: Sequence[str] = ()) -> DataFrame:
        """The rows, if the newest version isn't older than so many seconds and has the required columns (SRC-07); StaleTable otherwise."""
        if self.age() > most:
            raise StaleTable(f"{self.path} is {self.age():.0f} s old, more than {most:.0f}")
        df = self.read()
        lacks = [c for c in required if c not in df.columns]
        if lacks:
            raise StaleTable(f"{self.path} lacks {', '.join(lacks)}")
        return df

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, source: str | None = None, number: int | None = None, notes: dict | None = None) -> int:
        """Commit a batch and return the version that holds it.

        source and number name the batch: one that was committed before isn't committed again, so a batch that is run anew after a failure changes nothing. notes are kept in the manifest,
        committed with the rows. Buckets without a key of the batch keep their files.
        """
        head = self.head() or {"version": 0, "parts": {}, "applied": {}, "notes": {}, "schema": None}
        if source is not None and number is not None and number <= head["applied"].get(source, -1):
            return head["version"]
        schema = StructType.fromJson(head["schema"]) if head["schema"] else batch.schema
        rows = staged(batch.select(*[F.col(f"`{c}`") for c in schema.names]).withColumn("kb", self._bucket()), "batch")
        touched = sorted(str(r[0]) for r in rows.select("kb").distinct().collect())
        version = head["version"] + 1
        parts = dict(head["parts"])
        if touched:
            merged = self._newest(rows.withColumn("_new", F.lit(1)).unionByName(self._rows(head, [b for b in touched if b in parts]).withColumn("kb", self._bucket()).withColumn("_new", F.lit(0))) if parts else rows.withColumn("_new", F.lit(1)))
            folder = f"data/v{version}-{uuid.uuid4().hex}"
            spread = F.pmod(F.xxhash64(F.lit("file"), *[F.col(f"`{k}`") for k in self.keys]), F.lit(SPREAD))
            merged.repartition("kb", spread).write.partitionBy("kb").parquet(f"{self.path}/{folder}")
            dated = F.col(f"`{self.dated}`").cast("string") if self.dated else F.lit(None).cast("string")
            written = self.spark.read.schema(StructType(merged.schema.fields)).parquet(f"{self.path}/{folder}")
            for r in written.groupBy("kb").agg(F.count(F.lit(1)).alias("n"), F.min(dated).alias("least"), F.max(dated).alias("most")).collect():
                parts[str(r.kb)] = {"folder": f"{folder}/kb={r.kb}", "rows": r.n, "least": r.least, "most": r.most}
        applied = head["applied"] | ({source: number} if source is not None and number is not None else {})
        self._create(
            {"version": version, "written": time.time(), "keys": self.keys, "order": self.order, "dated": self.dated, "buckets": self.buckets, "schema": json.loads(schema.json()), "parts": parts, "applied": applied, "notes": head["notes"] | (notes or {})}
        )
        return version

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_rows(rows, self.keys, [*self.order, "_new"]).drop("_new")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but for the newest keep, and the folders that these don't name; returns the folders' names. Readers of older versions must be done."""
        versions = self.versions()
        kept = [m for v in versions[-keep:] if (m := self.manifest(v))]
        named = {s["folder"] for m in kept for s in m["parts"].values()}
        gone = []
        for version in versions[:-keep]:
            fs, at = self._hadoop(f"{self.path}/manifest/{version:012d}.json")
            fs.delete(at, False)
        for folder in self._names("data"):
            for bucket in self._names(f"data/{folder}"):
                if bucket.startswith("kb=") and f"data/{folder}/{bucket}" not in named:
                    fs, at = self._hadoop(f"{self.path}/data/{folder}/{bucket}")
                    fs.delete(at, True)
                    gone.append(f"data/{folder}/{bucket}")
        return gone


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the greatest by order, nulls least; then by all other columns that can be ordered, so that ties are told apart."""
    plain = [f.name for f in rows.schema.fields if f.name not in order and f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    place = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in (*order, *plain)]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
