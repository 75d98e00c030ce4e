"""A store of daily bars as a Spark data source: files are planned by buckets of symbols, and those outside a code or date filter aren't opened (SRC-10, SRC-14, SRC-25).

    <path>/<code>/<year>.parquet    columns date, open, high, low, close, volume, amount

A file that can't be read is tried again, and then looked for under the option stale, a store of the same layout; rows from there are marked. A file that is in neither fails its task, and with it
the query, unless missing is allowed.
"""

from __future__ import annotations

import datetime as dt
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "code string, date date, open double, high double, low double, close double, volume double, amount double, is_stale boolean"
PRICES = ("open", "high", "low", "close", "volume", "amount")


class BarFiles(InputPartition):
    """The files of some symbols."""

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(len(files))
        self.files = files


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _as_date(value) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


class BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stale = options["path"], options.get("stale")
        self.buckets, self.retries, self.pause = int(options.get("buckets", 64)), int(options.get("retries", 3)), float(options.get("pause", 0.5))
        self.missing = options.get("missing", "fail")
        self.codes: set[str] | None = None
        self.since: dt.date | None = None
        self.until: dt.date | None = None

    def pushFilters(self, filters: list[Filter]):
        """Codes and dates decide which files are planned; Spark still filters the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("code",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = asked if self.codes is None else self.codes & asked
            if f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual) and f.attribute == ("date",):
                self.since = max(self.since or dt.date.min, _as_date(f.value))
            if f.__class__ in (EqualTo, LessThan, LessThanOrEqual) and f.attribute == ("date",):
                self.until = min(self.until or dt.date.max, _as_date(f.value))
            yield f

    def partitions(self) -> list[BarFiles]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        folders = system.get_file_info(fs.FileSelector(root))
        found: dict[int, list[tuple[str, str]]] = {}
        for folder in folders:
            code = folder.base_name
            if folder.type != fs.FileType.Directory or self.codes is not None and code not in self.codes:
                continue
            for f in system.get_file_info(fs.FileSelector(folder.path)):
                year = f.base_name.removesuffix(".parquet")
                if year.isdigit() and (self.since is None or int(year) >= self.since.year) and (self.until is None or int(year) <= self.until.year):
                    found.setdefault(zlib.crc32(code.encode()) % self.buckets, []).append((code, year))
        return [BarFiles(sorted(files)) for _, files in sorted(found.items())] or [BarFiles([])]

    def read(self, partition: BarFiles) -> Iterator:
        import pyarrow as pa

        for code, year in partition.files:
            table, stale = self._bars(code, year)
            if table is None:
                continue
            n = table.num_rows
            columns = [pa.array([code] * n, pa.string()), table["date"].cast(pa.date32()).combine_chunks()]
            columns += [table[c].cast(pa.float64()).combine_chunks() if c in table.column_names else pa.nulls(n, pa.float64()) for c in PRICES]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([stale] * n)], names=["code", "date", *PRICES, "is_stale"])

    def _bars(self, code: str, year: str):
        import pyarrow.parquet as pq

        failed: Exception | None = None
        for store, stale in ((self.path, False), (self.stale, True)):
            if not store:
                continue
            system, root = _filesystem(store)
            for attempt in range(self.retries):
                try:
                    with system.open_input_file(f"{root}/{code}/{year}.parquet") as f:
                        return pq.read_table(f), stale
                except FileNotFoundError as e:
                    failed = e
                    break
                except Exception as e:  # noqa: BLE001  any fault of a store is worth another try
                    failed = e
                    time.sleep(self.pause * (attempt + 1))
        if self.missing == "skip":
            return None, False
        raise RuntimeError(f"no bars of {code} in {year}: {failed}") from failed


class BarHistory(DataSource):
    """Options: path, stale, buckets (64), retries (3), pause in seconds (0.5), missing (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "bar_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options)


def read_history(spark: SparkSession, path: str, **options) -> DataFrame:
    """The bars of a store; filters on code and date decide which files are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarHistory)
    return spark.read.format("bar_history").options(path=path, **options).load()


def store_codes(spark: SparkSession, path: str) -> DataFrame:
    """The codes of a store, from its folders alone."""
    from pyarrow import fs

    system, root = _filesystem(path)
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)
    return spark.createDataFrame([(c,) for c in found], "code string")
