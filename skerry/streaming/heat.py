"""Board heat as a stream: histories arrive as files, windows close by watermark, tables are upserted batch by batch (INC-02, INC-06, INC-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable, StaleTable
from ..sources.readers import HEAT


def heat_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Heat records of JSON-lines files as they come into a folder."""
    raw = spark.readStream.schema(HEAT).option("columnNameOfCorruptRecord", "broken").option("maxFilesPerTrigger", files_per_batch).json(folder)
    good = raw.where("broken is null and board is not null and max_board_heat_score between 0 and 100")
    return good.select("board", F.col("generated_at").alias("at"), F.col("max_board_heat_score").alias("heat"))


def daily_heat(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each board's heat by day: count, mean and most; days close once the watermark has passed them."""
    days = stream.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "board")
    return days.agg(F.count(F.lit(1)).alias("n"), F.avg("heat").alias("mean"), F.max("heat").alias("most")).select(F.to_date("w.start").alias("day"), "board", "n", "mean", "most")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, drain: bool = True, order: list[str] | None = None) -> StreamingQuery:
    """Keep a table at path up to date: of a key's rows the one with the greatest order counts, else that of the latest batch.

    A batch rewrites the buckets it touches and commits them as a version, so a batch that is run again after a failure changes nothing. Versions before the last two are removed as the stream goes on.
    """
    table = KeyedTable(stream.sparkSession, path, keys, order or [])

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, "stream", number)
        table.vacuum(keep=2)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's newest version, or None."""
    try:
        return KeyedTable(spark, path).read()
    except (ValueError, StaleTable):
        return None
