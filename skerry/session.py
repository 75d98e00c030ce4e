"""Session defaults shared by tests, bench and command-line use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "skerry", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
