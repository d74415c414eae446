"""Sessions for tests, the bench and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "quern") -> SparkSession:
    """A local session with AQE on, in UTC, with as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(8 if cores == "*" else cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
