"""Session defaults shared by tests, bench and scripts.

A cluster brings its own session; nothing in the library builds one.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with the settings the operators assume: UTC, AQE, Arrow."""
    n = shuffle_partitions or (cores if isinstance(cores, int) else os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
