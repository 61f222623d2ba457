"""The session that tests and the bench use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def new_session(cores: int | None = None) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", 8))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
