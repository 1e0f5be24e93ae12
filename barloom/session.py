"""Session settings shared by the driver contract, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # tables dealt by symbol stay there in joins on (symbol, day) and the like
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the JVM never compiles a method of more bytes; such stages run operator by operator, in small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on (UTC days above all)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "barloom", cpus: int | None = None, shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    return apply_settings(builder.getOrCreate())
