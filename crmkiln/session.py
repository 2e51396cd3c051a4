"""Spark settings the jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # Entity times carry no zone; a UTC session keeps casts to and from TIMESTAMP neutral.
    "spark.sql.session.timeZone": "UTC",
    # Files written with nanosecond times are read as long and converted on ingest.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An overflowing sum must stop the job, never wrap around.
    "spark.sql.ansi.enabled": "true",
}


_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built.

    Shuffles start with a few partitions per core, so that those of large joins fit in memory; AQE
    merges the partitions of small ones. A number the cluster sets itself is left alone.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(_INITIAL_PARTITIONS, None) is None:
        few_per_core = 3 * spark.sparkContext.defaultParallelism
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(_INITIAL_PARTITIONS, str(max(few_per_core, configured)))
    return spark


@contextmanager
def configured(spark: SparkSession) -> Iterator[None]:
    """The runtime settings for the length of a block; afterwards the session is as it was found."""
    names = [*RUNTIME_SETTINGS, _INITIAL_PARTITIONS]
    before = {name: spark.conf.get(name, None) for name in names}
    configure(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def local_session(cores: int | str = 8, app: str = "crmkiln", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
