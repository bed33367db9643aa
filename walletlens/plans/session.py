"""Session settings that the library needs or recommends."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Dates are UTC dates, so this one is a matter of correctness.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# Sessions of one account are merged before the shuffle, so a busy account is not one task.
STREAMING = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}

# For a cluster. Partitions start small and many; adaptive execution joins small ones
# and splits skewed ones. Stream state is kept outside the heap.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what correctness needs on an existing session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def prepare_stream(spark: SparkSession) -> SparkSession:
    """As ``prepare``, with the settings for streams."""
    for key, value in STREAMING.items():
        spark.conf.set(key, value)
    return prepare(spark)


def local_session(cpus: int = 8, name: str = "walletlens") -> SparkSession:
    """Session on one machine for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
