"""Intermediate tables in the shared folder that the cluster names.

A table written here cuts lineage, survives the loss of executors, and has a size on disk
that Spark knows. A later join therefore broadcasts it only when it is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise; no operator needs a
broadcast hint on data that grows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_folder(spark: SparkSession) -> str:
    """Shared folder of the session. Only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = _own_folder()
    return folder


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="walletlens-")


_scopes: list[list[str]] = []


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders that were made in it.

    Results that read them must have been used or written elsewhere before. Without a scope
    intermediate tables stay until the shared folder is emptied.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in made:
            path = files.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder that no other run uses."""
    path = f"{work_folder(spark).rstrip('/')}/walletlens/{label}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on with the written table."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
