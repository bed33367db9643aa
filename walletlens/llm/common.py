"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

import walletlens
from walletlens.sources.work import settle

# Identity of a stored row: the hash of its file's path and its place in the file. It does
# not depend on how a scan is split, so two scans of one table agree on it.
ROW_KEY = ["_file", "_index"]

# Rows of one file and one block are numbered by one task.
BLOCK_BITS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once for an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(walletlens.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="walletlens-code-")) / "walletlens.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def take(df: DataFrame, *names: str, key: bool = False) -> DataFrame:
    """The named columns, and the row key if asked for.

    Columns are found by exact name and place. Further columns do no harm, whatever their
    names; of two columns with one name the first counts. A missing column is null text.
    """
    ship(df.sparkSession)
    places = {}
    for place, name in enumerate(df.columns):
        places.setdefault(name, place)
    plain = df.toDF(*[f"c{place}" for place in range(len(df.columns))])
    chosen = [
        F.col(f"c{places[name]}").alias(name) if name in places else F.lit(None).cast("string").alias(name)
        for name in names
    ]
    if key:
        path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        chosen += [F.xxhash64(path).alias("_file"), index.alias("_index")]
    return plain.select(*chosen)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` if it is a file table whose rows have a place, else ``df`` written as one."""
    try:
        df.toDF(*[f"c{place}" for place in range(len(df.columns))]).select("_metadata.row_index")
    except AnalysisException:
        width = len(df.columns)
        plain = settle(df.toDF(*[f"c{place}" for place in range(width)]), label)
        return plain.toDF(*df.columns)
    return df


def block_of(file: str = "_file", index: str = "_index") -> Column:
    return F.xxhash64(F.col(file), F.shiftright(F.col(index), BLOCK_BITS))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps; no key is one task.

    ``df`` has the row key and must be a stored table, so that its two uses agree. Each key is
    cut into blocks of a file; blocks are counted, counts are summed, and rows are ranked
    inside their block only.
    """
    blocks = df.withColumn("_block", block_of())
    counts = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_index")) - 1
    ranked = blocks.withColumn("_inside", inside)
    return (
        ranked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_before", "_inside")
    )


def settled_with_key(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once, read with the row key of the written table."""
    return take(settle(df, label), *df.columns, key=True)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled at every size, never broadcast."""
    return df.hint("merge")


def words(column: str | Column) -> Column:
    """Words of a text: stretches of bytes other than blank and tab to carriage return."""
    text = F.col(column) if isinstance(column, str) else column
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda word: word != "")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    result = None
    for frame in frames:
        result = frame if result is None else result.unionByName(frame)
    return result
