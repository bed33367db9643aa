"""Sinks that a repeated micro-batch does not change, and a run over all present data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from walletlens.sources.work import new_folder

# A time behind all data. A row with it closes every window and session before it.
END_OF_STREAM = "2400-01-01 00:00:00"


def run_append(stream: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all present data into Parquet; the file sink commits each batch once."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_complete(
    operator: Callable[[DataFrame], DataFrame], tx: DataFrame, label: str, like: dict[str, str] | None = None
) -> DataFrame:
    """Process all present data of a windowed operator in append mode, last windows included.

    Append mode keeps a window until the watermark has passed it. A second source, empty at first,
    is read beside ``tx``. When all data are processed, one row with a time behind all of them
    goes into it and the run goes on from its progress. ``like`` gives that row the cells that
    the operator filters by; its own window stays open, so it is in no result.
    """
    spark = tx.sparkSession
    path = new_folder(spark, label)
    marks = f"{path}/marks"
    empty = spark.createDataFrame([], tx.schema)
    empty.write.parquet(marks)
    result = operator(tx.unionByName(spark.readStream.schema(tx.schema).parquet(marks)))

    def run() -> None:
        query = (
            result.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/table")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    cells = {"timestamp": END_OF_STREAM, **(like or {})}
    mark = spark.range(1).select(
        *[F.lit(cells.get(field.name)).cast(field.dataType).alias(field.name) for field in tx.schema.fields]
    )
    mark.write.mode("append").parquet(marks)
    run()
    return spark.read.schema(result.schema).parquet(f"{path}/table")


def run_update(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Process all present data in update mode and read the last state of each key.

    A batch overwrites its own folder, so a batch that is run again writes the same rows. A stream
    without data gives an empty table. ``compact`` joins the folders of many batches.
    """
    spark = stream.sparkSession
    path = new_folder(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest(spark, f"{path}/table", stream, keys)


def compact(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str], label: str) -> str:
    """A new table of batches with the last row of each key only, as one batch numbered 0.

    Batches of the old folder may go once readers use the new one.
    """
    new = f"{new_folder(spark, label)}/table"
    latest(spark, path, like, keys).write.parquet(f"{new}/batch_id=0")
    return new


def latest(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last written row of each key."""
    schema = T.StructType(like.schema.fields + [T.StructField("batch_id", T.LongType())])
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here):
        return spark.createDataFrame([], like.schema)
    written = spark.read.schema(schema).option("basePath", path).parquet(path)
    values = [name for name in like.columns if name not in keys]
    newest = F.max_by(F.struct(*values), F.col("batch_id")).alias("last")
    return written.groupBy(*keys).agg(newest).select(
        *[F.col(name) if name in keys else F.col(f"last.{name}") for name in like.columns]
    )
