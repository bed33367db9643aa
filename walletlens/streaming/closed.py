"""Detectors on streams that give what they give on the whole table, row for row.

A row is closed when the watermark has passed its second: no earlier row can come any more. Closed
rows leave the stream in batches that follow each other in time, each row once, whatever the order
in which they came. Rows that come behind the watermark are dropped by Spark, which counts them; they
are in no result, as if they had never been sent.

What a detector says of a row depends on rows at most ``behind`` seconds before it and ``ahead``
seconds after it. Closed rows are written by batch, and each batch runs the detector of tables over
its own span: the rows that became final with it, what lies ``behind`` them, and what lies ``ahead``.
A row is then in its own batch and, for its neighbours, in the next ones that still see it; the
detectors cut time into blocks, so a busy account is no single task. Folders that no batch can see
any more are deleted, so what is kept is bounded by the frames, not by the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from walletlens import contract
from walletlens.operators import detectors as d
from walletlens.operators.rolling import with_second
from walletlens.sources.work import new_folder, settle
from walletlens.streaming.operators import LATENESS
from walletlens.streaming.sinks import END_OF_STREAM

Detector = Callable[[DataFrame], DataFrame]


class Watch(NamedTuple):
    """A detector, the rows that it can use, and how many seconds it looks back and ahead."""

    detect: Detector
    rows: Callable[[], Column]
    behind: int
    ahead: int = 0
    # Cells of a row that ``rows`` keeps, for the row that closes a finished stream.
    like: dict[str, str] = {}


_TRANSFER = {"transaction_type": "TRANSFER", "status": "SUCCESS", "amount": "100"}


def bursts(limits: d.HighFrequency = d.HighFrequency()) -> Watch:
    """As ``detectors.high_frequency``."""
    like = {"transaction_type": limits.types[0], "status": "SUCCESS", "amount": limits.least_amount}
    return Watch(lambda tx: d.high_frequency(tx, limits), lambda: d.high_frequency_rows(limits), limits.seconds, 0, like)


def split_payments(limits: d.Structuring = d.Structuring()) -> Watch:
    """As ``detectors.structuring``."""
    return Watch(lambda tx: d.structuring(tx, limits), d.successful_transfers, limits.seconds, 0, _TRANSFER)


def circles(limits: d.Tontine = d.Tontine()) -> Watch:
    """As ``detectors.tontine``."""
    return Watch(lambda tx: d.tontine(tx, limits), d.transfers, limits.seconds, 0, _TRANSFER)


def unexplained_bursts(burst: d.HighFrequency, circle: d.Tontine = d.Tontine()) -> Watch:
    """Bursts that no savings circle explains, as ``detectors.without_tontines``.

    A circle may be complete only after a payment of it, so an alert waits for the span of a circle.
    """
    return Watch(
        lambda tx: d.without_tontines(d.high_frequency(tx, burst), tx, circle),
        lambda: d.high_frequency_rows(burst) | d.transfers(),
        max(burst.seconds, circle.seconds),
        circle.seconds,
        _TRANSFER,
    )


def closed_rows(tx: DataFrame, watch: Watch, lateness: str = LATENESS) -> DataFrame:
    """Each distinct row with the number of its copies, once its second is closed. Append mode.

    Rows are grouped by all their cells, so no account is a hot group.
    """
    kept = tx.filter(watch.rows() & F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness)
    # The window is the event time; the time of the row goes along as a number.
    cells = [F.unix_micros("timestamp").alias("timestamp") if name == "timestamp" else F.col(name) for name in tx.columns]
    counted = kept.groupBy(F.window("timestamp", "1 second").alias("second"), *cells).agg(F.count(F.lit(1)).alias("copies"))
    return counted.drop("second").withColumn("timestamp", F.timestamp_micros("timestamp"))


class Follower:
    """Writes closed rows and alerts by batch; a batch that is run again writes the same."""

    def __init__(self, spark: SparkSession, watch: Watch, schema, path: str) -> None:
        self.watch, self.schema, self.path = watch, schema, path
        self.files = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = self.files.Path(path)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, before: int) -> list[tuple[int, int, str]]:
        """Batch, last closed second and folder of the batches before one, by batch."""
        found = []
        folder = self.files.Path(f"{self.path}/closed")
        if self.system.exists(folder):
            for status in self.system.listStatus(folder):
                name = status.getPath().getName()
                batch, until = (int(part) for part in name.removeprefix("batch=").split("-until="))
                if batch < before and self.system.exists(self.files.Path(f"{self.path}/closed/{name}/_SUCCESS")):
                    found.append((batch, until, f"{self.path}/closed/{name}"))
        return sorted(found)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = settle(with_second(batch), "closed-batch")
        until = fresh.agg(F.max("sec")).first()[0]
        earlier = self._batches(number)
        closed = earlier[-1][1] if earlier else None
        if until is None:
            return
        fresh.write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}-until={until}")
        # Alerts of the seconds behind ``ready`` are out; those to ``until - ahead`` become final now.
        final = until - self.watch.ahead
        ready = None if closed is None else closed - self.watch.ahead
        parts = [fresh] + [
            spark.read.schema(fresh.schema).parquet(folder)
            for _, last, folder in earlier
            if last >= ready - self.watch.behind
        ]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if ready is not None:
            rows = rows.filter(F.col("sec") >= ready - self.watch.behind)
        copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
        rows = settle(rows.select(*self.schema.fieldNames(), copies.alias("copy")).drop("copy"), "closed-span")
        alerts = with_second(self.watch.detect(rows)).filter(F.col("sec") <= final)
        if ready is not None:
            alerts = alerts.filter(F.col("sec") > ready)
        alerts.drop("sec").write.mode("overwrite").parquet(f"{self.path}/alerts/batch_id={number}")
        # The batch before may be asked for again by no one; what it alone could see may go.
        if len(earlier) > 1:
            bound = earlier[-2][1] - self.watch.ahead - self.watch.behind
            for _, last, folder in earlier[:-1]:
                if last < bound:
                    self.system.delete(self.files.Path(folder), True)


def run_closed(watch: Watch, tx: DataFrame, label: str, lateness: str = LATENESS, finish: bool = True) -> DataFrame:
    """Process all present data and read the alerts of all batches.

    With ``finish`` one row behind all data closes the last rows; it is itself never closed. Without,
    rows within the lateness stay open for a later run.
    """
    spark = tx.sparkSession
    path = new_folder(spark, label)
    marks = f"{path}/marks"
    spark.createDataFrame([], tx.schema).write.parquet(marks)
    both = tx.unionByName(spark.readStream.schema(tx.schema).parquet(marks))
    stream = closed_rows(both, watch, lateness)
    follower = Follower(spark, watch, tx.schema, path)
    empty = watch.detect(spark.createDataFrame([], tx.schema))

    def run() -> None:
        query = (
            stream.writeStream.outputMode("append")
            .foreachBatch(follower)
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if finish:
        for moment in _marks(watch):
            cells = {"timestamp": moment, **watch.like}
            mark = spark.range(1).select(
                *[F.lit(cells.get(field.name)).cast(field.dataType).alias(field.name) for field in tx.schema.fields]
            )
            mark.write.mode("append").parquet(marks)
            run()
    if not follower.system.exists(follower.files.Path(f"{path}/alerts")):
        return empty
    written = spark.read.schema(empty.schema).option("basePath", f"{path}/alerts").parquet(f"{path}/alerts")
    return written.select(*empty.columns)


def _marks(watch: Watch) -> list[str]:
    """Times of the rows that finish a stream. A detector that looks ahead needs a closed second behind
    all data, so the first of two such rows is closed by the second."""
    return [END_OF_STREAM] if not watch.ahead else [END_OF_STREAM, "2500-01-01 00:00:00"]


def account_columns(tx: DataFrame) -> DataFrame:
    """The columns that detectors of sequences use."""
    names = ("transaction_id", "timestamp", "sender_id", "receiver_id", "amount", "transaction_type", "status")
    return tx.select(*[name for name in contract.COLUMNS if name in names])
