"""The profile of a table that grows, without reading its history again.

The table is Parquet in one folder per day. For each day the counts of every reported distribution
are kept, as ``profile_sets`` gives them for that day alone; counts of days add up, so the profile
of the whole table is the sum of small rows. A refresh compares the files of each day, by name, size and
time, with those that its counts were taken from, and counts only days whose files changed: new days,
days that got late rows or a repeated load, and days that were written anew. Counts of days that are
gone go too.

The state is a folder of versions. A version is a table of days, each with the state of its files and the
version that holds its counts, and is written after them; readers take the newest whole version. A
refresh that breaks off leaves the last version as it was, and two readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from walletlens.functions import DEFAULT_SEASONS, Season, truthy
from walletlens.operators.profile import distributions
from walletlens.plans.report import report_from_sets
from walletlens.sources.work import new_folder

_DAYS = "tx_date date, files long, bytes long, state long, version int"
_COUNTS = "tx_date date, metric string, value string, n long"
# The columns that are counted; files without one have nulls there. No footer is opened for a schema.
_SCHEMA = (
    "channel string, sender_wilaya string, transaction_type string, anomaly_type string, is_anomaly boolean, tx_date date"
)
_METRICS = ("channel", "sender_wilaya", "transaction_type", "anomaly_type")


def file_states(spark: SparkSession, source: str) -> DataFrame:
    """Number, size and a hash of names, sizes and times of the files of each day; no file is opened."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source)
    day = F.regexp_extract("path", r"/tx_date=([^/]*)/[^/]*$", 1).try_cast("date")
    return names.groupBy(day.alias("tx_date")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))).alias("state"),
    )


def day_counts(tx: DataFrame) -> DataFrame:
    """Rows per day, metric and value: the counts of ``profile_sets`` for each day alone.

    ``tx`` is the table as it is stored, with ``tx_date``, null for rows without a readable time.
    """
    columns = {name: F.col(name) for name in _METRICS}
    columns["is_anomaly"] = truthy(F.col("is_anomaly"))
    columns["tx_date"] = F.col("tx_date")
    columns["rows"] = F.lit("all")
    # The day goes with each value, behind a mark that a null value lacks.
    keyed = {
        name: F.concat(F.coalesce(F.col("tx_date").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("")))
        for name, column in columns.items()
    }
    counts = distributions(tx, keyed)
    cell = F.substring_index("value", "|", 1)
    rest = F.substr("value", F.length(cell) + 2)
    return counts.select(
        cell.try_cast("date").alias("tx_date"),
        "metric",
        F.when(rest.startswith("="), F.substr(rest, F.lit(2))).alias("value"),
        "n",
    )


class ProfileState:
    """Counts by day of one dated table, in versions under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def new(cls, spark: SparkSession, label: str = "profile-state") -> ProfileState:
        return cls(spark, new_folder(spark, label))

    def _versions(self) -> list[int]:
        """Versions that were written as a whole."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = files.Path(f"{self.path}/days")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(
            int(name.removeprefix("version="))
            for name in names
            if name.startswith("version=") and system.exists(files.Path(f"{self.path}/days/{name}/_SUCCESS"))
        )

    def days(self) -> DataFrame:
        """tx_date, files, bytes, state and version of each day of the newest version."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], _DAYS)
        return self.spark.read.schema(_DAYS).parquet(f"{self.path}/days/version={versions[-1]}")

    def sets(self) -> DataFrame:
        """(metric, value, n) of the whole table, as ``report.profile_sets`` counts them."""
        days = self.days()
        versions = self._versions()
        if not versions:
            counts = self.spark.createDataFrame([], f"{_COUNTS}, version int")
        else:
            counts = self.spark.read.schema(f"{_COUNTS}, version int").option("basePath", f"{self.path}/counts").parquet(
                f"{self.path}/counts"
            )
        current = days.select(F.col("tx_date").alias("day"), F.col("version").alias("taken"))
        kept = counts.join(
            current, F.col("tx_date").eqNullSafe(F.col("day")) & (F.col("version") == F.col("taken")), "left_semi"
        )
        return kept.groupBy("metric", "value").agg(F.sum("n").alias("n"))

    def report(self, seasons: Sequence[Season] = DEFAULT_SEASONS) -> dict[str, DataFrame]:
        """The distribution tables of the validation report."""
        return report_from_sets(self.sets(), seasons)

    def refresh(self, source: str) -> list[date | None]:
        """Count the days of ``source`` whose files changed, publish a new version and name these days.

        Returns no day and writes nothing if no file changed. The number of days is that of a calendar.
        """
        before = self.days().withColumnRenamed("state", "old_state").select("tx_date", "old_state", "version")
        now = file_states(self.spark, source)
        both = now.join(
            before.withColumnRenamed("tx_date", "day"), F.col("tx_date").eqNullSafe(F.col("day")), "full"
        ).selectExpr("coalesce(tx_date, day) AS tx_date", "files", "bytes", "state", "old_state", "version")
        rows = list(both.toLocalIterator())
        changed = [row.tx_date for row in rows if row.files is not None and row.state != row.old_state]
        gone = [row for row in rows if row.files is None]
        if not changed and not gone:
            return []
        version = (self._versions() or [0])[-1] + 1
        if changed:
            dates = [day for day in changed if day is not None]
            wanted = F.col("tx_date").isin(dates) if dates else F.lit(False)
            if None in changed:
                wanted = wanted | F.col("tx_date").isNull()
            tx = self.spark.read.schema(_SCHEMA).parquet(source).filter(wanted)
            day_counts(tx).write.mode("overwrite").parquet(f"{self.path}/counts/version={version}")
        kept = [
            (row.tx_date, row.files, row.bytes, row.state, version if row.tx_date in changed else row.version)
            for row in rows
            if row.files is not None
        ]
        self.spark.createDataFrame(kept, _DAYS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/days/version={version}")
        return sorted(changed + [row.tx_date for row in gone], key=lambda day: (day is None, day))
