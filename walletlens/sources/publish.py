"""Tables that appear as a whole: several sinks of one batch are seen together or not at all.

Data go to folders that no reader knows. A manifest, written last, names the folders of a batch for
every sink; a batch is published when its manifest is whole. A batch that was stopped between two sinks
has no manifest, so readers see nothing of it, and it may be run again; a batch that is published
is not written twice. A manifest may start a table anew: until it is there readers see the old rows,
from then on only the new ones, so an overwritten table is never empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from walletlens.sources.work import settle
from walletlens.operators.validation import with_route

_MANIFEST = "sink string, folder string, anew boolean"
_ROUTES = ("good", "quarantine")


class Publication:
    """Sinks under one folder, with their manifests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = self.files.Path(self.path)
        self.system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Published batches in order."""
        folder = self.files.Path(f"{self.path}/manifest")
        if not self.system.exists(folder):
            return []
        names = [status.getPath().getName() for status in self.system.listStatus(folder)]
        return sorted(int(name.removeprefix("batch=")) for name in names if self._whole(name))

    def _whole(self, name: str) -> bool:
        return name.startswith("batch=") and self.system.exists(self.files.Path(f"{self.path}/manifest/{name}/_SUCCESS"))

    def write(self, batch: int, tables: Mapping[str, DataFrame], anew: bool = False) -> bool:
        """Write the sinks of a batch and publish them together; False if the batch is published already."""
        if self._whole(f"batch={batch}"):
            return False
        made = []
        for sink, table in tables.items():
            folder = f"{self.path}/data/{sink}/batch={batch}-{uuid.uuid4().hex}"
            table.write.parquet(folder)
            made.append((sink, folder, anew))
        manifest = self.spark.createDataFrame(made, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return True

    def folders(self, sink: str) -> list[str]:
        """Folders of a sink that readers see: those from the last batch on that started it anew."""
        found: list[str] = []
        for batch in self.batches():
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={batch}").toLocalIterator()
            own = [row for row in rows if row.sink == sink]
            if any(row.anew for row in own):
                found = []
            found += [row.folder for row in own]
        return found

    def read(self, sink: str, schema: T.StructType) -> DataFrame:
        """The published rows of a sink."""
        folders = self.folders(sink)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def sweep(self) -> int:
        """Delete folders that no manifest names, left by batches that broke off; no batch may be running.

        Folders of a table that was started anew go, too. Returns their number.
        """
        gone = 0
        data = self.files.Path(f"{self.path}/data")
        for sink in self.system.listStatus(data) if self.system.exists(data) else []:
            known = {folder.rsplit("/", 1)[-1] for folder in self.folders(sink.getPath().getName())}
            for status in self.system.listStatus(sink.getPath()):
                if status.getPath().getName() not in known:
                    gone += self.system.delete(status.getPath(), True)
        return gone


def publish_routes(stream: DataFrame, path: str) -> Publication:
    """Process all present rows of a stream: good and failing rows of a batch appear together.

    The sinks are ``good`` and ``quarantine``; the rows of a batch are checked once.
    """
    spark = stream.sparkSession
    publication = Publication(spark, f"{path}/published")

    def write(batch: DataFrame, number: int) -> None:
        checked = settle(batch, "published-batch")
        publication.write(number, {route: checked.filter(checked.route == route) for route in _ROUTES})

    query = (
        with_route(stream).writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return publication


def published_routes(publication: Publication, schema: T.StructType) -> DataFrame:
    """The rows of both sinks."""
    first, second = (publication.read(route, schema) for route in _ROUTES)
    return first.unionByName(second)
