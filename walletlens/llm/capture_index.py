"""Operator 4: WARC archives with an index of captures, merged from sorted runs.

A writing task fills archives of bounded size. The captures of one archive are sorted by URL key
and time and leave the task as a run, in blocks. Splitters from a bounded sample of blocks cut
the order of all captures into ranges; a range gets the blocks of every run that reach into it,
and a loser tree merges the runs, a comparison for each level. Ranges in order are the capture
histories of all URLs. A URL with very many captures is cut by time like any other.

Archives are written in the folder that the session shares (``spark.checkpoint.dir``) through the
file systems of pyarrow. A task that runs again writes archives under new names, and only those
of the attempt that succeeded are in the runs, which are written before they are read.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from walletlens.llm import archive_files as files
from walletlens.llm.common import ROW_KEY, growing, stored, table, take
from walletlens.sources.work import new_folder, settle

MIN_BYTES = 0
ARCHIVE_BYTES = 32_000_000
BLOCK = 128
# Captures of a range, about; and blocks that the splitters are chosen from, at most.
RANGE = 4096
SAMPLE = 10_000

ENTRY = "struct<key: string, time: string, id: string, offset: bigint, length: bigint>"


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def identity(file: int, index: int) -> str:
    """A record's UUID from its row key."""
    return str(uuid.UUID(int=(file % 2**64) << 64 | index % 2**64))


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of a payload that another row has first: the row key and the first row's.

    First is the row with the smallest page_id (null last), then by row key.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", *ROW_KEY)
    digest = F.sha1("payload")
    sized = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", *ROW_KEY, digest.alias("digest"))
    groups = (
        sized.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return settle(groups.select("digest", "first"), "warc-groups")


def archived(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, captured: Column | None = None) -> DataFrame:
    """Writes the archives and returns the runs: run, block, low (the least entry) and entries.

    ``pages`` is a stored table with page_id, url and html. Null html is an empty payload, a null
    url has no target and an empty key, a null page_id has no such header. ``captured`` is the
    time of capture, without it seconds after 2024 began by page_id.
    """
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9))
    moment = F.timestamp_seconds(seconds) if captured is None else captured
    plain = take(pages, "page_id", "url", "html", key=True).withColumn(
        "payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")
    )
    groups = revisits(plain, min_bytes)
    first = F.when(F.octet_length("payload") >= min_bytes, F.col("first"))
    rows = plain.withColumn("digest", F.sha1("payload")).join(growing(groups), "digest", "left").select(
        F.col("page_id").cast("string").alias("page"), "url", F.date_format(moment, "yyyyMMddHHmmss").alias("time"),
        "payload", *ROW_KEY, first["_file"].alias("first_file"), first["_index"].alias("first_index"),
        first["page_id"].cast("string").alias("first_page"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        stream, run, entries, at = None, "", [], 0
        for batch in batches:
            for page, url, time, payload, file, index, first_file, first_index, first_page in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                if stream is None:
                    run = f"{uuid.uuid4().hex}.warc.gz"
                    stream, entries, at = system.open_output_stream(f"{root}/{run}", compression=None), [], 0
                own = identity(file, index)
                digest = files.base32_digest(payload)
                if first_file is None or (first_file, first_index) == (file, index):
                    made = files.response(own, url, time, page, digest, payload)
                else:
                    other = identity(first_file, first_index)
                    made = files.revisit(own, url, time, page, digest, len(payload), other, first_page)
                stream.write(made)
                entries.append((files.url_key(url), time, own, at, len(made)))
                at += len(made)
                if at >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
                    yield _blocks(run, entries)
        if stream is not None:
            stream.close()
            yield _blocks(run, entries)

    low = "struct<key: string, time: string, id: string>"
    return rows.mapInArrow(write, f"run string, block int, low {low}, entries array<{ENTRY}>")


_ENTRY = pa.struct(
    [("key", pa.string()), ("time", pa.string()), ("id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_LOW = pa.struct([("key", pa.string()), ("time", pa.string()), ("id", pa.string())])


def _blocks(run: str, entries: list[tuple]) -> pa.RecordBatch:
    """A sorted run, cut into blocks."""
    entries = sorted(entries)
    names = [field.name for field in _ENTRY]
    parts = [
        [dict(zip(names, entry)) for entry in entries[start : start + BLOCK]] for start in range(0, len(entries), BLOCK)
    ]
    lows = [{name: part[0][name] for name in ("key", "time", "id")} for part in parts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([run] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(lows, _LOW),
            pa.array(parts, pa.list_(_ENTRY)),
        ],
        ["run", "block", "low", "entries"],
    )


def splitters(runs: DataFrame) -> list[tuple[str, str, str]]:
    """Least keys of all ranges but the first, from at most ``SAMPLE`` blocks."""
    captures = runs.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0]
    ranges = min(SAMPLE, -(-captures // RANGE))
    sample = runs.orderBy(F.xxhash64("run", "block"), "run", "block").limit(SAMPLE).select("low.*").collect()
    lows = sorted(tuple(row) for row in sample)
    cuts = [lows[len(lows) * number // ranges] for number in range(1, ranges)] if lows else []
    return sorted(set(cuts))


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of its match; the winner goes up.

    After the winner is taken, only the matches on its way to the root are played again.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._play(leaf)

    def _before(self, one: int, other: int) -> bool:
        a, b = self.heads[one], self.heads[other]
        if a is None or b is None:
            return b is None and a is not None
        return (a, one) < (b, other)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Entries in order, each with the number of its run."""
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner], winner
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged(runs: DataFrame) -> DataFrame:
    """All captures with their place in the global order: range, place, key, time, id, run, offset
    and length. ``runs`` is a stored table."""
    cuts = splitters(runs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for run, block, entries in zip(*(batch.column(name).to_pylist() for name in ("run", "block", "entries"))):
                parts: dict[int, list] = {}
                for entry in entries:
                    key = (entry["key"], entry["time"], entry["id"])
                    parts.setdefault(bisect.bisect_right(cuts, key), []).append(entry)
                made += [(number, run, block, part) for number, part in parts.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in made], pa.int32()), pa.array([row[1] for row in made], pa.string()),
                    pa.array([row[2] for row in made], pa.int32()), pa.array([row[3] for row in made], pa.list_(_ENTRY)),
                ],
                ["range", "run", "block", "entries"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, {}
        for batch in batches:
            for at, run, entries in zip(*(batch.column(name).to_pylist() for name in ("range", "run", "entries"))):
                if at != number:
                    if own:
                        yield one_range(number, own)
                    number, own = at, {}
                own.setdefault(run, []).extend(tuple(entry.values()) for entry in entries)
        if own:
            yield one_range(number, own)

    def one_range(number: int, own: dict[str, list[tuple]]) -> pa.RecordBatch:
        names = list(own)
        ordered = [(*entry, names[winner]) for entry, winner in LoserTree([iter(own[name]) for name in names])]
        key, time, id_, offset, length, run = zip(*ordered)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(ordered), pa.int32()), pa.array(range(len(ordered)), pa.int64()), pa.array(key),
                pa.array(time), pa.array(id_), pa.array(run), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
            ],
            ["range", "place", "key", "time", "id", "run", "offset", "length"],
        )

    parts = runs.mapInArrow(split, f"range int, run string, block int, entries array<{ENTRY}>")
    together = parts.repartition("range").sortWithinPartitions("range", "run", "block")
    return together.mapInArrow(
        merge, "range int, place long, key string, time string, id string, run string, offset long, length long"
    )


def captures(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Reads the indexed records back from the archives, each archive once and in order.

    The payload column is null if payloads are not wanted, and for revisits. Digests and sizes are those of the payload that was read; for a revisit those of its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        name, stream = None, None
        for batch in batches:
            made = []
            for run, offset, length in zip(*(batch.column(name).to_pylist() for name in ("run", "offset", "length"))):
                if run != name:
                    if stream is not None:
                        stream.close()
                    name, stream = run, system.open_input_file(f"{root}/{run}")
                stream.seek(offset)
                headers, http, payload = files.parsed(stream.read(length))
                kind = headers["warc-type"]
                said = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size, digest = len(payload), files.base32_digest(payload)
                    if (digest, size) != (said, int(http["content-length"])):
                        raise ValueError(f"the payload of {headers['warc-record-id']} is not what was written")
                else:
                    size, digest = int(http["content-length"]), said
                shown = payload if payloads and kind == "response" else None
                made.append((headers.get("x-page-id"), size, digest, kind, headers.get("x-refers-to-page-id"), shown))
            columns = list(zip(*made)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("range", "place", "key", "time")),
                    *(pa.array(list(values), kind) for values, kind in zip(columns, kinds)),
                ],
                ["range", "place", "url_key", "captured", "page", "payload_bytes", "payload_digest", "record_type",
                 "refers", "payload"],
            )

    grouped = index.select("range", "place", "key", "time", "run", "offset", "length")
    return grouped.repartition("run").sortWithinPartitions("run", "offset").mapInArrow(
        read,
        "range int, place long, url_key string, captured string, page string, payload_bytes long, "
        "payload_digest string, record_type string, refers string, payload binary",
    )


def capture_histories(
    pages: DataFrame, min_bytes: int = MIN_BYTES, captured: Column | None = None, payloads: bool = True
) -> DataFrame:
    """Archives of the pages, read back through the merged index; one row for each page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured,
    payload, and history_range and history_place, whose order is that of the capture histories. Of rows with an
    equal payload of at least ``min_bytes`` bytes one is the response, also if page ids repeat.
    """
    pages = stored(pages, "warc")
    kind = take(pages, "page_id").schema["page_id"].dataType
    folder = new_folder(pages.sparkSession, "warc")
    runs = settle(archived(pages, folder, min_bytes, captured), "warc-runs")
    index = settle(merged(runs), "warc-index")
    return captures(index, folder, payloads).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"), "url_key", "captured",
        F.col("range").alias("history_range"), F.col("place").alias("history_place"), "payload",
    )


def op4_merged_capture_index(spark, folder: str) -> DataFrame:
    found = capture_histories(table(spark, folder, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP4_SQL = f"""
WITH sized AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
           sha1(coalesce(html, '')) AS hex
    FROM pages
),
ranked AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM sized
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([
           substr('{_ALPHABET}', 1 + CAST((CAST(('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5)) AS BIGINT)
               >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER), 1) for i in range(32)
       ], '') AS payload_digest,
       CASE WHEN payload_bytes < {MIN_BYTES} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first THEN first END AS refers_to
FROM ranked
"""
