"""Operator 1: best-two-fit packing of pieces into sequences of a fixed capacity.

How many pieces there are of each length is all that a packing needs to know, and that table has
at most ``capacity`` rows at any size of the input. The plan is made from it: a bin is filled
greedily with the longest length that fits, over and over; then the smallest length of the bin is
taken out, and if two unpacked lengths fill its expanded gap more tightly, they take its place. A
plan step packs as many bins of one pattern as the counts allow, so each step uses up a length
and there are a few thousand steps, however many bins.

Pieces are numbered inside their length, block by block, and a piece's number decides its bin:
no task sees all pieces of a length, and nothing but the counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walletlens.llm.common import ROW_KEY, numbered, settled_with_key, table, take
from walletlens.llm.token_counts import PACKED, vocabulary_path, word_tokens

CAPACITY = 2048
SEPARATOR = 0

# Rows of a batch that leaves a worker.
BATCH_PIECES = 2000


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Token pieces of whole texts: the id, piece, start, length and the ids, packed little-endian.

    A document is its ids and a separator, so a null or empty text is one piece of one id. A
    document longer than ``capacity`` is cut into pieces of it; the last may be shorter.
    Repeated rows are packed each on its own; an empty table has no pieces.
    """
    path = vocabulary or vocabulary_path()
    step = capacity * PACKED
    end = SEPARATOR.to_bytes(PACKED, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            parts: list[bytes] = []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = tokens.ids(value) + end
                for start in range(0, len(ids), step):
                    rows.append(row)
                    starts.append(start // PACKED)
                    parts.append(ids[start : start + step])
                if len(parts) >= BATCH_PIECES:
                    yield made(batch, rows, starts, parts)
                    rows, starts, parts = [], [], []
            yield made(batch, rows, starts, parts)

    def made(batch, rows, starts, parts) -> pa.RecordBatch:
        begin = np.array(starts, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array((begin // capacity).astype(np.int32)),
                pa.array(begin),
                pa.array(np.array([len(part) // PACKED for part in parts], dtype=np.int64)),
                pa.array(parts, pa.binary()),
            ],
            ["id", "piece", "start", "length", "ids"],
        )

    plain = take(docs, id_column, text)
    kind = plain.schema[id_column].dataType.simpleString()
    cut_up = plain.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids binary"
    )
    return cut_up.withColumnRenamed("id", id_column)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Steps of a packing: how many bins, and the lengths in each of them.

    ``counts`` has how many pieces there are of each length from 1 to ``capacity``.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    steps = []
    while (present := np.flatnonzero(left)).size:
        taken: dict[int, int] = {}
        gap = capacity
        bin_: list[int] = []
        for length in present[::-1].tolist():
            while length <= gap and taken.get(length, 0) < left[length]:
                taken[length] = taken.get(length, 0) + 1
                bin_.append(length)
                gap -= length
            if not gap:
                break
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            free = left.copy()
            for length, count in taken.items():
                free[length] -= count
            pair = _tightest_pair(free, smallest + gap)
            if pair and sum(pair) > smallest:
                bin_ = [*bin_[:-1], *pair]
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        steps.append((times, sorted(bin_, reverse=True)))
    return steps


def _tightest_pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two free lengths whose sum is largest but at most ``gap``."""
    lengths = np.flatnonzero(free[: gap + 1])
    if lengths.size == 0:
        return None
    # For each first length, the largest second one that still fits beside it.
    at = np.searchsorted(lengths, gap - lengths, side="right") - 1
    at = np.where((at >= 0) & (lengths[at] == lengths) & (free[lengths] < 2), at - 1, at)
    fits = at >= 0
    if not fits.any():
        return None
    sums = np.where(fits, lengths + lengths[at], -1)
    best = int(sums.argmax())
    return int(lengths[best]), int(lengths[at[best]])


def placements(steps: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, ranges of piece numbers and where a range's pieces go.

    A range holds the pieces of one length in one step; with u of them in a bin, piece number r of
    the range goes to bin r // u, at the offset of its (r % u)-th place.
    """
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows = []
    first_bin = 0
    for times, lengths in steps:
        offset = 0
        for length, uses in zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True):
            rows.append((length, used[length], uses, first_bin, offset))
            used[length] += uses * times
            offset += length * uses
        first_bin += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    names = ["length", "first", "uses", "bin", "offset"]
    return {name: table[:, place] for place, name in enumerate(names)}


def pack(cut_up: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces; every further column is carried along, except for
    columns of these names and of the row key.

    A piece is at most ``capacity`` long and at least 1; others are an error. Offsets of a
    sequence are gapless from 0. The pieces are written once, as they are read twice.
    """
    settled = settled_with_key(cut_up.drop("sequence_id", "offset", "_number", *ROW_KEY), "pieces")
    counts = {row[0]: row[1] for row in settled.groupBy(length).agg(F.count(F.lit(1))).collect()}
    if any(value is None or not 1 <= value <= capacity for value in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    where = placements(plan_bins(counts, capacity), capacity)
    most = max(counts.values(), default=0) + 1
    starts = where["length"] * most + where["first"]
    ranked = numbered(settled, [length], "_number").drop(*ROW_KEY)
    names = [name for name in ranked.columns if name != "_number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(length).to_numpy()
            numbers = batch.column("_number").to_numpy()
            at = np.searchsorted(starts, lengths * most + numbers, side="right") - 1
            inside = numbers - where["first"][at]
            uses = where["uses"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in names],
                    pa.array(where["bin"][at] + inside // uses),
                    pa.array(where["offset"][at] + inside % uses * lengths),
                ],
                [*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{name}` {ranked.schema[name].dataType.simpleString()}" for name in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op1_best_two_fit(spark, folder: str) -> DataFrame:
    cut_up = pieces(table(spark, folder, "documents"))
    narrow = cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow)
