"""Operator 5: passages that repeat across documents, by content-defined word windows.

Words with the blanks behind them are hashed by a gear table, and runs of words from these. Of the
runs in each window of ``min_words`` words the one with the least hash is an anchor, so equal
windows have an equal anchor. Around anchors that two texts share, each window of ``min_words``
words is paired with its first row. Windows one after the other in both rows are a stretch, which is
compared byte by byte and lengthened as far as both texts agree. So a row reports each window that
an earlier row has too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from walletlens.llm.common import ROW_KEY, growing, stored, table, take, union_all
from walletlens.llm.minhash_dedup import mixed
from walletlens.sources.work import settle

# A passage has this many words at least.
MIN_WORDS = 50
# Bits 11 to 15 of the hash end a chunk where they are zero: 32 bytes on average.
CUT_MASK = 0b11111 << 11
WINDOW = 16

GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 2**32, 256, dtype=np.uint32)
GEAR_WORDS = np.random.Generator(np.random.PCG64(6)).integers(0, 2**64, 256, dtype=np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def cuts(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one its length. Passages are found by word windows, without it."""
    if not text:
        return np.empty(0, np.int64)
    # The hash of the last 16 bytes, by sums over 1, 2, 4, 8 and 16 bytes.
    rolled = GEAR[np.frombuffer(text, np.uint8)]
    width = 1
    while width < WINDOW:
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width]
        rolled = rolled + (older << np.uint32(width))
        width *= 2
    at = (rolled & np.uint32(CUT_MASK)) == 0
    # Of a run of cuts the first counts.
    at[1:] &= ~at[:-1]
    at[: WINDOW - 1] = False
    ends = np.flatnonzero(at) + 1
    return ends if ends.size and ends[-1] == len(text) else np.append(ends, len(text))


class Words:
    """Starts, ends and hashes of the words of a text."""

    def __init__(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        blank = BLANK[data]
        edges = np.flatnonzero(np.diff(~blank, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        if not self.starts.size:
            return
        first = self.starts[0]
        lengths = np.diff(np.append(self.starts, len(text)))
        powers = np.multiply.accumulate(np.full(lengths.max(), _MULTIPLIER))
        offsets = np.arange(first, len(text)) - np.repeat(self.starts, lengths)
        values = GEAR_WORDS[data[first:]] * powers[offsets]
        # A word with the blanks behind it, and alone.
        self.tokens = mixed(np.add.reduceat(values, self.starts - first))
        self.words = mixed(np.add.reduceat(np.where(blank[first:], np.uint64(0), values), self.starts - first))

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all runs of so many words, by runs of 1, 2, 4 ... words."""
        count = self.starts.size - width + 1
        made, done, level, step = np.zeros(count, np.uint64), 0, self.tokens, 1
        while step < width:
            if (width - 1) & step:
                made = mixed(made * _MULTIPLIER + level[done : done + count])
                done += step
            level = mixed(level[:-step] * _MULTIPLIER + level[step:])
            step *= 2
        return mixed(made * _MULTIPLIER + self.words[done : done + count])

    def anchors(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        if self.starts.size < min_words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        run = (min_words + 1) // 2
        found = self.runs(run)
        windows = np.lib.stride_tricks.sliding_window_view(found, min_words - run + 1)
        places = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        return places, found[places].view(np.int64)


def _columns(lists: list[tuple], width: int) -> list[pa.Array]:
    parts = list(zip(*lists)) or [[np.empty(0, np.int64)]] * width
    return [pa.array(np.concatenate(part)) for part in parts]


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def common_stretch(one: bytes, start: int, end: int, other: bytes, shift: int) -> tuple[int, int]:
    """The longest stretch around ``one[start:end]`` that ``other`` has ``shift`` bytes further on."""
    left = min(start, start + shift)
    a = np.frombuffer(one, np.uint8)[start - left : start][::-1]
    b = np.frombuffer(other, np.uint8)[start + shift - left : start + shift][::-1]
    differ = np.flatnonzero(a != b)
    low = start - (int(differ[0]) if differ.size else left)
    right = min(len(one) - end, len(other) - end - shift)
    a = np.frombuffer(one, np.uint8)[end : end + right]
    b = np.frombuffer(other, np.uint8)[end + shift : end + shift + right]
    differ = np.flatnonzero(a != b)
    return low, end + (int(differ[0]) if differ.size else right)


def _whole_letters(text: bytes, low: int, high: int) -> tuple[int, int]:
    while low < high and text[low] & 0xC0 == 0x80:
        low += 1
    while low < high < len(text) and text[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


def _whole_words(text: bytes, low: int, high: int) -> int:
    """Words that lie in the stretch as a whole."""
    found = len(_WORD.findall(text, low, high))
    blank = b"\x20\x09\x0a\x0b\x0c\x0d"
    if found and low and text[low] not in blank and text[low - 1] not in blank:
        found -= 1
    if found and high < len(text) and text[high] not in blank and text[high - 1] not in blank:
        found -= 1
    return found


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    edges = np.flatnonzero(np.diff(~BLANK[np.frombuffer(text, np.uint8)], prepend=False, append=False))
    return edges[::2], edges[1::2]


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Passages that an earlier row has too: the id, start, length (bytes), n_words, first_id,
    first_start and the row key.

    ``docs`` is a stored table. Rows are in the order of the id (null ids last), then of the row
    key. A row that repeats as a whole is one passage; repeats inside one row are none. Passages of
    a row may overlap if they come from different rows. Null and empty texts have none; an empty table
    gives no rows; further columns do no harm, whatever their names.

    Equal texts are one node: only the first row of each goes through the windows, and the others
    repeat it as a whole. A window is sent as its hash, the number of its row and its place there.
    """
    plain = take(docs, id_column, text, key=True)
    filled = plain.where(F.octet_length(text) > 0)
    body = F.col(text).cast("binary").alias("text")
    kind = plain.schema[id_column].dataType.simpleString()
    run = (min_words + 1) // 2

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct anchors of each row, with the hash of its text."""
        for batch in batches:
            found = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(Words(value).anchors(min_words)[1])
                found.append((own, np.full(own.size, row, np.int64)))
            yield pa.RecordBatch.from_arrays(_columns(found, 2), ["chunk", "row"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All anchors of each row."""
        for batch in batches:
            found = []
            for row, value in enumerate(batch.column(2).to_pylist()):
                places, own = Words(value).anchors(min_words)
                found.append((np.full(own.size, row, np.int64), own, places))
            rows, own, places = _columns(found, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), own, places.cast(pa.int32())], [*ROW_KEY, "chunk", "at"]
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash, row and place of the windows that hold one of the shared anchors of their row."""
        for batch in batches:
            found = []
            for row, value, at in zip(*(batch.column(place).to_pylist() for place in range(3))):
                words = Words(value)
                first = np.array(at)[:, None] - np.arange(min_words - run + 1)
                place = np.unique(first[(first >= 0) & (first <= words.starts.size - min_words)])
                found.append((words.runs(min_words)[place].view(np.int64), np.full(place.size, row, np.int64), place))
            chunk, rows, place = _columns(found, 3)
            yield pa.RecordBatch.from_arrays([chunk, rows, place.cast(pa.int32())], ["chunk", "row", "place"])

    order = [F.col("id").isNull(), F.col("id"), *map(F.col, ROW_KEY)]
    rows = settle(
        filled.select(F.col(id_column).alias("id"), *ROW_KEY, F.unhex(F.md5(text)).alias("whole")), "chunks-rows"
    )
    firsts = rows.groupBy("whole").agg(
        F.min(F.struct(order[0].alias("none"), "id", *ROW_KEY)).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    same = (F.col("first._file") == F.col("_file")) & (F.col("first._index") == F.col("_index"))
    # The number of a row keeps the order: rows are dealt by ranges and sorted there.
    nodes = settle(
        firsts.select("first.id", "first._file", "first._index")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("row", F.monotonically_increasing_id()),
        "chunks-nodes",
    )
    anchors = filled.select(F.xxhash64(text).alias("row"), body).mapInArrow(digests, "chunk long, row long")
    shared = settle(
        anchors.groupBy("chunk").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("chunk"),
        "chunks-shared",
    )
    places = filled.select(*ROW_KEY, body).mapInArrow(placed, "_file long, _index long, chunk long, at int")
    marked = settle(
        places.join(growing(shared), "chunk").groupBy(*ROW_KEY).agg(F.collect_list("at").alias("at"))
        .join(growing(nodes.select(*ROW_KEY, "row")), ROW_KEY),
        "chunks-marked",
    )
    known = settle(
        plain.select(*ROW_KEY, body).join(growing(marked), ROW_KEY).select("row", "text", "at")
        .mapInArrow(windows, "chunk long, row long, place int"),
        "chunks-known",
    )
    # Both uses below read this one shuffle.
    met = known.repartition("chunk")
    leading = met.groupBy("chunk").agg(F.min(F.struct("row", "place")).alias("first"))
    later = (
        met.join(growing(leading), "chunk")
        .where(F.col("first.row") != F.col("row"))
        .select("row", "place", F.col("first.row").alias("first_row"), (F.col("first.place") - F.col("place")).alias("shift"))
    )
    side = ["row", "first_row", "shift"]
    turn = F.row_number().over(Window.partitionBy(*side).orderBy("place"))
    stretches = later.withColumn("island", F.col("place") - turn).groupBy(*side, "island").agg(
        F.min("place").alias("low"), F.max("place").alias("high")
    )
    pairs = settle(
        stretches.groupBy("row", "first_row").agg(
            F.array_sort(F.collect_list(F.struct("low", "high", "shift"))).alias("stretches")
        ),
        "chunks-pairs",
    )
    wanted = union_all([pairs.select("row"), pairs.select(F.col("first_row").alias("row"))]).distinct()
    used = settle(nodes.join(growing(wanted), "row"), "chunks-used")
    texts = settle(
        plain.select(body, *ROW_KEY).join(growing(used), ROW_KEY).select("row", "id", *ROW_KEY, "text"), "chunks-texts"
    )
    first_texts = texts.select(
        F.col("row").alias("first_row"), F.col("id").alias("first_id"), F.col("text").alias("first_text")
    )
    both = pairs.join(growing(texts), "row").join(growing(first_texts), "first_row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            takes, values = [], []
            lists, ones, others = (batch.column(name).to_pylist() for name in ("stretches", "text", "first_text"))
            for row, (found, one, other) in enumerate(zip(lists, ones, others)):
                starts, ends = word_spans(one)
                first_starts = word_spans(other)[0]
                seen: dict[int, int] = {}
                for part in found:
                    start, end = int(starts[part["low"]]), int(ends[part["high"] + min_words - 1])
                    shift = int(first_starts[part["low"] + part["shift"]]) - start
                    if seen.get(shift, 0) >= end or one[start:end] != other[start + shift : end + shift]:
                        continue
                    low, high = common_stretch(one, start, end, other, shift)
                    seen[shift] = high
                    low, high = _whole_letters(one, low, high)
                    words = _whole_words(one, low, high)
                    if words >= min_words:
                        takes.append(row)
                        values.append((low, high - low, words, low + shift))
            index = pa.array(takes, pa.int64())
            columns = np.array(values, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name).take(index) for name in ("id", "first_id", *ROW_KEY)),
                    *map(pa.array, columns),
                ],
                ["id", "first_id", *ROW_KEY, "start", "length", "n_words", "first_start"],
            )

    made = both.select("id", "first_id", *ROW_KEY, "stretches", "text", "first_text").mapInArrow(
        compare,
        f"id {kind}, first_id {kind}, _file long, _index long, start long, length long, n_words long, first_start long",
    )
    copies = rows.join(growing(firsts.where("copies > 1")), "whole").where(~same)
    counted = F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    whole = (
        plain.select(F.col(text), *ROW_KEY)
        .join(growing(copies.select("id", F.col("first.id").alias("first_id"), *ROW_KEY)), ROW_KEY)
        .select(
            "id", "first_id", *ROW_KEY, F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("length"),
            counted.alias("n_words"), F.lit(0).cast("long").alias("first_start"),
        )
        .where(F.col("n_words") >= min_words)
    )
    return made.unionByName(whole).withColumnRenamed("id", id_column)


def op5_gear_chunk_passages(spark, folder: str) -> DataFrame:
    found = repeated_passages(stored(table(spark, folder, "documents"), "chunks"))
    return found.drop(*ROW_KEY)
