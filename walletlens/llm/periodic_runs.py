"""Operator 12: periodic runs of words by an online sparse diagonal DP.

A diagonal is a lag: it is alive while each word equals the word so many places before, and its match
length grows by one with each word. A diagonal that ends with enough length is a run and is emitted
there. Which diagonals are alive is sparse: a word starts those of its earlier occurrences.

Frequent words have many earlier occurrences, so lags are taken by octaves (``width`` to twice
``width`` less one), and without a loss a diagonal is started only where it can lead to a run:

* A run of lag d has at least 3 d words in a row whose nearest earlier occurrence is at most d words
  away. Only stretches of 3 ``width`` such words are gone through, octave by octave.
* Such a stretch holds a word at each multiple of ``width`` at which the last ``width`` words match on
  the diagonal, so occurrences are looked up there only, and their last ``width`` words compared by
  prefix hashes. The words themselves are compared before a diagonal lives.
* A lag that is a multiple of the period of a known run around it has that run's period, so it never
  starts; no other lag matches there.

So a text of n words takes about n log n steps, also if it is one word over and over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walletlens.llm.common import ROW_KEY, stored, table, take
from walletlens.llm.minhash_dedup import mixed

# A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

_RADIX = np.uint64(0x9E3779B97F4A7C15)

Change = Callable[[object, list[bytes]], list[bytes]]


class Diagonals:
    """The runs of a sequence of words."""

    def __init__(self, words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> None:
        self.words = words
        self.least_words, self.least_periods = least_words, least_periods
        self.runs: list[tuple[int, int, int]] = []
        if least_periods < 3:
            raise ValueError("a run has three periods at least")
        count = len(words)
        if count < least_words:
            return
        codes = np.fromiter(map(hash, words), np.int64, count)
        # Places by word, each word's in order; ``rank`` is a place's position there.
        self.order = np.argsort(codes, kind="stable")
        ordered = codes[self.order]
        again = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        gaps = np.full(count, count, np.int64)
        gaps[self.order[again]] = self.order[again] - self.order[again - 1]
        self.codes, self.hashes = codes, None
        width = 1
        while width * least_periods <= count:
            near = gaps < 2 * width
            least = max((least_periods - 1) * width, least_words - 2 * width + 1)
            edges = np.flatnonzero(np.diff(near, prepend=False, append=False)).reshape(-1, 2)
            edges = edges[edges[:, 1] - edges[:, 0] >= least]
            if edges.size:
                self._know(2 * width)
            for start, end in edges.tolist():
                self._pass(width, start, end)
            width *= 2

    def _know(self, least: int) -> None:
        """Starts, ends and periods of the runs so far with ``least`` words; once, prefix hashes, and of
        each place where its word's places begin."""
        known = sorted((start, start + length, period) for start, length, period in self.runs if length >= least)
        self.known = np.array(known, np.int64).reshape(-1, 3).T
        if self.hashes is not None:
            return
        count = len(self.words)
        self.powers = np.ones(count + 1, np.uint64)
        np.multiply.accumulate(np.full(count, _RADIX), out=self.powers[1:])
        self.hashes = np.zeros(count + 1, np.uint64)
        np.cumsum(mixed(self.codes.view(np.uint64)) * self.powers[:-1], out=self.hashes[1:])
        ordered = self.codes[self.order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        self.rank = np.empty(count, np.int64)
        self.rank[self.order] = np.arange(count)
        self.first = np.maximum.accumulate(np.where(new, np.arange(count), 0))

    def _lags(self, at: int, width: int) -> list[int]:
        """Lags of the octave at which the last ``width`` words occur, without those of known runs."""
        if width == 1:
            return [1]
        rank = self.rank[at]
        earlier = self.order[self.first[rank] : rank]
        low = np.searchsorted(earlier, at - 2 * width + 1)
        high = np.searchsorted(earlier, at - width, side="right")
        lags = at - earlier[low:high]
        lags = lags[lags <= at - width + 1]
        if not lags.size:
            return []
        here = self.hashes[at + 1 : at + 2] - self.hashes[at + 1 - width : at + 2 - width]
        there = self.hashes[at + 1 - lags] - self.hashes[at + 1 - width - lags]
        lags = lags[there * self.powers[lags] == here]
        if lags.size:
            starts, ends, periods = self.known
            for period in np.unique(periods[(starts <= at + 1 - width - lags.min()) & (ends > at)]).tolist():
                covered = starts[(periods == period) & (ends > at)].min(initial=at)
                lags = lags[(lags % period != 0) | (at + 1 - width - lags < covered)]
        return lags.tolist()

    def _pass(self, width: int, start: int, end: int) -> None:
        """Goes through a stretch of words with the diagonals of an octave."""
        words, alive = self.words, {}
        starts, ends, _ = self.known.tolist()
        at = turn = start + width - 1
        run = bisect_left(starts, start - 2 * width)
        while at < end:
            word = words[at]
            for lag in [lag for lag in alive if words[at - lag] != word]:
                self._end(lag, alive.pop(lag), at)
            if at == turn:
                while run < len(ends) and ends[run] <= at:
                    run += 1
                turn += width
                if run < len(ends) and starts[run] <= at - 3 * width + 2:
                    # Inside a known run the last words occur at multiples of its period only.
                    turn += (ends[run] - turn + width - 1) // width * width if not alive else 0
                    at = at + 1 if alive else turn
                    continue
                for lag in self._lags(at, width):
                    if lag in alive:
                        continue
                    begin = at + 1
                    while begin > lag and words[begin - 1] == words[begin - 1 - lag]:
                        begin -= 1
                    if begin <= at:
                        alive[lag] = begin
            at = at + 1 if alive else turn
        for lag, begin in alive.items():
            self._end(lag, begin, end)

    def _end(self, lag: int, begin: int, end: int) -> None:
        """A diagonal that matched from ``begin`` to ``end``: a run if it is long enough and no shorter period holds."""
        start, length = begin - lag, end - begin + lag
        if length < max(self.least_words, self.least_periods * lag):
            return
        starts, ends, periods = self.known
        if not np.any((starts <= start) & (ends >= end) & (lag % periods == 0)):
            self.runs.append((start, length, lag))


def runs_of(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """start, length and period of each run, by start, then period."""
    return sorted(Diagonals(words, least_words, least_periods).runs, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those of each run behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[place] for place in np.flatnonzero(kept).tolist()]


def periodic_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    change: Change | None = None,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """For each row of a stored table: the id, the row key, n_words, runs and collapsed.

    runs is an array of (start, length, period) in words, by start, then period: the stretches with that
    smallest period, of at least ``least_words`` words and ``least_periods`` periods, that no neighbouring
    word lengthens. collapsed is the text of the words that no run has behind its first period, with one
    blank between them. ``change`` makes other words of a row's id and words first. Null and empty
    texts have no words; repeated rows give repeated rows, an empty table none. Further columns do no harm.
    """
    plain = take(docs, id_column, text, key=True)
    kind = plain.schema[id_column].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, found, rest = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                words = (value or b"").split()
                if change is not None:
                    words = change(key, words)
                runs = runs_of(words, least_words, least_periods)
                counts.append(len(words))
                found.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                rest.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(found, shape), pa.array(rest, pa.binary())],
                ["id", *ROW_KEY, "n_words", "runs", "collapsed"],
            )

    made = plain.select(F.col(id_column).alias("id"), *ROW_KEY, F.col(text).cast("binary").alias("text")).mapInArrow(
        find,
        f"id {kind}, _file long, _index long, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed binary",
    )
    return made.withColumn("collapsed", F.col("collapsed").cast("string")).withColumnRenamed("id", id_column)


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth one made periodic from a place on; a null id counts as empty."""
    number = zlib.crc32(b"" if key is None else str(key).encode())
    if number % 10 or not words:
        return words
    number //= 10
    start = number % len(words)
    period = 1 + (len(words) - start) // (3 + number % 8)
    block = words[start : start + period]
    rest = len(words) - start
    return words[:start] + (block * (rest // period + 1))[:rest]


def op12_sparse_diagonals(spark, folder: str) -> DataFrame:
    found = periodic_runs(stored(table(spark, folder, "documents"), "runs"), change=planted)
    order = F.transform("runs", lambda run: F.struct((-run["length"]).alias("n"), run["start"].alias("a"), run["period"].alias("p")))
    best = F.array_min(order)
    lines = F.transform(
        "runs", lambda run: F.concat(F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string")), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["a"].alias("start"),
        (-best["n"]).alias("length"),
        best["p"].alias("period"),
        F.floor(F.expr("1000L") * -best["n"] / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# crc32 of the decimal id: its 48 to 57 codes go in, and eight shifts follow each.
_CRC = """
    xor(list_reduce(
        flatten(list_transform(range(1, length(key) + 1), lambda i: [CAST(ord(key[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda done, step: CASE WHEN step >= 0 THEN xor(done, step)
            WHEN done % 2 = 1 THEN xor(done // 2, 3988292384) ELSE done // 2 END,
        CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))
"""

OP12_SQL = f"""
WITH keyed AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS key, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
summed AS (SELECT doc_id, words, len(words) AS n, {_CRC} AS h FROM keyed),
placed AS (SELECT *, h // 10 AS g, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM summed),
docs AS (
    SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a
        THEN words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE words[i + 1] END) ELSE words END AS words
    FROM placed
),
places AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM docs),
diagonals AS (
    SELECT b.doc_id, b.i - a.i AS lag, b.i, b.i - row_number() OVER (PARTITION BY b.doc_id, b.i - a.i ORDER BY b.i) AS island
    FROM places a JOIN places b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i AND {LEAST_PERIODS} * (b.i - a.i) <= a.n
),
matched AS (
    SELECT doc_id, lag AS period, min(i) - lag AS start, max(i) + 1 AS stop FROM diagonals GROUP BY doc_id, lag, island
),
long AS (SELECT * FROM matched WHERE stop - start >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * period)),
runs AS (
    SELECT doc_id, start, stop - start AS length, period FROM long l
    WHERE NOT EXISTS (
        SELECT 1 FROM long s WHERE s.doc_id = l.doc_id AND s.period < l.period AND s.start <= l.start AND s.stop >= l.stop
    )
),
summary AS (
    SELECT doc_id, count(*) AS n_runs, min(struct_pack(n := -length, a := start, p := period)) AS best,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM places ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.a AS BIGINT) AS start, CAST(-best.n AS BIGINT) AS length,
    CAST(best.p AS BIGINT) AS period, CAST(1000 * -best.n // best.p AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs d LEFT JOIN summary USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
