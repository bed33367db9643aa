"""Operator 13: spelling variants grouped by Bloom-guided neighbourhoods.

The vocabulary of a corpus is put into blocked Bloom filters, sharded by word length. Each word's
edits are generated and probed against the shards of the lengths that they have; only positives are
shuffled, to a join with the vocabulary that removes the false ones. A word is near another if they
differ by one inserted, deleted or replaced code point.

Nearness is mutual, so each pair is generated once: by a deletion from the longer word, or by putting
a letter of the alphabet in use in the place of a smaller one. Edits are not spelled out for a
probe: the hash of a word is a sum over its places, and that of an edit follows from partial sums.

A shard holds about ``SHARD_WORDS`` words. A round sends at most ``SHARDS`` shards to the workers, so
what is broadcast has a bounded size; a larger vocabulary takes more rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walletlens.llm.common import growing, table, take, union_all
from walletlens.llm.minhash_dedup import mixed
from walletlens.sources.work import settle

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A word is written as its form if that is so many times as frequent.
TIMES = 10

# Words of a shard, on average at most, and shards of a round.
SHARD_WORDS = 1 << 19
SHARDS = 32
# A block is 256 bits in 4 lanes; a word has 16 bits of the filter and sets 2 bits in each lane.
LANES = 4
WORDS_OF_BLOCK = 16
# Longer words share a class of shards.
LONGEST_CLASS = 64

# Distinct words that a task counts before it hands them on.
COUNTED = 200_000
# Letters of words whose edits are probed at a time, and words of a partition.
STRIDE = 1 << 17
PARTITION_WORDS = 1 << 14

_RUN = re.compile("[a-zÀ-ÿ]+")

Change = Callable[[object, str], str]


def _as_is(key: object, word: str) -> str:
    return word


def word_counts(
    docs: DataFrame, change: Change = _as_is, least_letters: int = LEAST_LETTERS, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """word and n: occurrences in all texts of the words of enough letters; ``change`` makes a word of a
    row's id and a run of letters first, and may shorten it."""
    long_run = re.compile(f"{_RUN.pattern[:-1]}{{{least_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return made

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                for run, n in Counter(long_run.findall(value.lower().decode())).items():
                    word = change(key, run)
                    if len(word) >= least_letters:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield handed()
        yield handed()

    # Lower-casing bytes changes A-Z only.
    plain = take(docs, id_column, text).select(id_column, F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- hashes of words and edits


def _place_hashes(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    code = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + letters.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(mixed(code + np.uint64(0xA0761D6478BD642F)))


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mixed(sums ^ np.uint64(length * 0x2545F4914F6CDD1D & (1 << 64) - 1))


class Layout:
    """Shards of each class of lengths: parts of a class, and blocks of each part as a power of two."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.parts = {kind: -(-count // SHARD_WORDS) for kind, count in counts.items()}
        self.bits = {
            kind: max(1, (-(-count // (self.parts[kind] * WORDS_OF_BLOCK)) - 1).bit_length()) for kind, count in counts.items()
        }

    def shards(self) -> list[tuple[int, int]]:
        return [(kind, part) for kind in sorted(self.parts) for part in range(self.parts[kind])]

    def part_and_block(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (hashes >> np.uint64(64 - self.bits[kind])).astype(np.int64)
        if self.parts[kind] == 1:
            return np.zeros(hashes.size, np.int64), block
        return (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.parts[kind])).astype(np.int64), block


def _lanes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The two bits of a lane, from mixed hashes."""
    one, low = np.uint64(1), np.uint64(63)
    return (one << (hashes >> np.uint64(12 * lane) & low)) | (one << (hashes >> np.uint64(12 * lane + 6) & low))


def _class(length: int) -> int:
    return min(length, LONGEST_CLASS)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Places of the words of each length, some at a time."""
    places: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        places.setdefault(len(word), []).append(place)
    for length, found in places.items():
        step = max(1, STRIDE // length)
        for start in range(0, len(found), step):
            yield length, found[start : start + step]


def _marks(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["kind", "part", "block", *[f"lane{lane}" for lane in range(LANES)]]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, places in _by_length(words):
                letters = _letters([words[place] for place in places], length)
                hashes = _finished(_place_hashes(np.arange(length), letters).sum(axis=1, dtype=np.uint64), length)
                part, block = layout.part_and_block(_class(length), hashes)
                again = mixed(hashes)
                lanes = [_lanes(again, lane).view(np.int64) for lane in range(LANES)]
                kind = np.full(hashes.size, _class(length), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in (kind, part, block, *lanes)], names)

    return mark


class Filters:
    """The shards of a round."""

    def __init__(self, layout: Layout, shards: list[tuple[int, int]], rows: pa.Table) -> None:
        self.layout = layout
        self.offsets: dict[int, np.ndarray] = {}
        size = 0
        for kind, part in shards:
            self.offsets.setdefault(kind, np.full(layout.parts[kind], -1, np.int64))[part] = size
            size += 1 << layout.bits[kind]
        self.lanes = np.zeros((size, LANES), np.uint64)
        kinds, parts, blocks = (rows.column(name).to_numpy() for name in ("kind", "part", "block"))
        for kind, offsets in self.offsets.items():
            own = np.flatnonzero(kinds == kind)
            at = offsets[parts[own]] + blocks[own]
            for lane in range(LANES):
                self.lanes[at, lane] = rows.column(f"lane{lane}").to_numpy()[own].view(np.uint64)

    def has(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Places of the hash sums that may be words of a length."""
        kind = _class(length)
        if kind not in self.offsets or not sums.size:
            return np.empty(0, np.int64)
        hashes = _finished(sums, length)
        part, block = self.layout.part_and_block(kind, hashes)
        offsets = self.offsets[kind]
        at = block + (offsets[0] if offsets.size == 1 else offsets[part])
        again, left = mixed(hashes), np.arange(hashes.size)
        if (offsets < 0).any():
            left = np.flatnonzero(offsets[part] >= 0)
            at, again = at[left], again[left]
        for lane in range(LANES):
            wanted = _lanes(again, lane)
            good = np.flatnonzero(self.lanes[at, lane] & wanted == wanted)
            at, again, left = at[good], again[good], left[good]
        return left


def _edits(filters: Filters, letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
    """Words, places and letters (0: none, a deletion) of the edits that may be words."""
    count, length = letters.shape
    own = _place_hashes(np.arange(length), letters)
    total = own.sum(axis=1, dtype=np.uint64)
    if _class(length - 1) in filters.offsets:
        # The places behind a deleted one move forward by one.
        moved = np.zeros_like(own)
        moved[:, 1:] = _place_hashes(np.arange(length - 1), letters[:, 1:])
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        # Of equal letters in a row the first stands for all.
        first = np.ones(letters.shape, bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        at = np.flatnonzero(first)
        found = at[filters.has((before + behind).ravel()[at], length - 1)]
        yield found // length, found % length, 0
    if _class(length) in filters.offsets:
        rest = (total[:, None] - own).ravel()
        flat = letters.ravel()
        columns = np.tile(np.arange(length), count)
        for letter in alphabet.tolist():
            at = np.flatnonzero(flat < letter)
            new = _place_hashes(np.arange(length), np.full(length, letter))
            found = at[filters.has(rest[at] + new[columns[at]], length)]
            yield found // length, found % length, letter


def _probe(filters, alphabet: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, places in _by_length(words):
                letters = _letters([words[place] for place in places], length)
                sources, edits = [], []
                for rows, columns, letter in _edits(filters.value, letters, alphabet):
                    new = chr(letter) if letter else ""
                    for row, column in zip(rows.tolist(), columns.tolist()):
                        word = words[places[row]]
                        sources.append(places[row])
                        edits.append(word[:column] + new + word[column + 1 :])
                source = pa.array(sources, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(source), batch.column(1).take(source), pa.array(edits, pa.string())],
                    ["word", "n", "edit"],
                )

    return probe


# ---------------------------------------------------------------- neighbours, forms, roots


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of near words of a written vocabulary (word, n) once."""
    spark = vocabulary.sparkSession
    kind = F.least(F.length("word"), F.lit(LONGEST_CLASS))
    # At most LONGEST_CLASS rows, and as many letters as there are.
    counts = {row.kind: row.n for row in vocabulary.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()
    alphabet = np.array(sorted(ord(row.letter) for row in used if row.letter), np.uint8)
    layout = Layout(counts)
    dealt = vocabulary.repartition(max(1, sum(counts.values()) // PARTITION_WORDS), "word")
    names = [f"lane{lane}" for lane in range(LANES)]
    marks = settle(
        dealt.select("word")
        .mapInArrow(_marks(layout), "kind long, part long, block long, " + ", ".join(f"{name} long" for name in names))
        .groupBy("kind", "part", "block")
        .agg(*[F.bit_or(name).alias(name) for name in names]),
        "spelling-filters",
    )
    shards, found = layout.shards(), []
    for start in range(0, len(shards), SHARDS):
        own = shards[start : start + SHARDS]
        wanted = F.struct("kind", "part").isin([F.struct(F.lit(k).cast("long"), F.lit(p).cast("long")) for k, p in own])
        filters = spark.sparkContext.broadcast(Filters(layout, own, marks.where(wanted).toArrow()))
        found.append(dealt.mapInArrow(_probe(filters, alphabet), "word string, n long, edit string"))
    if not found:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    positive = union_all(found).withColumnRenamed("edit", "other")
    return positive.join(growing(exact), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row of a written table (word, form): the end of its chain of forms.

    A form is ``TIMES`` as frequent as its word, so chains are short; each round doubles the reach.
    """
    up = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = settle(up.join(growing(above), "root", "left").select("word", "root", "top"), "spelling-moved")
        if moved.where("top IS NOT NULL").isEmpty():
            return up
        up = settle(moved.select("word", F.coalesce("top", "root").alias("root")), "spelling-roots")


def spelling_variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of a written vocabulary (word, n).

    ``word`` holds letters up to U+00FF and no word twice. The form is the near word of largest n
    (of equal ones the first in code-point order) if that is ``times`` the word's n at least, else
    null; the root is the end of the chain of forms, the word itself without one. An empty vocabulary
    gives no rows.
    """
    pairs = settle(near_words(vocabulary), "spelling-pairs")
    both = pairs.unionByName(
        pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = both.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    enough = -F.col("best.less") >= times * F.col("n")
    near = settle(
        best.select(
            "word",
            "n_near",
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-near",
    )
    ends = roots(near.where("form IS NOT NULL"))
    return (
        vocabulary.select("word", "n")
        .join(growing(near), "word", "left")
        .join(growing(ends), "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )


def corpus_variants(
    docs: DataFrame,
    change: Change = _as_is,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """``spelling_variants`` of the words of all texts with enough letters and occurrences.

    A word is a stretch of A-Z, a-z and U+00C0 to U+00FF as a whole, with A-Z in lower case. Null and empty
    texts have none; repeated rows count again; an empty table gives no rows; further columns do no harm.
    """
    counts = word_counts(docs, change, least_letters, text, id_column).where(F.col("n") >= least_count)
    return spelling_variants(settle(counts, "spelling-vocabulary"), times)


def planted(key: object, run: str) -> str:
    """The run, one of 31 without one of its letters; a null id counts as empty."""
    number = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if number % 31:
        return run
    place = number % len(run)
    return run[:place] + run[place + 1 :]


def op13_bloom_neighbours(spark, folder: str) -> DataFrame:
    return corpus_variants(table(spark, folder, "documents"), planted)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# crc32 of UTF-8: a letter from U+00C0 to U+00FF is two bytes; eight shifts follow each byte.
_SHIFTS = ", ".join(["-1"] * 8)
_CRC = f"""
    xor(list_reduce(
        flatten(list_transform(range(1, length(key) + 1), lambda i: CASE WHEN ord(key[i]) < 128
            THEN [CAST(ord(key[i]) AS BIGINT), {_SHIFTS}] ELSE [195, {_SHIFTS}, CAST(ord(key[i]) - 64 AS BIGINT), {_SHIFTS}] END)),
        lambda done, step: CASE WHEN step >= 0 THEN xor(done, step)
            WHEN done % 2 = 1 THEN xor(done // 2, 3988292384) ELSE done // 2 END,
        CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))
"""

OP13_SQL = f"""
WITH RECURSIVE found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
keyed AS (SELECT run, n, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS key FROM counted),
summed AS (SELECT run, n, {_CRC} AS h FROM keyed),
made AS (
    SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n
    FROM summed
),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {LEAST_LETTERS}
    GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
cut AS (
    SELECT DISTINCT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
),
near AS (
    SELECT p.word, count(*) AS n_near, min(struct_pack(less := -o.n, other := p.other)) AS best
    FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -best.less >= {TIMES} * w.n THEN best.other END AS form, CASE WHEN -best.less >= {TIMES} * w.n THEN -best.less END AS form_n
    FROM words w LEFT JOIN near USING (word)
),
chain AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.root AND e.form IS NULL
"""
