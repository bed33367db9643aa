"""Operator 7: base rules and a calibrated classifier over hashed word and character n-grams.

Features of a text are its words, its word pairs and the character triples inside its words
(with word ends), each hashed into a table of its own, counted and divided by the number of
words. A logistic regression is fitted on labelled rows, its score is calibrated on held-out
labelled rows by Platt scaling, and texts are scored in Arrow batches against a fixed threshold.

The base rules are exact counts over the whole text: see ``scored``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from walletlens.llm.common import table, take

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Deleting blanks and the later bytes of UTF-8 letters leaves one byte for each letter in a word.
NOT_LETTERS = BLANKS + bytes(range(0x80, 0xC0))

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5

# Labelled rows that a model is fitted on, at most; a fifth of them calibrate it.
FIT_ROWS = 4000
FIT_STEPS = 120
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS

# Remembered words of a worker.
REMEMBERED = 400_000
# Three word numbers below this fit into one 64-bit key.
SMALL_NUMBERS = 1 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    """Weights of word, pair and triple slots, the bias, and Platt's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def triple_slots(word: bytes) -> list[int]:
    framed = b"<" + word + b">"
    return [zlib.crc32(framed[at : at + 3]) & (SLOTS - 1) for at in range(len(framed) - 2)]


class Words(dict):
    """Numbers of words in order of first sight, with the hash and the weight of each.

    With a model, the weight is that of the word and of its triples together.
    """

    def __init__(self, model: Model | None = None):
        super().__init__()
        self.weights = None if model is None else model.weights.astype(np.float64)
        self.start()

    def start(self) -> None:
        self.clear()
        self.hashes = np.empty(1 << 16, np.uint64)
        self.scores = np.zeros(1 << 16)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        value = xxhash.xxh64_intdigest(word)
        self.hashes[number] = value
        if self.weights is not None:
            triples = self.weights[2 * SLOTS :]
            own = self.weights[value >> (64 - SLOT_BITS)]
            self.scores[number] = own + sum([triples[place] for place in triple_slots(word)])
        self[word] = number
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= REMEMBERED:
            self.start()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def base_counts(text: bytes, words: list[bytes], numbers: np.ndarray) -> tuple[int, ...]:
    """The counts of ``COUNTS``, over the whole text."""
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text.translate(None, NOT_LETTERS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
    )


def repeated_words(numbers: np.ndarray) -> int:
    """Words in windows of three that the text has twice or more."""
    if numbers.size < 4:
        return 0
    size = int(numbers.max()) + 1
    if size > SMALL_NUMBERS:
        numbers = np.unique(numbers, return_inverse=True)[1]
        size = int(numbers.max()) + 1
    pairs = numbers[:-1] * size + numbers[1:]
    if size > SMALL_NUMBERS:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + numbers[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    often = count[place] > 1
    covered = np.zeros(numbers.size, bool)
    for shift in range(3):
        covered[shift : shift + often.size] |= often
    return int(covered.sum())


def features(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their values: word slots, then pair slots, then triple slots."""
    parts = text.split()
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    numbers = words.numbers(parts)
    hashes = words.hashes[numbers]
    triples = np.array([place for part in parts for place in triple_slots(part)], np.int64)
    slots = np.concatenate([slot(hashes), SLOTS + slot(pair_hashes(hashes)), 2 * SLOTS + triples])
    found, counts = np.unique(slots, return_counts=True)
    return found.astype(np.int32), (counts / len(parts)).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", id_column: str = "doc_id",
    label: str = "quality",
) -> Model | None:
    """A model from at most ``rows`` labelled rows, chosen by the hash of the id.

    Null labels, labels other than 0 and 1, and rows without text are no examples. Without
    examples of both labels there is no model (None).
    """
    marked = take(labels, id_column, label).where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
    chosen = marked.orderBy(F.xxhash64(id_column), id_column, label).limit(rows)
    # At most ``rows`` rows of two numbers.
    joined = take(docs, id_column, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), id_column)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [features(value, words) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([slots.tobytes() for slots, _ in found], pa.binary()),
                    pa.array([values.tobytes() for _, values in found], pa.binary()),
                    batch.column(2),
                ],
                ["order", "slots", "values", "label"],
            )

    examples = joined.select(
        F.xxhash64(id_column).alias("order"), F.col(text).cast("binary").alias("text"), F.col(label).cast("int")
    ).mapInArrow(extract, "order long, slots binary, values binary, label int")
    got = examples.orderBy("order", F.crc32("slots")).limit(rows).collect()
    held = [row for place, row in enumerate(got) if place % 5 == 4]
    used = [row for place, row in enumerate(got) if place % 5 != 4]
    if len({row.label for row in used}) < 2:
        return None
    weights, bias = regression(*arrays(used))
    slope, shift = 1.0, 0.0
    if len({row.label for row in held}) == 2:
        slots, values, place, target = arrays(held)
        slope, shift = platt(np.bincount(place, values * weights[slots], len(target)) + bias, target)
    return Model(weights.astype(np.float32), bias, slope, shift)


def arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    slots = [np.frombuffer(row.slots, np.int32) for row in rows]
    values = [np.frombuffer(row["values"], np.float32) for row in rows]
    place = np.repeat(np.arange(len(rows)), [part.size for part in slots])
    return np.concatenate(slots), np.concatenate(values), place, np.array([row.label for row in rows], float)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def regression(slots, values, place, target, steps: int = FIT_STEPS, decay: float = 1e-6):
    """Logistic regression with both labels of equal total weight, fitted by Adam."""
    size = 3 * SLOTS
    known, slots = np.unique(slots, return_inverse=True)
    share = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    weights, bias = np.zeros(known.size), 0.0
    mean, square = np.zeros(known.size + 1), np.zeros(known.size + 1)
    for step in range(1, steps + 1):
        error = (sigmoid(np.bincount(place, values * weights[slots], target.size) + bias) - target) * share
        slope = np.append(np.bincount(slots, values * error[place], known.size) + decay * weights, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= float(move[-1])
    full = np.zeros(size)
    full[known] = weights
    return full, bias


def platt(score: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps; the targets are smoothed by the counts of the labels."""
    good, bad = target.sum(), (1 - target).sum()
    smooth = np.where(target > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    size = max(float(np.abs(score).max()), 1e-9)
    x = np.stack([score / size, np.ones_like(score)])
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(at @ x)
        slope = x @ (p - smooth) + 1e-3 * at
        curve = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(curve, slope)
    return float(at[0] / size), float(at[1])


_words: tuple[int, Words] | None = None


def _scoring_words(model: Model | None) -> Words:
    """The worker's words; a new model starts anew."""
    global _words
    mark = 0 if model is None else zlib.crc32(model.weights.tobytes())
    if _words is None or _words[0] != mark:
        _words = (mark, Words(model))
    return _words[1]


def scored(
    docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Base counts, probability and verdict of each row, beside the carried columns.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words. base_failed: fewer than 50 words, or more than half of
    the words repeated. probability: calibrated, null without a model. kept: base rules passed
    and the probability at least ``threshold``; without a model the base rules alone decide.
    A null or empty text has counts of 0 and fails. Rows stay one for one.
    """
    plain = take(docs, *carry, text) if text not in carry else take(docs, *carry)
    kinds = ", ".join(f"`{name}` {plain.schema[name].dataType.simpleString()}" for name in carry)
    sent = plain.select(*[F.col(f"`{name}`") for name in carry], F.col(text).cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        words = _scoring_words(use)
        pairs = None if use is None else use.weights[SLOTS : 2 * SLOTS].astype(np.float64)
        for batch in batches:
            counts, chances = [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                value = raw or b""
                parts = value.split()
                numbers = words.numbers(parts)
                counts.append(base_counts(value, parts, numbers))
                if use is None:
                    chances.append(None)
                    continue
                total = words.scores[numbers].sum() + pairs[slot(pair_hashes(words.hashes[numbers]))].sum()
                z = use.slope * (total / max(1, len(parts)) + use.bias) + use.shift
                chances.append(float(sigmoid(np.float64(z))))
            columns = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, columns), pa.array(chances, pa.float64())],
                [*carry, *COUNTS, "probability"],
            )

    made = sent.mapInArrow(score, f"{kinds}, {', '.join(f'{name} long' for name in COUNTS)}, probability double")
    failed = base_failed()
    verdict = F.when(failed, F.lit(False)).otherwise(F.coalesce(F.col("probability") >= threshold, F.lit(True)))
    return made.withColumn("base_failed", failed).withColumn("kept", verdict)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``scored`` keeps, with all their columns as they were, whatever their names.

    Null and empty texts are not kept; an empty table gives no rows.
    """
    names = docs.columns
    plain = [f"d{place}" for place in range(len(names))]
    found = scored(docs.toDF(*plain), model, tuple(plain), plain[names.index(text)], threshold)
    return found.where("kept").select(*plain).toDF(*names)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def op7_hashed_ngram_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, fit(docs, table(spark, folder, "labels")))
