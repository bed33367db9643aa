"""Operator 11: benchmark decontamination by a generalised suffix automaton of the test items.

Texts and items are normalised to words: A-Z is lower-cased, a word is a stretch of digits, letters
a-z and characters above U+007F. The automaton holds every stretch of words of every item. A
document's words are followed through it, and the longest stretch that ends at a word and occurs in
an item is known at each word. A window of an item is ``window`` words in a row, or the whole item
where it is shorter (the limit by length, and by coverage of the item); the words of each window
that occurs are hit.

Documents are never shuffled for this. Items are cut into segments that overlap by a window less one
word, so each window lies in one segment, and segments are dealt to parts of at most ``PART_WORDS``
words. A part is sent to the workers, which build its automaton once; documents pass each part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walletlens.llm.common import ROW_KEY, growing, numbered, settled_with_key, stored, table, take, union_all
from walletlens.sources.work import settle

WINDOW = 10
# Words of a segment, and of a part: at most 2048 segments.
SEGMENT_WORDS = 256
PART_WORDS = 1 << 19
# A longer word counts by its digest, so that a part has a bounded size.
LONGEST = 64
# Words that are followed at a time.
STRIDE_BYTES = 1 << 20

_SEPARATORS = bytes(value for value in range(128) if not chr(value).isalnum())
# Separators become blanks and A-Z becomes a-z.
_NORMAL = bytes.maketrans(
    _SEPARATORS + bytes(range(ord("A"), ord("Z") + 1)), b" " * len(_SEPARATORS) + bytes(range(ord("a"), ord("z") + 1))
)
_LONG = re.compile(rb"[^ ]{%d}" % (LONGEST + 1))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b"#" + hashlib.md5(word).hexdigest().encode()


def word_strides(text: bytes | None) -> Iterator[list[bytes]]:
    """The normalised words of a text, some at a time."""
    plain = (text or b"").translate(_NORMAL)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + STRIDE_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[start:end].split()
        if _LONG.search(plain, start, end):
            words = [_short(word) for word in words]
        yield words
        start = end


class Automaton:
    """Generalised suffix automaton of word sequences that knows where windows end.

    ``sequences`` are pairs of an item and words; ``window`` words in a row, or all words of a
    shorter sequence, are a window.
    """

    def __init__(self, sequences: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.lengths, self.links = [0], [-1]
        numbered_words = []
        pairs = set()
        for item, words in sequences:
            own = [self.numbers.setdefault(word, len(self.numbers)) for word in words]
            numbered_words.append((item, own))
            pairs.update(zip(own, own[1:]))
            state = 0
            for number in own:
                state = self._extended(state, number)
        self._mark(numbered_words)
        self._know(pairs)

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.lengths.append(length)
        self.links.append(link)
        self.steps.append(steps)
        return len(self.lengths) - 1

    def _split(self, state: int, number: int, target: int) -> int:
        """The state of the words that reach ``target`` from ``state`` and no longer ones."""
        if self.lengths[target] == self.lengths[state] + 1:
            return target
        made = self._state(self.lengths[state] + 1, self.links[target], dict(self.steps[target]))
        self.links[target] = made
        while state >= 0 and self.steps[state].get(number) == target:
            self.steps[state][number] = made
            state = self.links[state]
        return made

    def _extended(self, state: int, number: int) -> int:
        """The state of the words so far and one more."""
        known = self.steps[state].get(number)
        if known is not None:
            return self._split(state, number, known)
        made = self._state(self.lengths[state] + 1, 0, {})
        while state >= 0 and number not in self.steps[state]:
            self.steps[state][number] = made
            state = self.links[state]
        if state >= 0:
            self.links[made] = self._split(state, number, self.steps[state][number])
        return made

    def _holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` of the words that lead to ``state``."""
        while self.lengths[self.links[state]] >= length:
            state = self.links[state]
        return state

    def _mark(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        """Items of each window, at the state of its words, found by following the items themselves."""
        marks: dict[int, dict[int, set]] = {}
        for item, own in sequences:
            width = min(self.window, len(own))
            state = 0
            for place, number in enumerate(own):
                state = self.steps[state][number]
                if place + 1 >= width:
                    at = marks.setdefault(self._holding(state, width), {})
                    at.setdefault(width, set()).add(item)
        self.least = min((length for at in marks.values() for length in at), default=0)
        self.marks = {
            state: sorted(((length, frozenset(items)) for length, items in at.items()), key=lambda mark: -mark[0])
            for state, at in marks.items()
        }
        # The nearest state with a mark on the way to the root, the state itself included.
        self.marked = [-1] * len(self.lengths)
        for state in sorted(range(1, len(self.lengths)), key=self.lengths.__getitem__):
            self.marked[state] = state if state in marks else self.marked[self.links[state]]

    def _know(self, pairs: set[tuple[int, int]]) -> None:
        """A table of hashed pairs of words that follow each other in an item."""
        bits = max(10, (16 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pairs = np.zeros(1 << bits, bool)
        if pairs:
            both = np.array(sorted(pairs), np.int64)
            self.pairs[self._places(both[:, 0], both[:, 1])] = True

    def _places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        code = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift

    def stretches(self, numbers: np.ndarray) -> np.ndarray:
        """Starts and ends of the only stretches in which a window can lie: known pairs in a row."""
        known = numbers >= 0
        if self.least == 1:
            edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
            return edges.reshape(-1, 2)
        follow = known[:-1] & known[1:]
        at = np.flatnonzero(follow)
        follow[at] = self.pairs[self._places(numbers[at], numbers[at + 1])]
        edges = np.flatnonzero(np.diff(follow, prepend=False, append=False)).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= self.least - 1]
        edges[:, 1] += 1
        return edges

    def follow(self, numbers: list[int], before: int, spans: list[list[int]], items: set) -> None:
        """Follows words, the first of which has the number ``before``; adds hit stretches and items."""
        steps, links, lengths, marked = self.steps, self.links, self.lengths, self.marked
        state = length = 0
        for place, number in enumerate(numbers, before + 1):
            step = steps[state].get(number)
            while step is None and state:
                state = links[state]
                length = lengths[state]
                step = steps[state].get(number)
            if step is None:
                continue
            state, length = step, length + 1
            at, longest = marked[state], 0
            while at > 0:
                for width, found in self.marks[at]:
                    if width <= length:
                        longest = max(longest, width)
                        items |= found
                at = marked[links[at]]
            if longest:
                start = place - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, place])

    def matched(self, text: bytes | None) -> tuple[int, list[list[int]], set]:
        """Number of words, hit stretches of words (first, behind the last) and items of a text."""
        count, spans, items, tail = 0, [], set(), np.empty(0, np.int64)
        for words in word_strides(text):
            found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
            before = count - tail.size
            count += found.size
            if not self.least:
                continue
            # A window may begin in the words before.
            found = np.concatenate([tail, found]) if tail.size else found
            for start, end in self.stretches(found).tolist():
                self.follow(found[start:end].tolist(), before + start, spans, items)
            tail = found[max(0, found.size - self.window + 1) :]
        return count, spans, items


def item_segments(benchmark: DataFrame, window: int = WINDOW, text: str = "text", id_column: str = "item_id") -> DataFrame:
    """item (as text), part and words: stretches of items in which each window lies once."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    words = F.regexp_extract_all(
        F.translate(text, upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)
    )
    short = F.transform("words", lambda word: F.when(F.octet_length(word) > LONGEST, F.concat(F.lit("#"), F.md5(word))).otherwise(word))
    step = SEGMENT_WORDS - window + 1
    found = take(benchmark, id_column, text).select(F.col(id_column).cast("string").alias("item"), words.alias("words"))
    cut = found.where(F.size("words") > 0).select(
        "item",
        short.alias("words"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(step))).alias("start"),
    )
    segments = settled_with_key(
        cut.select("item", F.slice("words", F.col("start"), F.lit(SEGMENT_WORDS)).alias("words")), "leak-segments"
    )
    placed = numbered(segments, [], "number")
    return placed.select("item", "words", F.floor(F.col("number") / (PART_WORDS // SEGMENT_WORDS)).alias("part"))


_built: dict[str, Automaton] = {}


def _automaton(name: str, sequences: list[tuple[str | None, list[str]]], window: int) -> Automaton:
    """The automaton of a part; a worker keeps one."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(item, [word.encode() for word in words]) for item, words in sequences], window)
    return _built[name]


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """For each row of a stored table: the id, the row key, n_words, n_hit, spans (array of first word
    and word behind the last, from 0) and item_ids (texts, distinct, sorted).

    Spans of different parts may overlap; a word counts once. Items of one id are one item. Words of an
    item without an id are hit, and it is not listed. Null and empty texts have no words; repeated rows
    give repeated rows; an empty table gives none, an empty benchmark no hit. Further columns do no harm.
    """
    spark = docs.sparkSession
    segments = settle(item_segments(benchmark, window), "leak-parts")
    parts = [row.part for row in segments.select("part").distinct().orderBy("part").collect()] or [0]
    plain = take(docs, id_column, text, key=True)
    kind = plain.schema[id_column].dataType.simpleString()
    texts = plain.select(F.col(id_column).alias("id"), *ROW_KEY, F.col(text).cast("binary").alias("text"))

    def passed(sequences) -> DataFrame:
        name = uuid.uuid4().hex

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sequences.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for value in batch.column(3).to_pylist():
                    count, found, own = automaton.matched(value)
                    counts.append(count)
                    spans.append([{"start": start, "end": end} for start, end in found])
                    items.append([item for item in own if item is not None])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["id", *ROW_KEY, "n_words", "spans", "item_ids"],
                )

        return texts.mapInArrow(
            match,
            f"id {kind}, _file long, _index long, n_words long, spans array<struct<start: long, end: long>>, item_ids array<string>",
        )

    def sent(part):
        rows = segments.where(F.col("part") == part).select("item", "words").toArrow()
        return spark.sparkContext.broadcast(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))

    found = [passed(sent(part)) for part in parts]
    result = found[0]
    if len(found) > 1:
        result = union_all(found).groupBy(*ROW_KEY).agg(
            F.first("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("item_ids")).alias("item_ids"),
        )
    reached = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda done, span: F.struct(
            (done["n"] + F.greatest(F.lit(0).cast("long"), span["end"] - F.greatest(span["start"], done["end"]))).alias("n"),
            F.greatest(done["end"], span["end"]).alias("end"),
        ),
    )
    return result.select(
        F.col("id").alias(id_column),
        *ROW_KEY,
        "n_words",
        reached["n"].alias("n_hit"),
        F.array_sort("spans").alias("spans"),
        F.array_sort(F.array_distinct("item_ids")).alias("item_ids"),
    )


def _without(text: bytes, spans: list[dict]) -> bytes:
    """A text without the words of the spans and what lies between them."""
    places = [(found.start(), found.end()) for found in _WORD.finditer(text)]
    kept, done = [], 0
    for span in spans:
        start, end = places[span["start"]][0], places[span["end"] - 1][1]
        if start > done:
            kept.append(text[done:start])
        done = max(done, end)
    return b"".join([*kept, text[done:]])


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    most_share: float = 0.5,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """The rows without the hit spans of their texts; a row of whose words more than ``most_share`` are
    hit goes as a whole. All columns are kept, and rows without a hit are as they were.
    """
    names = docs.columns
    kept = stored(docs, "leaks")
    found = leaks(kept, benchmark, window, text, id_column).where(F.col("n_hit") <= most_share * F.col("n_words"))
    plain = [f"d{place}" for place in range(len(names))]
    rows = take(kept.toDF(*plain), *plain, key=True).join(growing(found.select(*ROW_KEY, "spans")), ROW_KEY).drop(*ROW_KEY)
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                _without(value.encode(), spans).decode() if spans else value
                for value, spans in zip(batch.column(at).to_pylist(), batch.column(len(plain)).to_pylist())
            ]
            columns = [pa.array(values, pa.string()) if place == at else batch.column(place) for place in range(len(plain))]
            yield pa.RecordBatch.from_arrays(columns, plain)

    return rows.select(*plain, "spans").mapInArrow(cut, rows.select(*plain).schema).toDF(*names)


def op11_suffix_automaton(spark, folder: str) -> DataFrame:
    found = leaks(stored(table(spark, folder, "documents"), "leaks"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CUT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH items AS (SELECT item_id, {_CUT} AS words FROM benchmark),
placed AS (
    SELECT item_id, words, least({WINDOW}, len(words)) AS width,
        unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) AS spot
    FROM items WHERE len(words) > 0
),
windows AS (SELECT DISTINCT item_id, width, array_to_string(list_slice(words, spot, spot + width - 1), ' ') AS passage FROM placed),
docs AS (SELECT doc_id, {_CUT} AS words FROM documents),
widths AS (SELECT DISTINCT width FROM windows),
starts AS (
    SELECT doc_id, width, unnest(range(1, len(words) - width + 2)) AS spot, words
    FROM docs, widths WHERE len(words) >= width
),
hits AS (
    SELECT doc_id, spot, s.width, item_id
    FROM starts s JOIN windows w ON s.width = w.width AND array_to_string(list_slice(words, spot, spot + s.width - 1), ' ') = passage
),
words_hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(spot, spot + width)) AS place FROM hits) GROUP BY doc_id),
items_hit AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items_hit i USING (doc_id)
"""
