"""Operator 9: token counts with a shortcut for words that are whole tokens.

The tokenizer cuts a text at white space, cuts what lies between into pre-tokens and merges
pairs inside each pre-token, so the tokens of a text are the tokens of its white-space words in
a row. ``whole_tokens`` proves, once for each vocabulary string, that the string alone encodes as
exactly one token. A pre-token in that table costs one look-up; only the rest is merged.

Two forms of words go to the library: one with a character outside the set for which lower-casing and
normalization are known to act on single characters, and one with ``<|``, which may hold a special
string. Normalization, pre-tokens and special strings never go over a blank, a tab or a line end, so
words stand for themselves whatever is around them, and all others of a text keep the shortcut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from walletlens.llm.common import table, take

# Longest run of ids that a document may have in one sequence.
DEFAULT_LIMIT = 2048

# Remembered words of a worker; the memory is emptied when it is full.
REMEMBERED = 500_000

# Characters that normalization maps one by one: tab to line end, printable ASCII, and the
# letters and two signs from U+00C0 to U+00FF. All are below U+0300, hence already composed.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿ]*")

# What words are cut at where a text holds other characters.
BLANKS = re.compile("[\t\n\r ]+")

# The pre-token pattern of the vocabulary file, on lower-case plain text without white space.
PRE_TOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"
)

PACKED = 4  # bytes of an id, little-endian


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return b"".join(value.to_bytes(PACKED, "little") for value in ids)


class WordTokens(dict):
    """Packed ids of a lower-case white-space word, made on first use.

    It starts with the proven whole tokens. Other words are cut into pre-tokens, and those that
    are no whole token are merged by the library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.merge = self.library.model.tokenize
        self.letters = str.maketrans({chr(value): letter for letter, value in _byte_letters().items()})
        self.whole = whole_tokens(self.library)
        self.update(self.whole)
        self.remembered: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(self.whole)
        parts = PRE_TOKEN.findall(word)
        if len(parts) == 1:
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = packed([token.id for token in self.merge(letters)])
        else:
            ids = b"".join([self[part] for part in parts])
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Packed ids of a text; a null text has none."""
        if not text:
            return b""
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        words = [word for word in BLANKS.split(text) if word]
        odd = self._odd({word for word in words if "<|" in word or PLAIN.fullmatch(word) is None})
        return b"".join([odd[word] if word in odd else self[word.lower()] for word in words])

    def _odd(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words by the library, the new ones at once."""
        known = {word: self.remembered[word] for word in words if word in self.remembered}
        new = [word for word in words if word not in known]
        for word, encoded in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            known[word] = packed(encoded.ids)
        if len(self.remembered) + len(new) >= REMEMBERED:
            self.remembered.clear()
        self.remembered.update(known)
        return known


def whole_tokens(library: Tokenizer) -> dict[str, bytes]:
    """Vocabulary strings that alone are one pre-token and encode as one token, with that id."""
    marker = "</w>"
    readable = _byte_letters()
    proven = {}
    candidates = []
    for letters in library.get_vocab(with_added_tokens=False):
        if not letters.endswith(marker):
            continue
        try:
            text = bytes(readable[letter] for letter in letters[: -len(marker)]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if PLAIN.fullmatch(text) and text == text.lower() and PRE_TOKEN.fullmatch(text):
            candidates.append(text)
    for text, encoded in zip(candidates, library.encode_batch_fast(candidates, add_special_tokens=False)):
        if len(encoded.ids) == 1 and PRE_TOKEN.findall(text) == [text]:
            proven[text] = packed(encoded.ids)
    return proven


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: a printable
    byte stands for itself, the n-th other byte is the letter 256 + n."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [value for value in range(256) if value not in set(kept)]
    letters = {chr(value): value for value in kept}
    letters.update({chr(256 + place): value for place, value in enumerate(others)})
    return letters


@cache
def word_tokens(path: str) -> WordTokens:
    """One table for each worker process."""
    return WordTokens(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Tokens of each whole text, one row for each row.

    ``vocabulary`` is the path of the vocabulary file on every worker. Columns: the id, n_bytes
    (UTF-8), n_tokens. Null and empty texts have 0 of both. Repeated rows give repeated rows, an
    empty table gives none, a null id stays null.
    """
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            counts = [len(tokens.ids(value)) // PACKED for value in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    plain = take(docs, id_column, text)
    kind = plain.schema[id_column].dataType.simpleString()
    sized = plain.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes"),
        F.col(text).alias("text"),
    )
    counted = sized.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_column)


def over_limit(counted: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_whole_token_shortcut(spark, folder: str) -> DataFrame:
    return over_limit(token_counts(table(spark, folder, "documents")))
