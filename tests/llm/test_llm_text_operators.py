"""Operators on document texts, against brute force and on odd rows."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from walletlens.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules, registry, sharding
from walletlens.llm import substring_dedup, token_counts
from walletlens.llm.common import stored
from walletlens.sources.work import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_file` string, `a.b` int, length string"


def sentence(start: int, count: int) -> str:
    return " ".join(f"w{start}x{place * 31 % 100003}" for place in range(count))


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n\r\x0b\x0c", None, "a"),
    (None, sentence(1, 60), "en", "b"),
    (None, None, None, None),
    (4, sentence(2, 60), "en", "a"),
    (4, sentence(2, 60), "en", "a"),
    (5, sentence(2, 60), "en", "c"),
    (6, "one two", "en", "a"),
    (7, "ONE two", "en", "a"),
    (8, sentence(3, 30_000), "en", "b"),
    (9, " x y\x85z " + "\U0001f600 é" * 40, "fr", "b"),
    (10, "same same same\n" * 40, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*row, len(row[1] or ""), "clash", 1, "clash") for row in ODD]
    return settle(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return settle(spark.createDataFrame([], SCHEMA), "empty")


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(row) for row in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]


def library():
    return token_counts.word_tokens(token_counts.vocabulary_path()).library


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


# Token counts


SCRIPTS = "aZ 09'\n\t\u00e9\u0153\u2019\u2014\u0416\u0438\u05d0\u0639\u4e2d\u6587\u3042\u30ab\uac00\u0e01\u0915\u094d\U0001f600\u0301\u0323\u0130\u03a3\u03c3\u1e9e\u00a0\u2003\u3000\u0085\x0b\x0c\x1c\u200b\ufb01\u1100\u1161<|>"


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=SCRIPTS, max_size=60) | st.text(max_size=40), st.sampled_from(["", "<|endoftext|>", " <|startoftext|> ", "\u0301"]))
def test_words_of_any_script_are_the_librarys(text, between):
    text = f"{text}{between}{text[::-1]}"
    ids = np.frombuffer(token_counts.word_tokens(token_counts.vocabulary_path()).ids(text), "<u4")
    assert ids.tolist() == library_ids(text)


def test_odd_words_alone_go_to_the_library(monkeypatch):
    tokens = token_counts.WordTokens(token_counts.vocabulary_path())
    asked = []
    library = tokens.library

    class Noted:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return library.encode_batch_fast(words, **more)

    tokens.library = Noted()
    text = "it\u2019s a plain text with one \u0153uvre and it\u2019s plain again <|endoftext|>"
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library_ids(text)
    assert sorted(asked) == sorted(["it\u2019s", "\u0153uvre", "<|endoftext|>"])
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    for part in (text, "\u4e2d \u6587 \u3042", text):
        assert np.frombuffer(tokens.ids(part), "<u4").tolist() == library_ids(part)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXYZ 'éß×÷ÿ\n\t12!?|<>&;sdtmrvlÀµİ\x0b\x85中é ", max_size=40), st.booleans())
def test_ids_are_the_librarys(text, special):
    text = f"{text}<|endoftext|>{text}" if special else text
    ids = np.frombuffer(token_counts.word_tokens(token_counts.vocabulary_path()).ids(text), "<u4")
    assert ids.tolist() == library_ids(text)


def test_whole_tokens_are_one_token():
    proven = token_counts.word_tokens(token_counts.vocabulary_path()).whole
    assert len(proven) > 30_000
    for text, ids in list(proven.items())[::500]:
        assert library_ids(text) == [int.from_bytes(ids, "little")]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 40_000)
    tokens = token_counts.WordTokens(token_counts.vocabulary_path())
    for number in range(12_000):
        tokens.ids(f"zq{number}xv")
    assert len(tokens) <= 40_001 and np.frombuffer(tokens.ids("zq1xv"), "<u4").tolist() == library_ids("zq1xv")


def test_token_counts(spark, odd, empty, small):
    got = {row.doc_id: row for row in registry.QUERIES["op9_whole_token_shortcut"](spark, SMALL).collect()}
    for doc_id, text, _ in small:
        n = len(library_ids(text))
        assert got[doc_id][1:] == (len(text.encode()), n, n > 2048)
    counted = token_counts.token_counts(odd).collect()
    assert sorted(map(repr, [row.n_tokens for row in counted])) == sorted(repr(len(library_ids(row[1]))) for row in ODD)
    assert token_counts.token_counts(empty).collect() == []


# Packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_holds_every_piece_once(lengths):
    counts = collections.Counter(lengths)
    steps = packing.plan_bins(counts, 64)
    packed = collections.Counter()
    for times, bin_ in steps:
        assert times > 0 and sum(bin_) <= 64
        for length in bin_:
            packed[length] += times
    assert packed == counts
    # No worse than first-fit decreasing, by its bound.
    bins = sum(times for times, _ in steps)
    assert bins <= math.ceil(11 / 9 * max(1, -(-sum(lengths) // 64)) + 6 / 9) + len(lengths) // 8 + 1


def test_two_replace_the_smallest():
    # Greedy fills 10 with 6 and 3; 2 and 2 fill the gap of 4 that 3 leaves.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]


def packed_rows(df):
    return [row.asDict() for row in df.collect()]


def check_sequences(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing(spark, odd, empty, small):
    rows = packed_rows(registry.QUERIES["op1_best_two_fit"](spark, SMALL))
    check_sequences(rows)
    by = collections.defaultdict(list)
    for row in rows:
        by[row["doc_id"]].append(row)
    for doc_id, text, _ in small:
        ids = [*library_ids(text), 0]
        own = sorted(by.pop(doc_id), key=lambda row: row["piece"])
        assert [row["start"] for row in own] == list(range(0, len(ids), 2048))
        for place, row in enumerate(own):
            part = np.array(ids[place * 2048 : (place + 1) * 2048], "<u4")
            assert (row["piece"], row["length"], row["ids_crc32"]) == (place, len(part), zlib.crc32(part.tobytes()))
    assert not by
    assert len({row["sequence_id"] for row in rows}) <= -(-sum(row["length"] for row in rows) // 2048) + 1
    cut_up = packing.pieces(odd)
    rows = packed_rows(packing.pack(cut_up.withColumn("offset", F.lit("clash")).drop("ids")))
    check_sequences(rows)
    assert sum(row["length"] for row in rows) == sum(len(library_ids(row[1])) + 1 for row in ODD)
    assert packing.pack(packing.pieces(empty)).collect() == []


def test_packing_refuses_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 4096)], "doc_id long, length long"))


# Quality rules


def rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {at + step for at, window in enumerate(windows) if often[window] > 1 for step in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_quality(spark, odd, empty, small):
    got = {row.doc_id: row for row in registry.QUERIES["op7_hashed_ngram_quality"](spark, SMALL).collect()}
    for doc_id, text, _ in small:
        row, counts = got[doc_id], rules(text)
        assert tuple(row[name] for name in quality_rules.COUNTS) == counts
        assert row.base_failed == base_failed(counts) and not (row.base_failed and row.kept)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(odd, labels) is None
    found = collections.Counter((row.doc_id, *row[1:7], row.kept) for row in quality_rules.scored(odd, None).collect())
    assert found == collections.Counter((i, *rules(t), None, not base_failed(rules(t))) for i, t, _, _ in ODD)
    assert quality_rules.scored(empty, None).collect() == []


def test_quality_learns(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0").dropna()
    model = quality_rules.fit(docs, train, rows=1500)
    rows = quality_rules.scored(docs.join(held, "doc_id"), model, carry=("doc_id", "quality")).collect()
    # Short and repeated texts are for the base rules; the others are for the classifier.
    judged = [row for row in rows if not row.base_failed]
    assert len(judged) > 1000
    assert sum(row.kept == bool(row.quality) for row in judged) >= 0.99 * len(judged)
    good = [row for row in judged if row.quality]
    assert sum(row.kept for row in good) >= 0.995 * len(good)
    # Calibrated: the mean probability is near the share of good rows.
    assert abs(np.mean([row.probability for row in judged]) - np.mean([row.quality for row in judged])) < 0.05


def test_null_labels_are_no_examples(spark, odd):
    labels = spark.createDataFrame([(4, None), (None, 1), (8, 7), (4, 1)], "doc_id long, quality int")
    assert quality_rules.fit(odd, labels) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_repeated_words(numbers):
    text = " ".join(map(str, numbers))
    assert quality_rules.repeated_words(np.array(numbers, np.int64)) == rules(text)[4]


# Sharding


def slots_are_gapless(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row.shard].append(row.slot)
    return all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_sharding(spark, odd, empty, small):
    rows = registry.QUERIES["op3_bounded_ring"](spark, SMALL).collect()
    assert slots_are_gapless(rows)
    sizes = collections.Counter(row.shard for row in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    texts = {doc_id: (text or "").encode() for doc_id, text, _ in small}
    assert all((row["size"], row.text_crc32) == (len(texts[row.doc_id]) + 1, zlib.crc32(texts[row.doc_id])) for row in rows)
    assert len(rows) == len(small) and {row.law for row in rows} == {"rows"}
    rows = sharding.assigned(odd.drop("text"), ["doc_id"], 3).collect()
    assert slots_are_gapless(rows) and len(rows) == len(ODD)
    assert sharding.assigned(empty, ["doc_id"]).collect() == []


def test_a_hot_key_is_split_and_little_moves(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("row"))
    eight = {row.row: row.shard for row in sharding.assigned(rows, ["doc_id"], 8, slack=0.2).collect()}
    nine = {row.row: row.shard for row in sharding.assigned(rows, ["doc_id"], 9, slack=0.2).collect()}
    assert max(collections.Counter(eight.values()).values()) <= math.ceil(6000 * 1.2 / 8)
    assert max(collections.Counter(nine.values()).values()) <= math.ceil(6000 * 1.2 / 9)
    assert sum(eight[row] != nine[row] for row in eight) < 0.5 * len(eight)


# Line dedup


def removed_lines(rows, least):
    sites, first = collections.defaultdict(set), {}
    order = sorted(range(len(rows)), key=lambda at: (rows[at][0] is None, rows[at][0] or 0, at))
    for at in order:
        for place, line in enumerate((rows[at][1] or "").split("\n")):
            if WORD.search(line):
                if rows[at][2] is not None:
                    sites[line].add(rows[at][2])
                first.setdefault(line, (at, place))
    made = []
    for at, (doc_id, text, site) in enumerate(rows):
        if text is None:
            made.append((doc_id, None))
            continue
        kept = [
            line for place, line in enumerate(text.split("\n"))
            if len(sites.get(line, ())) < least or first[line] == (at, place)
        ]
        if len(kept) == len(text.split("\n")):
            made.append((doc_id, text))
        elif any(map(WORD.search, kept)):
            made.append((doc_id, "\n".join(kept)))
    return sorted(made, key=repr)


@pytest.mark.parametrize("least", [2, 3, 10])
def test_lines(spark, least):
    rows = [(n, "\n".join([f"own {n}", "wide", f"group {n % 5}", " ", f"site {n % 3}"]), f"s{n % 12}") for n in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (None, "wide", "s3"), (102, "wide\nwide\nlast", None), (103, "wide", "s4")]
    df = settle(spark.createDataFrame(rows, "doc_id long, text string, source string"), "lines-test")
    got = line_dedup.without_spread_lines(df, least).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == removed_lines(rows, least)


def test_lines_of_odd_rows(odd, empty):
    rest = line_dedup.without_spread_lines(odd, 2)
    assert rest.columns == odd.columns
    # Rows 4 and 5 are one line on two sites: only the first row keeps it.
    assert sorted(map(repr, [row.doc_id for row in rest.collect()])) == sorted(map(repr, [1, 2, 3, None, None, 4, 6, 7, 8, 9, 10]))
    assert line_dedup.without_spread_lines(empty).collect() == []


# Near duplicates


def word_sets(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[at : at + size]) for at in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows):
    sets = [word_sets(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for one in range(len(rows)):
        for other in range(one):
            a, b = sets[one], sets[other]
            common = len(a & b)
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                parent[root(one)] = root(other)
    groups = collections.defaultdict(list)
    for at in range(len(rows)):
        groups[root(at)].append(rows[at][0])
    least = {at: min((i for i in ids if i is not None), default=None) for at, ids in groups.items()}
    return sorted(((rows[at][0], len(sets[at]), least[root(at)]) for at in range(len(rows))), key=repr)


def found_components(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_near_duplicates(spark, small):
    got = registry.QUERIES["op6_tensored_minhash"](spark, SMALL)
    assert found_components(got) == brute_components([row[:2] for row in small])
    assert all(row.kept == (row.doc_id == row.component_id) for row in got.collect())


def test_near_duplicates_of_odd_rows(odd, empty):
    assert found_components(minhash_dedup.near_duplicates(odd)) == brute_components([row[:2] for row in ODD])
    kept = minhash_dedup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, [row.doc_id for row in kept.collect()])) == sorted(map(repr, [1, 2, 3, None, None, 4, 6, 8, 9, 10]))
    assert minhash_dedup.near_duplicates(empty).collect() == []


def test_groups_of_edited_copies(spark):
    random = np.random.default_rng(4)
    rows = []
    for group in range(12):
        base = sentence(group + 50, 120).split()
        for copy in range(25):
            words = list(base)
            for at in random.integers(0, len(words), int(random.integers(0, 5))):
                words[at] = f"edit{random.integers(10**9)}"
            rows.append((1000 * group + copy, " ".join(words)))
    df = settle(spark.createDataFrame(rows, "doc_id long, text string"), "near-test")
    assert found_components(minhash_dedup.near_duplicates(df)) == brute_components(rows)


def test_true_partners_among_near_misses(spark):
    """In a family of 169 texts two differ in 25 or 26 places and are near misses, at 0.749 at most; ten pairs have
    one more word in common and are similar enough, at 0.758."""
    rows = []
    for family in range(2):
        base = sentence(700 + family, 874).split()
        for slope in range(13):
            for start in range(13):
                words = list(base)
                for turn in range(13):
                    # A changed word changes five shingles, and no two places share one.
                    words[4 + 5 * (13 * turn + (start + slope * turn) % 13)] = f"edit{slope}x{start}x{turn}"
                if slope == 1 and start < 10:
                    words[4 + 5 * start] = f"edit0x{start}x0"
                rows.append((1000 * family + 13 * slope + start, " ".join(words)))
    df = settle(spark.createDataFrame(rows, "doc_id long, text string"), "crowd-test")
    want = brute_components(rows)
    assert sum(doc_id != component for doc_id, _, component in want) == 20
    assert found_components(minhash_dedup.near_duplicates(df)) == want


def test_crowds_grow_in_proportion(spark, monkeypatch):
    """Of near misses, twice the texts give at most about twice the rows in every table that is written."""
    random, counts = np.random.default_rng(9), []
    base = sentence(900, 400).split()
    rows = []
    for number in range(400):
        words = list(base)
        for at in random.choice(len(words), 16, replace=False):
            words[at] = f"edit{number}x{at}"
        rows.append((number, " ".join(words)))
    monkeypatch.setattr(minhash_dedup, "FEW", 64)
    monkeypatch.setattr(minhash_dedup, "settle", lambda df, label: noted(settle(df, label), label))

    def noted(table, label):
        sums[label] += table.count()
        return table

    for size in (200, 400):
        sums = collections.Counter()
        df = settle(spark.createDataFrame(rows[:size], "doc_id long, text string"), "family")
        got = found_components(minhash_dedup.near_duplicates(df))
        assert got == brute_components(rows[:size])
        counts.append(sums)
    assert counts[1]["near-members"] == 400
    # What a text has of a table at most once is below its limit for so few texts, and still fills up.
    most = minhash_dedup.HALVES**2 * 400
    assert counts[1].pop("near-pairs") <= minhash_dedup.NEIGHBOURS * most and counts[1].pop("near-edges") <= most
    for label, n in counts[1].items():
        assert n <= 2.2 * counts[0][label] + 100, label


# Passages


def test_passages(spark, small):
    least = 50
    got = registry.QUERIES["op5_gear_chunk_passages"](spark, SMALL).collect()
    texts = {doc_id: text.encode() for doc_id, text, _ in small}
    for row in got:
        part = texts[row.doc_id][row.start : row.start + row.length]
        assert part == texts[row.first_id][row.first_start : row.first_start + row.length]
        assert row.first_id < row.doc_id and row.n_words >= least
    seen, repeats = set(), set()
    for doc_id in sorted(texts):
        spans = [match.span() for match in re.finditer(rb"[^\x20\x09-\x0d]+", texts[doc_id])]
        own = {texts[doc_id][spans[at][0] : spans[at + least - 1][1]] for at in range(len(spans) - least + 1)}
        if own & seen:
            repeats.add(doc_id)
        seen |= own
    assert {row.doc_id for row in got} == repeats


def test_passages_resist_shifts(spark):
    passage = sentence(9, 80)
    rows = [(n, f"{sentence(100 + n, 40 + 7 * n)} {passage} {sentence(300 + n, 30)}") for n in range(20)]
    rows += [(50, sentence(500, 200)), (51, None), (52, ""), (None, passage)]
    df = settle(spark.createDataFrame(rows, "doc_id long, text string"), "passages-test")
    got = substring_dedup.repeated_passages(df).collect()
    assert sorted({row.doc_id for row in got}, key=repr) == sorted([*range(1, 20), None], key=repr)
    assert all(row.n_words >= 80 for row in got)


def test_passages_of_short_words_and_edited_copies(spark):
    random = np.random.default_rng(3)
    rows, want = [], []
    for number in range(40):
        # One-letter words, a word group of period 3, and a text of which the first copy is edited in the middle.
        letters = " ".join(map(chr, random.integers(97, 123, 50)))
        period = " ".join(f"{chr(97 + number % 26)}{number} b{number} c{number}".split() * 17)
        whole = sentence(4000 + number, 60).split()
        edited = [*whole[:30], f"edit{number}", *whole[31:]]
        for kind, texts in enumerate([[letters] * 2, [period] * 2, [" ".join(edited), *[" ".join(whole)] * 2]]):
            for copy, part in enumerate(texts):
                doc_id = 1000 * number + 10 * kind + copy
                rows.append((doc_id, f"{sentence(doc_id, 20)} {part} {sentence(doc_id + 500000, 20)}"))
            want.append((doc_id, doc_id - 1))
    df = settle(spark.createDataFrame(rows, "doc_id long, text string"), "short-test")
    got = substring_dedup.repeated_passages(df).collect()
    assert sorted({(row.doc_id, row.first_id) for row in got}) == sorted(want)


def test_passages_of_odd_rows(odd, empty):
    got = substring_dedup.repeated_passages(odd).collect()
    assert sorted(((row.doc_id, row.first_id) for row in got), key=repr) == [(4, 4), (5, 4)]
    assert substring_dedup.repeated_passages(empty).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(min_size=40, max_size=400))
def test_cuts_depend_on_the_last_bytes_only(one, other, tail):
    a = {end - len(one) for end in substring_dedup.cuts(one + tail).tolist()}
    b = {end - len(other) for end in substring_dedup.cuts(other + tail).tolist()}
    inside = range(substring_dedup.WINDOW + 2, len(tail))
    assert a & set(inside) == b & set(inside)


# Mixing


def test_mixing(spark, odd, empty):
    rows = [(n, "w " * (9 + n % 3), "big") for n in range(900)] + [(2000 + n, "w " * 9, f"s{n % 4}") for n in range(100)]
    df = settle(spark.createDataFrame(rows, "doc_id long, text string, source string"), "mix-test")
    for entropy, repeats in ((0.9, None), (None, None), (1.0, 4.0), (0.95, 2.0)):
        made = mixing.mix(df, entropy=entropy, repeats=repeats).collect()
        total = sum(len(text.split()) + 1 for _, text, _ in rows)
        tokens, weights = collections.Counter(), {}
        for row in made:
            tokens[row.source] += row.n_tokens
            weights[row.source] = row.weight
        assert sum(weights.values()) == pytest.approx(1)
        height = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
        own = collections.Counter()
        for _, text, source in rows:
            own[source] += len(text.split()) + 1
        most = max(weights[s] * total / own[s] for s in own)
        if repeats:
            assert most <= repeats + 1e-6
        if entropy and not (repeats and most > repeats - 1e-3):
            assert height >= entropy - 1e-6
        for source, weight in weights.items():
            assert weight * total - 12 <= tokens[source] <= weight * total + 1
        # Every epoch but the last takes each row once.
        times = collections.Counter(row.doc_id for row in made)
        for source in own:
            counts = {times[doc_id] for doc_id, _, s in rows if s == source}
            assert max(counts) - min(counts) <= 1
    assert mixing.mix(df, entropy=None, repeats=None).count() == len(rows)
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_rows(odd, entropy=None, repeats=None).count() == len(ODD)


def test_mixing_follows_the_seed(spark, odd):
    def order(seed):
        return [r.doc_id for r in mixing.mix(odd, seed=seed).orderBy("epoch", "block_turn", "row_turn").collect()]

    assert order(1) == order(1) and order(1) != order(2)


def test_frames_that_are_no_files(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert stored(df, "plain").columns == df.columns
    assert line_dedup.without_spread_lines(df).collect() == df.collect()
