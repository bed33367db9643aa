"""Benchmark leaks, periodic runs and spelling variants, against brute force and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from walletlens.llm import leak_automaton, periodic_runs, spelling_variants
from walletlens.sources.work import settle

SCHEMA = "doc_id long, text string, n_words long, runs string, `_file` string, `a.b` int, word string, n string"
ITEMS = "item_id long, text string, item string, part long, words string"
LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda letter: letter[0].lower(), text)


def table_of(spark, rows, schema=SCHEMA, label="fixture"):
    width = schema.count(",") + 1
    return settle(spark.createDataFrame([(*row, *[None] * (width - len(row))) for row in rows], schema), label)


# Leaks


def brute_leaks(text, items, window):
    words = LEAK_WORD.findall(lower(text or ""))
    hit, own = set(), set()
    for item, passage in items:
        parts = LEAK_WORD.findall(lower(passage or ""))
        width = min(window, len(parts))
        for start in range(len(parts) - width + 1) if parts else []:
            for at in range(len(words) - width + 1):
                if words[at : at + width] == parts[start : start + width]:
                    hit.update(range(at, at + width))
                    own.add(item)
    return len(words), hit, own - {None}


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_automaton_is_brute_force(rnd):
    letters = ["a", "B", "b", "é", "É", "9", "z" * 70]

    def text(most):
        return "".join(rnd.choice(letters) + rnd.choice([" ", "-", "\n", ".. "]) for _ in range(rnd.randrange(most)))

    items = [(number, text(9)) for number in range(rnd.randrange(1, 5))]
    window = rnd.choice([1, 2, 3, 5])
    built = leak_automaton.Automaton(
        [(item, [word for words in leak_automaton.word_strides(passage.encode()) for word in words]) for item, passage in items], window
    )
    for _ in range(4):
        doc = text(60)
        count, spans, found = built.matched(doc.encode())
        assert (count, {place for start, end in spans for place in range(start, end)}, found) == brute_leaks(doc, items, window)
        assert all(first[1] < second[0] for first, second in zip(spans, spans[1:]))


def test_words_are_followed_over_strides(monkeypatch):
    monkeypatch.setattr(leak_automaton, "STRIDE_BYTES", 7)
    built = leak_automaton.Automaton([(1, [b"a", b"b", b"c", b"d"]), (2, [b"x", b"y"])], 3)
    text = "q a b c r x y a b c d " * 5
    count, spans, found = built.matched(text.encode())
    expected = brute_leaks(text, [(1, "a b c d"), (2, "x y")], 3)
    assert (count, {place for start, end in spans for place in range(start, end)}, found) == expected


def odd_texts():
    rnd = random.Random(3)
    passage = " ".join(f"t{number}" for number in range(14))
    return [
        (1, None), (2, ""), (3, " \t ,.- "), (None, passage), (None, None), (4, passage.upper() + " tail"), (4, passage.upper() + " tail"),
        (5, "Short Item"), (6, "short x item"), (7, " ".join(rnd.choice("abc") for _ in range(40_000)) + " " + passage),
        (8, "w " * 30_000), (9, "one two, three Four! one two. three four " * 9), (10, passage[:20]),
    ]


ODD_ITEMS = [
    (1, " ".join(f"t{number}" for number in range(12))), (2, "short item"), (2, "one two three four"), (3, None), (4, "  "),
    (None, "w w w w w w w w w w w"), (11, " ".join(f"t{number}" for number in range(13, -1, -1))),
]


@pytest.mark.parametrize("part_words", [leak_automaton.PART_WORDS, 16])
def test_leaks_of_odd_rows(spark, monkeypatch, part_words):
    monkeypatch.setattr(leak_automaton, "SEGMENT_WORDS", 11)
    monkeypatch.setattr(leak_automaton, "PART_WORDS", part_words)
    docs, items = table_of(spark, odd_texts()), table_of(spark, ODD_ITEMS, ITEMS)
    found = leak_automaton.leaks(docs, items).collect()
    got = Counter((row.doc_id, row.n_words, row.n_hit, tuple(row.item_ids)) for row in found)
    expected = Counter()
    for key, text in odd_texts():
        count, hit, own = brute_leaks(text, ODD_ITEMS, 10)
        expected[key, count, len(hit), tuple(sorted(map(str, own)))] += 1
    assert got == expected
    none = spark.createDataFrame([], SCHEMA)
    assert leak_automaton.leaks(settle(none, "none"), items).count() == 0
    clean = leak_automaton.leaks(docs, spark.createDataFrame([], ITEMS))
    assert clean.where("n_hit > 0").count() == 0 and clean.count() == len(odd_texts())


def test_leaks_are_cut_out(spark):
    passage = " ".join(f"t{number}" for number in range(12))
    rest = " ".join(f"u{number}" for number in range(30))
    docs = table_of(spark, [(1, f"{rest}, é {passage}! {rest}"), (2, passage), (3, rest), (4, None), (5, "T0 " + rest)])
    rows = leak_automaton.decontaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert rows.columns == docs.columns
    assert {row.doc_id: row.text for row in rows.collect()} == {1: f"{rest}, é ! {rest}", 3: rest, 4: None, 5: "T0 " + rest}


# Runs


def brute_runs(words, least_words=6, least_periods=4):
    found = []
    for lag in range(1, len(words) // least_periods + 1):
        at = lag
        while at < len(words):
            end = at
            while end < len(words) and words[end] == words[end - lag]:
                end += 1
            start, length = at - lag, end - at + lag
            if end > at and length >= max(least_words, least_periods * lag):
                part = words[start : start + length]
                if not any(part[period:] == part[:-period] for period in range(1, lag)):
                    found.append((start, length, lag))
            at = max(end, at + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


@settings(max_examples=400, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([(6, 4), (3, 3), (9, 5)]))
def test_runs_are_brute_force(rnd, limits):
    words = []
    for _ in range(rnd.randrange(6)):
        block = [bytes([97 + rnd.randrange(rnd.choice([2, 3, 9]))]) for _ in range(rnd.randrange(1, 12))]
        words += block * rnd.randrange(1, 9)
        if rnd.random() < 0.3:
            words = words * rnd.randrange(1, 6)
    words = words[:400]
    assert periodic_runs.runs_of(words, *limits) == brute_runs(words, *limits)


def test_one_word_over_and_over_is_no_square():
    assert periodic_runs.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert periodic_runs.runs_of([b"a", b"b", b"c"] * 60_000) == [(0, 180_000, 3)]


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.runs_of([b"a"] * 9, 4, 2)


def test_runs_of_odd_rows(spark):
    docs = table_of(spark, odd_texts())
    got = Counter()
    for row in periodic_runs.periodic_runs(docs).collect():
        got[row.doc_id, row.n_words, tuple(tuple(run) for run in row.runs), row.collapsed] += 1
    expected = Counter()
    for key, text in odd_texts():
        words = (text or "").split()
        runs = brute_runs(words) if len(words) < 5000 else periodic_runs.runs_of([word.encode() for word in words])
        dropped = {place for start, length, period in runs for place in range(start + period, start + length)}
        expected[key, len(words), tuple(runs), " ".join(word for place, word in enumerate(words) if place not in dropped)] += 1
    assert got == expected
    assert (8, 30_000, ((0, 30_000, 1),), "w") in got
    assert periodic_runs.periodic_runs(settle(spark.createDataFrame([], SCHEMA), "none")).count() == 0


# Spelling variants


def brute_variants(counts, times=10):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:place] + b[place + 1 :] == a for place in range(len(b)))

    found = {}
    for word, n in counts.items():
        others = [other for other in counts if other != word and near(word, other)]
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        found[word] = (best if best is not None and counts[best] >= times * n else None, n, len(others))
    rows = set()
    for word, (form, n, n_near) in found.items():
        root = word
        while found[root][0] is not None:
            root = found[root][0]
        rows.add((word, form, root, n, n_near, counts.get(form)))
    return rows


def vocabulary(rnd, size):
    words = {}
    while len(words) < size:
        word = "".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 9)))
        words[word] = rnd.choice([1, 2, 3, 20, 30, 300, 300, 4000])
    return words


@pytest.mark.parametrize("shard_words, shards", [(1 << 19, 32), (7, 2)])
def test_variants_are_brute_force(spark, monkeypatch, shard_words, shards):
    monkeypatch.setattr(spelling_variants, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling_variants, "SHARDS", shards)
    rnd = random.Random(5)
    counts = vocabulary(rnd, 120)
    counts |= {"a" * 70: 5, "a" * 71: 50, "a" * 70 + "ÿ": 6, "z" * 200 + "b": 9, "z" * 201: 90, "A×÷ÞÀ": 1}
    made = settle(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    got = [tuple(row) for row in spelling_variants.spelling_variants(made).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(counts)
    assert any(root != form for _, form, root, *_ in got if form is not None)


def test_variants_of_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "short 123"), (None, "Wonderful wonderfull"), (None, None), (4, "WONDERFUL_wonderful-wonderful"),
        (4, "WONDERFUL_wonderful-wonderful"), (5, "wonderful " * 30), (6, "Éwonderful éwonderful x" * 2), (7, "wonderfull wonderf中ul"),
        (8, "b" * 30_000 + " " + "b" * 30_001 + " " + "b" * 30_000), (9, "wonderful7wonderful"),
    ]
    counts = Counter()
    for _, text in rows:
        counts.update(word for word in re.findall("[a-zÀ-ÿ]+", lower(text or "")) if len(word) >= 7)
    expected = brute_variants({word: n for word, n in counts.items() if n >= 2})
    found = spelling_variants.corpus_variants(table_of(spark, rows))
    assert {tuple(row) for row in found.collect()} == expected and found.count() == len(expected)
    assert spelling_variants.corpus_variants(settle(spark.createDataFrame([], SCHEMA), "none")).count() == 0
