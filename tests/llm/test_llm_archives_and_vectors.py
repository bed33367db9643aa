"""Archives with their index, and vector search, against brute force and on odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import math

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from walletlens.llm import archive_files, capture_index, registry, vector_search
from walletlens.sources.work import new_folder, settle


# Archives


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=12), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted((value, at, place) for place, value in enumerate(run)) for at, run in enumerate(runs)]
    merged = [entry for entry, _ in capture_index.LoserTree([iter(run) for run in runs])]
    assert merged == sorted(entry for run in runs for entry in run)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.one_of(st.none(), st.text(max_size=30)), st.text(max_size=8))
def test_records_round_trip(payload, url, page):
    digest = archive_files.base32_digest(payload)
    made = archive_files.response("1-2", url, "20240102030405", page, digest, payload)
    headers, http, read = archive_files.parsed(made)
    assert (read, headers["warc-payload-digest"], http["content-length"]) == (payload, f"sha1:{digest}", str(len(payload)))
    assert headers["x-page-id"] == page.strip() or headers["x-page-id"] == page
    assert headers["warc-date"] == "2024-01-02T03:04:05Z"
    made = archive_files.revisit("1-3", url, "20240102030405", page, digest, len(payload), "1-2", None)
    headers, http, read = archive_files.parsed(made)
    assert (read, headers["warc-refers-to"], http["content-length"]) == (b"", "<urn:uuid:1-2>", str(len(payload)))


def test_url_keys():
    key = archive_files.url_key
    assert key("https://www.Example.org:443/a?b=1#c") == key("http://example.org:80/a?b=1") == "org,example)/a?b=1"
    assert key("http://example.org:8080") == "org,example:8080)/"
    assert key(None) == "" and key("no url") == "no url" and key("http://[bad") == "http://[bad"


ODD_PAGES = [
    (1, "http://a.example/x", "same"),
    (2, "http://b.example/x", "same"),
    (3, "http://a.example/x", None),
    (4, None, ""),
    (None, "http://c.example/", "same"),
    (5, "not a url \n\x07é", "é\U0001f600\r\n\r\nWARC/1.1"),
    (6, "http://a.example/x", "long " * 200_000),
    (7, "http://a.example/x", "other"),
    (7, "http://a.example/x", "other"),
    (-8, "http://a.example/y", "same"),
]


def expected(rows, least=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda row: (row[0] is None, row[0] or 0)):
        first.setdefault(html or "", page)
    seen, made = set(), []
    for page, _, html in sorted(rows, key=lambda row: (row[0] is None, row[0] or 0)):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = len(payload) >= least and payload in seen
        seen.add(payload)
        made.append((page, len(payload), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(made, key=repr)


def shown(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(row) for row in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("least", [0, 3, 5])
def test_odd_pages(spark, least):
    rows = [(*row, "clash") for row in ODD_PAGES]
    df = settle(spark.createDataFrame(rows, "page_id long, url string, html string, payload string"), "pages-test")
    assert shown(capture_index.capture_histories(df, min_bytes=least)) == expected(ODD_PAGES, least)
    assert capture_index.capture_histories(df.limit(0)).collect() == []


def test_pages(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert shown(registry.QUERIES["op4_merged_capture_index"](spark, SMALL)) == expected(rows)


def test_histories_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "RANGE", 50)
    monkeypatch.setattr(capture_index, "ARCHIVE_BYTES", 5_000)
    rows = [(n, f"http://h{n % 7 if n % 3 else 0}.example/{n % 11}", f"page {n // 2} " * 20) for n in range(900)]
    df = settle(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), "pages-test")
    got = capture_index.capture_histories(df).collect()
    order = sorted(got, key=lambda row: (row.history_range, row.history_place))
    keys = [(row.url_key, row.captured) for row in order]
    assert keys == sorted(keys) and len({row.history_range for row in got}) > 5
    sizes = collections.Counter(row.history_range for row in got)
    assert all(sorted(r.history_place for r in got if r.history_range == n) == list(range(size)) for n, size in sizes.items())
    assert sorted(row.page_id for row in got) == list(range(900))
    texts = {row[0]: row[2].encode() for row in rows}
    assert all(row.payload == texts[row.page_id] for row in got if row.record_type == "response")


def test_a_repeated_task_leaves_no_record_twice(spark):
    df = settle(spark.createDataFrame([(n, "u", f"p{n}") for n in range(20)], "page_id long, url string, html string"), "pages-test")
    folder = new_folder(spark, "warc-test")
    capture_index.archived(df, folder).collect()
    runs = settle(capture_index.archived(df, folder), "runs-test")
    index = settle(capture_index.merged(runs), "index-test")
    assert capture_index.captures(index, folder).count() == 20


# Vectors


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def brute(rows, is_query, wanted=5):
    good = {i: v for i, v in rows if usable(i, v)}
    made = {}
    for query in filter(is_query, good):
        near = sorted(((-cosine(good[query], v), i) for i, v in good.items() if i != query))[:wanted]
        made[query] = [(i, -score) for score, i in near]
    return made


def usable(i, v):
    return i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)


def found(df):
    made = collections.defaultdict(list)
    for row in sorted(df.collect(), key=lambda row: (row.query_id, row["rank"])):
        made[row.query_id].append((row.vec_id, row.score))
        assert row["rank"] == len(made[row.query_id])
    return dict(made)


def test_search_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(row.vec_id, list(row.embedding)) for row in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = found(registry.QUERIES["op2_multiprobe_p_stable"](spark, folder))
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(near) == 5 for near in got.values())
    met = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(met) >= 0.9
    vectors = dict(rows)
    assert all(abs(score - cosine(vectors[q], vectors[i])) < 1e-12 for q, near in got.items() for i, score in near)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 1e200]), (50, [1.0, 1.0]),
        (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]),
        (11, [1.0, 2.0, 3.0]), (100, None), (150, [0.0, -1.0]),
    ]
    schema = "vec_id long, embedding array<double>, id string, cell string"
    df = spark.createDataFrame([(*row, "clash", "clash") for row in rows], schema)
    query = F.pmod("id", F.lit(50)) == 0
    got = found(vector_search.nearest(df, query))
    plain = [(i, v) for i, v in rows if i != 11 and i != 4]
    want = brute(plain, lambda i: i % 50 == 0)
    assert set(got) == {0, 50, 150} and all(len(near) == 5 for near in got.values())
    assert [i for i, _ in got[0]][:2] == [1, 2] == [i for i, _ in want[0]][:2]
    assert vector_search.nearest(df.where("vec_id = 50"), query).collect() == []
    assert vector_search.nearest(df.limit(0), query).collect() == []
    few = found(vector_search.nearest(df.where("vec_id in (0, 1, 3)"), query))
    assert [i for i, _ in few[0]] == [1, 3]


def test_hot_cells_are_cut_and_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 64)
    random = np.random.default_rng(3)
    same = random.standard_normal(8).tolist()
    rows = [(n, same if n % 3 == 0 else random.standard_normal(8).tolist()) for n in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(vector_search.nearest(df, F.pmod("id", F.lit(50)) == 0))
    for query, near in got.items():
        if query % 3 == 0:
            others = [n for n in range(0, 1500, 3) if n != query][:5]
            assert [i for i, _ in near] == others


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40))
def test_visits_are_the_likeliest_cells(directions, visits):
    random = np.random.default_rng(directions)
    hashes = vector_search.Hashes(
        random.standard_normal((2, directions, 5)), random.uniform(-1, 1, (2, directions)), 0.5, 0.8, visits
    )
    units = random.standard_normal((3, 5))
    units /= np.linalg.norm(units, axis=1)[:, None]
    cells, scores = hashes.visited(units, visits)
    everything, every_score = hashes.visited(units, vector_search.CELLS_A_DIRECTION**directions)
    assert np.allclose(scores, every_score[..., : scores.shape[2]])
    assert (np.diff(every_score, axis=2) <= 1e-12).all()
