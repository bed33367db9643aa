"""Sketched quantiles, dated intervals and sinks that are published together."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, found, text_rows, typed_rows, utc
from test_follow import rows_of, stream_of
from test_plans import final_plan, plan
from walletlens.operators import detectors, intervals, sketches, validation
from walletlens.operators.quantiles import exact_quantiles
from walletlens.sources import files
from walletlens.sources.event_log import load_transactions
from walletlens.sources.publish import Publication, publish_routes, published_routes
from walletlens.sources.work import new_folder, settle


@pytest.fixture(scope="module")
def log(spark):
    return settle(load_transactions(spark, SMALL), "tables-log")


# Sketches


def test_error_of_a_sketch(spark):
    values = spark.range(200_000).select(
        (F.col("id") % 3).alias("kind"), F.timestamp_seconds(F.col("id") * 40).alias("timestamp"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("amount"),
    )
    stored = settle(sketches.day_sketches(values, ["kind"], "amount"), "sketches")
    assert stored.agg(F.max(F.octet_length("sketch"))).first()[0] < 12_000
    wanted = {f"p{part}": part / 100 for part in (1, 10, 50, 90, 99)}
    rows = sketches.quantiles_of(stored, ["kind"], wanted).collect()
    assert sum(row.n for row in rows) == 200_000 and len(rows) == 3
    for row in rows:
        own = values.filter(F.col("kind") == row.kind)
        below = own.agg(*[F.count_if(F.col("amount") <= row[name]).alias(name) for name in wanted]).first()
        for name, part in wanted.items():
            assert abs(below[name] / row.n - part) <= 2 * sketches.rank_error()


def test_days_merge_without_the_rows(spark, log):
    whole = settle(sketches.day_sketches(log, ["transaction_type"], "amount"), "whole")
    half = F.col("tx_date") < F.lit("2024-01-15").cast("date")
    parts = [settle(sketches.merged(whole.filter(side), ["transaction_type"]), "part") for side in (half, ~half)]
    both = {row.transaction_type: row for row in sketches.quantiles_of(parts[0].unionByName(parts[1]), ["transaction_type"], {"p": 0.5}).collect()}
    exact = {row.transaction_type: row.p for row in exact_quantiles(log, ["transaction_type"], "amount", {"p": 0.5}).collect()}
    counts = {row.transaction_type: row["count"] for row in log.groupBy("transaction_type").count().collect()}
    # So few values are all kept: one of the two middle values is given.
    assert {kind: row.n for kind, row in both.items()} == counts
    for kind, row in both.items():
        near = log.filter(F.col("transaction_type").eqNullSafe(kind))
        assert abs(near.filter(F.col("amount") <= row.p).count() - counts[kind] / 2) <= 0.02 * counts[kind] + 1, exact[kind]


def test_sketches_in_one_pass(log):
    text = plan(sketches.quantiles_of(sketches.day_sketches(log, ["transaction_type"], "amount"), ["transaction_type"], {"p": 0.5}))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_high_amounts_by_sketched_medians(spark, log):
    medians = sketches.sketched_type_medians(sketches.day_sketches(log, ["transaction_type"], "amount"))
    exact = {row.transaction_id for row in detectors.high_amount(log).collect()}
    near = {row.transaction_id for row in detectors.high_amount(log, medians=medians).collect()}
    assert exact and len(exact ^ near) <= 0.02 * len(exact) + 1
    rates = {row.transaction_type: row for row in sketches.sketched_fee_rates(log).collect()}
    assert rates["AIRTIME"].min_rate == 0 and rates["TRANSFER"].median_rate == pytest.approx(0.01, abs=0.001)


# Intervals


def test_thousands_of_overlapping_intervals(spark):
    chance = random.Random(8)
    first = date(2026, 1, 1)
    table, rows = [], []
    for number in range(3000):
        start = first + timedelta(days=chance.randrange(-400, 400))
        end = start + timedelta(days=chance.choice([0, 0, 1, 2, 7, 30, 31, 365, 4000, -1]))
        table.append((number, chance.choice(["A", "B", None]), chance.choice([start, start, None]), chance.choice([end, end, None])))
    for number in range(200):
        rows.append((number, chance.choice(["A", "B", "C", None]), chance.choice([first + timedelta(days=chance.randrange(-500, 500)), None])))
    left = spark.createDataFrame(rows, "row int, kind string, day date")
    right = spark.createDataFrame(table, "interval int, kind string, first_day date, last_day date")
    held = intervals.within(left, F.col("day"), right, ["kind"])
    low, high = date.min, date.max
    expected = sorted(
        (row, number)
        for row, kind, day in rows
        for number, own, start, end in table
        if kind is not None and kind == own and day is not None and (start or low) <= day <= (end or high)
    )
    assert [tuple(pair) for pair in found(held, "row", "interval")] == sorted(expected, key=repr)
    text = final_plan(held)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert intervals.within(left, F.col("day"), right.limit(0), ["kind"]).collect() == []


def test_an_interval_lies_in_two_bins(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(intervals, "settle", lambda df, label: made.setdefault(label, settle(df, label)))
    right = spark.range(500).select(
        "id", F.lit("A").alias("kind"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("first_day"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("last_day"),
    )
    intervals.within(typed_rows(spark, {}).select(F.lit("A").alias("kind")), F.current_date(), right, ["kind"]).collect()
    assert made["interval-bins"].groupBy("id").count().agg(F.max("count")).first()[0] <= 2


def test_seasons_of_a_table(spark):
    tx = typed_rows(spark, *[{"timestamp": utc(day)} for day in ("2026-02-16T23:59:59", "2026-02-17T00:00:00", "2027-02-08T12:00:00")])
    tx = tx.unionByName(typed_rows(spark, {"timestamp": None}))
    seasons = spark.createDataFrame(
        [(date(2026, 2, 17), date(2026, 3, 18)), (date(2027, 2, 8), date(2027, 3, 9)), (date(2027, 2, 1), date(2027, 2, 8))],
        "first_day date, last_day date",
    )
    flags = [(str(row.timestamp)[:10] if row.timestamp else None, row.in_season) for row in intervals.with_dated_season(tx, seasons).collect()]
    assert sorted(flags, key=repr) == sorted([("2026-02-16", False), ("2026-02-17", True), ("2027-02-08", True), (None, False)], key=repr)


# JSON arrays


def odd_objects(chance, count):
    """Objects with brackets, quotes and escapes in their texts, and nested values."""
    signs = ["{", "}", "[", "]", '"', "\\", ",", "\n", "é", "\u2028", "x", "\\\"}", "/"]
    text = lambda: "".join(chance.choice(signs) for _ in range(chance.randrange(12)))
    return [
        {"id": str(number), "a": text(), "b": chance.choice([None, 1.5, True, text()]), "c": chance.choice([{"d": text(), "e": [text(), {}]}, [], text()])}
        for number in range(count)
    ]


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_file_is_read_by_many_tasks(spark, tmp_path, indent):
    objects = odd_objects(random.Random(indent), 400)
    for number, part in enumerate((objects[:397], objects[397:], [])):
        (tmp_path / f"{number}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=number == 0), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 10
        rows = files.read_json(spark, str(tmp_path), array=True, columns=["id", "a", "b", "c", "none"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.option("multiLine", True).schema("id string, a string, b string, c string, none string").json(str(tmp_path))
    flat = lambda found: sorted(((int(row.id), row.a, row.b, row.none) for row in found), key=lambda row: row[0])
    assert len(rows) == 400 and [row[:2] for row in flat(rows)] == [(int(made["id"]), made["a"]) for made in objects]
    assert repr(flat(rows)) == repr(flat(whole.collect()))
    # Nested values are given as compact text.
    nested = {row.id: row.c for row in rows}
    assert all(nested[made["id"]] == made["c"] if isinstance(made["c"], str) else json.loads(nested[made["id"]]) == made["c"] for made in objects)


@pytest.mark.parametrize("text", ['[{"a": "1"}', '[{"a": "1"}, 5]', '[{"a": "1"', '[{"a": "}', '[{"a": "1"}] x', '[{"a": "1"}]]', '["x", {"a": "1"}]'])
def test_broken_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "a.json"), array=True, columns=["a"]).collect()


# Publication


def test_a_batch_is_seen_as_a_whole(spark):
    publication = Publication(spark, new_folder(spark, "publish"))
    good, bad = spark.range(3), spark.range(10, 12)
    assert publication.write(0, {"good": good, "bad": bad})

    class Stop(Exception):
        pass

    class Broken:
        @property
        def write(self):
            raise Stop

    with pytest.raises(Stop):
        publication.write(1, {"good": spark.range(100, 103), "bad": Broken()})
    assert publication.batches() == [0] and publication.read("good", good.schema).count() == 3
    # The batch comes again, and once more after it is published.
    assert publication.write(1, {"good": spark.range(100, 103), "bad": spark.range(2)})
    assert not publication.write(1, {"good": spark.range(100, 103), "bad": spark.range(2)})
    assert sorted(row.id for row in publication.read("good", good.schema).collect()) == [0, 1, 2, 100, 101, 102]
    assert publication.sweep() == 1 and publication.read("bad", good.schema).count() == 4


def test_an_overwrite_never_shows_an_empty_table(spark):
    publication = Publication(spark, new_folder(spark, "publish"))
    assert publication.read("t", spark.range(1).schema).collect() == []
    publication.write(0, {"t": spark.range(3)})
    publication.write(1, {"t": spark.range(3, 5)})
    before = publication.read("t", spark.range(1).schema)
    publication.write(2, {"t": spark.range(7, 8)}, anew=True)
    assert before.count() == 5 and [row.id for row in publication.read("t", spark.range(1).schema).collect()] == [7]
    assert publication.sweep() == 2


def test_routes_of_a_stream_appear_together(spark):
    parts = [text_rows(spark, {"transaction_id": f"T{part}"}, {"transaction_id": f"F{part}", "amount": "-1"}) for part in range(3)]
    path = new_folder(spark, "routes")
    publication = publish_routes(stream_of(spark, parts), path)
    assert len(publication.batches()) == 3
    schema = validation.with_route(parts[0]).schema
    routes = {(row.transaction_id, row.route) for row in published_routes(publication, schema).collect()}
    assert routes == {(f"{kind}{part}", route) for part in range(3) for kind, route in (("T", "good"), ("F", "quarantine"))}
    assert published_routes(publish_routes(stream_of(spark, parts), path), schema).count() == 6
