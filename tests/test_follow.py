"""Streams that give what the tables give, profiles by day, and circles over many rounds."""

from __future__ import annotations

import glob
import os
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, typed_rows, utc
from walletlens.checks import queries
from walletlens.operators import circles, detectors
from walletlens.plans import report
from walletlens.plans.incremental import ProfileState, file_states
from walletlens.sources import files
from walletlens.sources.event_log import load_transactions
from walletlens.sources.work import new_folder, settle
from walletlens.streaming import closed


def rows_of(df):
    return Counter(tuple(row) for row in df.collect())


def stream_of(spark, parts, per_batch=1):
    """A stream that reads the parts one after the other."""
    path = new_folder(spark, "parts")
    for number, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/{number:03d}")
        for file in glob.glob(f"{path}/{number:03d}/part-*"):
            os.utime(file, (1_700_000_000 + 10 * number,) * 2)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path}/*")


@pytest.fixture(scope="module")
def log(spark):
    """The small log in seven parts that follow each other, each in any order."""
    tx = settle(closed.account_columns(load_transactions(spark, SMALL)), "log")
    day = F.dayofyear("timestamp")
    return tx, [tx.filter((day > 5 * part) & (day <= 5 * part + 5)).orderBy("transaction_id") for part in range(7)]


CIRCLE = queries.TONTINE._replace(least_members=2)
INCOMING = queries.RECEIVER_BURST._replace(least_rows=2)
CASES = {
    "bursts": (closed.bursts(queries.HIGH_FREQUENCY), lambda tx: detectors.high_frequency(tx, queries.HIGH_FREQUENCY)),
    "splits": (closed.split_payments(queries.STRUCTURING), lambda tx: detectors.structuring(tx, queries.STRUCTURING)),
    "circles": (closed.circles(CIRCLE), lambda tx: detectors.tontine(tx, CIRCLE)),
    "unexplained": (
        closed.unexplained_bursts(INCOMING, CIRCLE),
        lambda tx: detectors.without_tontines(detectors.high_frequency(tx, INCOMING), tx, CIRCLE),
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_many_batches_equal_the_table(spark, log, name):
    tx, parts = log
    watch, batch = CASES[name]
    # Equal rows are all kept, and a row of a part may be a day behind another.
    parts = [part.unionByName(part.filter("transaction_id LIKE '%3'")) for part in parts]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    expected = rows_of(batch(settle(whole, "whole")))
    assert expected
    assert rows_of(closed.run_closed(watch, stream_of(spark, parts), f"follow-{name}", "6 days")) == expected


def payments(*at, sender="ACC_00001"):
    return [
        {"transaction_id": f"P{number}", "timestamp": utc("2026-04-10T12:00:00") + timedelta(seconds=second), "sender_id": sender}
        for number, second in enumerate(at)
    ]


def test_late_rows_are_in_no_result(spark):
    limits = detectors.HighFrequency(seconds=100, least_rows=3)
    early, late = payments(0, 50, 100, 20_000), payments(60, 90, 20_010, 20_020)
    parts = [typed_rows(spark, *early), typed_rows(spark, *payments(20_001)), typed_rows(spark, *late)]
    found = closed.run_closed(closed.bursts(limits), stream_of(spark, parts), "late", "1 hour")
    # The rows of second 60 and 90 come an hour and more behind; without them two bursts are seen.
    start = utc("2026-04-10T12:00:00")
    seconds = sorted(((row.timestamp.astimezone(start.tzinfo) - start).total_seconds(), row.n) for row in found.collect())
    assert seconds == [(100, 3), (20_010, 3), (20_020, 4)]


def test_old_rows_are_forgotten_and_batches_repeat(spark):
    limits = detectors.HighFrequency(seconds=100, least_rows=2)
    watch = closed.bursts(limits)
    path = new_folder(spark, "forget")
    schema = typed_rows(spark, {}).schema
    follower = closed.Follower(spark, watch, schema, path)
    for number in range(6):
        rows = typed_rows(spark, *payments(1000 * number, 1000 * number + 60)).withColumn("copies", F.lit(1).cast("long"))
        follower(rows, number)
        follower(rows, number)
    kept = [name for name in os.listdir(f"{path}/closed") if name.startswith("batch=")]
    assert len(kept) <= 3
    assert spark.read.parquet(f"{path}/alerts").count() == 6


def test_an_unfinished_stream_keeps_its_last_rows(spark):
    limits = detectors.HighFrequency(seconds=100, least_rows=2)
    stream = stream_of(spark, [typed_rows(spark, *payments(0, 10, 9000, 9010)), typed_rows(spark, *payments(9020))])
    found = closed.run_closed(closed.bursts(limits), stream, "open", "1 hour", finish=False)
    assert [row.transaction_id for row in found.collect()] == ["P1"]
    none = closed.run_closed(closed.bursts(limits), stream_of(spark, [typed_rows(spark, {}).limit(0)]), "none")
    assert none.collect() == []


# Profile by day


def dated(spark, *days):
    return typed_rows(spark, *[{"timestamp": utc(day) if day else None, "channel": "APP" if day else None} for day in days])


def test_profile_by_day_equals_the_full_scan(spark):
    path, state = new_folder(spark, "loads"), ProfileState.new(spark)

    def load(rows):
        files.write_parquet(rows, path, mode="append", by_date=True)
        return state.refresh(path)

    def equal():
        whole = spark.read.parquet(path)
        assert rows_of(state.sets()) == rows_of(report.profile_sets(whole))
        full = report.report_from_sets(report.profile_sets(whole))
        for name, table in state.report().items():
            assert [tuple(row) for row in table.collect()] == [tuple(row) for row in full[name].collect()], name

    assert state.sets().collect() == []
    first = load(dated(spark, "2026-02-16T10:00:00", "2026-02-17T10:00:00", "2026-02-17T11:00:00", None))
    assert [str(day) for day in first] == ["2026-02-16", "2026-02-17", "None"]
    equal()
    assert state.refresh(path) == []
    # A day is added, a day gets a late row, and one load is repeated.
    assert [str(day) for day in load(dated(spark, "2026-02-18T10:00:00", "2026-02-16T23:59:59"))] == ["2026-02-16", "2026-02-18"]
    equal()
    assert [str(day) for day in load(dated(spark, "2026-02-18T10:00:00"))] == ["2026-02-18"]
    equal()
    assert state.days().where("tx_date = DATE '2026-02-17'").first().version == 1
    assert state.days().count() == file_states(spark, path).count() == 4


def test_unchanged_days_are_not_read(spark):
    path, state = new_folder(spark, "loads"), ProfileState.new(spark)
    files.write_parquet(dated(spark, "2026-02-16T10:00:00", "2026-02-17T10:00:00"), path, by_date=True)
    state.refresh(path)
    before = rows_of(state.sets())
    # A file that cannot be read would stop a scan of its day.
    broken = glob.glob(f"{path}/tx_date=2026-02-16/part-*")[0]
    times = os.stat(broken)
    size = times.st_size
    with open(broken, "r+b") as file:
        file.write(b"\0" * size)
    os.utime(broken, ns=(times.st_atime_ns, times.st_mtime_ns))
    files.write_parquet(dated(spark, "2026-02-18T10:00:00"), path, mode="append", by_date=True)
    assert [str(day) for day in state.refresh(path)] == ["2026-02-18"]
    after = dict(((metric, value), n) for metric, value, n in rows_of(state.sets()))
    assert after["rows", "all"] == 3 and len(after) == len(before) + 1


def test_a_broken_refresh_leaves_the_last_version(spark):
    path, state = new_folder(spark, "loads"), ProfileState.new(spark)
    files.write_parquet(dated(spark, "2026-02-16T10:00:00"), path, by_date=True)
    state.refresh(path)
    before = rows_of(state.sets())
    # Counts without a table of days are of a refresh that broke off.
    spark.read.parquet(f"{state.path}/counts/version=1").write.parquet(f"{state.path}/counts/version=2")
    os.makedirs(f"{state.path}/days/version=2")
    assert rows_of(state.sets()) == before
    files.write_parquet(dated(spark, "2026-02-16T12:00:00"), path, mode="append", by_date=True)
    assert [str(day) for day in state.refresh(path)] == ["2026-02-16"]
    assert rows_of(state.sets()) == rows_of(report.profile_sets(spark.read.parquet(path)))


def test_a_day_that_goes_is_forgotten(spark):
    state, both, one = ProfileState.new(spark), new_folder(spark, "both"), new_folder(spark, "one")
    files.write_parquet(dated(spark, "2026-02-16T10:00:00", "2026-02-17T10:00:00"), both, by_date=True)
    files.write_parquet(dated(spark, "2026-02-17T10:00:00"), one, by_date=True)
    state.refresh(both)
    state.refresh(one)
    assert rows_of(state.sets()) == rows_of(report.profile_sets(spark.read.parquet(one)))


# Circles over many rounds


def circle_rows(people, days, amount=500, skip=()):
    """Each day the next of the people is paid by the others; ``skip`` holds (round, payer) that do not pay."""
    rows = []
    for turn, day in enumerate(days):
        beneficiary = people[turn % len(people)]
        payers = [person for person in people if person != beneficiary and (turn, person) not in skip]
        for second, payer in enumerate(payers):
            moment = utc("2026-04-01T18:00:00") + timedelta(days=day, seconds=60 * second)
            rows.append({
                "transaction_id": f"{payer}-{turn}-{amount}", "timestamp": moment, "sender_id": f"ACC_{payer:05d}",
                "receiver_id": f"ACC_{beneficiary:05d}", "amount": amount,
            })
    return rows


def test_circles_over_rounds(spark):
    weekly = circle_rows(range(100, 105), [0, 7, 15, 21, 28], skip={(2, 104)})
    other = circle_rows(range(200, 204), [0, 7, 14])
    # Same people and days but another amount, a round too far away, and strangers.
    dear = circle_rows(range(100, 105), [3], amount=900)
    far = circle_rows(range(300, 305), [0, 30])
    strangers = circle_rows(range(400, 405), [1]) + circle_rows(range(410, 415), [8])
    tx = settle(typed_rows(spark, *weekly, *other, *dear, *far, *strangers), "circle-rows")
    limits = detectors.Tontine(least_members=3)
    found = {row.first_beneficiary: row for row in circles.savings_circles(tx, limits).collect()}
    assert set(found) == {"ACC_00100", "ACC_00200"}
    row = found["ACC_00100"]
    assert (row.rounds, row.people, row.repeated_turns, row.missing_payments, str(row.last_day)) == (5, 5, 0, 1, "2026-04-29")
    assert row.beneficiaries == "ACC_00100,ACC_00101,ACC_00102,ACC_00103,ACC_00104"
    turns = circles.circle_turns(tx, limits).where("missing > 0").collect()
    assert [(turn.turn, turn.beneficiary, turn.payers, turn.missing) for turn in turns] == [(3, "ACC_00102", 3, 1)]
    # The first and the last of the weekly rounds are four weeks apart.
    assert {row.first_beneficiary for row in circles.savings_circles(tx, limits, circles.MONTHLY).collect()} == {"ACC_00100", "ACC_00300"}


def test_unrelated_rounds_never_meet(spark):
    """Rounds that share a busy person only are no pairs, however many there are."""
    rows = []
    for number in range(40):
        people = [1, *range(1000 + 10 * number, 1009 + 10 * number)]
        rows += circle_rows(people[::-1], [number % 20])
    people = settle(circles.round_people(typed_rows(spark, *rows), detectors.Tontine(least_members=3)), "people")
    rare = circles._rare_people(people, circles.WEEKLY)
    assert rare.where("member = 'ACC_00001'").count() == 0
    assert circles.similar_rounds(people).collect() == []


def test_rounds_over_midnight_are_refused(spark):
    with pytest.raises(ValueError):
        circles.round_people(typed_rows(spark, {}), detectors.Tontine(same_day=False))
