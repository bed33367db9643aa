from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from conftest import found, typed_rows, utc
from walletlens import contract
from walletlens.operators import detectors as d
from walletlens.operators import profile
from walletlens.sources.work import new_folder
from walletlens.streaming import operators as s
from walletlens.streaming.sinks import compact, latest, run_append, run_complete, run_update

START = utc("2026-04-10T08:00:00")


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream_of(spark, *batches):
    """A stream that takes one file, and so one batch, per list of rows."""
    folder = new_folder(spark, "stream-input")
    for number, rows in enumerate(batches):
        typed_rows(spark, *rows).coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")
    return (
        spark.readStream.schema(contract.CANONICAL_SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/part=*")
    )


def test_routes(spark):
    stream = stream_of(spark, [{}, {"channel": "WEB"}], [{"amount": "0.00", "fees": "0.00"}])
    rows = run_append(s.stream_validate(stream), "routes", ["route"])
    assert found(rows.select("route", F.array_join("violations", ",").alias("v")), "route", "v") == [
        ("good", ""), ("quarantine", "AMOUNT_POS"), ("quarantine", "CHANNEL_ENUM"),
    ]


def test_dedup_over_batches(spark):
    first = [{"transaction_id": "A", "timestamp": at(0)}, {"transaction_id": "A", "timestamp": at(1)}]
    second = [{"transaction_id": "A", "timestamp": at(60)}, {"transaction_id": "B", "timestamp": at(60)}]
    rows = run_append(s.stream_dedup(stream_of(spark, first, second)), "ids")
    assert found(rows, "transaction_id") == [("A",), ("B",)]


def test_volume_over_batches_equals_batch(spark):
    first = [{"timestamp": at(3600 * hour)} for hour in range(6)]
    second = [{"timestamp": at(3600 * hour + 60)} for hour in range(4, 40)]
    rows = run_update(s.stream_volume(stream_of(spark, first, second)), "volume", ["window_start", "window_end"])
    daily = profile.daily_counts(typed_rows(spark, *first, *second))
    assert found(rows.select(F.to_date("window_start").alias("d"), "n"), "d", "n") == found(daily, "tx_date", "n")


def test_late_rows_leave_the_counts_and_pass_the_check(spark):
    # A batch judges lateness by the watermark that the batch before it worked with.
    moments = (0, 10 * 3600, 10 * 3600 + 1, 60)
    stream = stream_of(spark, *[[{"timestamp": at(moment)}] for moment in moments])
    rows = run_update(s.stream_volume(stream, "1 hour"), "late", ["window_start", "window_end"])
    assert sorted(row.n for row in rows.collect()) == [1, 2]
    assert run_append(s.stream_validate(stream), "late-routes", ["route"]).count() == 4


def test_outage_equals_batch(spark):
    failed = {"status": "FAILED", "fees": "0.00"}
    rows = [{"timestamp": at(60 * minute), **(failed if minute < 6 else {})} for minute in range(10)]
    got = run_update(s.stream_outage(stream_of(spark, rows)), "outage", ["operator", "window_start", "window_end"])
    columns = ["operator", "window_start", "n", "failed", "failed_without_fees", "failure_rate", "outage"]
    assert found(got, *columns) == found(d.operator_outage(typed_rows(spark, *rows)), *columns)


def test_windows_hold_every_burst(spark):
    for start in (0, 3599, 500):
        offsets = [start + 380 * index for index in range(9)] + [start + 3480]
        rows = [{"timestamp": at(offset), "receiver_id": f"ACC_{n + 10:05d}"} for n, offset in enumerate(offsets)]
        assert d.high_frequency(typed_rows(spark, *rows)).count() == 1
        got = run_update(
            s.stream_burst(stream_of(spark, rows)), "burst", ["sender_id", "window_start", "window_end"]
        )
        assert got.filter("n = 10").count() >= 1


def test_circle_members_are_counted_once(spark):
    rows = [
        {"timestamp": at(60 * index), "sender_id": f"ACC_{index % 11 + 100:05d}", "receiver_id": "ACC_00001", "amount": "500.00"}
        for index in range(22)
    ]
    closing = [{"timestamp": at(86400), "transaction_type": "TRANSFER", "amount": "1.00"}]
    got = run_append(s.stream_tontine(stream_of(spark, rows, closing)), "circles")
    assert got.agg(F.max("members"), F.max("payments")).first()[:] == (11, 22)
    estimated = run_update(
        s.stream_tontine_estimate(stream_of(spark, rows)),
        "circle-estimates",
        ["receiver_id", "amount", "window_start", "window_end"],
    )
    assert estimated.agg(F.max("members")).first()[0] == 11


def test_a_window_of_few_payers_has_a_small_state(spark):
    rows = [{"timestamp": at(0), "amount": f"{number + 1}.00", "sender_id": f"ACC_{number % 7:05d}"} for number in range(2000)]
    estimates = s.stream_tontine_estimate(stream_of(spark, rows), d.Tontine(least_members=1), "10 minutes")
    query = (
        estimates.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", new_folder(spark, "payer-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [progress["stateOperators"][0] for progress in query.recentProgress]
    assert max(state["numRowsTotal"] for state in states) == 2000
    assert max(state["memoryUsedBytes"] for state in states) < 2000 * 1000


def test_payers_are_estimated_at_every_size(spark):
    sizes = (1, 2, 16, 300, 3000)
    rows = [
        {"timestamp": at(number % 600), "amount": f"{size}.00", "sender_id": f"ACC_{number:05d}"}
        for size in sizes
        for number in list(range(size)) * 2
    ]
    unnamed = [{"timestamp": at(0), "amount": "7.00", "sender_id": name} for name in (None, "", "", "ACC_00001")]
    nobody = [{"timestamp": at(0), "amount": "8.00", "sender_id": None}]
    # Halves of the rows come in different batches, so sketches of state and batch are merged.
    parts = rows[::2] + unnamed[:2] + nobody, rows[1::2] + unnamed[2:]
    keys = ["receiver_id", "amount", "window_start", "window_end"]
    estimates = s.stream_tontine_estimate(stream_of(spark, *parts), d.Tontine(least_members=0), "10 minutes")
    members = {int(row.amount): row.members for row in run_update(estimates, "payers", keys).collect()}
    assert {size: members[size] for size in (1, 2, 16, 300, 7, 8)} == {1: 1, 2: 2, 16: 16, 300: 300, 7: 2, 8: 0}
    assert abs(members[3000] - 3000) < 300


def test_sessions_close_by_gap(spark):
    first = [{"timestamp": at(offset)} for offset in (0, 60, 500)]
    second = [{"timestamp": at(offset)} for offset in (1000, 5000)] + [{"timestamp": at(86400)}]
    got = run_append(s.stream_sessions(stream_of(spark, first, second)), "sessions")
    assert [row.n for row in got.orderBy("window_start").collect()] == [4, 1]


def test_the_last_windows_are_complete(spark):
    batches = [
        [{"timestamp": at(500 * number + 60 * step), "sender_id": f"ACC_{step % 3:05d}"} for step in range(9)]
        for number in range(8)
    ]
    rows = typed_rows(spark, *[row for batch in batches for row in batch])
    got = run_complete(s.stream_sessions, stream_of(spark, *batches), "sessions")
    assert got.agg(F.sum("n")).first()[0] == rows.count()
    columns = ["sender_id", "window_start", "window_end", "n", "total"]
    assert found(got, *columns) == found(s.stream_sessions(rows), *columns)
    circles = [
        [{"timestamp": at(60 * step + number), "sender_id": f"ACC_{step + 100:05d}", "amount": "500.00"} for step in range(6)]
        for number in range(3)
    ]
    rows = typed_rows(spark, *[row for batch in circles for row in batch])
    limits = d.Tontine(least_members=5)
    got = run_complete(
        lambda tx: s.stream_tontine(tx, limits), stream_of(spark, *circles), "circles", {"transaction_type": "TRANSFER"}
    )
    columns = ["receiver_id", "window_start", "window_end", "members", "payments"]
    assert found(got, *columns) == found(s.stream_tontine(rows, limits), *columns) != []


def test_a_stream_without_rows(spark):
    folder = new_folder(spark, "no-rows")
    typed_rows(spark, {}).limit(0).write.parquet(folder)
    stream = spark.readStream.schema(contract.CANONICAL_SCHEMA).parquet(folder)
    keys = ["window_start", "window_end"]
    assert run_update(s.stream_volume(stream), "none", keys).collect() == []
    assert run_complete(s.stream_sessions, stream, "none").collect() == []


def test_batches_can_be_joined(spark):
    folder = new_folder(spark, "batches")
    like = spark.createDataFrame([("a", 1)], "k string, n int")
    for number in range(12):
        spark.createDataFrame([("a", number), (f"k{number % 3}", number)], "k string, n int").write.parquet(
            f"{folder}/batch_id={number}"
        )
    before = found(latest(spark, folder, like, ["k"]), "k", "n")
    assert before == [("a", 11), ("k0", 9), ("k1", 10), ("k2", 11)]
    joined = compact(spark, folder, like, ["k"], "joined")
    assert found(latest(spark, joined, like, ["k"]), "k", "n") == before


def test_a_repeated_batch_changes_nothing(spark):
    stream = stream_of(spark, [{"timestamp": at(0)}], [{"timestamp": at(1)}])
    volume = s.stream_volume(stream)
    folder = new_folder(spark, "repeat")

    def write(batch, number):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{folder}/table/batch_id={number}")

    query = (
        volume.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = latest(spark, f"{folder}/table", volume, ["window_start", "window_end"])
    assert [row.n for row in got.collect()] == [2]
