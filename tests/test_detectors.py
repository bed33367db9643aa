from __future__ import annotations

import random
import statistics
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, found, typed_rows, utc
from walletlens.operators import detectors as d
from walletlens.operators import labels
from walletlens.operators.quantiles import exact_quantiles, magnitude
from walletlens.operators.rolling import dense_rows, frame_seconds, per_second, rolling, rolling_distinct
from walletlens.sources.event_log import load_transactions

START = utc("2026-04-10T08:00:00")


def at(seconds):
    return START + timedelta(seconds=seconds)


def ids(df):
    return sorted(row.transaction_id for row in df.select("transaction_id").collect())


# ---------------------------------------------------------------- rolling measures


def payments(spark, seed):
    """Random payments; one key and one member hold a third of the rows."""
    draw = random.Random(seed)
    rows = []
    for _ in range(600):
        key = "hot" if draw.random() < 0.34 else draw.choice(["a", "b", "c"])
        member = "m0" if draw.random() < 0.34 else f"m{draw.randrange(8)}"
        rows.append((key, member, draw.randrange(-40, 400), draw.randrange(1, 50)))
    rows += [("hot", f"m{n % 5}", 200, 7) for n in range(300)]
    return rows, spark.createDataFrame(rows, "k string, member string, sec bigint, amount int").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)")
    )


@pytest.mark.parametrize("seconds", [0, 1, 7, 50, 1000])
def test_rolling_equals_brute_force(spark, seconds):
    rows, df = payments(spark, seconds)
    expected = {}
    for key, _, sec, _ in rows:
        frame = [row for row in rows if row[0] == key and sec - seconds <= row[2] <= sec]
        before = [row[2] for row in frame if row[2] < sec]
        expected[key, sec] = (
            len(frame), sum(row[3] for row in frame), min(row[3] for row in frame), max(row[3] for row in frame),
            min(row[2] for row in frame), max(before, default=None),
        )
    got = {(r.k, r.sec): tuple(r)[2:] for r in rolling(per_second(df, ["k"]), ["k"], seconds).collect()}
    assert got == expected


@pytest.mark.parametrize("seconds", [0, 1, 7, 50, 1000])
def test_rolling_distinct_equals_brute_force(spark, seconds):
    rows, df = payments(spark, seconds + 1)
    got = {(r.k, r.sec): r.members for r in rolling_distinct(df, ["k"], "member", seconds).collect()}
    for key, _, sec, _ in rows:
        members = {row[1] for row in rows if row[0] == key and sec - seconds <= row[2] <= sec}
        assert got[key, sec] == len(members)


@pytest.mark.parametrize("seconds", [0, 7, 50])
def test_frame_seconds_equals_brute_force(spark, seconds):
    rows, df = payments(spark, 5)
    alerts = df.filter("sec % 41 = 0").select("k", "sec").distinct()
    marks = {(r.k, r.sec) for r in alerts.collect()}
    expected = {
        (key, sec) for key, _, sec, _ in rows if any((key, sec + step) in marks for step in range(seconds + 1))
    }
    got = frame_seconds(df, alerts, ["k"], seconds).collect()
    assert {(r.k, r.sec) for r in got} == expected and len(got) == len(expected)


def test_dense_rows_keep_every_full_frame(spark):
    rows, df = payments(spark, 9)
    kept = Counter(tuple(r) for r in dense_rows(df, ["k"], 5, 6).select("k", "member", "sec").collect())
    for key, _, sec, _ in rows:
        frame = [row for row in rows if row[0] == key and sec - 5 <= row[2] <= sec]
        if len(frame) >= 6:
            assert all(kept[row[:3]] for row in frame)
    assert sum(kept.values()) < len(rows)


# ---------------------------------------------------------------- quantiles


def test_quantiles_equal_sorted_values(spark):
    draw = random.Random(3)
    values = {
        "a": [round(draw.uniform(0, 1e6), 2) for _ in range(501)],
        "b": [float(draw.randrange(4)) for _ in range(100)],
        "c": [-5.5, 0.0, 1e-7, 999.99, 1000.0, 1000.01],
        None: [1.0, 2.0],
    }
    df = spark.createDataFrame([(key, value) for key in values for value in values[key]], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"p0": 0.0, "mid": 0.5, "p90": 0.9, "p1": 1.0}).collect()}
    assert set(got) == set(values)
    for key, group in values.items():
        ordered = sorted(group)
        assert got[key].mid == pytest.approx(statistics.median(group))
        assert (got[key].p0, got[key].p1) == (ordered[0], ordered[-1])
        place = 0.9 * (len(ordered) - 1)
        low = ordered[int(place)]
        high = ordered[min(int(place) + 1, len(ordered) - 1)]
        assert got[key].p90 == pytest.approx(low + (high - low) * (place - int(place)))
    everything = exact_quantiles(df, [], "v", {"mid": 0.5}).first().mid
    assert everything == pytest.approx(statistics.median([x for group in values.values() for x in group]))


def test_magnitude_keeps_order(spark):
    draw = random.Random(4)
    numbers = sorted({draw.choice([-1, 1]) * 10 ** draw.uniform(-6, 12) for _ in range(3000)} | {0.0, 999.0, 1000.0, -1000.0})
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    classes = [r.m for r in df.select("v", magnitude(F.col("v")).alias("m")).orderBy("v").collect()]
    assert classes == sorted(classes)


# ---------------------------------------------------------------- split payments and bursts


def split(offsets, receiver="ACC_00002", amounts=None):
    amounts = amounts or ["25000.00"] * len(offsets)
    return [
        {"timestamp": at(60 * minutes), "receiver_id": receiver, "amount": amount}
        for minutes, amount in zip(offsets, amounts)
    ]


def test_structuring(spark):
    rows = typed_rows(spark, *split([0, 15, 4, 45], amounts=["25000.00", "23750.00", "26250.00", "25100.00"]))
    alert = d.structuring(rows).collect()
    assert [row.transaction_id for row in alert] == ["T0003"]
    assert (alert[0].n, str(alert[0].total)) == (4, "100100.00")
    assert (alert[0].first_time, alert[0].last_time) == (at(0).replace(tzinfo=None), at(2700).replace(tzinfo=None))
    assert d.structuring_seconds(rows).count() == 4


@pytest.mark.parametrize(
    "changes",
    [
        split([0, 15, 4]),
        split([0, 15, 4, 106]),
        split([0, 15]) + split([4, 45], receiver="ACC_00003"),
        split([0, 15, 4, 45], amounts=["23000.00"] * 4),
        split([0, 15, 4, 45], amounts=["25000.00", "25000.00", "25000.00", "30000.00"]),
        [{**change, "status": "FAILED"} for change in split([0, 15, 4, 45])],
        [{**change, "transaction_type": "MERCHANT"} for change in split([0, 15, 4, 45])],
    ],
)
def test_structuring_near_misses(spark, changes):
    assert d.structuring(typed_rows(spark, *changes)).count() == 0


def test_structuring_at_the_time_limit(spark):
    assert ids(d.structuring(typed_rows(spark, *split([0, 15, 4, 105])))) == ["T0003"]


def burst(count, step=20, amount="1000.00", last=None):
    offsets = [step * index for index in range(count)]
    if last is not None:
        offsets[-1] = last
    return [
        {"timestamp": at(offset), "amount": amount, "receiver_id": f"ACC_{index + 10:05d}"}
        for index, offset in enumerate(offsets)
    ]


def test_high_frequency(spark):
    rows = typed_rows(spark, *burst(10))
    alert = d.high_frequency(rows).first()
    assert (alert.transaction_id, alert.n, alert.gap_seconds) == ("T0009", 10, 20)
    assert d.high_frequency_seconds(rows).count() == 10
    assert d.high_frequency(typed_rows(spark, *burst(10, last=3480))).count() == 1


@pytest.mark.parametrize(
    "changes",
    [burst(9), burst(9) + burst(1, amount="5001.00"), burst(9) + burst(1, amount="99.99"), burst(10, last=3481)],
)
def test_high_frequency_near_misses(spark, changes):
    assert d.high_frequency(typed_rows(spark, *changes)).count() == 0


# ---------------------------------------------------------------- amounts, outages, places


def test_high_amount(spark):
    rows = typed_rows(
        spark, *[{"amount": "500.00"}] * 5, {"amount": "80000.01"}, {"amount": "5000.00"}, {"amount": "4999.99"}
    )
    got = {row.transaction_id: (row.above_range, row.above_median) for row in d.high_amount(rows).collect()}
    assert got == {"T0005": (True, True), "T0006": (False, True)}
    # The tenfold of a small payment stays hidden when the usual payment is larger.
    larger = typed_rows(spark, *[{"amount": "9000.00"}] * 3, {"amount": "5000.00"})
    assert d.high_amount(larger).count() == 0


def test_operator_outage(spark):
    failed = {"status": "FAILED", "fees": "0.00"}
    rows = [{"timestamp": at(60 * minute), **(failed if minute < 6 else {})} for minute in range(10)]
    rows += [{"timestamp": at(60 * minute), "operator": "Masrvi"} for minute in range(10)]
    got = {row.operator: row for row in d.operator_outage(typed_rows(spark, *rows)).collect()}
    assert (got["Bankily"].failed_without_fees, got["Bankily"].failure_rate, got["Bankily"].outage) == (6, 60.0, True)
    assert not got["Masrvi"].outage


def test_unusual_location(spark):
    rows = typed_rows(
        spark,
        *[{"receiver_wilaya": "Trarza"}] * 5,
        {"receiver_wilaya": "Inchiri"},
        *[{"receiver_id": "ACC_00009", "receiver_wilaya": region} for region in ("Gorgol", "Assaba")],
    )
    got = found(d.unusual_location(rows), "transaction_id", "home_region")
    assert got == [("T0005", "Trarza"), ("T0006", "Assaba")]
    assert ids(d.unusual_location(rows, regions=["Inchiri"])) == ["T0005"]
    same = typed_rows(spark, *[{"receiver_wilaya": "Trarza"}] * 2, {"receiver_wilaya": "Nouakchott-Ouest"})
    assert d.unusual_location(same, only_between_regions=True).count() == 0


# ---------------------------------------------------------------- savings circles


def circle(members, amount="500.00", step=300, receiver="ACC_00001"):
    return [
        {"timestamp": at(step * index), "sender_id": f"ACC_{index + 100:05d}", "receiver_id": receiver, "amount": amount}
        for index in range(members)
    ]


def test_tontine(spark):
    rows = typed_rows(spark, *circle(10))
    assert [(row.transaction_id, row.members) for row in d.tontine(rows).collect()] == [("T0009", 10)]
    assert d.tontine_seconds(rows).count() == 10


@pytest.mark.parametrize(
    "changes",
    [
        circle(9),
        circle(9) + circle(1)[:1],
        circle(5) + circle(10, amount="600.00")[5:],
        circle(9, step=1) + [{**circle(10)[9], "timestamp": at(7201)}],
        [{**change, "transaction_type": "MERCHANT"} for change in circle(10)],
    ],
)
def test_tontine_near_misses(spark, changes):
    assert d.tontine(typed_rows(spark, *changes)).count() == 0


def test_a_circle_over_midnight(spark):
    late = [{**row, "timestamp": utc("2026-04-10T23:15:00") + timedelta(seconds=600 * index)} for index, row in enumerate(circle(10))]
    rows = typed_rows(spark, *late)
    assert d.tontine(rows).count() == 0
    assert [row.members for row in d.tontine(rows, d.Tontine(same_day=False)).collect()] == [10]


def test_circles_are_taken_from_the_alerts(spark):
    normal = circle(10)
    strange = [
        {**change, "receiver_id": "ACC_00002", "amount": f"{500 + index}.00"}
        for index, change in enumerate(circle(10))
    ]
    rows = typed_rows(spark, *normal, *strange)
    limits = d.HighFrequency(key=("receiver_id",))
    alerts = d.high_frequency(rows, limits)
    assert ids(alerts) == ["T0009", "T0019"]
    assert ids(d.without_tontines(alerts, rows)) == ["T0019"]
    # By sender a circle raises no alert, because each member pays once.
    assert d.high_frequency(rows).count() == 0


# ---------------------------------------------------------------- labels


def test_labels_and_scores(spark):
    rows = typed_rows(
        spark,
        *[{**row, "is_anomaly": True, "anomaly_type": "STRUCTURING"} for row in split([0, 15, 4, 45])],
        *[{**row, "sender_id": "ACC_00077", "is_anomaly": True, "anomaly_type": "HIGH_FREQUENCY"} for row in burst(10)],
        {"sender_id": "ACC_00500", "receiver_id": "ACC_00501", "amount": "90000.00"},
        {"sender_id": "ACC_00502", "receiver_id": "ACC_00503", "is_anomaly": True, "anomaly_type": "UNUSUAL_LOCATION"},
    )
    labelled = labels.rule_label(rows)
    counts = {row.rule_label: row.n for row in labelled.groupBy("rule_label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"STRUCTURING": 4, "HIGH_FREQUENCY": 10, "HIGH_AMOUNT": 1, "NONE": 1}
    assert labelled.filter("rule_flag != (rule_label != 'NONE')").count() == 0
    scores = {row.label: tuple(row)[1:] for row in labels.label_scorecard(labelled).collect()}
    assert scores["STRUCTURING"] == (4, 0, 0, 1.0, 1.0)
    assert scores["HIGH_AMOUNT"] == (0, 1, 0, 0.0, 0.0)
    assert scores["UNUSUAL_LOCATION"] == (0, 0, 1, 0.0, 0.0)


def test_detectors_do_not_depend_on_order(spark):
    tx = load_transactions(spark, SMALL)
    wide = d.Structuring(seconds=10 * 86400, least_rows=2, variation="0.5", least_total="1000")
    circle_limits = d.Tontine(seconds=48 * 3600, least_members=3)
    shuffled = tx.orderBy(F.xxhash64("transaction_id", "timestamp")).repartition(7)
    for run in (lambda t: d.structuring(t, wide), lambda t: d.tontine(t, circle_limits), d.unusual_location):
        assert ids(run(tx)) == ids(run(shuffled))
