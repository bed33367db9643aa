from __future__ import annotations

from pyspark.sql import functions as F

from conftest import utc
from walletlens import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def moment(text):
    return F.lit(text).cast("timestamp")


def test_money_rounds_half_up(spark):
    values = {"1.005": "1.01", "1.004": "1.00", "2.675": "2.68", "-1.005": "-1.01"}
    for value, rounded in values.items():
        assert str(one(spark, fn.money(F.lit(value).cast("decimal(18,3)")))) == rounded
    assert str(one(spark, fn.money(F.lit("0.00499999999995").cast("decimal(20,14)")))) == "0.00"


def test_season_borders(spark):
    cases = {
        "2026-02-16 23:59:59": False,
        "2026-02-17 00:00:00": True,
        "2026-03-18 23:59:59": True,
        "2026-03-19 00:00:00": False,
    }
    for text, inside in cases.items():
        assert one(spark, fn.in_season(moment(text))) is inside
        assert one(spark, fn.season_weight(moment(text))) == (2.5 if inside else 1.0)
    other = (fn.Season("2025-01-01", "2025-01-01"), fn.Season("2026-05-05", "2026-05-06"))
    assert one(spark, fn.in_season(moment("2026-05-06 10:00:00"), other))


def test_salary_and_weekend(spark):
    assert one(spark, fn.is_salary_day(moment("2026-01-05 23:00:00")))
    assert not one(spark, fn.is_salary_day(moment("2026-01-06 00:00:00")))
    assert one(spark, fn.salary_weight(moment("2026-01-01 00:00:00"))) == 1.8
    # 2026-01-02 is a Friday.
    days = [one(spark, fn.is_diaspora_weekend(moment(f"2026-01-{day:02d} 12:00:00"))) for day in range(1, 8)]
    assert days == [False, True, True, True, False, False, False]


def test_day_bounds(spark):
    frame = spark.range(1).select(fn.day_bound("2026-01-02").alias("a"), fn.day_bound("2026-01-02", True).alias("b"))
    assert frame.select(F.unix_seconds("a"), F.unix_seconds("b")).first()[:] == (
        int(utc("2026-01-02T00:00:00").timestamp()),
        int(utc("2026-01-02T23:59:59").timestamp()),
    )


def test_timestamps(spark):
    good = ["2026-01-01T00:00:00Z", "2026-01-01 00:00:00+00:00", "2026-01-01T01:00:00+01:00", "2026-01-01T00:00",
            "2026-01-01T00:00:00,5Z"]
    for text in good:
        assert one(spark, F.unix_seconds(fn.utc_timestamp(F.lit(text)))) == 1767225600
    for text in ["", "2026-01-01", "12", "2026-02-30T00:00:00Z", "x"]:
        assert one(spark, fn.utc_timestamp(F.lit(text))) is None


def test_text_rules(spark):
    assert [one(spark, fn.truthy(F.lit(word))) for word in ("TRUE", "1", "yes", "")] == [True, True, False, False]
    assert one(spark, fn.truthy(F.lit(None).cast("string"))) is False
    assert one(spark, fn.blank_to_null(F.lit("  \n"))) is None
    assert one(spark, fn.blank_to_null(F.lit(" a "))) == " a "
    assert one(spark, fn.account_id(F.lit(7))) == "ACC_00007"
    assert one(spark, fn.account_id(F.lit(100000))) is None
    assert one(spark, fn.in_capital_by_prefix(F.lit("Nouakchott-Est")))
    assert not one(spark, fn.in_capital(F.lit("Nouakchott-Est")))
    assert one(spark, fn.is_rural(F.lit("Inchiri"))) and not one(spark, fn.is_rural(F.lit("Trarza")))


def test_ratios(spark):
    assert one(spark, fn.percent(F.lit(1), F.lit(8))) == 12.5
    assert one(spark, fn.percent(F.lit(1), F.lit(800))) == 0.12
    assert one(spark, fn.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, fn.guarded_ratio(F.lit(7), F.lit(0))) == 0.0
    assert one(spark, fn.fee_rate(F.lit(1), F.lit(0))) is None
