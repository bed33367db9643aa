"""Profiles and conformance checks: observed behaviour against the expected one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from walletlens import contract
from walletlens.functions import (
    DEFAULT_SEASONS,
    Season,
    fee_rate,
    guarded_ratio,
    half_even,
    in_season,
    is_diaspora_weekend,
    is_rural,
    is_salary_day,
    month_half,
    percent,
    tx_date,
)
from walletlens.operators.profile import distributions, with_share
from walletlens.operators.quantiles import exact_quantiles
from walletlens.sources import dimensions
from walletlens.sources.work import settle

# Fee rates of types that are charged, and types that are free.
LEAST_FEE_RATE = "0.005"
GREATEST_FEE_RATE = "0.02"
FREE_TYPES = ["AIRTIME", "BILL_PAY"]


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _share_within(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each row of a small count table in the total of its keys."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", percent(F.col("n"), total))


# ---------------------------------------------------------------- mixes and seasons


def mix_drift(tx: DataFrame, mixes: Mapping[str, Mapping[str, float]] = dimensions.EXPECTED_MIXES) -> DataFrame:
    """Observed and expected share per mix and value, and their difference in points.

    All mixes are counted in one scan. Values that only one side has are kept.
    """
    rural, salary = is_rural(F.col("sender_wilaya")), is_salary_day(F.col("timestamp"))
    kind = F.col("transaction_type")
    # Text in front of a value tells a row outside the mix (null) from a null value.
    def part_of(condition: Column, value: str) -> Column:
        return F.when(condition, F.concat(F.lit("="), F.coalesce(F.col(value), F.lit(""))))

    columns = {
        "operator": part_of(F.lit(True), "operator"),
        "sender_wilaya": part_of(F.lit(True), "sender_wilaya"),
        "channel_urban": part_of(~rural, "channel"),
        "channel_rural": part_of(rural, "channel"),
        "type_salary_days": part_of(salary, "transaction_type"),
        "type_other_days": part_of(~salary, "transaction_type"),
        "bill_provider": part_of((kind == "BILL_PAY") & F.col("bill_provider").isNotNull(), "bill_provider"),
        "origin_country": part_of((kind == "CASH_IN") & F.col("origin_country").isNotNull(), "origin_country"),
    }
    counts = distributions(tx, columns).filter(F.col("value").isNotNull())
    counts = counts.select(F.col("metric").alias("mix"), F.substr(F.col("value"), F.lit(2)).alias("value"), "n")
    observed = _share_within(counts, ["mix"])
    expected = dimensions.expected_mixes(tx.sparkSession, mixes)
    return observed.join(expected, ["mix", "value"], "full").select(
        "mix",
        "value",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("share", F.lit(0.0)).alias("observed_share"),
        F.coalesce("expected_share", F.lit(0.0)).alias("expected_share"),
        half_even(F.coalesce("share", F.lit(0.0)) - F.coalesce("expected_share", F.lit(0.0)), 2).alias("difference"),
    )


def seasonal_expectation(
    tx: DataFrame, first: str, last: str, seasons: Sequence[Season] = DEFAULT_SEASONS
) -> DataFrame:
    """Expected and observed rows per day of a calendar; days without rows are kept.

    One more row, without a day, counts the rows outside the calendar and those without a time.
    The running weight is taken over the calendar, which has one row per day, not over
    transactions. The rows of each day are counted once, in one scan, and written first.
    """
    counted = settle(tx.groupBy(F.to_date("timestamp").alias("tx_date")).agg(_n("n")), "daily-counts")
    days = dimensions.calendar(tx.sparkSession, first, last, seasons)
    upto = Window.orderBy("tx_date").rowsBetween(Window.unboundedPreceding, 0)
    expected = days.withColumn("running_weight", F.sum("weight").over(upto))
    joined = expected.join(counted, "tx_date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy()
    weight, running = F.col("weight").cast("double"), F.col("running_weight").cast("double")
    total, rows = F.sum("weight").over(whole).cast("double"), F.sum("n").over(whole)
    inside = joined.select(
        "tx_date",
        weight.alias("weight"),
        half_even(weight / total, 6).alias("expected_share"),
        half_even(running / total, 6).alias("running_share"),
        F.col("n").alias("observed_rows"),
        guarded_ratio(F.col("n") * total, weight * rows).alias("observed_to_expected"),
    )
    within = F.coalesce(F.col("tx_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))
    outside = counted.agg(F.coalesce(F.sum(F.when(~within, F.col("n"))), F.lit(0)).alias("observed_rows"))
    return inside.unionByName(outside, allowMissingColumns=True)


def hourly_profile(tx: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> DataFrame:
    """Share of each hour inside and outside the season."""
    counts = _hours(tx, seasons)
    return _share_within(counts, ["in_season"])


def _hours(tx: DataFrame, seasons: Sequence[Season]) -> DataFrame:
    keys = [
        in_season(F.col("timestamp"), seasons).alias("in_season"),
        F.hour("timestamp").alias("hour"),
    ]
    return tx.filter(F.col("timestamp").isNotNull()).groupBy(*keys).agg(_n("n"))


def evening_share(tx: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> DataFrame:
    """Part of the rows in hours 19 to 23 and in hours 7 to 22, inside and outside the season."""
    counts = _hours(tx, seasons).groupBy("in_season").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("hour").between(19, 23), F.col("n")).otherwise(0)).alias("evening"),
        F.sum(F.when(F.col("hour").between(7, 22), F.col("n")).otherwise(0)).alias("daytime"),
    )
    return counts.select(
        "in_season",
        "n",
        percent(F.col("evening"), F.col("n")).alias("evening_percent"),
        percent(F.col("daytime"), F.col("n")).alias("daytime_percent"),
    )


def type_mix_by_day_class(tx: DataFrame) -> DataFrame:
    """One row per day class, one column per type with its share in percent."""
    day_class = F.when(is_salary_day(F.col("timestamp")), "SALARY_DAYS").otherwise("OTHER_DAYS")
    pivoted = (
        tx.filter(F.col("timestamp").isNotNull())
        .groupBy(day_class.alias("day_class"), "transaction_type")
        .agg(_n("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("day_class")))
        .groupBy("day_class", "total")
        .pivot("transaction_type", contract.TRANSACTION_TYPES)
        .agg(F.sum("n"))
    )
    shares = [
        percent(F.coalesce(F.col(kind), F.lit(0)), F.col("total")).alias(f"{kind.lower()}_percent")
        for kind in contract.TRANSACTION_TYPES
    ]
    return pivoted.select("day_class", F.col("total").alias("n"), *shares)


def channel_mix_by_region_class(tx: DataFrame) -> DataFrame:
    """Share of each channel in rural and in other regions."""
    region_class = F.when(is_rural(F.col("sender_wilaya")), "RURAL").otherwise("OTHER")
    counts = tx.groupBy(region_class.alias("region_class"), "channel").agg(_n("n"))
    return _share_within(counts, ["region_class"])


# ---------------------------------------------------------------- amounts and fees


def range_key(ranges: Mapping[str, tuple[str, str]] = dimensions.AMOUNT_RANGES) -> Column:
    """Key of the usual range: the provider of a bill, the diaspora, or the type."""
    kind, provider = F.col("transaction_type"), F.col("bill_provider")
    providers = [key.removeprefix("BILL_PAY/") for key in ranges if key.startswith("BILL_PAY/")]
    abroad = F.lit("CASH_IN/DIASPORA" in ranges) & (kind == "CASH_IN") & F.col("origin_country").isNotNull()
    return (
        F.when((kind == "BILL_PAY") & provider.isin(*providers), F.concat(F.lit("BILL_PAY/"), provider))
        .when(abroad, F.lit("CASH_IN/DIASPORA"))
        .otherwise(kind)
    )


def with_range(tx: DataFrame, ranges: Mapping[str, tuple[str, str]] = dimensions.AMOUNT_RANGES) -> DataFrame:
    """Add ``low`` and ``high``, the usual range of the row. The table has one row per key."""
    table = F.broadcast(dimensions.amount_ranges(tx.sparkSession, ranges))
    return tx.withColumn("range_key", range_key(ranges)).join(table, "range_key", "left")


def amount_range(tx: DataFrame, ranges: Mapping[str, tuple[str, str]] = dimensions.AMOUNT_RANGES) -> DataFrame:
    """Rows whose amount lies outside the usual range."""
    rows = with_range(tx.select("transaction_id", "transaction_type", "bill_provider", "origin_country", "amount"), ranges)
    side = F.when(F.col("amount") < F.col("low"), "BELOW").when(F.col("amount") > F.col("high"), "ABOVE")
    return (
        rows.withColumn("side", side)
        .filter(F.col("side").isNotNull())
        .select("transaction_id", "range_key", "amount", "low", "high", "side")
    )


def fee_rule(tx: DataFrame) -> DataFrame:
    """Rows whose fee does not follow the fee rule, with half a cent for rounding.

    Airtime and bills are free. Others cost 0.5 to 2 percent; a failed row may also be free.
    """
    half_cent = F.lit("0.005").cast("decimal(4,3)")
    amount, fees = F.col("amount"), F.col("fees")
    least = amount * F.lit(LEAST_FEE_RATE).cast("decimal(4,3)") - half_cent
    greatest = amount * F.lit(GREATEST_FEE_RATE).cast("decimal(4,3)") + half_cent
    free = F.col("transaction_type").isin(*FREE_TYPES)
    waived = (F.col("status") == "FAILED") & (fees == 0)
    broken = F.when(free, fees != 0).otherwise(~waived & ~fees.between(least, greatest))
    verdict = F.when(free, "NOT_FREE").when(fees < least, "TOO_LOW").otherwise("TOO_HIGH")
    columns = ["transaction_id", "transaction_type", "status", "amount", "fees"]
    return tx.filter(broken).select(*columns, verdict.alias("verdict"))


def fee_rate_profile(tx: DataFrame) -> DataFrame:
    """Least, median and greatest fee rate per type, in millionths."""
    rates = tx.select("transaction_type", F.round(fee_rate(F.col("fees"), F.col("amount")), 6).alias("rate"))
    wanted = {"least_rate": 0.0, "median_rate": 0.5, "greatest_rate": 1.0}
    rows = exact_quantiles(rates, ["transaction_type"], "rate", wanted)
    return rows.select("transaction_type", *[F.round(name, 6).alias(name) for name in wanted])


# ---------------------------------------------------------------- bills


def recurring_bills(tx: DataFrame) -> DataFrame:
    """Bills and amount per account, provider and month."""
    bills = tx.filter(F.col("transaction_type") == "BILL_PAY")
    return bills.groupBy("sender_id", "bill_provider", _month()).agg(
        _n("bills"), F.sum("amount").cast("decimal(38,2)").alias("amount")
    )


def _month() -> Column:
    return F.trunc(tx_date(F.col("timestamp")), "month").alias("month")


def bill_payer_share(tx: DataFrame) -> DataFrame:
    """Part of the accounts active in a month that paid a bill in it."""
    active = tx.groupBy(_month(), "sender_id").agg(
        F.max((F.col("transaction_type") == "BILL_PAY").cast("int")).alias("pays")
    )
    counted = active.groupBy("month").agg(_n("active_accounts"), F.sum("pays").alias("paying_accounts"))
    return counted.withColumn("share", percent(F.col("paying_accounts"), F.col("active_accounts")))


def bill_day_profile(tx: DataFrame) -> DataFrame:
    """Bills per provider in days 1 to 10 and after."""
    bills = tx.filter(F.col("transaction_type") == "BILL_PAY")
    counts = bills.groupBy("bill_provider", month_half(F.col("timestamp")).alias("half")).agg(_n("n"))
    return _share_within(counts, ["bill_provider"])


# ---------------------------------------------------------------- accounts


def _most_frequent(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; of equally frequent ones the first by name, null last.

    A plain aggregate combined before the shuffle, so no key is ordered in one task.
    """
    first = F.min(F.struct(-F.col("n"), F.col(value).isNull(), F.col(value)))
    return counts.groupBy(key).agg(first.alias("first"), F.sum("n").alias("all_n")).select(
        key,
        F.col(f"first.{value}").alias(value),
        (-F.col("first.col1")).alias("modal_n"),
        "all_n",
    )


def account_profile(tx: DataFrame) -> DataFrame:
    """Rows and value sent and received, modal region, operator and channel, and tier.

    Rows without a sender or receiver count for the account null. Transactions are first reduced
    to one row per account and combination of its values; the rest works on that table. LOW, MEDIUM and HIGH split the accounts at the 60th and
    90th percentile of rows sent.
    """
    dims = ["sender_wilaya", "operator", "channel"]
    combined = settle(
        tx.groupBy("sender_id", *dims).agg(_n("n"), F.sum("amount").alias("amount")), "account-values"
    )
    value = combined.unpivot(["sender_id", "n"], dims, "dimension", "value")
    per_value = value.groupBy("sender_id", "dimension", "value").agg(F.sum("n").alias("n"))
    order = F.struct(-F.col("n"), F.col("value").isNull(), F.col("value"))
    modal = per_value.groupBy("sender_id").agg(
        *[
            F.min(F.when(F.col("dimension") == name, order)).getField("value").alias(f"modal_{short}")
            for name, short in zip(dims, ("region", "operator", "channel"))
        ]
    )
    sent = combined.groupBy("sender_id").agg(F.sum("n").alias("sent_rows"), F.sum("amount").alias("sent_amount"))
    received = tx.groupBy("receiver_id").agg(_n("received_rows"), F.sum("amount").alias("received_amount"))
    sender = sent.withColumnRenamed("sender_id", "sent_by")
    known = sender.join(modal, F.col("sent_by").eqNullSafe(F.col("sender_id")), "left").drop("sender_id")
    accounts = (
        known.join(received, F.col("sent_by").eqNullSafe(F.col("receiver_id")), "full")
        .select(
            F.coalesce("sent_by", "receiver_id").alias("account_id"),
            *[F.coalesce(name, F.lit(0)).alias(name) for name in ("sent_rows", "received_rows")],
            *[
                F.coalesce(name, F.lit(0)).cast("decimal(38,2)").alias(name)
                for name in ("sent_amount", "received_amount")
            ],
            "modal_region",
            "modal_operator",
            "modal_channel",
        )
    )
    accounts = settle(accounts, "accounts")
    cuts = exact_quantiles(accounts, [], "sent_rows", {"p60": 0.6, "p90": 0.9})
    tier = (
        F.when(F.col("sent_rows") <= cuts.select("p60").scalar(), "LOW")
        .when(F.col("sent_rows") <= cuts.select("p90").scalar(), "MEDIUM")
        .otherwise("HIGH")
    )
    return accounts.withColumn("tier", tier)


def account_consistency(tx: DataFrame) -> DataFrame:
    """Accounts that send from more than one region or through more than one operator."""
    pairs = tx.groupBy("sender_id", "sender_wilaya", "operator").agg(_n("n"))
    counted = pairs.groupBy("sender_id").agg(
        F.countDistinct("sender_wilaya").alias("regions"), F.countDistinct("operator").alias("operators")
    )
    return counted.filter("regions > 1 OR operators > 1")


def channel_loyalty(tx: DataFrame) -> DataFrame:
    """Most frequent channel of each account and its share of the account's rows."""
    counts = tx.groupBy("sender_id", "channel").agg(_n("n"))
    return _most_frequent(counts, "sender_id", "channel").select(
        "sender_id", "channel", F.col("all_n").alias("n"), percent(F.col("modal_n"), F.col("all_n")).alias("loyalty")
    )


def counterparties(tx: DataFrame) -> DataFrame:
    """Self-transfers and distinct other accounts, paid or paying, per account."""
    pairs = tx.groupBy("sender_id", "receiver_id").agg(_n("n"))
    sides = pairs.select(
        "n",
        F.inline(
            F.array(
                F.struct(F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("other"), F.lit(True).alias("sends")),
                F.struct(F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("other"), F.lit(False).alias("sends")),
            )
        ),
    )
    own = (F.col("account_id") == F.col("other")) & F.col("sends")
    met = sides.groupBy("account_id", "other").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("self_rows"))
    return met.groupBy("account_id").agg(
        F.sum("self_rows").alias("self_transfers"),
        F.count_if(F.col("account_id") != F.col("other")).alias("counterparties"),
    )


# ---------------------------------------------------------------- flows


def diaspora_flow(tx: DataFrame) -> DataFrame:
    """Cash-in by day class and country of origin, with the expected part from abroad."""
    weekend = is_diaspora_weekend(F.col("timestamp"))
    cash_in = tx.filter((F.col("transaction_type") == "CASH_IN") & F.col("timestamp").isNotNull())
    counts = cash_in.groupBy(
        F.when(weekend, "WEEKEND").otherwise("WEEKDAY").alias("day_class"), "origin_country"
    ).agg(_n("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
    abroad = F.sum(F.when(F.col("origin_country").isNotNull(), F.col("n")).otherwise(0)).over(
        Window.partitionBy("day_class")
    )
    total = F.sum("n").over(Window.partitionBy("day_class"))
    expected = F.lit(dimensions.DIASPORA_SHARE) * F.when(
        F.col("day_class") == "WEEKEND", F.lit(dimensions.DIASPORA_WEEKEND_FACTOR)
    ).otherwise(F.lit(1.0))
    return counts.select(
        "day_class",
        "origin_country",
        "n",
        "amount",
        percent(F.col("n"), total).alias("share"),
        percent(abroad, total).alias("abroad_share"),
        half_even(expected, 2).alias("expected_abroad_share"),
    )


def corridors(tx: DataFrame) -> DataFrame:
    """Rows, value and share per sending and receiving region.

    The flows are few and are written first, so their total costs no second scan of the table.
    """
    flows = tx.groupBy("sender_wilaya", "receiver_wilaya").agg(
        _n("n"), F.sum("amount").cast("decimal(38,2)").alias("amount")
    )
    return with_share(settle(flows, "flows"))


def corridor_matrix(tx: DataFrame) -> DataFrame:
    """Rows per sending region, one column per receiving region."""
    matrix = tx.groupBy("sender_wilaya").pivot("receiver_wilaya", contract.REGIONS).agg(F.count(F.lit(1)))
    return matrix.na.fill(0)


def operator_indicators(tx: DataFrame) -> DataFrame:
    """Rows, value, fees and shares by status per operator."""
    status = [F.count_if(F.col("status") == name).alias(name) for name in contract.STATUSES]
    counted = tx.groupBy("operator").agg(
        _n("n"),
        F.sum("amount").cast("decimal(38,2)").alias("amount"),
        F.sum("fees").cast("decimal(38,2)").alias("fees"),
        *status,
    )
    shares = [percent(F.col(name), F.col("n")).alias(f"{name.lower()}_percent") for name in contract.STATUSES]
    return counted.select("operator", "n", "amount", "fees", *shares)
