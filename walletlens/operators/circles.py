"""Savings circles over many rounds: the same people pay in turn for one of them each week or month.

A round is a day on which enough accounts pay one amount to one beneficiary within a circle's span
(see ``detectors.tontine``). Its people are the payers and the beneficiary. Two rounds of one amount
follow each other if as many days as a period has lie between them and their people are much the same.

The similarity join of rounds is by prefix filter: two sets that share enough share one of their
rarest people, so only these are joined, within an amount and a bin of days. Rounds of unrelated
circles never meet. Each pair that meets is checked on all its people.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from walletlens.operators.detectors import Tontine, tontine_seconds, transfers
from walletlens.operators.rolling import with_second
from walletlens.sources.work import settle

_ROUND = ["receiver_id", "amount", "day"]
_EARLIER = ["earlier_receiver", "amount", "earlier_day"]


class Rotation(NamedTuple):
    """Rounds that follow each other; the fixed values are those of a weekly circle."""

    least_days: int = 6
    most_days: int = 8
    # Common people of two rounds in percent of all people of both.
    similarity: int = 60
    least_rounds: int = 2


WEEKLY = Rotation()
MONTHLY = Rotation(27, 33)


def round_people(tx: DataFrame, limits: Tontine = Tontine()) -> DataFrame:
    """receiver_id, amount, day and member: the people of each round, the beneficiary included."""
    if not limits.same_day:
        raise ValueError("a round is of one day")
    seconds = tontine_seconds(tx, limits)
    rows = with_second(tx.filter(transfers() & F.col("sender_id").isNotNull()))
    payers = rows.join(settle(seconds, "round-seconds"), ["receiver_id", "amount", "sec"], "left_semi").select(
        "receiver_id", "amount", F.to_date("timestamp").alias("day"), F.col("sender_id").alias("member")
    ).distinct()
    beneficiaries = payers.select(*_ROUND).distinct().withColumn("member", F.col("receiver_id"))
    return payers.unionByName(beneficiaries).distinct()


def _rare_people(people: DataFrame, rotation: Rotation) -> DataFrame:
    """The people of each round that one of every similar enough round is among, and its size.

    A round of n people that has at least s percent in common with another shares one of its
    n - ceil(s n / 100) + 1 rarest; rare is by the rounds of the amount that a person is in.
    """
    known = people.groupBy("amount", "member").agg(F.count(F.lit(1)).alias("rounds"))
    size = people.groupBy(*_ROUND).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*_ROUND).orderBy("rounds", "member")
    ranked = people.join(known, ["amount", "member"]).withColumn("rank", F.row_number().over(order)).join(size, _ROUND)
    return ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * rotation.similarity / 100) + 1)


def similar_rounds(people: DataFrame, rotation: Rotation = WEEKLY) -> DataFrame:
    """receiver_id, amount, day, earlier_receiver, earlier_day, common and similarity of rounds that
    follow each other, from a written table of people."""
    rare = settle(_rare_people(people, rotation).select(*_ROUND, "member", "n"), "round-rare")
    number, width = F.unix_date("day"), rotation.most_days

    def bin_of(day: Column) -> Column:
        return F.floor(day / width)

    earlier = rare.select(
        F.col("receiver_id").alias("earlier_receiver"), "amount", F.col("day").alias("earlier_day"), "member",
        F.col("n").alias("earlier_n"), bin_of(number).alias("bin"),
    )
    later = rare.withColumn("bin", F.explode(F.sequence(bin_of(number - width), bin_of(number - rotation.least_days))))
    apart = F.datediff("day", "earlier_day")
    pairs = (
        later.join(earlier, ["amount", "member", "bin"])
        .filter(apart.between(rotation.least_days, rotation.most_days))
        .select(*_ROUND, "n", "earlier_receiver", "earlier_day", "earlier_n")
        .distinct()
    )
    own = pairs.join(people, _ROUND)
    old = people.select(F.col("receiver_id").alias("earlier_receiver"), "amount", F.col("day").alias("earlier_day"), "member")
    both = (
        own.join(old, [*_EARLIER, "member"])
        .groupBy(*_ROUND, "n", "earlier_receiver", "earlier_day", "earlier_n")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    whole = F.col("n") + F.col("earlier_n") - F.col("common")
    return both.filter(100 * F.col("common") >= rotation.similarity * whole).select(
        *_ROUND, "earlier_receiver", "earlier_day", "common", (F.col("common") / whole).alias("similarity")
    )


def _chains(links: DataFrame) -> DataFrame:
    """root_receiver and root_day of each round that follows another; each round follows its most similar
    earlier one, of equal ones the latest, then the first by name. Each step doubles the reach."""
    best = F.min(
        F.struct((-F.col("similarity")).alias("s"), (-F.unix_date("earlier_day")).alias("d"), F.col("earlier_receiver").alias("r"))
    ).alias("best")
    up = links.groupBy(*_ROUND).agg(best).select(
        *_ROUND, F.col("best.r").alias("root_receiver"), F.date_from_unix_date(-F.col("best.d")).alias("root_day")
    )
    up = settle(up, "round-roots")
    while True:
        above = up.select(
            F.col("receiver_id").alias("root_receiver"), "amount", F.col("day").alias("root_day"),
            F.col("root_receiver").alias("top_receiver"), F.col("root_day").alias("top_day"),
        )
        moved = settle(up.join(above, ["root_receiver", "amount", "root_day"], "left"), "round-moved")
        if moved.filter("top_day IS NOT NULL").isEmpty():
            return up
        up = settle(
            moved.select(
                *_ROUND, F.coalesce("top_receiver", "root_receiver").alias("root_receiver"),
                F.coalesce("top_day", "root_day").alias("root_day"),
            ),
            "round-roots",
        )


def _turns(people: DataFrame, rotation: Rotation) -> tuple[DataFrame, DataFrame]:
    """Rounds of circles with their root and number of people, and the people of each circle."""
    root = ["root_receiver", "amount", "root_day"]
    roots = _chains(similar_rounds(people, rotation))
    first = roots.select(*root).distinct()
    firsts = first.select(F.col("root_receiver").alias("receiver_id"), "amount", F.col("root_day").alias("day"), "root_receiver", "root_day")
    members = settle(people.join(roots.unionByName(firsts), _ROUND), "circle-people")
    turns = members.groupBy(*root, "receiver_id", "day").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.select(*root, "member").distinct().groupBy(*root).agg(F.count(F.lit(1)).alias("n_members"))
    return turns, sizes


def circle_turns(tx: DataFrame, limits: Tontine = Tontine(), rotation: Rotation = WEEKLY) -> DataFrame:
    """One row per round of a circle: first_beneficiary and first_day of the circle, turn (from 1), day,
    beneficiary, payers, and missing: people of the circle who neither paid nor were paid."""
    people = settle(round_people(tx, limits), "round-people")
    turns, sizes = _turns(people, rotation)
    root = ["root_receiver", "amount", "root_day"]
    order = Window.partitionBy(*root).orderBy("day", "receiver_id")
    numbered = turns.withColumn("turn", F.row_number().over(order)).join(sizes, root)
    enough = numbered.withColumn("rounds", F.count(F.lit(1)).over(Window.partitionBy(*root)))
    return enough.filter(F.col("rounds") >= rotation.least_rounds).select(
        F.col("root_receiver").alias("first_beneficiary"), F.col("root_day").alias("first_day"), "amount", "turn", "day",
        F.col("receiver_id").alias("beneficiary"), (F.col("n") - 1).alias("payers"), (F.col("n_members") - F.col("n")).alias("missing"),
    )


def savings_circles(tx: DataFrame, limits: Tontine = Tontine(), rotation: Rotation = WEEKLY) -> DataFrame:
    """One row per circle: its rounds, people, days, beneficiaries in turn, how many of them were paid
    more than once, and payments that are missing."""
    turns = settle(circle_turns(tx, limits, rotation), "circle-turns")
    circle = ["first_beneficiary", "first_day", "amount"]
    in_turn = F.expr("listagg(beneficiary, ',') WITHIN GROUP (ORDER BY turn)")
    return turns.groupBy(*circle).agg(
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("rounds"),
        (F.max(F.col("payers") + F.col("missing")) + 1).alias("people"),
        in_turn.alias("beneficiaries"),
        (F.count(F.lit(1)) - F.count_distinct("beneficiary")).alias("repeated_turns"),
        F.sum("missing").alias("missing_payments"),
    )
