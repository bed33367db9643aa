"""Exact quantiles per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def magnitude(value: Column) -> Column:
    """Order-keeping class of a number by its power of ten and first three digits.

    There are at most 900 classes per power of ten, so the classes of a group always fit
    into one small sort.
    """
    size = F.abs(value.cast("double"))
    power = F.floor(F.log10(size))
    digits = F.floor(size / F.pow(F.lit(10.0), power - 2))
    return F.when(size == 0, F.lit(0).cast("bigint")).otherwise(
        (F.signum(value.cast("double")) * ((power + 400) * 10000 + digits)).cast("bigint")
    )


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles; ``wanted`` maps a result name to a fraction.

    Equal values are counted before the shuffle. The classes that hold the wanted ranks
    are found from class totals, and only the values of those classes are put in order.
    """
    keys = list(group)
    values = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("class", magnitude(F.col("v")))
    )
    by_class = Window.partitionBy(*keys).orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    totals = values.groupBy(*keys, "class").agg(F.sum("n").alias("class_n"))
    totals = totals.withColumns(
        {"upto": F.sum("class_n").over(by_class), "all_n": F.sum("class_n").over(Window.partitionBy(*keys))}
    )

    def rank(fraction: float) -> Column:
        return F.lit(fraction) * (F.col("all_n") - 1)

    start = F.col("upto") - F.col("class_n")
    holds = F.lit(False)
    for fraction in wanted.values():
        for at in (F.floor(rank(fraction)), F.ceil(rank(fraction))):
            holds = holds | ((at >= start) & (at < F.col("upto")))
    kept = totals.filter(holds).select(
        *[F.col(name).alias(f"kept_{name}") for name in [*keys, "class"]], start.alias("start"), "all_n"
    )

    in_class = Window.partitionBy(*keys, "class").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # Null-safe: a null group stays, and both sides read the same counts, so these are made once.
    same = [F.col(name).eqNullSafe(F.col(f"kept_{name}")) for name in [*keys, "class"]]
    ranked = values.join(kept, same)
    ranked = ranked.withColumn("last", F.col("start") + F.sum("n").over(in_class) - 1)
    ranked = ranked.withColumn("first", F.col("last") - F.col("n") + 1)

    def value_at(at: Column) -> Column:
        return F.max(F.when(at.between(F.col("first"), F.col("last")), F.col("v").cast("double")))

    picks = []
    for name, fraction in wanted.items():
        picks += [
            value_at(F.floor(rank(fraction))).alias(f"{name}__low"),
            value_at(F.ceil(rank(fraction))).alias(f"{name}__high"),
            F.max(rank(fraction) - F.floor(rank(fraction))).alias(f"{name}__part"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * F.col(f"{name}__part")
            ).alias(name)
            for name in wanted
        ],
    )
