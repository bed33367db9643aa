"""Operator 10: temperature mixing of sources, in SQL functions.

A source's share of the tokens is raised to an exponent from 1 (shares as they are) to 0 (all
sources alike). The exponent is found by nested intervals over the table of sources, and the
weights make a token budget for each source. The budget is realised in epochs: whole epochs take
every row of the source, and the last one takes rows in the order of a block permutation until
the budget is used up.

A source of any size is cut into blocks of about ``BLOCK_TOKENS``. Sums run over the blocks of a
source and over the rows of a block, never over all rows of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from walletlens.llm.common import ROW_KEY, growing, stored, table, take
from walletlens.sources.work import settle

ENTROPY = 0.9
REPEATS = 4.0
BLOCK_TOKENS = 65_536
SEED = 11

# Points of an exponent interval that one pass over the sources evaluates; each pass keeps the
# part between two of them.
POINTS = 16
PASSES = 8


def token_count(text: Column) -> Column:
    """Words of the text and one for its end, so that no row is free."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def source_key(source: Column) -> Column:
    """Text that keeps a null source apart from every other."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def exponent(sources: DataFrame, total: int, budget: int, entropy: float | None, repeats: float | None) -> float:
    """The largest exponent that meets the entropy, raised as far as the repetition limit needs.

    ``sources`` has n_tokens, all positive. Entropy is relative to that of equal weights. A lower
    exponent has a higher entropy and repeats small sources more often, so both are bisected.
    """

    def measured(points: list[float]) -> list[tuple[float, float]]:
        share = F.col("n_tokens") / F.lit(float(total))
        rows = (
            sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("e"))
            .groupBy("e")
            .agg(
                F.sum(F.pow("p", "e")).alias("z"),
                F.sum(F.pow("p", "e") * F.log("p")).alias("s"),
                F.max(F.pow("p", F.col("e") - 1)).alias("m"),
                F.count(F.lit(1)).alias("n"),
            )
            .collect()
        )
        found = {}
        for row in rows:
            height = (math.log(row.z) - row.e * row.s / row.z) / math.log(row.n) if row.n > 1 else 1.0
            found[row.e] = (height, row.m / row.z * budget / total)
        return [found[point] for point in points]

    def edge(good, low: float, high: float) -> float:
        """The last point before ``good`` ends, going from ``low``, which is good, to ``high``."""
        for _ in range(PASSES):
            points = [low + (high - low) * step / POINTS for step in range(POINTS + 1)]
            if len(set(points)) < len(points):
                break
            meets = [good(at) for at in measured(points)]
            last = max((place for place, fine in enumerate(meets) if fine), default=0)
            if last == POINTS:
                return points[last]
            low, high = points[last], points[last + 1]
        return low

    at = 1.0
    if entropy is not None:
        at = edge(lambda m: m[0] >= entropy, 0.0, 1.0)
    if repeats is not None and measured([at])[0][1] > repeats:
        # At exponent 1 every source is repeated budget / total times.
        at = edge(lambda m: m[1] <= repeats, 1.0, at)
    return at


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float | None = ENTROPY,
    repeats: float | None = REPEATS,
    seed: int = SEED,
    source: str = "source",
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """The rows of the mixture: one for each row and epoch that takes it.

    ``budget`` in tokens, without it the tokens of the input. Columns: the id, the source,
    n_tokens, the source's weight, epoch from 1, and block_turn and row_turn, whose order inside
    an epoch is the permutation; and the row key. A source never exceeds its budget; it misses it
    by less than the row that comes next.
    A null source is a source of its own, rows with null or empty text have one token, repeated
    rows count each for itself, an empty table gives no rows.
    """
    plain = take(stored(docs, "mix"), id_column, source, text, key=True)
    rows = settle(
        plain.select(
            id_column, source, source_key(F.col(source)).alias("_source"),
            token_count(F.col(text)).alias("n_tokens"), *ROW_KEY,
        ),
        "mix-rows",
    )
    sources = settle(rows.groupBy("_source").agg(F.sum("n_tokens").alias("n_tokens")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return _made(rows.withColumns({"weight": F.lit(0.0), "epoch": F.lit(1), "_block": F.lit(0)}), id_column, source, seed)
    budget = total if budget is None else budget
    e = exponent(sources, total, budget, entropy, repeats)
    raised = F.pow(F.col("n_tokens") / F.lit(float(total)), F.lit(e))
    scale = sources.agg(F.sum(raised)).first()[0]
    planned = settle(
        sources.select(
            "_source",
            (raised / F.lit(scale)).alias("weight"),
            F.round(raised / F.lit(scale) * F.lit(float(budget))).cast("long").alias("_quota"),
            F.col("n_tokens").alias("_all"),
        ).select(
            "_source",
            "weight",
            F.floor(F.col("_quota") / F.col("_all")).cast("int").alias("_whole"),
            F.pmod("_quota", "_all").alias("_rest"),
            F.ceil(F.col("_all") / F.lit(BLOCK_TOKENS)).cast("long").alias("_blocks"),
        ),
        "mix-plan",
    )
    dealt = rows.join(planned, "_source").withColumn(
        "_block", F.pmod(F.xxhash64(F.lit(seed), *ROW_KEY), F.col("_blocks"))
    )
    last = F.col("_whole") + 1
    blocks = dealt.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("_sum"), F.max("_whole").alias("_whole"))
    earlier = (
        Window.partitionBy("_source")
        .orderBy(_block_turn(seed, last), "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = blocks.select("_source", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy("_source", "_block")
        .orderBy(_row_turn(seed, last), *ROW_KEY)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ended = dealt.withColumn("_inside", F.sum("n_tokens").over(inside)).join(before, ["_source", "_block"])
    taken = F.col("_before") + F.col("_inside") <= F.col("_rest")
    epochs = F.col("_whole") + taken.cast("int")
    return _made(
        ended.withColumn("_epochs", epochs)
        .where("_epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_epochs")))),
        id_column, source, seed,
    )


def _block_turn(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("block"), "_source", epoch, "_block")


def _row_turn(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("row"), epoch, *ROW_KEY)


def _made(rows: DataFrame, id_column: str, source: str, seed: int) -> DataFrame:
    epoch = F.col("epoch")
    return rows.select(
        id_column, source, "n_tokens", "weight", "epoch",
        _block_turn(seed, epoch).alias("block_turn"), _row_turn(seed, epoch).alias("row_turn"), *ROW_KEY,
    )


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, all columns kept."""
    kept = stored(docs, "mix")
    chosen = mix(kept, **settings).select(*ROW_KEY)
    names = kept.columns
    keyed = take(kept.toDF(*[f"d{place}" for place in range(len(names))]),
                 *[f"d{place}" for place in range(len(names))], key=True)
    return keyed.join(growing(chosen), ROW_KEY).drop(*ROW_KEY).toDF(*names)


def op10_temperature_mixing(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop(*ROW_KEY)
