"""Operator 3: a consistent-hash ring with virtual nodes and bounded loads, in SQL functions.

The ring is cut into a fixed number of cells. Every shard has virtual nodes in some cells; a key
hashes to a cell and belongs to the shard of the next virtual node clockwise. A shard takes rows
up to its bound; rows beyond it go on clockwise to the next shard with room.

Rows are counted by cell, so the walk around the ring is over a table of ``CELLS`` rows at any
size of the input: for each cell, in a fixed mixed order, how many of its rows each shard takes.
Rows are then numbered inside their cell, block by block, and a row's number decides its shard
and its slot there. No task sees a whole shard or all rows of a repeated key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from walletlens.llm.common import numbered, settled_with_key, table, take

CELLS = 4096
VIRTUAL_NODES = 64
SHARDS = 16


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """For each cell, all shards in the order in which a key meets them clockwise.

    A table of ``CELLS`` rows. A further shard changes the first place only where it comes in.
    """
    nodes = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .select("shard", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("node"))
        .select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "node"), F.lit(CELLS)).alias("at"))
    )
    # Fixed sizes: one row that lists the nodes of each shard, then a row for each cell.
    per_shard = nodes.groupBy("shard").agg(F.sort_array(F.collect_set("at")).alias("at"))
    every = F.array_sort(F.collect_list(F.struct("shard", "at")))
    listed = per_shard.agg(every.alias("all"))
    distance = F.transform(
        "all",
        lambda one: F.struct(
            F.array_min(F.transform(one["at"], lambda at: F.pmod(at - F.col("cell"), F.lit(CELLS)))).alias("steps"),
            F.xxhash64(one["shard"], F.col("cell")).alias("tie"),
            one["shard"].alias("shard"),
        ),
    )
    cells = listed.select("all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))).alias("cell"))
    ways = cells.select("cell", F.array_sort(distance).alias("way"))
    return ways.select("cell", F.transform("way", lambda one: one["shard"]).alias("way"))


def _bounds(total: Column, shards: int, slack: float) -> Column:
    """How many rows each shard may take. Without slack the bounds sum to the number of rows."""
    exact = F.sequence(F.lit(0), F.lit(shards - 1))
    if not slack:
        return F.transform(
            exact,
            lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0).cast("long"),
        )
    return F.transform(exact, lambda s: F.ceil(total * F.lit(1 + slack) / shards).cast("long"))


def shares(counts: DataFrame, ways: DataFrame, shards: int, slack: float) -> DataFrame:
    """For each cell, the ranges of its rows by shard: first, end, shard and the first slot there.

    ``counts`` has cell and n. One row holds all cells, at most ``CELLS`` of them.
    """
    joined = counts.join(ways, "cell").select(
        F.struct(F.xxhash64(F.lit("turn"), "cell").alias("turn"), "cell", "n", "way").alias("c")
    )
    one = joined.agg(F.array_sort(F.collect_list("c")).alias("cells"), F.coalesce(F.sum("c.n"), F.lit(0)).alias("total"))
    one = one.select("cells", _bounds(F.col("total"), shards, slack).alias("bound"))
    empty_range = F.struct(
        F.lit(0).cast("long").alias("cell"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("first"),
        F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("slot"),
    )
    start = F.struct(
        F.transform("bound", lambda _: F.lit(0).cast("long")).alias("load"),
        F.filter(F.array(empty_range), lambda _: F.lit(False)).alias("ranges"),
    )

    def turn(state: Column, cell: Column) -> Column:
        room = F.transform(cell["way"], lambda s: F.col("bound")[s] - state["load"][s])
        # Room of the shards met before each one on the way; the row numbers a shard takes
        # start there and end after its own room, both at most the cell's count.
        walk = F.aggregate(
            F.arrays_zip(cell["way"].alias("way"), room.alias("room")),
            F.struct(F.lit(0).cast("long").alias("met"), state["ranges"].alias("ranges"), state["load"].alias("load")),
            lambda at, step: F.when(
                (step["room"] > 0) & (at["met"] < cell["n"]),
                F.struct(
                    F.least(at["met"] + step["room"], cell["n"]).alias("met"),
                    F.concat(
                        at["ranges"],
                        F.array(
                            F.struct(
                                cell["cell"].alias("cell"), step["way"].alias("shard"), at["met"].alias("first"),
                                F.least(at["met"] + step["room"], cell["n"]).alias("end"),
                                at["load"][step["way"]].alias("slot"),
                            )
                        ),
                    ).alias("ranges"),
                    F.transform(
                        at["load"],
                        lambda load, s: F.when(
                            s == step["way"], load + F.least(step["room"], cell["n"] - at["met"])
                        ).otherwise(load),
                    ).alias("load"),
                ),
            ).otherwise(at),
        )
        return F.struct(walk["load"].alias("load"), walk["ranges"].alias("ranges"))

    ranges = one.select(F.explode(F.aggregate("cells", start, turn, lambda state: state["ranges"])).alias("r"))
    return (
        ranges.select("r.*")
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("first", "end", "shard", "slot"))).alias("ranges"))
    )


def assigned(rows: DataFrame, key: list[str], shards: int = SHARDS, slack: float = 0.0,
             virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to the rows.

    A null key is a key. Repeated keys and rows share a cell and may be split between shards when
    one is full. ``slack`` is how far a shard may exceed the mean, 0 for counts at most one apart;
    more slack moves fewer rows when a shard comes in. An empty table stays empty.
    The rows are written once, as they are read three times; give narrow ones. Columns that are
    called shard, slot, cell, ranges or begin with an underscore are replaced or dropped.
    """
    spark = rows.sparkSession
    own = {"shard", "slot", "cell", "ranges"}
    rows = rows.select(*[F.col(f"`{name}`") for name in rows.columns if name not in own and name[:1] != "_"])
    cell = F.pmod(F.xxhash64(F.lit("key"), *[F.col(f"`{name}`") for name in key]), F.lit(CELLS))
    settled = settled_with_key(rows.withColumn("_cell", cell), "shards")
    counts = settled.groupBy(F.col("_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # At most CELLS rows.
    plan = F.broadcast(shares(counts, ring(spark, shards, virtual_nodes), shards, slack))
    ranked = numbered(settled, ["_cell"], "_number").join(plan, F.col("_cell") == F.col("cell"))
    mine = F.filter("ranges", lambda r: (r["first"] <= F.col("_number")) & (F.col("_number") < r["end"]))[0]
    return (
        ranked.withColumn("_mine", mine)
        .withColumn("shard", F.col("_mine.shard"))
        .withColumn("slot", F.col("_mine.slot") + F.col("_number") - F.col("_mine.first"))
        .drop("_mine", "_number", "_cell", "_file", "_index", "cell", "ranges")
    )


def op3_bounded_ring(spark, folder: str) -> DataFrame:
    docs = take(table(spark, folder, "documents"), "doc_id", "text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return assigned(rows, ["doc_id"]).withColumn("grown_shard", F.lit(None).cast("int"))
