"""One JSON array per file, read by many tasks.

A file is cut at each closing brace, in byte blocks as any text file, even if it is one line. Whether a
piece begins inside a string, and how deep it is nested, depends on all that comes before it. So for
each piece and each block two things are summed up: its quotes, and what it adds to the depth if it
begins outside and if it begins inside a string. Blocks of a file are few; their sums are put in a row,
which gives the state at the start of each block, and pieces follow inside their block. A brace that
closes an element of the array ends an object; pieces up to it are put together, over block borders too.

A quote that is escaped opens nothing, and no escape can stand before a closing brace in JSON, so
none goes over a cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from walletlens.sources.work import settle

_CLOSING = "}"


def _opened(text: Column) -> Column:
    """Opening less closing brackets of a text without strings; closing braces are the cuts."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, value, quotes, and the depth that a piece adds from outside and inside a string."""
    raw = spark.read.option("lineSep", _CLOSING).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    cut = raw.withColumn("quotes", F.size(parts) - 1)
    closes = F.when(F.col("quotes") % 2 == 0, 1).otherwise(0)
    return settle(
        cut.withColumns(
            {
                "outside": _opened(F.array_join(F.filter(parts, lambda part, at: at % 2 == 0), "")) - closes,
                "inside": _opened(F.array_join(F.filter(parts, lambda part, at: at % 2 == 1), "")) - (1 - closes),
            }
        ),
        "json-pieces",
    )


def _before(total: Column, window) -> Column:
    return F.coalesce(F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0) and text of each object of the arrays, one array per file.

    Elements that are no objects, text behind the array and a file that ends too early are errors.
    """
    in_block, blocks_of = Window.partitionBy("file", "block").orderBy("seq"), Window.partitionBy("file").orderBy("block")
    pieces = _pieces(spark, path).withColumn("own", _before(F.col("quotes"), in_block) % 2)
    first, second = (F.when(F.col("own") == state, F.col("outside")).otherwise(F.col("inside")) for state in (0, 1))
    pieces = pieces.withColumns({"added": first, "added_inside": second})
    blocks = pieces.groupBy("file", "block").agg(*[F.sum(name).alias(f"all_{name}") for name in ("quotes", "added", "added_inside")])
    blocks = blocks.withColumn("start", _before(F.col("all_quotes"), blocks_of) % 2)
    grown = F.when(F.col("start") == 0, F.col("all_added")).otherwise(F.col("all_added_inside"))
    whole = Window.partitionBy("file")
    # The last piece has no brace behind it and was counted with one.
    ended = (F.sum("grown").over(whole) == -1) & (F.sum("all_quotes").over(whole) % 2 == 0)
    blocks = blocks.withColumn("grown", grown).withColumns({"depth": _before(F.col("grown"), blocks_of), "ended": ended})
    known = pieces.join(blocks.select("file", "block", "start", "depth", "ended"), ["file", "block"])
    added = F.when(F.col("start") == 0, F.col("added")).otherwise(F.col("added_inside"))
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    outside = (F.col("own") + F.col("start") + F.col("quotes")) % 2 == 0
    known = known.withColumn("added", added).withColumn("after", F.col("depth") + F.sum("added").over(upto)).withColumn(
        "ends", (outside & (F.col("after") == 1)).cast("int")
    )
    # Where the array is closed nothing but its bracket may stand.
    rest = (F.col("after") == -1) & outside & ~F.col("value").rlike(r"\A[\s﻿]*\[?\s*\]\s*\z")
    broken = F.raise_error(F.lit("no array of objects, or a file that ends too early")).cast("string")
    known = settle(
        known.select(
            "file", "block", "seq", "ends", F.when(~F.col("ended") | rest | (F.col("after") < -1), broken).otherwise(F.col("value")).alias("value")
        ),
        "json-states",
    )
    counts = known.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    counts = counts.select("file", "block", _before(F.col("n"), blocks_of).alias("earlier"))
    numbered = known.join(counts, ["file", "block"]).withColumn("number", F.col("earlier") + _before(F.col("ends"), in_block))
    text = F.expr("listagg(value || '}', '') WITHIN GROUP (ORDER BY block, seq)")
    objects = numbered.groupBy("file", "number").agg(text.alias("value"), F.max("ends").alias("ends")).filter("ends = 1")
    return objects.select("file", "number", F.regexp_replace("value", r"\A[\s\[,﻿]+", "").alias("value"))


def read_json_array(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the objects as text; a column that an object lacks is null."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    parsed = array_objects(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("row.*")
