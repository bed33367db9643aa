"""Operator 2: nearest vectors by multiprobe p-stable hashing.

A table hashes a vector, scaled to length 1, by ``floor((a . v + b) / w)`` for a few Gaussian
directions a and shifts b; the values together are its cell. Every vector is in one cell of each
table. A query visits cells in the order of the estimated probability that a neighbour lies there:
a neighbour's place along a direction is taken as normal around a part of the query's place, with
the mean and the spread that the neighbours of a sample of queries have.

How many cells are visited is fitted, too: the exact neighbours of the sample are found among all
vectors, and the number of cells is the one at which ``RECALL`` of them are met in some table.

Vectors and visits meet by cell. Cells with many vectors or many visits are cut into blocks that
meet each with each; exact scores are computed where they meet, and only the best few of a block
for each query leave it. No pairs are listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from walletlens.llm.common import table, take
from walletlens.sources.work import settle

TABLES = 12
WIDTH = 2.5
CELLS_A_DIRECTION = 4
# Vectors of a cell, about, that the number of directions aims at.
CELL_ROWS = 48
MOST_DIRECTIONS = 24
RECALL = 0.97
SAMPLE = 160
# Rows of one block of a cell.
BLOCK = 4096
# Queries whose visits are listed at a time, also for the fit, and cells of a table that a query
# visits at most; queries that find too few there are compared with all vectors.
QUERY_BATCH = 64
FIT_BATCH = 8
MOST_VISITS = 4096


@dataclass(frozen=True)
class Hashes:
    """Directions and shifts of all tables, and where neighbours lie along a direction."""

    directions: np.ndarray  # tables, directions, dimensions
    shifts: np.ndarray  # tables, directions
    part: float
    spread: float
    visits: int

    def places(self, units: np.ndarray) -> np.ndarray:
        """Places of unit vectors along the directions, in widths: rows, tables, directions."""
        scale = math.sqrt(units.shape[1])
        return (np.einsum("nd,tkd->ntk", units * scale, self.directions) + self.shifts) / WIDTH

    def cells(self, units: np.ndarray) -> np.ndarray:
        values = np.clip(np.floor(self.places(units)) + CELLS_A_DIRECTION // 2, 0, CELLS_A_DIRECTION - 1)
        return values.astype(np.int64) @ _radix(values.shape[2])

    def visited(self, units: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest cells of each query and table, and the logarithms of their probabilities."""
        places = self.places(units)
        centre = (places * WIDTH - self.shifts) * self.part + self.shifts
        edges = (np.arange(1, CELLS_A_DIRECTION) - CELLS_A_DIRECTION // 2) * WIDTH
        below = _normal((edges - centre[..., None]) / self.spread)
        ends = np.concatenate([np.zeros_like(below[..., :1]), below, np.ones_like(below[..., :1])], axis=-1)
        chance = np.log(np.maximum(np.diff(ends, axis=-1), 1e-12))
        score = np.zeros((*places.shape[:2], 1))
        cell = np.zeros((*places.shape[:2], 1), np.int64)
        # A beginning that is not among the best cannot become one of the best cells.
        for direction in range(places.shape[2]):
            score = (score[..., :, None] + chance[:, :, None, direction, :]).reshape(*places.shape[:2], -1)
            cell = (cell[..., :, None] * CELLS_A_DIRECTION + np.arange(CELLS_A_DIRECTION)).reshape(*places.shape[:2], -1)
            if score.shape[2] > visits:
                best = np.argpartition(-score, visits - 1, axis=2)[..., :visits]
                score, cell = np.take_along_axis(score, best, 2), np.take_along_axis(cell, best, 2)
        order = np.argsort(-score, axis=2, kind="stable")
        return np.take_along_axis(cell, order, 2), np.take_along_axis(score, order, 2)


def _radix(directions: int) -> np.ndarray:
    return CELLS_A_DIRECTION ** np.arange(directions - 1, -1, -1, dtype=np.int64)


def _normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, by its logistic approximation."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -60, 60)))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vec of vectors that can be compared: not null, not zero, all components finite, and
    of the commonest number of dimensions (the larger of two)."""
    plain = take(vectors, id_column, vector)
    kind = plain.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    plain = plain.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = plain.where(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))
    sizes = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return good.where(F.size("vec") == (sizes[0].size if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, summed in the order of the dimensions, safe for large components."""
    most = np.abs(rows).max(axis=1)
    total = np.zeros(len(rows))
    for column in range(rows.shape[1]):
        total += (rows[:, column] / most) ** 2
    return most * np.sqrt(total)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query and row. A pair's score does not depend on its neighbours in a block."""
    left, right = queries / lengths(queries)[:, None], rows / lengths(rows)[:, None]
    total = np.zeros((len(left), len(right)))
    for column in range(left.shape[1]):
        total += left[:, column, None] * right[None, :, column]
    return np.clip(total, -1.0, 1.0)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, wanted: int) -> list[tuple]:
    """(query, id, score) of the best rows for each query, equal scores by id; not itself."""
    made = []
    scores = cosines(queries, rows)
    for number, query in enumerate(query_ids):
        others = np.flatnonzero(ids != query)
        score, other = scores[number, others], ids[others]
        if len(score) > wanted:
            edge = np.partition(score, len(score) - wanted)[len(score) - wanted]
            near = np.flatnonzero(score >= edge)
            score, other = score[near], other[near]
        order = np.lexsort((other, -score))[:wanted]
        made += zip([int(query)] * len(order), other[order].tolist(), score[order].tolist())
    return made


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), kind) for values, kind in zip(columns, kinds)], ["query_id", "vec_id", "score"]
    )


def ranked(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def exact_for(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, wanted: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries, among all vectors in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for start in range(0, len(ids), BLOCK):
                part = slice(start, start + BLOCK)
                best += best_of(query_ids, queries, ids[part], rows[part], wanted)
            yield _found(best)
            best = []

    return ranked(vectors.select("id", "vec").mapInArrow(compare, _FOUND), wanted)


def fit(vectors: DataFrame, queries: DataFrame, wanted: int, seed: int = 7) -> Hashes | None:
    """Hashes for stored vectors, with the number of visits that finds the sample's neighbours."""
    count = vectors.count()
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample or not count:
        return None
    units = np.array([row.vec for row in sample])
    ids = np.array([row.id for row in sample], np.int64)
    dimensions = units.shape[1]
    per_direction = math.log2(2.6)  # cells of one direction that are in use, about
    directions = int(np.clip(round(math.log2(max(2, count / CELL_ROWS)) / per_direction), 2, MOST_DIRECTIONS))
    random = np.random.Generator(np.random.PCG64(seed))
    directed = random.standard_normal((TABLES, directions, dimensions))
    directed /= np.sqrt((directed**2).sum(axis=2, keepdims=True))
    shifts = random.uniform(-WIDTH / 2, WIDTH / 2, (TABLES, directions))
    start = Hashes(directed, shifts, 1.0, 1.0, 1)
    near = exact_for(vectors, ids, units, wanted)
    pairs = near.join(vectors, F.col("vec_id") == F.col("id")).select("query_id", "vec").collect()
    if not pairs:
        return start
    units = units / lengths(units)[:, None]
    number = {value: place for place, value in enumerate(ids.tolist())}
    at = np.array([number[row.query_id] for row in pairs])
    found = np.array([row.vec for row in pairs])
    found = found / lengths(found)[:, None]
    x = start.places(units)[at] * WIDTH - shifts
    y = start.places(found) * WIDTH - shifts
    part = float((x * y).sum() / max((x * x).sum(), 1e-12))
    spread = float(max(np.sqrt(((y - part * x) ** 2).mean()), 0.05))
    fitted = Hashes(directed, shifts, part, spread, 1)
    listed = min(CELLS_A_DIRECTION**directions, MOST_VISITS)
    cells = fitted.cells(found)
    ranks = np.full(len(pairs), listed)
    for begin in range(0, len(ids), FIT_BATCH):
        visited, _ = fitted.visited(units[begin : begin + FIT_BATCH], listed)
        mine = np.flatnonzero((at >= begin) & (at < begin + FIT_BATCH))
        hit = visited[at[mine] - begin] == cells[mine][..., None]
        first = np.where(hit.any(axis=2), hit.argmax(axis=2), listed)
        ranks[mine] = first.min(axis=1)
    visits = int(np.quantile(ranks, RECALL, method="higher")) + 1
    return Hashes(directed, shifts, part, spread, min(visits, listed))


def nearest(
    vectors: DataFrame, is_query: Column, wanted: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The nearest vectors of each query: query_id, rank, vec_id, score (cosine).

    ``is_query`` is a condition on the column ``id``. Vectors that cannot be compared take no part
    (see ``usable``). A repeated id is a candidate once, with its best score. Equal scores go by id.
    Queries for which too few are found in the visited cells are compared with all vectors.
    """
    usable_rows = settle(usable(vectors, id_column, vector), "vectors")
    queries = usable_rows.where(is_query)
    hashes = fit(usable_rows, queries, wanted)
    if hashes is None:
        return usable_rows.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).where(F.lit(False))
    found = settle(ranked(_visited(usable_rows, queries, hashes, wanted), wanted), "vectors-found")
    counted = found.groupBy(F.col("query_id").alias("id")).count()
    short = settle(queries.join(counted.where(F.col("count") >= wanted), "id", "left_anti"), "vectors-few")
    shown = ["query_id", "rank", "vec_id", "score"]
    if short.isEmpty():
        return found.select(*shown)
    full = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return full.select(*shown).unionByName(_short(usable_rows, short, wanted).select(*shown))


def _short(vectors: DataFrame, short: DataFrame, wanted: int) -> DataFrame:
    """Exact neighbours of the queries that found too few, in blocks of queries."""
    blocks = F.pmod(F.xxhash64("id"), F.lit(64))
    left = short.select(F.lit(1).alias("kind"), blocks.cast("int").alias("cell"), "id", "vec")
    held = left.select("cell").distinct()
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell"), "id", "vec").join(
        F.broadcast(held), "cell"
    )
    rows = left.unionByName(right.select(F.lit(0).alias("kind"), "cell", "id", "vec"))
    part = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("id"), F.lit(16))).cast("int")
    spread = rows.withColumn("block", F.explode(F.when(F.col("kind") == 0, F.array(part)).otherwise(F.sequence(F.lit(0), F.lit(15)))))
    return ranked(_meet(spread.withColumn("table", F.lit(0)).withColumn("turn", F.lit(0)), wanted), wanted)


def _visited(vectors: DataFrame, queries: DataFrame, hashes: Hashes, wanted: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(hashes)

    def listed(ids: pa.Array, vecs: pa.Array, cells: np.ndarray) -> pa.RecordBatch:
        rows, tables, each = cells.shape
        take_rows = pa.array(np.repeat(np.arange(rows), tables * each))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), rows)),
                pa.array(cells.reshape(-1)), ids.take(take_rows), vecs.take(take_rows),
            ],
            ["table", "cell", "id", "vec"],
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                rows = _matrix(batch.column(1))
                cells = shared.value.cells(rows / lengths(rows)[:, None])
                yield listed(batch.column(0), batch.column(1), cells[..., None])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(begin, QUERY_BATCH)
                rows = _matrix(batch.column(1))
                cells, _ = shared.value.visited(rows / lengths(rows)[:, None], shared.value.visits)
                yield listed(batch.column(0), batch.column(1), cells)

    shape = f"table int, cell long, id long, vec {vectors.schema['vec'].dataType.simpleString()}"
    cell = ["table", "cell"]
    at_home = vectors.select("id", "vec").mapInArrow(index, shape)
    visits = queries.select("id", "vec").mapInArrow(probe, shape)
    # Cells over a block: at most one in BLOCK rows of the index or the visits.
    large = settle(
        at_home.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"),
        "vectors-blocks",
    )
    busy = settle(
        visits.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns")).where("turns > 1"),
        "vectors-turns",
    )

    def sized(rows: DataFrame) -> DataFrame:
        return (
            rows.join(large, cell, "left").join(busy, cell, "left")
            .withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "turns": F.coalesce("turns", F.lit(1))})
        )

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    left = sized(visits).select(F.lit(1).alias("kind"), *cell, "id", "vec", own("turns").alias("turn"),
                                F.explode(every("blocks")).alias("block"))
    right = sized(at_home).select(F.lit(0).alias("kind"), *cell, "id", "vec", F.explode(every("turns")).alias("turn"),
                                  own("blocks").alias("block"))
    return _meet(right.unionByName(left), wanted)


def _meet(rows: DataFrame, wanted: int) -> DataFrame:
    """Best candidates of the queries (kind 1) among the vectors (kind 0) of the same block."""
    key = ["table", "cell", "turn", "block"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = np.stack([batch.column(name).to_numpy() for name in key])
            ends = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            starts = [0, *ends.tolist(), batch.num_rows]
            for low, high in zip(starts, starts[1:]):
                part = batch.slice(low, high - low)
                if held and part.num_rows and any(held[-1].column(n)[0] != part.column(n)[0] for n in key):
                    yield from block(held)
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from block(held)

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_batches(parts)
        split = int((whole.column("kind").to_numpy() == 0).sum())
        if not 0 < split < whole.num_rows:
            return
        ids, rows = whole.column("id").to_numpy(), _matrix(whole.column("vec"))
        made = []
        for start in range(split, whole.num_rows, QUERY_BATCH):
            part = slice(start, start + QUERY_BATCH)
            made += best_of(ids[part], rows[part], ids[:split], rows[:split], wanted)
        yield _found(made)

    together = rows.select(*key, "kind", "id", "vec").repartition(*key).sortWithinPartitions(*key, "kind")
    return together.mapInArrow(compare, _FOUND)


def op2_multiprobe_p_stable(spark, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.pmod("id", F.lit(50)) == 0)
