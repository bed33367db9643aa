"""Operator 6: MinHash near-duplicates by tensored banding, with links confirmed on full sets.

Two collections of ``HALVES`` half keys are made, each half key from ``PER_HALF`` minima. A table
is a pair of a half key of the first and one of the second collection, so ``HALVES`` squared
tables of ``2 * PER_HALF`` minima each need only ``2 * HALVES * PER_HALF`` minima: the square root
of the work. A pair of sets of similarity s shares a table with probability
(1 - (1 - s ** PER_HALF) ** HALVES) ** 2, which is 0.9995 at 0.75, 0.9999 at 0.8 and closer to 1
above. Only half keys that at least two sets share are paired.

Documents of one set are one node. Inside a table, nodes of one key are ordered by their minima,
and each is compared with the next few; the order starts at another minimum in each table. So a
key of any size gives a number of candidates in proportion to it, the most similar sets come side
by side again and again, and no group is collected. Candidates are confirmed on full shingle sets.

What the order leaves out is made up for. Keys with more nodes than are compared and more than one
component so far are crowds; nodes that crowds connect are a family. The full sets of a family are
dealt to a few blocks, and all pairs of two blocks that are in different components are compared
inside one task: tiles of pairs that cannot be similar enough by their sizes and minima are passed
over, the sets of the rest are intersected as products of matrices. A task joins components as
it finds links and lets out one link for each join, so what leaves it grows with the family only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from walletlens.llm.common import ROW_KEY, growing, stored, table, take, union_all
from walletlens.sources.work import settle

SHINGLE = 5
PERCENT = 75

HALVES = 10
PER_HALF = 2
MINIMA = 2 * HALVES * PER_HALF

# Following nodes of a key that a node is compared with.
NEIGHBOURS = 4
# Blocks of a family with more nodes than ``FEW``; more only where a block would hold more than
# ``BLOCK_SHINGLES`` shingles on average. A set is sent once for each block of its family.
BLOCKS = 8
FEW = 512
BLOCK_SHINGLES = 1 << 21
# Nodes whose pairs are compared at a time, columns of a product, and pairs that are not worth one.
TILE = 256
COLUMNS = 4096
SINGLY = 32
# Equal minima, of ``MINIMA``, below which a pair is not confirmed: 4.4 standard errors below the
# mean at the wanted similarity.
LEAST_EQUAL = 18

# Remembered words of a worker.
REMEMBERED = 300_000
# Shingles that are hashed at a time.
STRIDE = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _constants(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, count, dtype=np.uint64)


FACTORS = _constants(MINIMA, 1) | np.uint64(1)
TERMS = _constants(MINIMA, 2)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of the words of a whole text, lower-cased in A-Z only.

    A text of fewer words than a shingle has its whole sequence as the only one.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    windows = len(words) - width + 1
    made = np.full(windows, width, np.uint64)
    for shift in range(width):
        made = mixed(made * _MULTIPLIER + hashed[shift : shift + windows])
    return np.unique(made)


def minima(values: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, values.size, STRIDE):
        part = values[None, start : start + STRIDE] * FACTORS[:, None] + TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """The half keys of both collections; a key does not depend on its place."""
    parts = least.reshape(2 * HALVES, PER_HALF)
    key = np.zeros(2 * HALVES, np.uint64)
    for column in range(PER_HALF):
        key = mixed(key * _MULTIPLIER + parts[:, column])
    return key.astype(np.int64)


def signatures(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """For each row of a stored table: the id, the row key, n_shingles, and for a text with words
    the digest of its set, its half keys and a byte of each minimum."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, marks = [], [], [], []
            for value in batch.column(3).to_pylist():
                found = shingles(value)
                sizes.append(found.size)
                if not found.size:
                    digests.append(None), keys.append(None), marks.append(None)
                    continue
                least = minima(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(half_keys(least))
                marks.append(mixed(least).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()),
                ],
                ["id", *ROW_KEY, "n_shingles", "digest", "keys", "marks"],
            )

    plain = take(docs, id_column, text, key=True)
    kind = plain.schema[id_column].dataType.simpleString()
    return plain.select(F.col(id_column).alias("id"), *ROW_KEY, F.col(text).cast("binary").alias("text")).mapInArrow(
        sign,
        f"id {kind}, _file long, _index long, n_shingles long, digest binary, keys array<long>, marks binary",
    )


def shared_halves(nodes: DataFrame) -> DataFrame:
    """The half keys of each node that another node has too, left and right, with what ``nodes`` knows.

    ``nodes`` has digest, n_shingles, keys and marks, one row for each digest.
    """
    single = nodes.select("digest", F.posexplode("keys").alias("at", "key"))
    shared = single.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "key")
    halves = single.join(growing(shared), ["at", "key"]).groupBy("digest").agg(
        F.collect_list(F.when(F.col("at") < HALVES, F.struct("at", "key"))).alias("left"),
        F.collect_list(F.when(F.col("at") >= HALVES, F.struct("at", "key"))).alias("right"),
    )
    known = nodes.select("digest", "n_shingles", "marks")
    return settle(
        halves.where((F.size("left") > 0) & (F.size("right") > 0)).join(growing(known), "digest"), "near-halves"
    )


def _tables(paired: DataFrame, *columns: str) -> DataFrame:
    """A row for each table of a node: the table, l and r, and the columns."""
    tables = paired.select(*columns, F.explode("left").alias("l"), "right").select(
        *columns, "l", F.explode("right").alias("r")
    )
    return tables.select(
        (F.col("l.at") * HALVES + F.col("r.at") - HALVES).cast("int").alias("table"),
        F.xxhash64("l.key", "r.key").alias("key"),
        *columns,
    )


def candidates(paired: DataFrame) -> DataFrame:
    """Distinct pairs of digests, the smaller first, that come close in a table."""
    turn = F.pmod(F.col("table") * 7, F.lit(MINIMA))
    rows = _tables(paired, "marks", "digest", "n_shingles").withColumn(
        "marks", F.concat(F.substr("marks", turn + 1, F.lit(MINIMA)), F.substr("marks", F.lit(1), turn))
    )
    # A key is in one partition: it has a hundredth of the rows at most, and is read as a stream.
    ordered = rows.repartition("table", "key").sortWithinPartitions("table", "key", "marks", "digest")
    return ordered.mapInArrow(_neighbours, "one binary, other binary").distinct()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows at most ``NEIGHBOURS`` apart that may be similar enough."""
    tail: pa.RecordBatch | None = None
    for batch in batches:
        old = 0 if tail is None else tail.num_rows
        rows = batch if tail is None else pa.concat_batches([tail, batch])
        if not rows.num_rows:
            continue
        tail = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
        tables, keys, sizes = (rows.column(name).to_numpy() for name in ("table", "key", "n_shingles"))
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, MINIMA)
        digests = np.array(rows.column("digest").to_pylist(), dtype=object)
        for apart in range(1, min(NEIGHBOURS, rows.num_rows - 1) + 1):
            first, second = slice(0, -apart), slice(apart, None)
            small, large = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
            good = (tables[first] == tables[second]) & (keys[first] == keys[second])
            good &= (100 * small >= PERCENT * large) & (np.arange(apart, rows.num_rows) >= old)
            at = np.flatnonzero(good)
            at = at[(marks[at] == marks[at + apart]).sum(axis=1) >= LEAST_EQUAL]
            pairs = [sorted(pair) for pair in zip(digests[at], digests[at + apart])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())],
                ["one", "other"],
            )


def texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """digest and text of each node of the pairs; no other text is read again."""
    wanted = union_all([pairs.select(F.col(name).alias("digest")) for name in ("one", "other")]).distinct()
    places = settle(nodes.select("digest", *ROW_KEY).join(growing(wanted), "digest"), "near-places")
    return settle(
        take(docs, text, key=True)
        .select(F.col(text).cast("binary").alias("text"), *ROW_KEY)
        .join(growing(places), ROW_KEY)
        .select("digest", "text"),
        "near-texts",
    )


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = settle(pairs, "near-pairs")
    texts = texts_of(pairs, nodes, docs, text)
    first = texts.select(F.col("digest").alias("one"), F.col("text").alias("text_one"))
    second = texts.select(F.col("digest").alias("other"), F.col("text").alias("text_other"))
    both = pairs.join(growing(first), "one").join(growing(second), "other")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = shingles(one), shingles(other)
                common = np.intersect1d(a, b, assume_unique=True).size
                good.append(100 * common >= PERCENT * (a.size + b.size - common))
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield kept

    return both.select("one", "other", "text_one", "text_other").mapInArrow(confirm, "one binary, other binary")


def components(links: DataFrame) -> DataFrame:
    """node and label, one node of its component, for each node that has a link.

    In a round each node joins its smallest neighbour, and that one's; then links between joined
    nodes go and equal links become one. So later rounds work on few links.
    """
    edges = settle(links.select(F.col("one").alias("node"), F.col("other").alias("peer")), "near-edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("peer").alias("node"), F.col("node").alias("peer")))
        least = ends.groupBy("node").agg(F.min("peer").alias("up"))
        up = settle(least.select("node", F.least("node", "up").alias("up")), "near-up")
        second = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hop = settle(up.join(growing(second), "up").select("node", F.col("top").alias("up")), "near-hop")
        if labels is None:
            labels = hop.select("node", F.col("up").alias("label"))
        else:
            moved = hop.select(F.col("node").alias("label"), "up")
            labels = labels.join(growing(moved), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = settle(labels, "near-labels")
        far = hop.select(F.col("node").alias("peer"), F.col("up").alias("peer_up"))
        joined = edges.join(growing(hop), "node").join(growing(far), "peer").where(F.col("up") != F.col("peer_up"))
        edges = settle(
            joined.select(F.least("up", "peer_up").alias("node"), F.greatest("up", "peer_up").alias("peer")).distinct(),
            "near-edges",
        )
    if labels is None:
        return edges.select("node", F.col("peer").alias("label"))
    return labels


class Tiles:
    """The sets of a block, cut into tiles, with distinct shingles of each tile."""

    def __init__(self, members: np.ndarray, sets: list[np.ndarray]) -> None:
        self.tiles = [members[start : start + TILE] for start in range(0, members.size, TILE)]
        self.sets = sets
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles, and the place there and the row of each shingle of each set."""
        if tile not in self.known:
            own = [self.sets[member] for member in self.tiles[tile].tolist()]
            values, place = np.unique(np.concatenate(own), return_inverse=True)
            rows = np.repeat(np.arange(len(own), dtype=np.int32), [found.size for found in own])
            self.known[tile] = values, place.astype(np.int32), rows
        return self.known[tile]


def _common(left: Tiles, a: int, right: Tiles, b: int) -> np.ndarray:
    """Sizes of the intersections of all sets of two tiles."""
    values, place, rows = left.shingles(a)
    other_values, other_place, other_rows = right.shingles(b)
    shared, at, other_at = np.intersect1d(values, other_values, assume_unique=True, return_indices=True)
    common = np.zeros((left.tiles[a].size, right.tiles[b].size), np.float32)
    column, other_column = np.full(values.size, -1, np.int64), np.full(other_values.size, -1, np.int64)
    column[at], other_column[other_at] = np.arange(shared.size), np.arange(shared.size)
    column, other_column = column[place], other_column[other_place]
    for start in range(0, shared.size, COLUMNS):
        parts = []
        for found, row, count in ((column, rows, common.shape[0]), (other_column, other_rows, common.shape[1])):
            inside = np.flatnonzero((found >= start) & (found < start + COLUMNS))
            part = np.zeros((count, min(COLUMNS, shared.size - start)), np.float32)
            part[row[inside], found[inside] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return common.astype(np.int64)


def _join_blocks(rows: pa.Table) -> pa.Table:
    """Links between components of two blocks of a family, one for each join of two components."""
    rows = rows.combine_chunks()
    own, low, high = (rows.column(name).to_numpy() for name in ("own", "low", "high"))
    names, roots = np.unique(np.array(rows.column("label").to_pylist(), dtype=object), return_inverse=True)
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, MINIMA)
    sets = [np.frombuffer(found, np.uint64) for found in rows.column("shingles").to_pylist()]
    sizes = np.array([found.size for found in sets], np.int64)
    order = np.lexsort((sizes, roots))
    left = Tiles(order[own[order] == low[order]], sets)
    right = left if low[0] == high[0] else Tiles(order[own[order] == high[order]], sets)
    ones, others = [], []
    for a, first in enumerate(left.tiles):
        for b in range(a if right is left else 0, len(right.tiles)):
            second = right.tiles[b]
            good = roots[first][:, None] != roots[second][None, :]
            good &= 100 * np.minimum.outer(sizes[first], sizes[second]) >= PERCENT * np.maximum.outer(sizes[first], sizes[second])
            if not good.any():
                continue
            equal = np.zeros(good.shape, np.uint8)
            for turn in range(MINIMA):
                equal += marks[first, turn][:, None] == marks[second, turn][None, :]
            good &= equal >= LEAST_EQUAL
            found = np.argwhere(good)
            if len(found) <= SINGLY:
                common = [np.intersect1d(sets[first[i]], sets[second[j]], assume_unique=True).size for i, j in found]
            else:
                common = _common(left, a, right, b)[found[:, 0], found[:, 1]]
            one, other = first[found[:, 0]], second[found[:, 1]]
            common = np.array(common, np.int64)
            enough = 100 * common >= PERCENT * (sizes[one] + sizes[other] - common)
            for i, j in zip(one[enough].tolist(), other[enough].tolist()):
                if roots[i] != roots[j]:
                    ones.append(names[roots[i]]), others.append(names[roots[j]])
                    roots[roots == roots[i]] = roots[j]
    return pa.table({"one": pa.array(ones, pa.binary()), "other": pa.array(others, pa.binary())})


def _families(paired: DataFrame) -> DataFrame | None:
    """place and family of the nodes in crowds; ``paired`` has the mark of each node's component."""
    rows = _tables(paired, "mark", "place")
    crowds = rows.groupBy("table", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("mark").alias("least"), F.max("mark").alias("most"), F.min("place").alias("first")
    )
    crowds = settle(
        crowds.where((F.col("n") > NEIGHBOURS + 1) & (F.col("least") < F.col("most"))).select("table", "key", "first"), "near-crowds"
    )
    if crowds.isEmpty():
        return None
    links = rows.join(growing(crowds), ["table", "key"]).where(F.col("place") != F.col("first"))
    return components(links.select(F.col("place").alias("one"), F.col("first").alias("other")).distinct())


def crowded_links(
    paired: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, text: str = "text"
) -> DataFrame | None:
    """Links between components that only nodes have which are no neighbours in any table, as pairs
    of labels; ``labels`` has the digest and the label of each node."""
    known = settle(
        paired.join(growing(labels), "digest").withColumns(
            {"mark": F.xxhash64("label"), "place": F.xxhash64("digest")}
        ),
        "near-known",
    )
    families = _families(known)
    if families is None:
        return None
    families = families.select(F.col("node").alias("place"), F.col("label").alias("family"))
    members = (
        known.select("place", "digest", "n_shingles", "marks", "label")
        .join(growing(families), "place")
        .join(growing(nodes.select("digest", *ROW_KEY)), "digest")
        .select("family", "digest", "n_shingles", "marks", "label", *ROW_KEY)
    )
    members = settle(members, "near-members")
    asked = F.greatest(
        F.when(F.count(F.lit(1)) > FEW, BLOCKS).otherwise(1), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    ).cast("int")
    sizes = members.groupBy("family").agg(asked.alias("blocks"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(value).tobytes() for value in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], [*batch.schema.names[1:], "shingles"])

    texts = take(docs, text, key=True).select(F.col(text).cast("binary").alias("text"), *ROW_KEY)
    placed = members.join(growing(sizes), "family").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    sets = settle(
        texts.join(growing(placed), ROW_KEY)
        .select("text", "family", "own", "blocks", "marks", "label")
        .mapInArrow(shingled, "family long, own int, blocks int, marks binary, label binary, shingles binary"),
        "near-sets",
    )
    met = sets.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("own", "peer").alias("low"), F.greatest("own", "peer").alias("high"), "own", "marks", "label", "shingles"
    )
    return met.groupBy("family", "low", "high").applyInArrow(_join_blocks, "one binary, other binary")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Component of each row of a stored table: the id, n_shingles, component_id, first_row and
    the row key.

    Rows are linked when their shingle sets have a similarity of at least ``PERCENT``; equal texts
    always are. component_id is the smallest id that links reach; null ids come last, so it is null
    only where all are. first_row marks one row of each component, also if its id is repeated. A
    row without words is linked with nothing and is its own component.
    """
    signed = settle(signatures(docs, text, id_column), "near-signed")
    filled = signed.where("n_shingles > 0")
    order = Window.partitionBy("digest").orderBy(*ROW_KEY)
    nodes = settle(filled.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "id"), "near-nodes")
    # A set of one shingle is similar enough to no other set.
    paired = shared_halves(nodes.where("n_shingles > 1"))
    links = confirmed(candidates(paired), nodes, docs, text)
    labels = components(links)
    place = F.struct(F.col("id").isNull().alias("none"), "id", *ROW_KEY)
    firsts = filled.groupBy("digest").agg(F.min(place).alias("first"))
    labelled = firsts.join(growing(labels.withColumnRenamed("node", "digest")), "digest", "left").select(
        "digest", "first", F.coalesce("label", "digest").alias("label")
    )
    labelled = settle(labelled, "near-labelled")
    more = crowded_links(paired, labelled.select("digest", "label"), nodes, docs, text)
    if more is not None:
        moved = components(more).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        labelled = labelled.join(growing(moved), "label", "left").select(
            "digest", "first", F.coalesce("whole", "label").alias("label")
        )
        labelled = settle(labelled, "near-labelled")
    best = labelled.groupBy("label").agg(F.min("first").alias("best"))
    whole = settle(labelled.join(growing(best), "label").select("digest", "best"), "near-components")
    linked = filled.join(growing(whole), "digest").select(
        "id", "n_shingles", F.col("best.id").alias("component_id"),
        ((F.col("best._file") == F.col("_file")) & (F.col("best._index") == F.col("_index"))).alias("first_row"),
        *ROW_KEY,
    )
    alone = signed.where("n_shingles = 0").select(
        "id", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("first_row"), *ROW_KEY
    )
    return linked.unionByName(alone).withColumnRenamed("id", id_column)


def without_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each component, all columns kept."""
    names = docs.columns
    kept = stored(docs, "near")
    firsts = near_duplicates(kept, text, id_column).where("first_row").select(*ROW_KEY)
    plain = [f"d{place}" for place in range(len(names))]
    return take(kept.toDF(*plain), *plain, key=True).join(growing(firsts), ROW_KEY).drop(*ROW_KEY).toDF(*names)


def op6_tensored_minhash(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP6_SQL = f"""
WITH RECURSIVE cut AS (
    SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+') AS parts
    FROM documents
),
words AS (
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS place, count(*) OVER (PARTITION BY doc_id) AS n
    FROM (SELECT doc_id, unnest(parts) AS word, unnest(range(1, len(parts) + 1)) AS place FROM cut) WHERE word <> ''
),
shingles AS (
    SELECT DISTINCT doc_id, shingle
    FROM (
        SELECT doc_id, place, n, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS shingle
        FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place)
    ) WHERE place <= greatest(1, n - {SHINGLE - 1})
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT one, other FROM common c JOIN sizes a ON a.doc_id = one JOIN sizes b ON b.doc_id = other
    WHERE 100 * c.n >= {PERCENT} * (a.n + b.n - c.n)
),
ends AS (SELECT one, other FROM links UNION ALL SELECT other, one FROM links),
reached AS (
    SELECT doc_id, doc_id AS node FROM documents
    UNION SELECT reached.doc_id, ends.other FROM reached JOIN ends ON reached.node = ends.one
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
