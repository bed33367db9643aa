"""The mixture and the ring against plain loops."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from walletlens.llm import mixing, sharding
from walletlens.llm.common import ROW_KEY, take
from walletlens.sources.work import settle


def plain_exponent(tokens, budget, entropy, repeats):
    """By halving, on plain numbers."""
    total = sum(tokens)

    def weights(e):
        raised = [(n / total) ** e for n in tokens]
        return [value / sum(raised) for value in raised]

    def height(e):
        return -sum(w * math.log(w) for w in weights(e)) / math.log(len(tokens))

    def most(e):
        return max(w * budget / n for w, n in zip(weights(e), tokens))

    def last(good, low, high):
        """The point nearest to ``high`` that is good, from ``low``, which is."""
        if good(high):
            return high
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if good(middle) else (low, middle)
        return low

    at = last(lambda e: height(e) >= entropy, 0.0, 1.0) if entropy is not None else 1.0
    if repeats is not None and most(at) > repeats:
        at = last(lambda e: most(e) <= repeats, 1.0, at)
    return weights(at)


@pytest.mark.parametrize("entropy, repeats, budget", [(0.9, None, None), (0.97, 3.0, None), (None, None, 700), (1.0, 2.5, 4000)])
def test_mixture_is_a_plain_loop(spark, monkeypatch, entropy, repeats, budget):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    texts = [(n, "w " * (1 + n * 7 % 11), "big") for n in range(300)]
    texts += [(1000 + n, "w " * (1 + n % 5), f"s{n % 3}") for n in range(60)] + [(2000, None, None), (2001, "", None), (2001, "", None)]
    docs = settle(spark.createDataFrame(texts, "doc_id long, text string, source string"), "mix-brute")
    got = mixing.mix(docs, budget, entropy, repeats).collect()
    rows = take(docs, "doc_id", "text", "source", key=True).withColumn("_source", mixing.source_key(F.col("source"))).collect()
    size = {(row._file, row._index): len((row.text or "").split()) + 1 for row in rows}
    own = defaultdict(int)
    for row in rows:
        own[row._source] += size[row._file, row._index]
    names = sorted(own)
    total = sum(own.values())
    plan = dict(zip(names, plain_exponent([own[name] for name in names], budget or total, entropy, repeats)))
    weights = {"null" if row.source is None else f"={row.source}": row.weight for row in got}
    assert weights == pytest.approx({name: plan[name] for name in weights}, rel=1e-5)
    # The turns of the last epoch, by the same hash; the choice by a loop.
    quota = {name: round(plan[name] * (budget or total)) for name in names}
    ordered = spark.createDataFrame([(row._source, row._file, row._index) for row in rows], "_source string, _file long, _index long")
    known = spark.createDataFrame([(name, quota[name] // own[name] + 1, -(-own[name] // 60)) for name in names], "_source string, last int, blocks long")
    ordered = ordered.join(known, "_source").withColumn("_block", F.pmod(F.xxhash64(F.lit(mixing.SEED), *ROW_KEY), F.col("blocks")))
    turns = ordered.select(
        "_source", *ROW_KEY, mixing._block_turn(mixing.SEED, F.col("last")).alias("b"), "_block", mixing._row_turn(mixing.SEED, F.col("last")).alias("r")
    ).orderBy("_source", "b", "_block", "r", *ROW_KEY).collect()
    expected, spent = Counter(), Counter()
    for row in turns:
        key = (row._file, row._index)
        spent[row._source] += size[key]
        expected[key] = quota[row._source] // own[row._source] + (spent[row._source] <= quota[row._source] % own[row._source])
    assert Counter((row._file, row._index) for row in got) == +expected
    epochs = defaultdict(set)
    for row in got:
        epochs[row._file, row._index].add(row.epoch)
    assert all(found == set(range(1, len(found) + 1)) for found in epochs.values())


@pytest.mark.parametrize("shards, count", [(16, 900), (5, 33), (3, 2)])
def test_ring_is_a_plain_loop(spark, monkeypatch, shards, count):
    monkeypatch.setattr(sharding, "CELLS", 64)
    # A key that a third of the rows have fills its shard and goes on clockwise.
    rows = spark.range(count).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), "id")
    got = sharding.assigned(settle(rows, "ring-rows"), ["key"], shards)
    cell = F.pmod(F.xxhash64(F.lit("key"), F.col("key")), F.lit(64))
    placed = Counter((row.cell, row.shard) for row in got.select(cell.alias("cell"), "shard").collect())
    nodes = spark.range(shards).select(F.col("id").cast("int").alias("shard")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(sharding.VIRTUAL_NODES - 1))).alias("node")
    ).select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "node"), F.lit(64)).alias("at")).collect()
    ties = {
        (row.shard, row.cell): row.tie
        for row in spark.range(64).select(F.col("id").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        .select("cell", "shard", F.xxhash64("shard", "cell").alias("tie")).collect()
    }
    turns = {row.cell: row.turn for row in spark.range(64).select(F.col("id").alias("cell"), F.xxhash64(F.lit("turn"), "id").alias("turn")).collect()}
    counts = Counter(row.cell for row in rows.select(cell.alias("cell")).collect())
    load, bound = [0] * shards, [count // shards + (shard < count % shards) for shard in range(shards)]
    expected = Counter()
    for at in sorted(counts, key=lambda one: (turns[one], one)):
        steps = {shard: min((node.at - at) % 64 for node in nodes if node.shard == shard) for shard in range(shards)}
        way = sorted(range(shards), key=lambda shard: (steps[shard], ties[shard, at], shard))
        for _ in range(counts[at]):
            shard = next(shard for shard in way if load[shard] < bound[shard])
            load[shard] += 1
            expected[at, shard] += 1
    assert placed == expected and load == bound
