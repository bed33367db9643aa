"""The pipeline, and what the registry promises."""

from __future__ import annotations

import collections
import functools

import corpus_pipeline
import __spark_entry__
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from walletlens.llm import registry
from walletlens.sources.work import settle


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = []
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, SMALL), "stage-test")
        made.append((name, docs, result))
        docs = result
    return made


def test_stages_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]
    for _, docs, result in stages[:-1]:
        assert result.columns == docs.columns and 0 < result.count()


def test_quality_stage(spark, stages):
    _, docs, result = stages[0]
    kept = registry.QUERIES["op7_hashed_ngram_quality"](spark, SMALL).where("kept")
    assert {row.doc_id for row in kept.collect()} == {row.doc_id for row in result.collect()}
    assert result.exceptAll(docs).count() == 0


def test_near_duplicate_stage(stages):
    _, docs, result = stages[2]
    assert result.exceptAll(docs).count() == 0
    texts = [row.text for row in result.collect() if len((row.text or "").split()) >= 5]
    assert len(texts) == len(set(texts)) < docs.count()


def test_mixing_stage(stages):
    _, docs, result = stages[3]
    assert result.distinct().exceptAll(docs.distinct()).count() == 0


def test_packing_stage(stages):
    _, docs, result = stages[4]
    assert result.where("piece = 0").count() == docs.count()
    by = collections.Counter()
    for row in result.collect():
        by[row.sequence_id] += row.length
    assert max(by.values()) <= 2048


def test_run_is_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, SMALL).select(*columns)
    assert run.exceptAll(stages[-1][2].select(*columns)).count() == 0 == stages[-1][2].select(*columns).exceptAll(run).count()


def test_odd_documents_pass(spark):
    rows = [
        (None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, "word " * 60, "en", None, 300, "x"),
        (2, "word " * 60, "en", None, 300, "x"), (3, " ".join(f"w{n}" for n in range(9000)), "en", "b", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_index` string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        df = settle(docs, "odd-test")
        for _, stage in corpus_pipeline.STAGES:
            df = settle(stage(spark, df, SMALL), "odd-test")
        assert df.count() >= 0


def test_registry(spark):
    names = set(__spark_entry__.queries())
    for number in range(1, 14):
        assert len([name for name in names if name.startswith(f"op{number}_")]) == 1
    assert "pipeline" in names and set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_results_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    theirs = con.execute(registry.SQL[name])
    columns = [column[0] for column in theirs.description]
    ours = registry.QUERIES[name](spark, SMALL)
    assert sorted(ours.columns) == sorted(columns)
    rows = collections.Counter(tuple(row) for row in ours.select(*columns).collect())
    assert rows == collections.Counter(theirs.fetchall())


@pytest.mark.parametrize("number", [3, 10])
def test_native_operators_run_no_python(spark, number):
    name = next(name for name in registry.QUERIES if name.startswith(f"op{number}_"))
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_nothing_else_imports_the_package():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("walletlens/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "walletlens.llm" not in path.read_text()


def test_stages_carry_columns_of_any_name(spark):
    """Own names of the stages as further columns, no n_chars, and an empty table."""
    names = ["n_words", "probability", "_text", "kept", "base_failed", "word_chars", "n_tokens", "weight", "epoch", "label", "digest", "_file", "site"]
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").drop("n_chars")
    rows = rows.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id")).alias(name) for name in names])
    for docs in (settle(rows, "further"), settle(rows.limit(0), "further-none")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            result = settle(stage(spark, docs, SMALL), "further-stage")
            assert result.columns == rows.columns, name
            wrong = [F.col(own) != F.concat(F.lit(f"{own}-"), F.col("doc_id")) for own in names]
            assert result.where(functools.reduce(lambda one, other: one | other, wrong)).count() == 0, name
            docs = result
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
