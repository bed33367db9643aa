"""Operator 8: removal of lines that spread over many sites.

Each line's sites go into a HyperLogLog sketch; sketches of one line merge by aggregation, so a
line on any number of rows moves one small sketch from each task. Lines whose estimate is near
the threshold get an exact distinct count. A line that reaches it is boilerplate and stays only
where it comes first; documents of which nothing is left go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from walletlens.llm.common import ROW_KEY, growing, stored, table, take
from walletlens.sources.work import settle

MIN_SITES = 10
LOG_REGISTERS = 8
# Relative distance from the threshold within which an estimate is not relied on: over four times
# the standard error of 256 registers, 1.04 / 16.
NEAR = 0.3

LINE = ["_line", "_check"]


def lines(rows: DataFrame, text: str, *carry: str) -> DataFrame:
    """Lines with a word: two independent hashes of the line, its place, and carried columns."""
    cut = rows.select(*carry, F.posexplode(F.split(text, "\n")).alias("_place", "_text"))
    return cut.where(F.col("_text").rlike("[^\\x20\\x09-\\x0D]")).select(
        F.xxhash64("_text").alias("_line"), F.xxhash64(F.lit(1), "_text").alias("_check"), *carry, "_place"
    )


def spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", id_column: str = "doc_id"
) -> DataFrame:
    """Occurrences of boilerplate lines but the first: the row key and the line's place.

    ``docs`` must be a stored table. The first occurrence is that of the smallest id (null ids
    last), then of the row key, then of the place. A null site is no site.
    """
    rows = take(docs, id_column, text, site, key=True)
    sketched = (
        lines(rows, text, site)
        .groupBy(*LINE)
        .agg(F.hll_sketch_agg(F.col(site).cast("string"), F.lit(LOG_REGISTERS)).alias("_sites"))
        .select(*LINE, F.hll_sketch_estimate("_sites").alias("_estimate"))
        .where(F.col("_estimate") >= min_sites * (1 - NEAR))
    )
    candidates = settle(sketched, "lines-candidates")
    found = settle(
        lines(rows, text, id_column, site, *ROW_KEY).join(candidates, LINE), "lines-occurrences"
    )
    near = F.col("_estimate") <= min_sites * (1 + NEAR)
    exact = (
        found.where(near)
        .groupBy(*LINE)
        .agg(F.countDistinct(site).alias("_exact"))
        .where(F.col("_exact") >= min_sites)
        .select(*LINE)
    )
    wide = candidates.where(~near).select(*LINE).unionByName(exact)
    place = F.struct(F.col(id_column).isNull(), id_column, *ROW_KEY, "_place")
    first = found.groupBy(*LINE).agg(F.min(place).alias("_first"))
    return (
        found.join(wide.join(first, LINE), LINE)
        .where(place != F.col("_first"))
        .select(*ROW_KEY, "_place")
    )


def without_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", id_column: str = "doc_id",
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with cross-site boilerplate lines removed, all columns kept.

    A document with a removed line and no word left is gone; every other row stays, with null and
    empty texts unchanged. Repeated rows count as rows of their site: they spread no line, but all
    except the first lose a line that is spread. ``removed`` names a column for the number of
    removed lines.
    """
    names = docs.columns
    kept = stored(docs, "lines")
    gone = (
        spread_lines(kept, min_sites, text, site, id_column)
        .groupBy(*ROW_KEY)
        .agg(F.collect_set("_place").alias("_gone"))
    )
    plain = [f"d{place}" for place in range(len(names))]
    here = plain[names.index(text)]
    joined = take(kept.toDF(*plain), *plain, key=True).join(growing(gone), ROW_KEY, "left")
    cut = F.array_join(
        F.filter(F.split(here, "\n"), lambda _, at: ~F.array_contains("_gone", at)), "\n"
    )
    text_left = F.when(F.col("_gone").isNull(), F.col(here)).otherwise(cut)
    rest = joined.withColumn(here, text_left).where(
        F.col("_gone").isNull() | F.col(here).rlike("[^\\x20\\x09-\\x0D]")
    )
    count = [] if removed is None else [F.coalesce(F.size("_gone"), F.lit(0)).alias(removed)]
    return rest.select(*[F.col(column).alias(name) for column, name in zip(plain, names, strict=True)], *count)


def op8_site_spread_lines(spark, folder: str) -> DataFrame:
    docs = take(table(spark, folder, "documents"), "doc_id", "text", "source")
    return without_spread_lines(docs, removed="n_removed")


OP8_SQL = f"""
WITH cut AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place
    FROM documents
),
spread AS (
    SELECT line, min(struct_pack(doc_id, place)) AS first
    FROM cut WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
    GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
),
marked AS (
    SELECT cut.doc_id, cut.line, cut.place,
           spread.line IS NOT NULL AND struct_pack(doc_id := cut.doc_id, place := cut.place) <> spread.first AS gone
    FROM cut LEFT JOIN spread USING (line)
),
left_over AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN n_removed = 0 THEN d.text ELSE l.text END AS text, d.source, CAST(n_removed AS INTEGER) AS n_removed
FROM left_over l JOIN documents d USING (doc_id)
WHERE n_removed = 0 OR regexp_matches(l.text, '[^\\x20\\x09-\\x0D]')
UNION ALL SELECT doc_id, text, source, 0 FROM documents WHERE text IS NULL
"""
