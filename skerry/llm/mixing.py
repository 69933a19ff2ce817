"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a share of `budget` x all words by its weight; no target exceeds
`most` x the source's words, and what a capped source leaves is shared again by weight.
A target of q whole copies and a rest takes every document q times, and once more the
documents whose hash lies under a threshold. The threshold is nested: words are summed
by source and the first three hex digits of the hash, the one bucket in which the rest
runs out is refined by the next three digits, and that one by the last three. Nothing is
sorted; histograms have at most 4096 rows a source. The last boundary bucket (one in
2^36 of the hashes) is taken if that comes nearer to the target.

Defined results: null text has size 0; the null source is a source, last in order; rows
that repeat both id and text share a hash, hence a fate; sources without words get target 0; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialise, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
DIGITS = 3
LEVELS = 3


def hashed(doc_id: Column, text: Column) -> Column:
    """Of id and text, so that rows that share or lack an id don't share a fate."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(named.cast("binary")), 1, DIGITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every row."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
        hashed(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size (one row a source).

    The level L with sum(min(weight * L, most * size)) = budget: sources are capped in
    the order of size / weight, so running sums over that order find the first level
    that caps no further source. The windows run over one row per source.
    """
    ranked = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level", (F.lit(float(budget)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(running), F.lit(0.0))) / F.sum("w").over(rest)
    ).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    # The first source, in that order, whose share fits settles the level of all after it.
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), "k", "level"))).over(every)
    settled = levels.withColumn("final", first["level"])
    return settled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies and the exclusive hash bound `upto` of each source.

    rows: source, size, hash. goals: source, source_size, target.
    """
    per = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    bounds = goals.withColumn("copies", per).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(""))
    for level in range(1, LEVELS + 1):
        keys = bounds.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        boundary = rows
        if level > 1:
            boundary = rows.join(keys, F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, DIGITS * (level - 1)) == F.col("p")), "left_semi")
        histogram = boundary.groupBy("source", F.substring("hash", 1, DIGITS * level).alias("bucket")).agg(F.sum("size").alias("words"))
        in_order = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("through", F.sum("words").over(in_order))
        own = histogram.select(F.col("source").alias("hs"), "bucket", "words", "through")
        joined = bounds.join(own, F.col("source").eqNullSafe(F.col("hs")), "left")
        last = level == LEVELS
        under = F.col("through") - F.col("words")
        over = (under + F.col("words") / 2 > F.col("left")) if last else (F.col("through") > F.col("left"))
        first = F.min(F.when(over, F.struct("bucket", under.alias("under"))))
        bounds = joined.groupBy("source", "source_size", "target", "copies", "left", "prefix").agg(first.alias("b"))
        # No bucket runs over: all of the range is taken, so the bound lies behind it.
        behind = F.concat(F.col("prefix"), F.lit("~"))
        bounds = bounds.select(
            "source", "source_size", "target", "copies",
            (F.col("left") - F.coalesce(F.col("b.under"), F.lit(0))).alias("left"),
            F.coalesce(F.col("b.bucket"), behind).alias("prefix"),
        )
    return bounds.select("source", "source_size", "target", "copies", F.col("prefix").alias("upto"))


def settle(docs: DataFrame, weights: Sequence[int], budget: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all documents, and the thresholds of all sources."""
    rows = materialise(sized(docs), "mix-sizes")
    sums = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    found = materialise(thresholds(rows, targets(sums, weights, budget, most)), "mix-thresholds")
    return rows, found.withColumnRenamed("source", "s")


def times(most: int) -> Column:
    """How often the mix takes a document, from hash, copies and upto."""
    return F.col("copies") + F.when((F.col("copies") < most) & (F.col("hash") < F.col("upto")), 1).otherwise(0)


def remix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as the mix takes it."""
    _, found = settle(docs, weights, budget, most)
    own = docs.select(F.struct("*").alias("row")).select("row", hashed(F.col("row.doc_id"), F.col("row.text")).alias("hash"), F.col("row.source").alias("own_source"))
    taken = own.join(found, F.col("own_source").eqNullSafe(F.col("s"))).withColumn("times", times(most)).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of `docs` (doc_id, source, text)."""
    rows, found = settle(docs, weights, budget, most)
    return rows.join(found, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times(most)).alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def mixing_sql(relation: str = "documents") -> str:
    return rf"""
WITH n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 9) AS hash FROM {relation}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM n GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][k % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (cap / w, k)) AS level FROM l WHERE level * w <= cap),
t AS (SELECT l.source, source_size, least(cap, coalesce(f.level, 'infinity'::DOUBLE) * w) AS target FROM l LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT source, hash, CAST(sum(size) AS BIGINT) AS words, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS BIGINT) AS through FROM n GROUP BY source, hash)
SELECT n.doc_id, n.size, c.source_size, c.target,
  n.size * (c.copies + CASE WHEN c.copies < 2 AND b.through - b.words + b.words / 2.0::DOUBLE <= c.target - c.copies * c.source_size THEN 1 ELSE 0 END) AS taken
FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source
JOIN b ON n.source IS NOT DISTINCT FROM b.source AND n.hash = b.hash
"""
