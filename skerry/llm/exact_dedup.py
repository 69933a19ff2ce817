"""Exact duplicates by skew-safe combining, in built-in operators only.

Texts are equal when identical after each run of ASCII white space became one space.
Equal texts meet in three steps, and each step groups by the digest *and* the whole
normalised text, so two texts with one digest never become one group:

1. every map task combines its own rows (the partial side of the aggregate),
2. rows are combined by (digest, text, salt), so a hot text is spread over `salts` tasks,
3. the salt winners are combined by (digest, text).

Only combined rows are shuffled with their text. The verdict then returns to the
documents by a join on the digest, hot groups by broadcast. That join compares no less than the
texts: the groups, made of whole texts, show whether any digest
has two of them, and if one has, all rows are joined by digest and text.

Defined results: null text counts as empty; a group's row with the smallest doc_id stays;
null doc_ids are larger than all others (of a group of null ids only, `verdicts` calls each
kept); rows that repeat both id and text share one verdict, and `deduplicate` returns one of
them; an empty table gives an empty result; further columns are ignored by `verdicts` and
returned untouched by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, table


#: Groups that are broadcast, at most: those of this share of all rows.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct (digest, body): keep_id and group_size. rows: doc_id, digest, body."""
    salted = (
        rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        .groupBy("digest", "body", "salt")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def judged(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> tuple[DataFrame, list[str]]:
    """doc_id, digest, keep_id, group_size of every row of `docs`, and the columns that name its text.

    Groups are made of whole texts, and the same pass tells whether any digest has two texts.
    If none has, the digest names the text; else the text itself is joined, and comes along.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
    found = materialise(groups(rows, salts).select("digest", F.octet_length("body").alias("n"), "keep_id", "group_size"), "exact-groups")
    if not found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        names = ["digest", "body"]
        return rows.select("doc_id", *names).join(materialise(groups(rows, salts), "exact-groups"), names), names
    # Groups of a HOT_GROUPS-th of all rows or more, HOT_GROUPS at most, go to their rows, which
    # then take part in the join under keys of their own: no partition holds a hot group's rows.
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    told = F.struct("keep_id", "group_size")
    hot = found.where(F.col("group_size") >= max(2, -(-total // HOT_GROUPS))).select(F.col("digest").alias("hot_digest"), told.alias("hot"))
    own = rows.select("doc_id", "digest").join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    apart = F.concat(F.lit("-"), F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 20)))
    own = own.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(apart))
    met = own.join(found.select(F.col("digest").alias("group_digest"), told.alias("cold")), F.col("key") == F.col("group_digest"), "left")
    return met.withColumn("told", F.coalesce("hot", "cold")).select("doc_id", "digest", "told.keep_id", "told.group_size"), ["digest"]


def verdicts(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row of `docs` (doc_id, text)."""
    found, _ = judged(docs, digest, salts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Rows that repeat the smallest id of their group (or share its null id) are equal witnesses;
    any one of them stays.
    """
    found, names = judged(docs, digest, salts)
    own = docs.select(F.struct("*").alias("row")).withColumn("body", normalised(F.col("row.text"))).withColumn("digest", digest(F.col("body")))
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("dropped_id"), *[F.col(n).alias(f"dropped_{n}") for n in names]).distinct()

    def same(rows: DataFrame, side: str) -> Column:
        out = own["row"]["doc_id"].eqNullSafe(rows[f"{side}_id"])
        for n in names:
            out = out & (own[n] == rows[f"{side}_{n}"])
        return out

    kept = own.join(dropped, same(dropped, "dropped"), "left_anti")
    ties = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", *names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = materialise(ties.select(F.col("doc_id").alias("tied_id"), *[F.col(n).alias(f"tied_{n}") for n in names]), "exact-ties")
    if ties.isEmpty():
        return kept.select("row.*")
    # Few rows, as a rule: map tasks keep one of each of theirs before they meet.
    one = own.join(ties, same(ties, "tied"), "left_semi").groupBy("row.doc_id", "digest", "body").agg(F.any_value("row").alias("row"))
    return kept.join(ties, same(ties, "tied"), "left_anti").select("row.*").unionAll(one.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
