"""Rankings: BM25, reciprocal rank fusion, the head of a ranking and how far above it stands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answer import ordered
from .similarity import NAN, OWN, UNITS, by_space

#: Fixed values of the scores.
K1, B, RRF_DEPTH, HEAD_SHARE = 1.2, 0.75, 60, 0.5


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def bm25(docs: DataFrame, id: str, text: str, words: list[str]) -> DataFrame:
    """id and score of the documents that have one of `words`.

    One scan finds lengths and how many documents have each word, another the scores. A document's
    words add up in the order of `words`, so that equal texts have equal scores to the last bit.
    """
    words = list(dict.fromkeys(words))
    held = docs.select(F.col(id), tokens(F.col(text)).alias("t")).select(id, F.array_size("t").alias("length"), F.filter("t", lambda x: x.isin(words)).alias("hits"))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), F.array(*[F.count_if(F.array_contains("hits", w)) for w in words]).alias("df"))
    joined = held.where(F.size("hits") > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, w in enumerate(words):
        tf, df = F.size(F.filter("hits", F.lit(w).eqNullSafe)), F.col("df")[k]
        raw = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))).otherwise(F.lit(0.0))
    return joined.select(id, score.alias("score")).groupBy(id).agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame, id: str, space: str | None = None, most: int | None = None) -> DataFrame:
    """Position in each space, from 1: best score first, ties by id; with `most`, only so many of each.

    The best of a space are a window whose head Spark cuts off before the shuffle. Positions of
    all are counted over range partitions of (space, score, id): a space may lie in many tasks,
    and what comes before a row is its place in all spaces less where its own begins.
    """
    order = [F.desc("score"), F.col(id)]
    if most is not None:
        w = Window.partitionBy(space) if space else Window.partitionBy()
        return scores.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("position") <= most)
    if space is None:
        return ordered(scores, order, "position")
    placed = ordered(scores, [F.col(space), *order], "__all")
    # One row a space.
    begins = placed.groupBy(F.col(space).alias("__space")).agg((F.min("__all") - 1).alias("__begin"))
    return placed.join(begins, placed[space] == begins["__space"]).withColumn("position", F.col("__all") - F.col("__begin")).drop("__all", "__space", "__begin")


def fused(rankings: DataFrame, id: str, depth: int = RRF_DEPTH) -> DataFrame:
    """Reciprocal rank fusion of rows id, position (one per space)."""
    return rankings.groupBy(id).agg(F.sum(F.lit(1.0) / (F.lit(float(depth)) + F.col("position"))).alias("fusion"), F.count(F.lit(1)).alias("spaces"))


def head(scores: DataFrame, space: str) -> DataFrame:
    """Adds middle, best, relevance (0 to 1) and answers: at least middle + half of best - middle."""
    levels = scores.groupBy(space).agg(F.median("score").alias("middle"), F.max("score").alias("best"))
    joined = scores.join(F.broadcast(levels), space)
    reach = F.col("best") - F.col("middle")
    standing = F.when(reach > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - F.col("middle")) / reach))).otherwise(F.lit(0.0))
    return joined.withColumn("relevance", F.round(standing, 4)).withColumn("answers", (reach > 0) & (F.col("score") >= F.col("middle") + HEAD_SHARE * reach))


# -- whole spaces, without a row for each pair ------------------------------------------

Spaces = Iterator[tuple[int, np.ndarray]]


def fused_spaces(vectors: DataFrame, queries: DataFrame, id: str, vector: str, depth: int = RRF_DEPTH) -> DataFrame:
    """id, fusion, spaces: `fused` of the positions (`ranked`) of all vectors by cosine to each query of another id."""

    def fold(ids: np.ndarray, spaces: Spaces) -> Iterator[pa.RecordBatch]:
        total, count, share = np.zeros(len(ids)), np.zeros(len(ids), np.int64), 1.0 / (depth + np.arange(1.0, len(ids) + 1))
        at = np.arange(len(ids), dtype=np.uint64)
        for _, keys in spaces:
            # Best first, then by id; the query's own come last.
            order = np.sort((NAN - keys.astype(np.int64)).astype(np.uint64) << np.uint64(32) | at) & np.uint64(2**32 - 1)
            order = order[: np.count_nonzero(keys != OWN)].astype(np.int64)
            total[order] += share[: len(order)]
            count[order] += 1
        met = np.flatnonzero(count)
        for k in range(0, len(met), 65_536):
            own = met[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(total[own]), pa.array(count[own])], ["id", "fusion", "spaces"])

    parts = by_space(vectors, queries, id, vector, fold, "id long, fusion double, spaces long", "fused")
    return parts.groupBy(F.col("id").alias(id)).agg(F.sum("fusion").alias("fusion"), F.sum("spaces").alias("spaces"))


def _heads(spaces: Spaces) -> Iterator[tuple[int, np.ndarray, float, float]]:
    """Query, scores (NaN for its own), middle and best of each space that has a score."""
    for query, keys in spaces:
        held = keys[keys != OWN]
        if not len(held):
            continue
        n, real = len(held), lambda k: np.where(k == NAN, np.nan, k / UNITS)
        middle = np.partition(held, ((n - 1) // 2, n // 2))
        low, high = real(middle[(n - 1) // 2]), real(middle[n // 2])
        yield query, np.where(keys == OWN, np.nan, real(keys)), float(low if low == high else 0.5 * low + 0.5 * high), float(real(held.max()))


def head_of_spaces(vectors: DataFrame, queries: DataFrame, id: str, vector: str) -> DataFrame:
    """query_id, id, score: the rows of `head` that answer."""

    def fold(ids: np.ndarray, spaces: Spaces) -> Iterator[pa.RecordBatch]:
        for query, scores, middle, best in _heads(spaces):
            if best - middle > 0:
                own = np.flatnonzero(scores >= middle + HEAD_SHARE * (best - middle))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), query)), pa.array(ids[own]), pa.array(scores[own])], ["query_id", "id", "score"])

    return by_space(vectors, queries, id, vector, fold, "query_id long, id long, score double").withColumnRenamed("id", id)


def standing_in_spaces(vectors: DataFrame, queries: DataFrame, id: str, vector: str) -> DataFrame:
    """id, relevance (the largest of `head`'s) and answers (in any space) of every vector that has a score."""

    def fold(ids: np.ndarray, spaces: Spaces) -> Iterator[pa.RecordBatch]:
        most, answers = np.full(len(ids), np.nan), np.zeros(len(ids), bool)
        for _, scores, middle, best in _heads(spaces):
            reach = best - middle
            standing = np.clip((scores - middle) / reach, 0.0, 1.0) if reach > 0 else np.where(np.isnan(scores), np.nan, 0.0)
            most = np.fmax(most, standing)
            if reach > 0:
                answers |= scores >= middle + HEAD_SHARE * reach
        met = np.flatnonzero(~np.isnan(most))
        for k in range(0, len(met), 65_536):
            own = met[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(most[own]), pa.array(answers[own])], ["id", "relevance", "answers"])

    parts = by_space(vectors, queries, id, vector, fold, "id long, relevance double, answers boolean", "standing")
    return parts.groupBy(F.col("id").alias(id)).agg(F.round(F.max("relevance"), 4).alias("relevance"), F.max("answers").alias("answers"))
