"""Providers of vectors for texts, and ranking by several of them.

A provider turns a column of texts into a column of vectors and says what its space is. The
ones here hash words and letter runs, in built-in functions; a trained encoder is one entry more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, unit
from ..sources.snapshots import Space
from .ranking import fused, ranked, tokens


@dataclass(frozen=True)
class Provider:
    space: Space
    encode: Callable[[Column], Column]


def hashed(parts: Column, dimensions: int) -> Column:
    """The sum of an array of parts: each adds one, with a sign of its own, at a place of its own."""
    at = F.transform(parts, lambda p: F.struct(F.pmod(F.xxhash64(p), F.lit(dimensions)).alias("i"), F.when(F.pmod(F.xxhash64(p, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    return F.aggregate(at, F.array_repeat(F.lit(0.0), dimensions), lambda v, x: F.transform(v, lambda y, k: F.when(x["i"] == k, y + x["s"]).otherwise(y)))


def letters(text: Column, n: int = 3) -> Column:
    """The runs of n letters of a text's words."""
    line = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.when(F.length(line) >= n, F.transform(F.sequence(F.lit(1), F.length(line) - (n - 1)), lambda k: F.substring(line, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


PROVIDERS = {
    "words": Provider(Space("words", 64, "cosine", "hashed words", "1"), lambda text: hashed(tokens(text), 64)),
    "letters": Provider(Space("letters", 64, "cosine", "hashed letter runs", "1"), lambda text: hashed(letters(text), 64)),
}


def embedded(texts: DataFrame, id: str, text: str, provider: str) -> DataFrame:
    """id and unit vector of every text in a provider's space."""
    return texts.select(id, PROVIDERS[provider].encode(F.col(text)).alias("__raw")).select(id, unit(F.col("__raw")).alias("vector"))


def answered(spaces: dict[str, DataFrame], phrase: str, id: str, most: int) -> DataFrame:
    """id, fusion, spaces: items ranked by a phrase in every space (id, vector), the rankings fused."""
    out = None
    for name, vectors in spaces.items():
        asked = vectors.sparkSession.createDataFrame([(0, phrase)], "id int, phrase string")
        one = embedded(asked, "id", "phrase", name).select(F.col("vector").alias("__q"))
        # One row: the phrase.
        scores = vectors.crossJoin(F.broadcast(one)).select(id, F.round(dot(F.col("vector"), F.col("__q")), 9).alias("score"))
        head = ranked(scores, id, most=most).select(id, "position")
        out = head if out is None else out.unionByName(head)
    return fused(out, id)
