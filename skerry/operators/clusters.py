"""Runs of a clustering: methods, what a run stores, whether its shape bars it, which run is shown, what groups are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, doubles, unit
from ..storage import materialise
from . import graph
from .joins import iou
from .similarity import centroids, range_pairs

#: The smallest group; from how many items shape is judged; the largest share of one group; the share of loners; the least silhouette.
SMALLEST, JUDGED, LARGEST, LONERS, APART = 2, 20, 0.5, 0.95, 0.10
#: Fixed value: how much a named box must cover of a found one.
OVERLAP = 0.3


def kmeans(edges: DataFrame, vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """node, label by cosine k-means with as many groups as the edges' components."""
    k = graph.components(edges).agg(F.countDistinct("component")).first()[0]
    return graph.spherical_kmeans(vectors, id, vector, max(2, k)).select(F.col(id).alias("node"), F.col("cluster").cast("long").alias("label"))


#: Name -> function of (edges a, b, weight; vectors; id; vector) that returns node, label. One entry is one method more.
METHODS: dict[str, Callable[[DataFrame, DataFrame, str, str], DataFrame]] = {
    "components": lambda edges, vectors, id, vector: graph.components(edges.select("a", "b")).select("node", F.col("component").alias("label")),
    "whispers": lambda edges, vectors, id, vector: graph.whispers(edges),
    "kmeans": lambda edges, vectors, id, vector: kmeans(edges.select("a", "b"), vectors, id, vector),
}


def run(method: str, vectors: DataFrame, id: str, vector: str, threshold: float, smallest: int = SMALLEST) -> tuple[DataFrame, DataFrame]:
    """What a run stores: members (node, label) and groups (label, members, centroid), of groups of `smallest` or more.

    A label is its group's smallest node; a centroid is the normalised mean of unit vectors.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; one of {', '.join(METHODS)}")
    vectors = vectors.select(id, vector)
    edges = materialise(range_pairs(vectors, id, vector, threshold).withColumnRenamed("similarity", "weight"), "run-edges")
    found = METHODS[method](edges, vectors, id, vector)
    names = found.groupBy("label").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest)
    members = materialise(found.join(names, "label").select("node", F.col("least").alias("label")), "run-members")
    held = vectors.join(members, F.col(id) == F.col("node")).select("label", vector)
    return members, centroids(held, "label", vector)


def silhouette(vectors: DataFrame, members: DataFrame, id: str, vector: str) -> DataFrame:
    """label, silhouette of each item's place among groups, by cosine to the groups' centroids.

    An item's own centroid against the nearest other one; items times groups are compared, so
    this is asked of runs with few groups.
    """
    u = vectors.select(id, vector).join(members, F.col(id) == F.col("node")).select("node", "label", unit(doubles(F.col(vector))).alias("v"))
    middle = centroids(u, "label", "v").select(F.col("label").alias("other"), "centroid")
    away = 1 - dot(F.col("v"), F.col("centroid"))
    each = u.join(middle).groupBy("node", "label").agg(F.min(F.when(F.col("label") != F.col("other"), away)).alias("b"), F.min(F.when(F.col("label") == F.col("other"), away)).alias("a"))
    most = F.greatest("a", "b")
    return each.groupBy("label").agg(F.avg(F.when(most > 0, (F.col("b") - F.col("a")) / most).otherwise(0.0)).alias("silhouette"))


def health(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """run, items, clusters, largest_share, alone_share of rows run, node, label; totals: run, items."""
    sizes = runs.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("run").agg(F.count_if(F.col("n") >= SMALLEST).alias("clusters"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") >= SMALLEST, F.col("n")).otherwise(0)).alias("held"))
    joined = totals.join(shape, "run", "left").fillna(0, ["clusters", "largest", "held"])
    return joined.select("run", "items", "clusters", (F.col("largest") / F.col("items")).alias("largest_share"), ((F.col("items") - F.col("held")) / F.col("items")).alias("alone_share"))


def disqualified(clusters: Column, items: Column, largest_share: Column, alone_share: Column, silhouette: Column) -> Column:
    """Why a run may not be chosen unasked, or null: the first rung of the ladder that holds."""
    return (
        F.when(clusters == 0, "it grouped nothing").when(items < JUDGED, None)
        .when(largest_share > LARGEST, "it chained").when(alone_share > LONERS, "it grouped nothing much")
        .when((clusters > 1) & (silhouette < APART), "its groups are not apart")
    )


def choose_primary(runs: DataFrame, agreed: DataFrame) -> DataFrame:
    """The run that is shown: of the sound ones, the most agreement with what people said, then the threshold nearest to the measured one.

    runs: run, barred (null: sound), threshold, measured. agreed: run, held, split, mixing; no
    row at all if nobody said anything.
    """
    said = runs.where("barred is null").join(agreed, "run", "left")
    score = F.coalesce(F.col("held") - F.col("split") - F.col("mixing"), F.lit(0))
    return said.orderBy(score.desc(), F.abs(F.col("threshold") - F.col("measured")), "run").limit(1).select("run")


def named(found: DataFrame, said: DataFrame) -> DataFrame:
    """label, name: groups that people's assertions call by exactly one name.

    found: label, file, x, y, w, h. said: file, name, is (false: a veto), x, y, w, h (null: no
    box). A boxed assertion counts for the boxes it covers enough of; one without a box counts
    where it is its file's only name and nothing there is boxed. Names are votes less vetoes.
    """
    boxed = said.where("x is not null").select("file", "name", "is", *[F.col(c).alias(f"s_{c}") for c in "xywh"])
    near = found.join(boxed, "file").where(iou(tuple("xywh"), ("s_x", "s_y", "s_w", "s_h")) >= OVERLAP).select("label", "name", "is")
    bare = said.where("x is null").select("file", "name", "is")
    per = said.groupBy("file").agg(F.countDistinct(F.when(F.col("is"), F.col("name"))).alias("names"), F.count("x").alias("boxes"))
    alone = bare.join(per.where("boxes = 0 and names <= 1"), "file").join(found.select("label", "file").distinct(), "file").select("label", "name", "is")
    told = near.unionByName(alone)
    left = told.where("is").select("label", "name").distinct().join(told.where("not is").select("label", "name").distinct(), ["label", "name"], "left_anti")
    return left.groupBy("label").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def duplicate_edges(pairs: DataFrame, hashes: DataFrame, radius: int) -> DataFrame:
    """a, b, verified of near pairs: by the second hash, where both have one; a pair that can't be verified stays unverified."""
    left, right = (hashes.select(F.col("node").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return joined.where((apart <= radius) | apart.isNull()).select("a", "b", apart.isNotNull().alias("verified"))


def best_annotations(scores: DataFrame, file: str, score: str = "score") -> DataFrame:
    """One row a file: its best annotation's score, and its position among files."""
    best = scores.groupBy(file).agg(F.max(score).alias(score))
    from .ranking import ranked

    return ranked(best.withColumnRenamed(score, "score"), file)


def provenance(spaces: DataFrame, rankings: DataFrame, captions: str = "captions") -> DataFrame:
    """space, standing (contributor, missing or unmatched) and reason of every space that took part.

    spaces: space, recorded, current (numbers of vectors). rankings: rows with a space that answered.
    """
    answered = rankings.select("space").distinct().withColumn("answered", F.lit(True))
    told = spaces.join(answered, "space", "left")
    ok = F.col("answered").isNotNull()
    reason = (
        F.when(ok, None).when(F.col("space") == captions, "no caption mentions a word of the phrase in this scope")
        .when(F.col("recorded") == 0, "no embeddings recorded").when(F.col("current") == 0, "no current embeddings").otherwise("no current embeddings in this scope")
    )
    standing = F.when(ok, "contributor").when(F.col("space") == captions, "unmatched").otherwise("missing")
    return told.select("space", standing.alias("standing"), reason.alias("reason"))


def overfetch(rows: int, wanted: int, constrained: bool) -> int:
    """How deep a space is searched: all of it where a scope will thin the answer, else four times what is wanted."""
    return rows if constrained else min(max(4 * wanted, 100), rows)


def first_by(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__place = 1").drop("__place")
