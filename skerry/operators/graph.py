"""Graphs of near items: components, label voting, consensus, verified duplicate groups.

Iterations cut their lineage with reliable checkpoints in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir
from . import voting
from .similarity import neighbours, unite
from .voting import SWEEPS  # noqa: F401

#: Edges that a task reduces to a forest at once.
REDUCED = 1 << 21


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def forest(edges: DataFrame) -> DataFrame:
    """a, b with the components of the edges a, b: each task's edges, REDUCED at a time, as stars around the smallest nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, ends = np.unique(np.concatenate((t["a"].to_numpy(), t["b"].to_numpy())), return_inverse=True)
        root = np.arange(len(nodes))
        unite(root, ends[: t.num_rows], ends[t.num_rows :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= REDUCED:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """node, component (its smallest node) for edges a, b: smallest-neighbour contraction of each task's forest."""
    now = checkpointed(forest(edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    for _ in range(most):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("low"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def labels_of(blocks: DataFrame, name: str, rule: Callable[[voting.Graph], np.ndarray], by_id: bool = False) -> DataFrame:
    """node, label of each partition's graph, of rows of voting.BLOCK or, with `by_id`, of rows a, b, weight in the order of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = voting.Graph(voting.sorted_blocks(batches) if by_id else batches, by_id)
        label = rule(held)
        some = np.flatnonzero(label >= 0)
        for k in range(0, len(some), 65_536):
            part = some[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(held.ids[part]), pa.array(held.ids[label[part]])], ["node", "label"])

    return materialise(blocks.mapInArrow(run, "node long, label long"), name)


def whispers(edges: DataFrame, kept: bool = False) -> DataFrame:
    """node, label for edges a, b, weight. Voting is sequential, so each component is one task's work;
    components are independent of one another. A task gets its edges in order, and holds a block of them
    at a time. kept: the edges are a table already; else they are made one, as they are read twice."""
    edges = edges if kept else materialise(edges.select("a", "b", "weight"), "whispers-edges")
    placed = edges.join(components(edges), F.col("a") == F.col("node"))
    way = lambda a, b: F.struct(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    rows = placed.select("component", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), F.col("weight").cast("double").alias("weight")).select("component", "e.a", "e.b", "weight")
    return labels_of(rows.repartition("component").sortWithinPartitions("a", "b").drop("component"), "whispers", voting.voted, True)


def labels_near(vectors: DataFrame, id: str, vector: str, threshold: float, name: str, rule: Callable[[voting.Graph], np.ndarray]) -> DataFrame:
    """node, label by `rule` over all pairs with a cosine of at least `threshold`, none of which is a row.

    Neighbour lists are found by all tasks and pass one shuffle, packed. One task votes for all
    components: it holds labels and a block of edges, the others are in a temporary file.
    """
    lists, sent = neighbours(vectors, id, vector, threshold)
    found = labels_of(lists.repartition(1), name, rule)
    for b in sent:
        b.destroy()
    return found


def whispers_near(vectors: DataFrame, id: str, vector: str, threshold: float) -> DataFrame:
    """`whispers` over the pairs of `labels_near`."""
    return labels_near(vectors, id, vector, threshold, "whispers", voting.voted)


def consensus_near(vectors: DataFrame, id: str, vector: str, threshold: float, leasts: list[float]) -> DataFrame:
    """`consensus` over the pairs of `labels_near`: of their `whispers`, of `whispers` over those of at least each of `leasts`, and of their components.

    An edge's ends always share their component, so that labeling puts every edge's ends together unasked.
    """
    keeps = [None, *((lambda a, b, w, least=least: w >= least) for least in leasts)]
    return labels_near(vectors, id, vector, threshold, "consensus", lambda held: voting.agreed(held, keeps, 1))


def consensus(labelings: list[DataFrame], edges: DataFrame) -> DataFrame:
    """Voting over the edges whose ends most of the labelings (node, label) put together."""
    votes = edges.select("a", "b", "weight", F.lit(0).alias("votes"))
    for x in labelings:
        x = materialise(x.select("node", "label"), "consensus-labels")  # read twice
        left, right = (x.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        votes = votes.join(left, "a", "left").join(right, "b", "left").select("a", "b", "weight", (F.col("votes") + F.coalesce((F.col("la") == F.col("lb")).cast("int"), F.lit(0))).alias("votes"))
    return whispers(votes.where(F.col("votes") * 2 > len(labelings)).select("a", "b", "weight"))


def duplicate_groups(pairs: DataFrame, verified: DataFrame, size: DataFrame) -> DataFrame:
    """group_id, node, best for pairs a, b: components whose members are all near their best member.

    verified: a, b of pairs that pass the second test. size: node, weight (larger is better).
    Members that aren't a verified neighbour of the best one leave; groups of one are none.
    """
    near = verified.select("a", "b").unionAll(verified.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return groups_beside(components(verified.select("a", "b")), size, lambda held: held.join(near, (F.col("node") == F.col("a")) & (F.col("best") == F.col("b")), "left_semi"))


def groups_beside(parts: DataFrame, size: DataFrame, beside: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`duplicate_groups` of components (node, component); beside: keeps the rows node, component, best whose node is a verified neighbour of the best."""
    ranked = parts.join(size, "node")
    best = ranked.groupBy("component").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("best"))
    held = parts.join(best, "component").select("component", "node", "best")
    kept = beside(held.where("node <> best")).select("component", "node", "best").unionAll(held.where("node = best"))
    names = kept.groupBy("component").agg(F.min("node").alias("group_id"), F.count(F.lit(1)).alias("members")).where("members >= 2")
    return kept.join(names, "component").select("group_id", "node", "best", "members")


def spherical_kmeans(vectors: DataFrame, id: str, vector: str, k: int, rounds: int = 20, seed: int = 7) -> DataFrame:
    """id and cluster by cosine k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select(F.col(id), array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(ready)
    return model.transform(ready).select(id, F.col("prediction").alias("cluster"))


def agreement(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """held: true groups kept in one cluster; split: in several; mixing: clusters with several true groups."""
    both = labels.join(truth, "node")
    per = both.groupBy("truth").agg(F.countDistinct("label").alias("n"), F.count(F.lit(1)).alias("m")).where("m >= 2")
    out = per.agg(F.count_if(F.col("n") == 1).alias("held"), F.count_if(F.col("n") > 1).alias("split"))
    mixed = both.groupBy("label").agg(F.countDistinct("truth").alias("n")).agg(F.count_if(F.col("n") > 1).alias("mixing"))
    return out.crossJoin(mixed)


