"""Operators without SQL against plain versions of themselves."""

import pathlib
import random
import time

import numpy as np
import pytest

from skerry.operators import answer, clusters, documents, graph, semantic, similarity, voting
from skerry.operators.graph import SWEEPS
from skerry.plans import registry
from skerry.plans.vectors import THRESHOLD
from skerry.storage import shared_dir
from skerry.streaming import runs


def weighted(seed, nodes=40, n=90):
    pick = random.Random(seed)
    pairs = {tuple(sorted(pick.sample(range(nodes), 2))) for _ in range(n)}
    return [(a, b, pick.choice([0.25, 0.5, 0.75, 1.0])) for a, b in sorted(pairs)]


def voted(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(SWEEPS):
        before = dict(label)
        for n in sorted(near):
            weight = {}
            for m, w in near[n]:
                weight[label[m]] = weight.get(label[m], 0) + w
            label[n] = min(x for x in weight if weight[x] == max(weight.values()))
        if label == before:
            break
    return label


@pytest.mark.parametrize("seed", range(4))
def test_whispers(spark, seed):
    edges = weighted(seed)
    got = {r.node: r.label for r in graph.whispers(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert got == voted(edges)


@pytest.mark.parametrize("most", [1, 7, 1 << 21])
def test_whispers_in_blocks(spark, monkeypatch, most):
    """Blocks of few edges, in a file: the same labels; self-loops, copies of edges and edges that don't count as well."""
    monkeypatch.setattr(voting, "IN_MEMORY", 64)
    edges = [*weighted(5, 60, 150), (1, 1, 1.0), (2, 3, 0.5), (2, 3, 0.5), (70, 71, 1.0)]
    blocks = list(cut(edges, most))
    assert (len(blocks) > 20) == (most < 10)
    held = voting.Graph(iter(blocks[::-1]), by_id=True)
    assert labels(held) == voted(edges)
    kept = [e for e in edges if e[2] >= 0.75]
    assert labels(held, lambda a, b, w: w >= 0.75) == voted(kept)


def cut(edges, most):
    """Blocks of whole nodes, of `most` edges or one node's."""
    both = sorted([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges])
    held = []
    for n in sorted({a for a, _, _ in both}):
        own = [e for e in both if e[0] == n]
        if held and len(held) + len(own) > most:
            yield one(held)
            held = []
        held += own
    yield one(held)


def one(held):
    a, b, w = (np.array(c) for c in zip(*held, strict=True))
    nodes, source = np.unique(a, return_inverse=True)
    return voting.block(nodes, nodes, source, b, w)


def labels(held, keep=None):
    label = voting.voted(held, keep)
    return {int(held.ids[n]): int(held.ids[x]) for n, x in enumerate(label) if x >= 0}


def bundled(spark, tmp_path, n=600):
    """A folder of embeddings of which most are near one another, and the edges of `graph_whispers`."""
    pick = np.random.default_rng(2)
    rows = [(i * 3 - 40, [float(x) for x in np.float32(np.eye(8)[i % 6] + np.eye(8)[7] * (i % 2 * 3 - 1.5) + pick.normal(size=8) * 0.5)], i % 5) for i in pick.permutation(n).tolist()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    m = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    ids = sorted(m)
    s = np.array([m[i] for i in ids]) @ np.array([m[i] for i in ids]).T
    return [(ids[x], ids[y], float(s[x, y])) for x, y in zip(*np.nonzero(np.triu(s >= THRESHOLD, 1)), strict=True)]


def test_whispers_writes_no_pair(spark, tmp_path, monkeypatch):
    """The labels of all pairs, while what is kept between steps grows with the vectors, not with the pairs."""
    edges = bundled(spark, tmp_path)
    monkeypatch.setattr(voting, "BLOCK_EDGES", 5000)
    assert len(edges) > 50_000
    before = kept(spark)
    got = {r.node: r.label for r in registry.QUERIES["graph_whispers"](spark, str(tmp_path)).collect()}
    assert kept(spark) - before < len(edges)
    want = voted(edges)
    assert got == want
    assert len(set(want.values())) > 1


def kept(spark):
    """Bytes of the tables kept between steps."""
    return sum(p.stat().st_size for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))


def test_neighbours_of_odd_vectors(spark):
    """Ids that come twice, vectors of length 0, pairs exactly at the threshold: both directions, once each."""
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (1, [0.0, 1.0]), (3, [0.0, 0.0]), (9, [1.0, 0.0]), (7, [-1.0, 0.0])]
    lists, _ = similarity.neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.6)
    held = voting.Graph(b for r in lists.toArrow().to_batches() for b in [r])
    found = sorted((int(held.ids[n]), int(held.ids[t]), round(float(w), 9)) for of in held.blocks for ends, target, weight in [held.edges(of, None)] for k, n in enumerate(of[0]) for t, w in zip(target[ends[k] : ends[k + 1]], weight[ends[k] : ends[k + 1]], strict=True))
    pairs = [(1, 2, 0.6), (1, 2, 0.8), (1, 9, 1.0), (2, 9, 0.6)]
    assert found == sorted(pairs + [(b, a, w) for a, b, w in pairs])


def test_consensus_writes_no_pair(spark, tmp_path, monkeypatch):
    """As with whispers, of three labelings, one of which lacks the nodes that only weak edges reach."""
    edges = bundled(spark, tmp_path)
    monkeypatch.setattr(voting, "BLOCK_EDGES", 5000)
    before = kept(spark)
    got = {r.node: r.label for r in registry.QUERIES["graph_consensus"](spark, str(tmp_path)).collect()}
    assert kept(spark) - before < len(edges)
    both = voted(edges), voted([e for e in edges if e[2] >= 0.38])
    assert got == voted([(a, b, w) for a, b, w in edges if sum(a in x and b in x and x[a] == x[b] for x in both) + 1 >= 2])


def test_agreement_of_labelings():
    """Sparse graphs, where labelings part the ends of edges and leave nodes out."""
    parted = 0
    for seed in range(12):
        edges = weighted(seed, 40, 60)
        held = voting.Graph(iter([*cut(edges, 9)]), by_id=True)
        some = [None, lambda a, b, w: w >= 0.5, lambda a, b, w: w >= 0.75]
        both = [voted([e for e in edges if e[2] >= least]) for least in (0, 0.5, 0.75)]
        agreed = [(a, b, w) for a, b, w in edges if 2 * (sum(a in x and b in x and x[a] == x[b] for x in both) + 1) > 4]
        parted += len(edges) - len(agreed)
        label = voting.agreed(held, some, 1)
        assert {int(held.ids[n]): int(held.ids[x]) for n, x in enumerate(label) if x >= 0} == voted(agreed)
    assert parted > 50


def test_consensus(spark):
    edges = weighted(9)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    pick = random.Random(1)
    labelings = [{n: n % k if pick.random() < 0.9 else 99 for n in nodes} for k in (2, 3, 2)]
    frames = [spark.createDataFrame(sorted(x.items()), "node long, label long") for x in labelings]
    got = {r.node: r.label for r in graph.consensus(frames, spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert got == voted([(a, b, w) for a, b, w in edges if sum(x[a] == x[b] for x in labelings) * 2 > 3])


def vectors(seed, n, centres=3):
    pick = np.random.default_rng(seed)
    middle = np.eye(8)[:centres] * 3
    return [(i, i % 4, [float(x) for x in middle[i % centres] + pick.normal(size=8) * 0.2]) for i in range(n)]


def test_kmeans_finds_bundles(spark):
    rows = vectors(3, 60)
    found = graph.spherical_kmeans(spark.createDataFrame(rows, "id long, g long, v array<double>"), "id", "v", 3).collect()
    assert {frozenset(r.id % 3 for r in found if r.cluster == c) for c in {r.cluster for r in found}} == {frozenset({0}), frozenset({1}), frozenset({2})}


@pytest.mark.parametrize("method", sorted(clusters.METHODS))
def test_methods_find_bundles(spark, method):
    df = spark.createDataFrame(vectors(4, 45), "id long, g long, v array<double>")
    members, groups = clusters.run(method, df, "id", "v", 0.8)
    got = {}
    for r in members.collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(k, 45, 3)) for k in range(3)]
    assert {r.label: r.members for r in groups.collect()} == {k: 15 for k in range(3)}
    assert clusters.silhouette(df, members, "id", "v").where("silhouette < 0.8").count() == 0
    with pytest.raises(ValueError, match="no method"):
        clusters.run("dream", df, "id", "v", 0.8)


def test_anchored_phases_and_families(spark):
    rows = vectors(5, 80)
    rows = [(i, g, None if i % 9 == 4 else v) for i, g, v in rows]
    df = spark.createDataFrame(rows, "at long, g long, v array<double>")
    got = {r["at"]: r.phase for r in documents.anchored_phases(df, "g", "at", "v", 0.7).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for g in range(4):
        phase, anchor = 0, None
        for i, _, v in [r for r in rows if r[1] == g]:
            if v is not None and anchor is None:
                anchor = unit(v)
            elif v is not None and float(anchor @ unit(v)) < 0.7:
                phase, anchor = phase + 1, unit(v)
            assert got[i] == phase
    families = {r["at"]: r.family for r in documents.family_phases(df, "g", "at", "v", 0.7).collect()}
    for g in range(4):
        own = [r for r in rows if r[1] == g]
        for i, _, v in own:
            same = [j for j, _, w in own if v is not None and w is not None and float(unit(v) @ unit(w)) >= 0.7]
            assert families[i] == (min(same) if same else i)


def test_hashed_spaces(spark):
    texts = [(1, "the red house"), (2, "The RED house!"), (3, "a blue boat"), (4, ""), (5, "red")]
    df = spark.createDataFrame(texts, "id long, text string")
    for name in semantic.PROVIDERS:
        got = {r.id: np.array(r.vector) for r in semantic.embedded(df, "id", "text", name).collect()}
        assert np.allclose(got[1], got[2])
        assert np.isclose(np.linalg.norm(got[1]), 1)
        if name == "words":
            assert not got[4].any()
    spaces = {name: semantic.embedded(df, "id", "text", name) for name in semantic.PROVIDERS}
    best = semantic.answered(spaces, "red house the", "id", 5).orderBy("fusion", ascending=False).collect()
    assert {best[0].id, best[1].id} == {1, 2}


def test_selections_are_held_to_their_answer(spark, monkeypatch):
    items = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, s long")
    order = answer.total_order("s", "id", True)
    expected = answer.digest(items, "id", order).first()["digest"]
    assert answer.held_to(items.where("id < 4"), items, "id", order, expected).count() == 4
    with pytest.raises(answer.Changed, match="isn't the one"):
        answer.held_to(items.where("id < 4"), items.where("id <> 7"), "id", order, expected)
    with pytest.raises(answer.Changed, match="holds items"):
        answer.held_to(spark.createDataFrame([(99,)], "id long"), items, "id", order, expected)
    monkeypatch.setattr(answer, "SELECTED_MOST", 3)
    with pytest.raises(ValueError, match="at most"):
        answer.held_to(items.where("id < 4"), items, "id", order, expected)


def test_shared_folder_is_wanted_on_a_cluster(spark, monkeypatch):
    from skerry import storage

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Elsewhere)
    assert runs.scratch(spark).startswith(storage.shared_dir(spark))


def test_a_kept_table_leaves_no_shuffle_files(spark):
    
    from skerry import storage

    release = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(release, "false")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(x) for x in (f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())) if x.startswith("shuffle_")}

    before = files()
    kept = storage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "seven")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(release) == "false"
    assert sorted((r["k"], r["count"]) for r in kept.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
