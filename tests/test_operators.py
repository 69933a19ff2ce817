"""Operators against plain Python on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import moments, text
from skerry.functions.vector import sign_bits
from skerry.operators import answer, graph, similarity, timeline
from skerry.operators.joins import asof, overlapping, reconcile
from skerry.operators.ranking import bm25, fused, fused_spaces, head, head_of_spaces, ranked, standing_in_spaces
from skerry.operators.similarity import hamming_pairs, range_pairs, top_k
from skerry.sources.files import sniffed, walk


def test_order_page_and_places_agree(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(57)]
    items = spark.createDataFrame(rows, "id long, s int").repartition(5)
    order = answer.total_order("s", "id", True)
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))]
    placed = {r.ordinal: r.id for r in answer.ordered(items, order).collect()}
    assert [placed[k + 1] for k in range(57)] == want
    page = sorted((r.ordinal, r.id) for r in answer.page(items, order, 3, 10).collect())
    assert [i for _, i in page] == want[20:30]
    assert [i for _, i in sorted((r.ordinal, r.id) for r in answer.page(items, order, 99, 10).collect())] == want[50:]
    around = sorted((r.ordinal, r.id) for r in answer.neighbourhood(items, "id", order, want[2], 9).collect())
    assert [i for _, i in around] == want[:9]
    one = answer.located(items, "id", order, want[0], 10).first()
    assert (one.ordinal, one.previous_id, one.next_id, one.first_id, one.last_id, one.page) == (1, None, want[1], want[0], want[-1], 1)
    assert answer.located(items, "id", order, 999, 10).count() == 0
    assert answer.page(items.where("false"), order, 2, 10).count() == 0


def test_digest_names_the_order(spark):
    items = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, s int")
    one = answer.digest(items, "id", answer.total_order("s", "id", True)).first()
    same = answer.digest(items.repartition(7), "id", answer.total_order("s", "id", True)).first()
    other = answer.digest(items, "id", answer.total_order("s", "id", False)).first()
    assert one == same
    assert one.members == 40
    assert one.digest != other.digest


def test_asof_matches_a_scan(spark):
    pick = random.Random(1)
    left = [(i, pick.randrange(3), pick.randrange(50)) for i in range(60)]
    right = [(i, pick.randrange(3), pick.randrange(50)) for i in range(40)]
    right = list({(u, t): (i, u, t) for i, u, t in right}.values())
    a = spark.createDataFrame(left, "id long, u int, t int")
    b = spark.createDataFrame(right, "rid long, u int, s int")
    back = {r.id: r.rid for r in asof(a, b, "u", "t", "s", ["rid"]).collect()}
    ahead = {r.id: r.rid for r in asof(a, b, "u", "t", "s", ["rid"], forward=True).collect()}
    for i, u, t in left:
        older = [(s, r) for r, v, s in right if v == u and s <= t]
        newer = [(s, r) for r, v, s in right if v == u and s >= t]
        assert back[i] == (max(older)[1] if older else None)
        assert ahead[i] == (min(newer)[1] if newer else None)


def test_overlaps_once(spark):
    a = spark.createDataFrame([(1, "x", 0, 25), (2, "x", 30, 31), (3, "y", 5, 6)], "id long, g string, lo int, hi int")
    b = spark.createDataFrame([(7, "x", 10, 31), (8, "y", 6, 9), (9, "y", 7, 9)], "other long, g string, start int, stop int")
    got = sorted((r.id, r.other) for r in overlapping(a, b, "g", 10, "lo", "hi", "start", "stop").collect())
    assert got == [(1, 7), (2, 7), (3, 8)]


def test_reconcile_partitions_both_sides(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "d")], "k long, c string")
    seen = spark.createDataFrame([(1, "a"), (20, "b"), (3, "x"), (40, "d"), (50, "new")], "k long, c string")
    got = sorted((str(r.o_key), str(r.s_key), r.outcome) for r in reconcile(seen, stored, "k", "c").collect())
    assert got == sorted([("1", "1", "matched"), ("20", "2", "moved"), ("3", "3", "replaced"), ("40", "None", "ambiguous"), ("50", "None", "new"), ("None", "4", "missing"), ("None", "5", "missing")])


def test_sessions_split_strictly(spark):
    times = [0, 10, 20, 31, 100, 200, 205]
    events = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "id long, u int, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    found = timeline.sessions(events, "ts", "id", 10_000_000, "u").collect()
    assert sorted((r.first_us // 10**6, r.last_us // 10**6, r.members) for r in found) == [(0, 20, 3), (200, 205, 2)]
    everyone = timeline.global_sessions(events, "ts", "id", 10_000_000, 15_000_000).collect()
    assert sorted((r.first_us // 10**6, r.last_us // 10**6, r.members) for r in everyone) == [(0, 20, 3), (200, 205, 2)]


def test_range_pairs_over_blocks(spark):
    pick = np.random.default_rng(7)
    m = pick.normal(size=(60, 8))
    m[5] = 0
    df = spark.createDataFrame([(i * 10 + 5, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")
    u = m.astype(np.float32).astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, n, out=u, where=n > 0)
    want = {(i * 10 + 5, j * 10 + 5) for i, j in itertools.combinations(range(60), 2) if u[i] @ u[j] >= 0.5}
    assert {(r.a, r.b) for r in range_pairs(df, "id", "v", 0.5, block_rows=13).collect()} == want
    for pivots in (1, 6, 64):
        assert {(r.a, r.b) for r in range_pairs(df, "id", "v", 0.5, block_rows=7, pivots=pivots).collect()} == want
    low = {(i * 10 + 5, j * 10 + 5) for i, j in itertools.combinations(range(60), 2) if u[i] @ u[j] >= -0.2}
    assert {(r.a, r.b) for r in range_pairs(df, "id", "v", -0.2, block_rows=13).collect()} == low
    got = {(r.query_id, r.place): r.id for r in top_k(df, df, "id", "v", 4, block_rows=11, block_queries=9).collect()}
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-float(u[i] @ u[j]), j))
        assert [got[i * 10 + 5, k] for k in range(1, 5)] == [j * 10 + 5 for j in order[:4]]
    best = top_k(df, df.where("id = 15"), "id", "v", 3).orderBy("place").collect()
    s = u @ u[1]
    assert [r.id for r in best] == [i * 10 + 5 for i in sorted((i for i in range(60) if i != 1), key=lambda i: -s[i])[:3]]


@pytest.mark.parametrize(("radius", "bands"), [(3, 4), (4, 5), (9, 0), (16, 0)])
def test_hamming_pairs_lose_none(spark, radius, bands):
    pick = random.Random(radius)
    base = [pick.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in pick.sample(range(64), pick.randrange(radius + 3))) for b in base for _ in range(6)]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {(r.a, r.b) for r in hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", radius, bands).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= radius}


def test_distant_cells_are_not_compared(spark):
    """Vectors in two far bundles: no tile joins them."""
    rows = [(i, [1.0, 0.01 * (i % 7), 0.0]) for i in range(40)] + [(100 + i, [-1.0, 0.01 * (i % 7), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert range_pairs(df, "id", "v", 0.9, block_rows=16).count() == 2 * 40 * 39 // 2


def test_narrow_bands_are_refused(spark):
    with pytest.raises(ValueError, match="bands"):
        hamming_pairs(spark.createDataFrame([(1, 1)], "id long, h long"), "id", "h", 16, 8)


def test_sign_bits(spark):
    one = spark.createDataFrame([([1.0] * 63 + [2.0],), ([-1.0] * 64,), ([1.0] + [-1.0] * 63,)], "v array<double>")
    assert [r.b for r in one.select(sign_bits(F.col("v")).alias("b")).collect()] == [-1, 0, 1]


def test_components_and_votes(spark):
    pick = random.Random(3)
    pairs = [(a, b) for a, b in ((pick.randrange(80), pick.randrange(80)) for _ in range(50)) if a != b] + [(200 + i, 201 + i) for i in range(30)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in up}
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 0.1), (4, 5, 1.0)], "a long, b long, weight double")
    labels = {r.node: r.label for r in graph.whispers(edges).collect()}
    assert labels[1] == labels[2] == labels[3]
    assert labels[4] == labels[5] != labels[1]


def test_tags_and_tails(spark):
    row = spark.createDataFrame([("a <lora:x:0.5> <lora:y> <lora:x:9> <lyco:z:te=0.2:unet=0.3>\nSteps: 5, Sampler: e, Note: \"a, b: c\"",), ("",), (None,)], "t string")
    got = row.select(text.network_tags(F.col("t")).alias("n"), text.infotext(F.col("t")).alias("i")).collect()
    assert [tuple(x) for x in got[0].n] == [("x", 0.5, 0.5), ("y", 1.0, 1.0), ("z", 0.2, 0.3)]
    assert got[0].i == {"Steps": "5", "Sampler": "e", "Note": "a, b: c"}
    assert got[1].n == []
    assert got[1].i is None
    assert got[2].i is None


def test_stamps(spark):
    names = [("IMG_20240229_1.jpg", "2024-02-29"), ("x-2023.02.30", None), ("120240101", None), ("1850-12-31", "1850-12-31")]
    got = spark.createDataFrame([(n,) for n, _ in names], "n string").select(moments.name_day(F.col("n")).alias("d")).collect()
    assert [r.d for r in got] == [d for _, d in names]


def test_walk_sniffs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "y.mp3").write_bytes(b"none")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: (r.format, r.kind, r.size) for r in walk(spark, str(tmp_path)).collect()}
    # The source has no row for a file without bytes.
    assert got == {"x.txt": ("png", "image", 11), "y.mp3": (None, "audio", 4)}
    assert sniffed(F.lit(b"\x00\x00\x00\x18ftypmp42")) is not None


def test_equal_texts_have_equal_scores(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    same = " ".join(w for k, w in enumerate(words) for _ in range(k + 1)) + " and more"
    rows = [(i, same if i % 2 else f"other text {i} {words[i % 5]} {words[i % 3]}") for i in range(400)] + [(400, None), (401, "")]
    scores = {r.id: r.score for r in bm25(spark.createDataFrame(rows, "id long, text string"), "id", "text", words).collect()}
    assert len(scores) == 400
    assert len({scores[i] for i in range(1, 400, 2)}) == 1


@pytest.mark.parametrize("rows", [0, 1, 2, 90])
def test_whole_spaces_are_those_of_all_pairs(spark, monkeypatch, rows):
    """Ties, vectors of length 0, queries that aren't among the vectors, blocks and tasks of a few."""
    monkeypatch.setattr(similarity, "SENT_ROWS", 7)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 3)
    monkeypatch.setattr(similarity, "SPACE_BYTES", 800)
    pick = np.random.default_rng(3)
    every = [(i * 3, [float(x) for x in (pick.integers(-1, 2, 6) if i % 4 else np.zeros(6))]) for i in range(max(rows, 5))]
    pick.shuffle(every)
    df = spark.createDataFrame(every, "id long, v array<float>").repartition(4)
    among, asks = df.where(F.col("id") < 3 * rows), df.where("id % 2 = 0")
    pairs = similarity.scores(among, asks, "id", "v").localCheckpoint()
    told = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert told(fused_spaces(among, asks, "id", "v").select("id", "fusion", "spaces")) == told(fused(ranked(pairs, "id", "query_id"), "id").select("id", "fusion", "spaces"))
    judged = head(pairs, "query_id")
    assert told(head_of_spaces(among, asks, "id", "v").select("query_id", "id", "score")) == told(judged.where("answers").select("query_id", "id", "score"))
    assert told(standing_in_spaces(among, asks, "id", "v")) == told(judged.groupBy("id").agg(F.max("relevance"), F.max("answers")))


@pytest.mark.parametrize("name", ["ret_rrf", "ret_answering_set", "ret_head_cut", "ret_standing", "ret_rrf_constrained"])
def test_rankings_have_no_row_for_each_pair(spark, sf_dir, monkeypatch, name):
    from skerry.plans import retrieval

    def refused(*_):
        raise AssertionError("scores of all pairs are rows")

    monkeypatch.setattr(retrieval, "scores", refused)
    assert getattr(retrieval, name)(spark, sf_dir).count() > 0


def test_linked_has_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SENT_ROWS", 11)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)
    pick = np.random.default_rng(11)
    rows = [(i * 7, [float(x) for x in (pick.normal(size=9) if i % 10 else np.zeros(9))]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    u = np.array([v for _, v in rows], np.float32).astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    unit = np.divide(u, n, out=u.copy(), where=n > 0)
    for signs in (64, 3):
        root = list(range(70))
        for i, j in itertools.combinations(range(70), 2):
            if unit[i] @ unit[j] >= 0.6 and sum((u[i] > 0) != (u[j] > 0)) <= signs and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        got = {r.node: r.component for r in graph.components(similarity.linked(df, "id", "v", 0.6, signs)).collect()}
        assert got == {i * 7: root[i] * 7 for i in range(70) if root.count(root[i]) > 1}


def test_duplicate_groups_have_no_row_for_each_pair(spark, sf_dir, monkeypatch):
    from skerry.plans import graphs

    def refused(*_):
        raise AssertionError("all pairs are rows")

    monkeypatch.setattr(graphs, "range_pairs", refused)
    assert graphs.dupe_groups(spark, sf_dir).count() > 0


def test_components_of_many_edges_from_few(spark, monkeypatch):
    monkeypatch.setattr(graph, "REDUCED", 50)
    edges = [(i, j) for i, j in itertools.combinations(range(40), 2) if i % 3 == j % 3] + [(50, 50), (60, 61)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(2)
    assert {(r.node, r.component) for r in graph.components(df).collect()} == {(i, i % 3) for i in range(40)} | {(60, 60), (61, 60)}
    assert graph.forest(df.coalesce(1)).count() <= 41 * -(-len(edges) // 50)
    monkeypatch.setattr(graph, "REDUCED", 1 << 21)
    assert graph.forest(df.coalesce(1)).count() == 38
