"""Files of several roots, scans applied to what is stored, snapshots and sidecars."""

import pytest
from pyspark.sql import functions as F

from skerry.operators.joins import applied, reconcile, symmetric_difference
from skerry.sources import files, snapshots

PNG, HEIC, M4A = b"\x89PNG\r\n\x1a\n1234", b"\0\0\0\x1cftypheic\0\0\0\0", b"\0\0\0\x1cftypM4A \0\0\0\0"


def test_roots_are_one_observation(spark, tmp_path):
    for name, held in {"a/x/one.png": PNG, "a/two.mov": HEIC, "b/x/one.png": M4A, "b/three.pdf": b"no magic"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(held)
    got = {(r.root, r.path): (r.kind, r.format) for r in files.observed(spark, {"A": f"{tmp_path}/a", "B": f"file://{tmp_path}/b"}).collect()}
    assert got == {("A", "x/one.png"): ("image", "png"), ("A", "two.mov"): ("image", "heif"), ("B", "x/one.png"): ("audio", "m4a"), ("B", "three.pdf"): ("document", None)}


def test_one_stored_content_goes_to_one_observed(spark):
    """Several observed rows with a moved content: the first has moved, the others are new; a null content was never hashed."""
    stored = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "y"), (5, "y")], "k long, c string")
    seen = spark.createDataFrame([(10, "a"), (11, "a"), (2, "z"), (3, "new"), (12, "y")], "k long, c string")
    got = {(r.o_key, r.s_key, r.outcome) for r in reconcile(seen, stored, "k", "c").collect()}
    assert got == {(10, 1, "moved"), (11, None, "new"), (2, 2, "matched"), (3, 3, "replaced"), (12, None, "ambiguous"), (None, 4, "missing"), (None, 5, "missing")}
    walked = {(r.o_key, r.s_key, r.outcome) for r in reconcile(seen, stored, "k", "c", F.col("k") != 4).collect()}
    assert walked == got - {(None, 4, "missing")}


def test_a_scan_deletes_nothing(spark):
    stored = spark.createDataFrame([(1, "/a", "a", None), (2, "/b", "b", None), (3, "/c", "c", 5.0), (4, "/d", "d", 5.0), (9, "/other", "o", None)], "id long, path string, sha string, missing_since double")
    seen = spark.createDataFrame([("/a", "a"), ("/moved", "b"), ("/c", "c2"), ("/new", "n")], "path string, sha string")
    got = {(r.id, r.path, r.sha, r.missing_since, r.outcome) for r in applied(seen, stored, "id", "path", "sha", F.lit(7.0), F.col("path") != "/other").collect()}
    assert got == {(1, "/a", "a", None, "matched"), (2, "/moved", "b", None, "moved"), (3, "/c", "c2", None, "replaced"), (4, "/d", "d", 5.0, "missing"), (9, "/other", "o", None, None), (10, "/new", "n", None, "new")}


def test_snapshots_are_for_their_maker(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>")
    space = snapshots.Space("s", 1, "cosine", "p", "1")
    path = f"file://{tmp_path}/space"
    assert snapshots.restore(spark, path, space) is None
    snapshots.write(rows, path, space)
    assert snapshots.restore(spark, path, space).count() == 2
    for other in (snapshots.Space("s", 2, "cosine", "p", "1"), snapshots.Space("s", 1, "cosine", "p", "2"), snapshots.Space("t", 1, "cosine", "p", "1")):
        assert snapshots.restore(spark, path, other) is None
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    assert snapshots.restore(spark, path, space) is None


@pytest.mark.parametrize(("raw", "want"), [('{"a": {"b": [1, {"c": "x"}]}, "d": null, "e": false}', {"a.b.0": "1", "a.b.1.c": "x", "e": "false"}), ("[1]", None), ("no", None), (None, None), ("{}", {})])
def test_sidecars(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(files.sidecar(F.col("raw")).alias("m")).first().m
    assert got == want


def test_symmetric_difference(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "x long") for rows in ([1, 1, 2, None], [2, 3, 3]))
    assert sorted((r.x for r in symmetric_difference(a, b).collect()), key=str) == sorted([1, 3, None], key=str)
