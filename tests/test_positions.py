"""Positions over several range partitions, with columns outside the order, against row_number."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.operators import answer

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(params=["true", "false"])
def adaptive(request, spark):
    """With and without adaptive execution, and never with partitions put together."""
    names = {"spark.sql.adaptive.enabled": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


CASES = [("events", "event_id", "ts"), ("orders", "o_orderkey", "o_totalprice"), ("documents", "doc_id", "n_chars"), ("documents", "doc_id", "lang")]


def rows_of(spark, sf_dir, name):
    rows = spark.read.parquet(f"{LARGE if os.path.isdir(LARGE) else sf_dir}/{name}.parquet")
    return rows.drop("text")


@pytest.mark.parametrize(("name", "id", "sort"), CASES)
@pytest.mark.parametrize("descending", [True, False])
def test_ordinals_equal_row_numbers(spark, sf_dir, adaptive, name, id, sort, descending):
    rows = rows_of(spark, sf_dir, name)
    order = answer.total_order(sort, id, descending)
    got = answer.ordered(rows, order)
    want = rows.select(id).withColumn("want", F.row_number().over(Window.orderBy(*order))) if sort == id else rows.select(id, F.col(sort).alias("__s")).withColumn("want", F.row_number().over(Window.orderBy(*answer.total_order("__s", id, descending)))).select(F.col(id).alias("__id"), "want")
    assert got.columns == [*rows.columns, "ordinal"]
    assert got.count() == rows.count()
    assert got.join(want, got[id] == want["__id"]).where("want <> ordinal").count() == 0


@pytest.mark.parametrize(("name", "id", "sort"), CASES[:3])
def test_windows_and_places(spark, sf_dir, adaptive, name, id, sort):
    rows = rows_of(spark, sf_dir, name)
    order = answer.total_order(sort, id, True)
    ids = [r[0] for r in rows.orderBy(*order).select(id).collect()]
    for at in (0, 3, len(ids) // 2, len(ids) - 1):
        got = answer.neighbourhood(rows, id, order, ids[at], 15).orderBy("ordinal").collect()
        first = max(0, min(at - 7, len(ids) - 15))
        assert [r[id] for r in got] == ids[first : first + 15]
        assert set(rows.columns) <= set(got[0].asDict())
    place = answer.located(rows, id, order, ids[-2], 60).collect()
    assert [(r.member, r.ordinal, r.total, r.previous_id, r.next_id, r.first_id, r.last_id, r.page) for r in place] == [(ids[-2], len(ids) - 1, len(ids), ids[-3], ids[-1], ids[0], ids[-1], -(-(len(ids) - 1) // 60))]
    assert answer.located(rows, id, order, -5, 60).count() == 0


@pytest.mark.parametrize("deep", [50_000, 10])
def test_pages_from_either_end(spark, monkeypatch, deep):
    monkeypatch.setattr(answer, "DEEP", deep)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(200)], "id long, s long").repartition(4)
    for descending in (True, False):
        order = answer.total_order("s", "id", descending)
        ids = [r.id for r in rows.orderBy(*order).collect()]
        for number in (1, 2, 4, 6, 7, 99):
            n = min(number, 7)
            got = answer.page(rows, order, number, 30).orderBy("ordinal").collect()
            assert [(r.id, r.ordinal) for r in got] == [(x, (n - 1) * 30 + k + 1) for k, x in enumerate(ids[(n - 1) * 30 : n * 30])]


def test_keyset_reaches_rows_without_value(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(1, 25)], "id long, s long")
    for descending in (True, False):
        order = [(r.s, r.id) for r in rows.orderBy(*answer.total_order("s", "id", descending)).collect()]
        now, seen = order[0], [order[0]]
        while step := answer.keyset_next(rows, "s", "id", now, 1, descending).collect():
            now = (step[0].s, step[0].id)
            seen.append(now)
        assert seen == order
