"""Queries: stamps in names and folders, and claims of when something was made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import when
from ..sources.tables import load, seconds
from .registry import query


def at(pattern: str, column: str = "ts"):
    return F.date_format(column, pattern)


@query("when_name_stamp", """
WITH e AS (SELECT event_id, event_id % 9 AS k, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS s, CAST(epoch(date_trunc('day', ts)) AS DOUBLE) AS d FROM events)
SELECT event_id, CASE WHEN k IN (0, 1, 2, 7) THEN s WHEN k = 3 THEN s + 0.321::DOUBLE WHEN k IN (4, 5) THEN d WHEN k = 6 THEN s + 0.5::DOUBLE END AS at,
 CASE WHEN k IN (0, 1, 2, 7) THEN 'second' WHEN k IN (3, 6) THEN 'subsecond' WHEN k IN (4, 5) THEN 'day' END AS precision FROM e
""")
def when_name_stamp(spark, sf_dir):
    names = [
        F.concat(F.lit("IMG_"), at("yyyyMMdd_HHmmss"), F.lit(".jpg")),
        F.concat(F.lit("Screenshot "), at("yyyy-MM-dd"), F.lit(" at "), at("HH.mm.ss"), F.lit(".png")),
        F.concat(at("yyyyMMdd"), F.lit("T"), at("HHmmss"), F.lit("007.png")),
        F.concat(F.lit("PXL_"), at("yyyyMMdd_HHmmss"), F.lit("321.jpg")),
        F.concat(F.lit("IMG-"), at("yyyyMMdd"), F.lit("-WA0001.jpg")),
        F.concat(F.lit("scan 9999-99-99 "), at("yyyy_MM_dd"), F.lit(".tif")),
        F.concat(F.lit("v"), F.unix_seconds(F.col("ts").cast("timestamp")), F.lit("500.mp4")),
        F.concat(F.lit("v"), F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(".mp4")),
        F.concat(F.lit("IMG_1234_"), F.col("event_id"), F.lit(".jpg")),
    ]
    name = F.element_at(F.array(*names), (F.col("event_id") % 9 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", when.name_stamp(name).alias("w")).select("event_id", "w.*")


@query("when_folder", """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(epoch(date_trunc('day', o_orderdate)) AS DOUBLE) AS d, CAST(epoch(date_trunc('month', o_orderdate)) AS DOUBLE) AS m, CAST(epoch(date_trunc('year', o_orderdate)) AS DOUBLE) AS y, CAST(epoch(date_trunc('decade', o_orderdate)) AS DOUBLE) AS t FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN d WHEN k IN (2, 3) THEN m WHEN k = 4 THEN y WHEN k = 5 THEN t END AS at, CASE WHEN k IN (0, 1) THEN 'day' WHEN k IN (2, 3) THEN 'month' WHEN k = 4 THEN 'year' WHEN k = 5 THEN 'decade' END AS precision FROM o
""")
def when_folder(spark, sf_dir):
    d = lambda p: at(p, "o_orderdate")
    paths = [
        F.array(F.lit("1999"), F.lit("a"), d("yyyy-MM-dd"), F.lit("raw")), F.array(d("yyyy"), d("M"), d("d")), F.array(F.lit("2001-02-30"), d("yyyy_MM")), F.array(d("yyyy"), d("MM"), F.lit("best")),
        F.array(F.lit("1850"), d("yyyy")), F.array(F.concat(F.substring(d("yyyy"), 1, 3), F.lit("0's"))), F.array(F.lit("1799"), F.lit("2003-13")), F.array(F.lit("200307x")),
    ]
    chosen = F.element_at(F.array(*paths), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", when.folder_stamp(chosen).alias("w")).select("o_orderkey", "w.*")


def shown(rows, id):
    """A verdict's columns, lists as texts."""
    told = [F.array_join(F.col("w")[c], "; ").alias(c) for c in ("supports", "conflicts")]
    return rows.where("w is not null").select(id, *[F.col("w")[c].alias(c) for c in ("at", "instant", "precision", "basis", "finished_at", "estimated_at")], *told)


@query("when_judged", """
WITH e AS (SELECT event_id, event_id % 4 AS k, event_id % 5 AS f, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS s, CAST(epoch(date_trunc('day', ts)) AS DOUBLE) AS d FROM events),
c AS (SELECT *, CASE k WHEN 0 THEN s WHEN 1 THEN d END AS claim, CASE k WHEN 0 THEN 1.0::DOUBLE ELSE 86400.0::DOUBLE END AS width, CASE f WHEN 0 THEN s + 30 WHEN 1 THEN s - 200000 WHEN 2 THEN s + 200000 WHEN 3 THEN NULL ELSE s END AS mtime, CASE f WHEN 2 THEN s - 90000 WHEN 4 THEN s + 5 END AS btime FROM e),
j AS (SELECT *, mtime >= claim - 2 AND mtime < claim + width + 90 AS ok FROM c)
SELECT event_id, claim AS at, CASE WHEN claim IS NULL THEN CASE WHEN btime < mtime OR mtime IS NULL THEN btime ELSE mtime END END AS instant,
 CASE k WHEN 0 THEN 'second' WHEN 1 THEN 'day' ELSE 'subsecond' END AS precision, CASE WHEN k < 2 THEN CASE k WHEN 0 THEN 'filename' ELSE 'folder' END WHEN btime < mtime OR mtime IS NULL THEN 'btime' ELSE 'mtime' END AS basis,
 CASE WHEN ok THEN mtime END AS finished_at, NULL::DOUBLE AS estimated_at,
 CASE WHEN k < 2 THEN concat_ws('; ', CASE WHEN k = 0 THEN 'folder_day' END, CASE WHEN ok THEN 'mtime_consistent' END, CASE WHEN btime >= claim - 1 THEN 'btime_after_claim' END, CASE WHEN mtime IS NOT NULL OR btime IS NOT NULL THEN 'host_zone_assumed' END) ELSE CASE WHEN abs(btime - mtime) <= 86400 THEN 'btime_consistent' ELSE '' END END AS supports,
 CASE WHEN k < 2 THEN concat_ws('; ', CASE WHEN mtime < claim - 2 THEN 'filesystem: mtime before the claim' END, CASE WHEN mtime >= claim + width + 90 THEN 'filesystem: mtime after the claim' END, CASE WHEN btime < claim - 1 THEN 'filesystem: btime before the claim' END) ELSE '' END AS conflicts
FROM j WHERE k < 2 OR mtime IS NOT NULL OR btime IS NOT NULL
""")
def when_judged(spark, sf_dir):
    id, s = F.col("event_id"), F.floor(seconds(F.col("ts"))).cast("double")
    name = F.when(id % 4 == 0, F.concat(F.lit("IMG_"), at("yyyyMMdd_HHmmss"), F.lit(".jpg"))).otherwise(F.lit("x.jpg"))
    folders = F.when(id % 4 < 2, F.array(F.lit("a"), at("yyyy-MM-dd"))).otherwise(F.array(F.lit("a")))
    mtime = F.when(id % 5 == 0, s + 30).when(id % 5 == 1, s - 200000).when(id % 5 == 2, s + 200000).when(id % 5 == 4, s)
    btime = F.when(id % 5 == 2, s - 90000).when(id % 5 == 4, s + 5)
    found = load(spark, sf_dir, "events").select("event_id", "ts", when.name_stamp(name).alias("stamp"), when.folder_stamp(folders).alias("dated"))
    return shown(found.select("event_id", when.judge_file(F.col("stamp"), F.col("dated"), mtime, btime).alias("w")), "event_id")


@query("when_filesystem", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) END AS m, CASE WHEN event_id % 2 = 0 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) - 3600 * (event_id % 40) END AS b FROM events)
SELECT event_id, NULL::DOUBLE AS at, coalesce(m, b) AS instant, 'subsecond' AS precision, CASE WHEN m IS NULL THEN 'btime' ELSE 'mtime' END AS basis, NULL::DOUBLE AS finished_at, NULL::DOUBLE AS estimated_at, CASE WHEN abs(b - m) <= 86400 THEN 'btime_consistent' ELSE '' END AS supports, '' AS conflicts FROM e WHERE m IS NOT NULL OR b IS NOT NULL
""")
def when_filesystem(spark, sf_dir):
    id, s = F.col("event_id"), F.floor(seconds(F.col("ts"))).cast("double")
    rows = load(spark, sf_dir, "events").select("event_id", when.judge_filesystem(F.when(id % 3 != 0, s), F.when(id % 2 == 0, s - 3600 * (id % 40))).alias("w"))
    return shown(rows, "event_id")


@query("when_captured", """
WITH e AS (SELECT event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS s, event_id % 3 AS z, event_id % 4 AS k FROM events),
c AS (SELECT *, s + CASE WHEN k = 0 THEN 0.25::DOUBLE ELSE 0 END AS local, CASE z WHEN 0 THEN 60 WHEN 1 THEN -120 END AS zone FROM e),
i AS (SELECT *, local - zone * 60.0::DOUBLE AS instant, coalesce(local - zone * 60.0::DOUBLE, local) AS start, CASE k WHEN 1 THEN s + 5 WHEN 2 THEN s - 900000 WHEN 3 THEN s + 900000 END AS mtime FROM c)
SELECT event_id, local AS at, instant, CASE WHEN k = 0 THEN 'subsecond' ELSE 'second' END AS precision, 'capture' AS basis, CASE WHEN mtime >= start - 2 AND mtime <= start + 90 THEN mtime END AS finished_at, NULL::DOUBLE AS estimated_at,
 concat_ws('; ', CASE WHEN k = 0 THEN 'exif_subsecond' END, CASE WHEN z = 0 THEN 'exif_offset' END, CASE WHEN z = 1 OR z = 0 AND event_id % 2 = 0 THEN 'maker_timezone' END, CASE WHEN z = 2 AND mtime IS NOT NULL THEN 'host_zone_assumed' END, CASE WHEN mtime >= start - 2 AND mtime <= start + 90 THEN 'mtime_write_consistent' END) AS supports,
 concat_ws('; ', CASE WHEN z = 0 AND event_id % 2 <> 0 THEN 'camera: its zones disagree' END, CASE WHEN mtime < start - 2 THEN 'filesystem: mtime before the capture' END, CASE WHEN mtime > start + 90 THEN 'filesystem: mtime after the capture' END) AS conflicts FROM i
""")
def when_captured(spark, sf_dir):
    id, s = F.col("event_id"), F.floor(seconds(F.col("ts"))).cast("double")
    offset = F.when(id % 3 == 0, 60)
    maker = F.when((id % 3 == 0) & (id % 2 == 0), 60).when(id % 3 == 0, 0).when(id % 3 == 1, -120)
    mtime = F.when(id % 4 == 1, s + 5).when(id % 4 == 2, s - 900000).when(id % 4 == 3, s + 900000)
    verdict = when.judge_capture(s, F.when(id % 4 == 0, 250), offset, maker, mtime, F.lit(None).cast("double"))
    return shown(load(spark, sf_dir, "events").select("event_id", verdict.alias("w")), "event_id")


@query("when_generated", """
WITH e AS (SELECT event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS s, CAST(epoch(date_trunc('day', ts)) AS DOUBLE) AS d, event_id % 3 AS n, event_id % 4 AS k FROM events),
c AS (SELECT *, CASE WHEN n < 2 THEN s END AS stamped, CASE n WHEN 0 THEN d WHEN 1 THEN d + 86400 ELSE s END AS claimed, CASE k WHEN 0 THEN s + 10 WHEN 1 THEN s + 40 WHEN 2 THEN s - 5000 WHEN 3 THEN s + 5000 END AS mtime, CASE WHEN k = 1 THEN 40.0::DOUBLE END AS took FROM e),
j AS (SELECT *, CASE WHEN took IS NOT NULL THEN mtime - took >= s - 90 AND mtime - took < s + 91 ELSE mtime >= s AND mtime < s + 91 END AS good FROM c)
SELECT event_id, s AS at, NULL::DOUBLE AS instant, 'second' AS precision, CASE WHEN n < 2 THEN 'filename' ELSE 'embedded' END AS basis, CASE WHEN good THEN mtime END AS finished_at, CASE WHEN good AND took IS NOT NULL THEN mtime - took END AS estimated_at,
 concat_ws('; ', CASE WHEN n = 0 THEN 'embedded_day' END, CASE WHEN good AND took IS NOT NULL THEN 'mtime_finish_consistent' WHEN good THEN 'mtime_consistent' END, 'host_zone_assumed') AS supports,
 concat_ws('; ', CASE WHEN n = 1 THEN 'generator: the name''s moment isn''t in the embedded claim' END, CASE WHEN NOT good AND mtime < s THEN 'filesystem: mtime before the claim' WHEN NOT good THEN 'filesystem: mtime after the claim' END) AS conflicts FROM j
""")
def when_generated(spark, sf_dir):
    id, s = F.col("event_id"), F.floor(seconds(F.col("ts"))).cast("double")
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double")
    claimed = F.when(id % 3 == 0, day).when(id % 3 == 1, day + 86400).otherwise(s)
    mtime = F.when(id % 4 == 0, s + 10).when(id % 4 == 1, s + 40).when(id % 4 == 2, s - 5000).otherwise(s + 5000)
    verdict = when.judge_generation(claimed, F.when(id % 3 < 2, "day").otherwise("second"), F.when(id % 3 < 2, s), F.lit(None).cast("int"), mtime, F.lit(None).cast("double"), F.when(id % 4 == 1, 40.0))
    return shown(load(spark, sf_dir, "events").select("event_id", verdict.alias("w")), "event_id")
