"""Time: bins, sessions, islands, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import micros
from ..storage import materialise


def islands(rows: DataFrame, starts: Column, order: list, by: list[str], name: str = "island") -> DataFrame:
    """Numbers runs: a new one where `starts` is true, counted inside `by`."""
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, moment: str, id: str, gap_us: int, by: str, least: int = 2) -> DataFrame:
    """by, session, first_us, last_us, members: acts not more than `gap_us` apart, `least` at least."""
    rows = events.select(id, by, micros(F.col(moment)).alias("us"))
    order = Window.partitionBy(by).orderBy("us", id)
    before = F.lag("us").over(order)
    marked = rows.withColumn("new", before.isNull() | (F.col("us") - before > gap_us))
    placed = islands(marked, F.col("new"), ["us", id], [by], "session")
    return placed.groupBy(by, "session").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def global_sessions(events: DataFrame, moment: str, id: str, gap_us: int, bucket_us: int, least: int = 2) -> DataFrame:
    """Sessions of all acts together, without one task seeing them all.

    Buckets of `bucket_us` are split into runs; a run that ends within the gap of the next
    bucket's first act continues it. Only the first and last act of each bucket's runs take
    part in that second, much smaller pass.
    """
    rows = events.select(id, micros(F.col(moment)).alias("us")).withColumn("bucket", F.floor(F.col("us") / bucket_us))
    inside = Window.partitionBy("bucket").orderBy("us", id)
    before = F.lag("us").over(inside)
    runs = islands(rows.withColumn("new", before.isNull() | (F.col("us") - before > gap_us)), F.col("new"), ["us", id], ["bucket"], "run")
    runs = materialise(runs.groupBy("bucket", "run").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")), "runs")
    # A run inside a bucket can't be continued; only a bucket's first and last run meet those of other buckets.
    ends = Window.partitionBy("bucket")
    edged = runs.withColumn("lo", F.min("run").over(ends)).withColumn("hi", F.max("run").over(ends))
    inner = edged.where("run > lo and run < hi").select("first_us", "last_us", "n")
    outer = edged.where("run = lo or run = hi").select("first_us", "last_us", "n")
    whole = Window.orderBy("first_us")
    joined = islands(outer.withColumn("new", F.lag("last_us").over(whole).isNull() | (F.col("first_us") - F.lag("last_us").over(whole) > gap_us)), F.col("new"), ["first_us"], [], "session")
    chained = joined.groupBy("session").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("members"))
    return chained.select("first_us", "last_us", "members").unionAll(inner.select("first_us", "last_us", F.col("n").alias("members"))).where(F.col("members") >= least)


def merged(intervals: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each `by` as one."""
    window = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(window.rowsBetween(Window.unboundedPreceding, -1))
    placed = islands(intervals.withColumn("new", reach.isNull() | (F.col(start) > reach)), F.col("new"), [start, end], [by])
    return placed.groupBy(by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("island")


#: Grouper -> the kind of occurrence it reads, and the pause in minutes that ends a session.
GROUPERS = {"generation_session": ("generation", 30), "capture_session": ("capture", 180), "file_session": ("file", 180)}


def grouped(occurrences: DataFrame, grouper: str, least: int = 1) -> DataFrame:
    """grouper, axis, session, first, last, members of one grouper's sessions.

    occurrences: item, kind, local_at, instant_at (seconds). Those with an instant and those with
    a wall clock alone are on different axes and never meet. Sessions of an axis are global, so
    they are found in buckets of a day and joined at the buckets' ends.
    """
    kind, minutes = GROUPERS[grouper]
    own = occurrences.where(F.col("kind") == kind)
    out = None
    for axis, at in (("instant", F.col("instant_at")), ("wall", F.when(F.col("instant_at").isNull(), F.col("local_at")))):
        rows = own.select("item", F.timestamp_micros((at * 1_000_000).cast("long")).alias("at")).where("at is not null")
        found = global_sessions(rows, "at", "item", minutes * 60_000_000, 86_400_000_000, least)
        told = found.select(F.lit(grouper).alias("grouper"), F.lit(axis).alias("axis"), "first_us", "last_us", "members")
        out = told if out is None else out.unionByName(told)
    return out
