"""Queries: histograms, density, sessions, spans and silence on the time axis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.moments import MONDAY, bin_of
from ..operators import axis, timeline
from ..operators.answer import ordered
from ..sources import library
from ..sources.tables import load, micros, seconds
from .joins import SESSIONS_SQL
from .registry import query

GAP = 21_600_000_000


def events(spark, sf_dir):
    return load(spark, sf_dir, "events")


@query("tl_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def tl_months(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("tl_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 400")
def tl_days(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.desc("day")).limit(400)


@query("tl_density", """
SELECT CAST(trunc(epoch(ts) / 86400) AS BIGINT) * 86400 AS bin, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS others
FROM events GROUP BY 1
""")
def tl_density(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy(bin_of(seconds(F.col("ts")), 86400).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "purchase").alias("purchases"), F.count_if(~kind.isin("click", "purchase")).alias("others")
    )


@query("tl_density_fine", library.WITH + """
SELECT CAST(trunc(moment / 3600) AS BIGINT) * 3600 AS bin, count(*) AS n, round(sum(moment), 3) AS moments, count(*) FILTER (origin = 'captured') AS captured, count(*) FILTER (origin = 'generated') AS generated, count(*) FILTER (origin = 'mixed') AS mixed, count(*) FILTER (origin = 'imported') AS imported
FROM context WHERE granule <= 3600 GROUP BY 1
""")
def tl_density_fine(spark, sf_dir):
    """Hours of the human moment: only claims as fine as the bin count in it; sums give each bin's middle."""
    rows = library.tables(spark, sf_dir)["context"].where("granule <= 3600")
    by = [F.count_if(F.col("origin") == o).alias(o) for o in ("captured", "generated", "mixed", "imported")]
    return rows.groupBy(bin_of(F.col("moment"), 3600).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("moment"), 3).alias("moments"), *by)


@query("tl_session_faces", """
WITH p AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS place, count(*) OVER (PARTITION BY day) AS people FROM p)
SELECT day, user_id, n, place, people FROM r WHERE place <= 4
""")
def tl_session_faces(spark, sf_dir):
    """The four people most seen in each day, and how many there are."""
    per = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "user_id"))
    totals = per.groupBy("day").agg(F.count(F.lit(1)).alias("people"))
    return per.withColumn("place", place.cast("long")).where("place <= 4").join(totals, "day").select("day", "user_id", "n", "place", "people")


@query("tl_calendar_sheet", """
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS day), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(d.day, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '2024-01-01', CAST(d.day AS DATE)) // 7 AS BIGINT) AS week, CAST(isodow(d.day) AS BIGINT) AS weekday, month(d.day) = 1 AS inside, coalesce(n, 0) AS n FROM d LEFT JOIN n ON n.day = CAST(d.day AS DATE)
""")
def tl_calendar_sheet(spark, sf_dir):
    return axis.calendar_sheet(events(spark, sf_dir), F.col("ts"), 2024, 1)


@query("tl_year_grid", "WITH m AS (SELECT unnest(range(1, 13)) AS month), n AS (SELECT month(o_orderdate) AS month, count(*) AS n, min(day(o_orderdate)) AS first_day FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT m.month AS month, coalesce(n, 0) AS n, first_day FROM m LEFT JOIN n ON n.month = m.month")
def tl_year_grid(spark, sf_dir):
    return axis.year_grid(load(spark, sf_dir, "orders"), F.col("o_orderdate"), 1996)


@query("tl_presets", """
WITH p(name, lo, hi) AS (VALUES ('today', DATE '2024-01-17', DATE '2024-01-18'), ('yesterday', DATE '2024-01-16', DATE '2024-01-17'), ('this week', DATE '2024-01-15', DATE '2024-01-22'), ('this month', DATE '2024-01-01', DATE '2024-02-01'), ('this year', DATE '2024-01-01', DATE '2025-01-01'), ('last 7 days', DATE '2024-01-11', DATE '2024-01-18'), ('last 30 days', DATE '2023-12-19', DATE '2024-01-18'))
SELECT name, count(ts) AS n FROM p LEFT JOIN events ON ts >= lo AND ts < hi GROUP BY name
""")
def tl_presets(spark, sf_dir):
    return axis.preset_counts(events(spark, sf_dir), F.col("ts"), date(2024, 1, 17))


@query("tl_density_week_anchor", "SELECT CAST(trunc((epoch(o_orderdate) - 345600) / 604800) AS BIGINT) * 604800 + 345600 AS bin, count(*) AS n FROM orders GROUP BY 1")
def tl_density_week_anchor(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(bin_of(seconds(F.col("o_orderdate")), 604800, MONDAY).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("tl_spans", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id")
def tl_spans(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("tl_coarse_spans", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS moment, 'month' AS precision, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def tl_coarse_spans(spark, sf_dir):
    moment = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return load(spark, sf_dir, "orders").where("o_orderpriority like '1%'").groupBy(moment.alias("moment"), F.lit("month").alias("precision")).agg(F.count(F.lit(1)).alias("n"))


@query("tl_samples_per_bin", """
SELECT bin, event_id, place FROM (SELECT CAST(trunc(epoch(ts) / 86400) AS BIGINT) * 86400 AS bin, event_id, row_number() OVER (PARTITION BY CAST(trunc(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) AS place FROM events) WHERE place <= 3
""")
def tl_samples_per_bin(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", bin_of(seconds(F.col("ts")), 86400).alias("bin"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("ts", "event_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 3").select("bin", "event_id", "place")


@query("tl_coverage", "SELECT count(*) AS members, count(quality) AS covered, CAST(coalesce(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS disputed FROM documents LEFT JOIN labels USING (doc_id)")
def tl_coverage(spark, sf_dir):
    told = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return told.agg(F.count(F.lit(1)).alias("members"), F.count("quality").alias("covered"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("disputed"))


@query("tl_extent", "SELECT min(ts) AS first, max(ts) AS last, count(*) AS n FROM events")
def tl_extent(spark, sf_dir):
    return events(spark, sf_dir).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("tl_last_before", "SELECT user_id, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id")
def tl_last_before(spark, sf_dir):
    return events(spark, sf_dir).where("ts < TIMESTAMP_NTZ '2024-01-15'").groupBy("user_id").agg(F.max("ts").alias("last"))


@query("tl_at", "(SELECT event_id FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts LIMIT 1)")
def tl_at(spark, sf_dir):
    at = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    older = events(spark, sf_dir).where("ts <= TIMESTAMP_NTZ '2024-01-15 12:00:00'").orderBy(F.desc("ts")).limit(1)
    newer = events(spark, sf_dir).where("ts > TIMESTAMP_NTZ '2024-01-15 12:00:00'").orderBy("ts").limit(1)
    return older.unionAll(newer).orderBy(F.abs(micros(F.col("ts")) - at), "ts").limit(1).select("event_id")


@query("tl_sessions", f"WITH {SESSIONS_SQL} SELECT user_id, session, first_us, last_us, members FROM s")
def tl_sessions(spark, sf_dir):
    return timeline.sessions(events(spark, sf_dir), "ts", "event_id", GAP, "user_id")


@query("tl_sessions_global", """
WITH f AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 600000000 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (ORDER BY us, event_id) AS k FROM f)
SELECT min(us) AS first_us, max(us) AS last_us, count(*) AS members FROM r GROUP BY k HAVING count(*) >= 2
""")
def tl_sessions_global(spark, sf_dir):
    return timeline.global_sessions(events(spark, sf_dir), "ts", "event_id", 600_000_000, 86_400_000_000)


@query("tl_session_touching", f"WITH {SESSIONS_SQL} SELECT user_id, session, first_us FROM s WHERE first_us < epoch_us(TIMESTAMP '2024-01-12') AND last_us >= epoch_us(TIMESTAMP '2024-01-11')")
def tl_session_touching(spark, sf_dir):
    lo, hi = (F.unix_micros(F.lit(d).cast("timestamp")) for d in ("2024-01-11", "2024-01-12"))
    found = timeline.sessions(events(spark, sf_dir), "ts", "event_id", GAP, "user_id")
    return found.where((F.col("first_us") < hi) & (F.col("last_us") >= lo)).select("user_id", "session", "first_us")


@query("tl_session_people", f"""
WITH {SESSIONS_SQL} SELECT CAST(day AS VARCHAR) AS day, people, sessions FROM (SELECT CAST(make_timestamp(first_us) AS DATE) AS day, count(DISTINCT user_id) AS people, count(*) AS sessions FROM s GROUP BY 1)
""")
def tl_session_people(spark, sf_dir):
    found = timeline.sessions(events(spark, sf_dir), "ts", "event_id", GAP, "user_id")
    return found.groupBy(F.date_format(F.timestamp_micros("first_us"), "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("people"), F.count(F.lit(1)).alias("sessions"))


@query("tl_interval_merge", """
WITH i AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + 14400000000 AS hi FROM events),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS merged FROM k GROUP BY user_id, g
""")
def tl_interval_merge(spark, sf_dir):
    spans = events(spark, sf_dir).select("user_id", micros(F.col("ts")).alias("lo")).withColumn("hi", F.col("lo") + 14_400_000_000)
    return timeline.merged(spans, "user_id", "lo", "hi")


@query("tl_bursts", """
WITH f AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM f)
SELECT user_id, min(us) AS first_us, count(*) AS members, (count(*) - 1) * 1000000.0::DOUBLE / (max(us) - min(us)) AS rate FROM r GROUP BY user_id, k HAVING count(*) >= 3
""")
def tl_bursts(spark, sf_dir):
    found = timeline.sessions(events(spark, sf_dir), "ts", "event_id", 7_200_000_000, "user_id", 3)
    return found.select("user_id", "first_us", "members", ((F.col("members") - 1) * 1e6 / (F.col("last_us") - F.col("first_us"))).alias("rate"))


@query("tl_pause_phases", """
WITH f AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM f)
SELECT user_id, CAST(k AS BIGINT) AS phase, min(us) AS first_us, min(event_type) AS event_type, count(*) AS members FROM r GROUP BY user_id, k
""")
def tl_pause_phases(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.lag("us").over(w).isNull() | (F.col("us") - F.lag("us").over(w) > 86_400_000_000) | (F.lag("event_type").over(w) != F.col("event_type"))
    placed = timeline.islands(rows.withColumn("new", new), F.col("new"), ["us", "event_id"], ["user_id"], "phase")
    return placed.groupBy("user_id", "phase").agg(F.min("us").alias("first_us"), F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("members"))


@query("tl_silence", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 400000)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN lag(day) OVER (ORDER BY day) IS NOT NULL THEN CAST(greatest(0, day - lag(day) OVER (ORDER BY day) - 1) AS BIGINT) END AS silent FROM d
""")
def tl_silence(spark, sf_dir):
    days = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("day")).distinct()
    # One row per day, so this window's single task has a few thousand rows a decade.
    gap = F.datediff("day", F.lag("day").over(Window.orderBy("day"))) - 1
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(gap.isNull(), None).otherwise(F.greatest(F.lit(0), gap)).cast("long").alias("silent"))


@query("tl_busiest_bins", "SELECT bin, n FROM (SELECT CAST(trunc(epoch(ts) / 3600) AS BIGINT) * 3600 AS bin, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, bin LIMIT 120")
def tl_busiest_bins(spark, sf_dir):
    bins = events(spark, sf_dir).groupBy(bin_of(seconds(F.col("ts")), 3600).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.orderBy(F.desc("n"), "bin").limit(120)


@query("tl_nearest_ordinal", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events WHERE event_type = 'purchase'")
def tl_nearest_ordinal(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "ts")
    return ordered(rows, [F.asc("ts"), F.asc("event_id")]).select("event_id", "ordinal")


@query("tl_groupers", """
WITH o AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'generation' WHEN 1 THEN 'capture' ELSE 'file' END AS kind, event_id % 2 AS wall, CAST(epoch_us(ts) // 1000000 AS BIGINT) * 1000000 AS us FROM events),
g AS (SELECT *, CASE kind WHEN 'generation' THEN 30 ELSE 180 END * 60000000::BIGINT AS gap FROM o),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY kind, wall ORDER BY us, event_id) <= gap THEN 0 ELSE 1 END AS new FROM g), r AS (SELECT *, sum(new) OVER (PARTITION BY kind, wall ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT kind || '_session' AS grouper, CASE wall WHEN 1 THEN 'wall' ELSE 'instant' END AS axis, min(us) AS first_us, max(us) AS last_us, count(*) AS members FROM r GROUP BY kind, wall, k
""")
def tl_groupers(spark, sf_dir):
    at = F.floor(seconds(F.col("ts"))).cast("double")
    kind = F.when(F.col("event_id") % 3 == 0, "generation").when(F.col("event_id") % 3 == 1, "capture").otherwise("file")
    held = events(spark, sf_dir).select(F.col("event_id").alias("item"), kind.alias("kind"), at.alias("local_at"), F.when(F.col("event_id") % 2 == 0, at).alias("instant_at"))
    parts = [timeline.grouped(held, name) for name in timeline.GROUPERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
