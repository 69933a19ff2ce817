"""Queries: streams run to the end of what is there, held against the same question in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming.runs import latest, ledger, live, scratch, settled, settled_aggregate, settled_updates, stream_of, tallied
from .registry import query


def wall(name: str):
    return F.col(name).cast("timestamp_ntz")


#: How late an event may come; windows older than that leave the state.
LATE = "60 days"


@query("st_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return settled_updates(stream, "window", "event_type").select(wall("window.start").alias("start"), "event_type", "n")


@query("st_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, value FROM events, range(0, 3) t(k))
SELECT CAST(start AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1
""")
def st_sliding(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").withWatermark("ts", LATE).groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return settled_updates(stream, "window").select(wall("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("st_session", """
WITH f AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, k HAVING count(*) >= 2
""")
def st_session(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return settled_aggregate(stream).where("n >= 2").select("user_id", wall("first").alias("first"), wall("last").alias("last"), "n")


@query("st_dedupe_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedupe_watermark(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return settled(stream.select("user_id", "event_type"))


@query("st_ledger_since", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 400")
def st_ledger_since(spark, sf_dir):
    return settled(ledger(stream_of(spark, sf_dir, "events"), "event_id", 400).select("event_id", "user_id", "event_type"))


@query("st_latest_note", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def st_latest_note(spark, sf_dir):
    return settled_aggregate(latest(stream_of(spark, sf_dir, "events"), "user_id", "event_id", "event_type"))


@query("st_stream_join", "SELECT p.event_id AS buy_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts")
def st_stream_join(spark, sf_dir):
    rows = stream_of(spark, sf_dir, "events")
    buys = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought")).withWatermark("bought", "40 days")
    views = rows.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts").withWatermark("ts", "40 days")
    near = (F.col("user_id") == F.col("buyer")) & (F.col("ts") <= F.col("bought")) & (F.col("ts") >= F.col("bought") - F.expr("INTERVAL 2 HOURS"))
    return settled(buys.join(views, near).select("buy_id", "view_id"))


@query("st_open_items", "SELECT user_id, count(*) FILTER (event_type = 'view') AS opened, count(*) FILTER (event_type = 'purchase') AS closed FROM events GROUP BY user_id")
def st_open_items(spark, sf_dir):
    return settled_updates(tallied(stream_of(spark, sf_dir, "events"), "user_id", "event_type", "view", "purchase"), "user_id")


@query("st_live", "SELECT CASE WHEN event_id <= 400 THEN 0 ELSE 1 END AS message, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def st_live(spark, sf_dir):
    """What a watcher gets: what there was, then what came."""
    rows = stream_of(spark, sf_dir, "events").select("event_id", "event_type")
    before = load(spark, sf_dir, "events").where("event_id <= 400").select("event_id", "event_type")
    got = live(before, ledger(rows, "event_id", 400), scratch(spark))
    return got.groupBy(F.least("message", F.lit(1)).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
