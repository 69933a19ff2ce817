"""Queries: window functions."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


def per() -> WindowSpec:
    return Window.partitionBy("o_custkey")


def in_time() -> WindowSpec:
    return per().orderBy("o_orderdate", "o_orderkey")


OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


@query("win_rank_family", """
SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, percent_rank() OVER w AS percent, cume_dist() OVER w AS cume FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_rank_family(spark, sf_dir):
    w = per().orderBy("o_orderpriority")
    return orders(spark, sf_dir).select("o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.percent_rank().over(w).alias("percent"), F.cume_dist().over(w).alias("cume"))


@query("win_running_total", f"SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_total(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.round(F.sum("o_totalprice").over(in_time().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("win_moving_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def win_moving_avg(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.round(F.avg("o_totalprice").over(in_time().rowsBetween(-2, 0)), 4).alias("moving"))


@query("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN 2592000000000 PRECEDING AND CURRENT ROW) AS recent FROM orders")
def win_range_frame(spark, sf_dir):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    frame = per().orderBy("us").rangeBetween(-2_592_000_000_000, 0)
    return orders(spark, sf_dir).withColumn("us", at).select("o_orderkey", F.count(F.lit(1)).over(frame).alias("recent"))


@query("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {OVER} AS previous, lead(o_orderkey) {OVER} AS following FROM orders")
def win_lag_lead(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.lag("o_orderkey").over(in_time()).alias("previous"), F.lead("o_orderkey").over(in_time()).alias("following"))


@query("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_id, last_value(o_orderkey) OVER w AS last_id, nth_value(o_orderkey, 2) OVER w AS second_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, sf_dir):
    w = in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return orders(spark, sf_dir).select("o_orderkey", F.first("o_orderkey").over(w).alias("first_id"), F.last("o_orderkey").over(w).alias("last_id"), F.nth_value("o_orderkey", 2).over(w).alias("second_id"))


@query("win_ntile", f"SELECT o_orderkey, ntile(4) {OVER} AS quarter FROM orders")
def win_ntile(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.ntile(4).over(in_time()).cast("long").alias("quarter"))


@query("win_newest_per", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 4")
def win_newest_per(spark, sf_dir):
    place = F.row_number().over(per().orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders(spark, sf_dir).withColumn("place", place.cast("long")).where("place <= 4").select("o_custkey", "o_orderkey", "place")


@query("win_first_by_preference", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_type, event_id) AS place FROM events) WHERE place = 1")
def win_first_by_preference(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy((F.col("event_type") == "purchase").desc(), "event_type", "event_id"))
    return load(spark, sf_dir, "events").withColumn("place", place).where("place = 1").select("user_id", "event_id")


@query("win_act_grouping", """
WITH a AS (SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS act, event_type, ts FROM events)
SELECT act, event_id, members FROM (SELECT act, event_id, row_number() OVER (PARTITION BY act ORDER BY event_type = 'purchase' DESC, lower(event_type), event_id) AS place, count(*) OVER (PARTITION BY act) AS members FROM a) WHERE place = 1
""")
def win_act_grouping(spark, sf_dir):
    acts = load(spark, sf_dir, "events").withColumn("act", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    w = Window.partitionBy("act")
    place = F.row_number().over(w.orderBy((F.col("event_type") == "purchase").desc(), F.lower("event_type"), "event_id"))
    return acts.withColumn("place", place).withColumn("members", F.count(F.lit(1)).over(w)).where("place = 1").select("act", "event_id", "members")


@query("win_pair_transitions", "SELECT conv_id, turn, role, lag(role) OVER w AS before, length(text) - lag(length(text)) OVER w AS grew FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_pair_transitions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), (F.length("text") - F.lag(F.length("text")).over(w)).cast("long").alias("grew"))


@query("win_latest_per_subject", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def win_latest_per_subject(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("win_refined_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS place FROM lineitem")
def win_refined_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))
