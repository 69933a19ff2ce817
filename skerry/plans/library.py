"""Queries: axis, names, galleries, exports, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import axis
from ..operators.answer import ordered
from ..sources.tables import load, micros, seconds
from .registry import query

LO, HI = 1_704_067_200_000_000, 1_706_659_200_000_000  # 2024-01-01 and 2024-01-31 in microseconds


@query("axis_projection", f"""
WITH i AS (SELECT epoch_us(ts) AS lo, least(epoch_us(ts) + 7200000000, {HI}) AS hi FROM events WHERE event_type = 'purchase' AND value > 90 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m), h AS (SELECT min(lo) AS lo, max(hi) AS hi FROM k GROUP BY g),
p AS (SELECT *, least(lo - coalesce(lag(hi) OVER (ORDER BY lo), {LO}), CAST(trunc(({HI} - {LO}) * 0.04) AS BIGINT)) AS gap FROM h)
SELECT lo, hi, CAST(sum(gap + hi - lo) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) - (hi - lo) AS BIGINT) AS at FROM p
""".replace("AS at FROM", "AS place FROM"))
def axis_projection(spark, sf_dir):
    spans = load(spark, sf_dir, "events").where("event_type = 'purchase' and value > 90").select(micros(F.col("ts")).alias("lo")).withColumn("hi", F.col("lo") + 7_200_000_000)
    return axis.projection(spans, "lo", "hi", LO, HI).withColumnRenamed("at", "place")


@query("axis_strip_width", "SELECT 86400::BIGINT AS width, count(DISTINCT CAST(ts AS DATE)) AS bins FROM events")
def axis_strip_width(spark, sf_dir):
    return axis.strip_width(load(spark, sf_dir, "events"), seconds(F.col("ts")), widths=(3600, 86_400, 604_800))


@query("axis_sampled_moments", """
WITH d AS (SELECT doc_id, n_chars, greatest(1, least(5, CAST(ceil(n_chars / 1000.0) AS BIGINT))) AS n FROM documents)
SELECT doc_id, CAST(floor((k + 0.5) * n_chars / n) AS BIGINT) AS moment FROM d, range(0, 5) t(k) WHERE k < n
""")
def axis_sampled_moments(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(axis.sampled(F.col("n_chars"), 1000, 5)).alias("moment"))


@query("person_gallery", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS exemplar FROM events GROUP BY user_id")
def person_gallery(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("exemplar"))


@query("settings_merged", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"size\":60}' AS settings FROM events")
def settings_merged(spark, sf_dir):
    return merged_settings(load(spark, sf_dir, "events"))


def merged_settings(events):
    """Each event's own settings over the defaults, keys in order."""
    own = F.from_json("props", "map<string,int>")
    defaults = F.create_map(F.lit("k"), F.lit(0), F.lit("size"), F.lit(60))
    whole = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)
    keys = F.array_sort(F.map_keys(whole))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(whole, k)))
    return events.select("event_id", F.to_json(ordered).alias("settings"))


@query("run_across", """
WITH s AS (SELECT l_suppkey % 10 AS g, l_partkey % 7 AS h, l_orderkey FROM lineitem),
a AS (SELECT g, count(*) AS n FROM s GROUP BY g), b AS (SELECT h, count(*) AS n FROM s GROUP BY h)
SELECT *, row_number() OVER (ORDER BY abs(left_size - right_size) DESC, g, h) AS place FROM (SELECT g, h, any_value(a.n) AS left_size, any_value(b.n) AS right_size, count(*) AS shared FROM s JOIN a USING (g) JOIN b USING (h) GROUP BY g, h)
""")
def run_across(spark, sf_dir):
    return clusters_across(load(spark, sf_dir, "lineitem"))


def clusters_across(lines):
    """Sizes of the clusters of two runs over `lines`, how many members each pair shares, and its place: the largest difference first."""
    s = lines.select((F.col("l_suppkey") % 10).alias("g"), (F.col("l_partkey") % 7).alias("h"))
    pairs = s.groupBy("g", "h").agg(F.count(F.lit(1)).alias("shared"))
    # Sizes of both runs' clusters from the pair counts, over one row per pair of clusters.
    sized = pairs.select("g", "h", F.sum("shared").over(Window.partitionBy("g")).alias("left_size"), F.sum("shared").over(Window.partitionBy("h")).alias("right_size"), "shared")
    return ordered(sized, [F.abs(F.col("left_size") - F.col("right_size")).desc(), F.col("g"), F.col("h")], "place")


@query("host_folders", "SELECT regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]+://[^/]*/([^/?#]*)', 1) AS top, count(*) AS n FROM pages GROUP BY 1, 2")
def host_folders(spark, sf_dir):
    host, top = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1), F.regexp_extract("url", r"^[^:]+://[^/]*/([^/?#]*)", 1)
    return load(spark, sf_dir, "pages").groupBy(host.alias("host"), top.alias("top")).agg(F.count(F.lit(1)).alias("n"))
