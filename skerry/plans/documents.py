"""Queries: snapshots, phases, transitions and claims of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents, timeline
from ..sources.tables import load, micros
from .registry import query


@query("doc_snapshot_hash", """
WITH g AS (SELECT conv_id, count(*) AS members, string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn, role) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, members, sha256('{"v":1,"subject":' || conv_id || ',"members":[' || m || ']}') AS sha256 FROM g
""")
def doc_snapshot_hash(spark, sf_dir):
    return documents.snapshots(load(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role"]).select("conv_id", "members", "sha256")


@query("doc_verify", "SELECT count(DISTINCT conv_id) AS documents, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS damaged, CAST(coalesce(sum(DISTINCT conv_id) FILTER (conv_id % 5 = 0), 0) AS BIGINT) AS which FROM conversations")
def doc_verify(spark, sf_dir):
    """Every fifth stored document was changed after it was named by its hash; exactly those are found."""
    stored = documents.snapshots(load(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role"])
    damaged = stored.withColumn("document", F.when(F.col("conv_id") % 5 == 0, F.regexp_replace("document", "user", "User")).otherwise(F.col("document")))
    damaged = damaged.withColumn("document", F.when((F.col("conv_id") % 5 == 0) & (F.sha2(F.col("document").cast("binary"), 256) == F.col("sha256")), F.concat("document", F.lit(" "))).otherwise(F.col("document")))
    told = documents.verified(damaged)
    return told.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("intact")).alias("damaged"), F.coalesce(F.sum(F.when(~F.col("intact"), F.col("conv_id"))), F.lit(0)).alias("which"))


@query("doc_append_absent", "SELECT count(DISTINCT conv_id) AS fresh FROM conversations WHERE conv_id % 2 = 1")
def doc_append_absent(spark, sf_dir):
    every = documents.snapshots(load(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role"])
    return documents.appended(every, every.where("conv_id % 2 = 0")).agg(F.count(F.lit(1)).alias("fresh"))


@query("doc_member_hash", "SELECT user_id, substr(sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)), 1, 16) AS member_hash FROM events GROUP BY user_id")
def doc_member_hash(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    joined = F.concat_ws(",", F.transform(ordered, lambda x: x["event_id"].cast("string")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("member_hash"))


@query("doc_phases")
def doc_phases(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return documents.anchored_phases(vectors, "label", "vec_id", "embedding", 0.0)


@query("doc_capture_phases", """
WITH f AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 172800000000 THEN 1 ELSE 0 END AS new, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM f)
SELECT user_id, CAST(k AS BIGINT) AS phase, count(*) AS members, min(value) AS least, max(value) AS most FROM r GROUP BY user_id, k
""")
def doc_capture_phases(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "value", micros(F.col("ts")).alias("us"))
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    placed = timeline.islands(rows.withColumn("new", before.isNull() | (F.col("us") - before > 172_800_000_000)), F.col("new"), ["us", "event_id"], ["user_id"], "phase")
    return placed.groupBy("user_id", "phase").agg(F.count(F.lit(1)).alias("members"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("doc_transitions", """
SELECT user_id, event_id, event_type <> lag(event_type) OVER w AS changed, round(value - lag(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def doc_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != F.lag("event_type").over(w)).alias("changed"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("doc_parts_changed", """
WITH p AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber = 1), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber = 2), []) AS b FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1)
SELECT l_orderkey, list_max(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_max(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM p
""")
def doc_parts_changed(spark, sf_dir):
    held = lambda n: F.collect_set(F.when(F.col("l_linenumber") == n, F.col("l_partkey")))
    sets = load(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)").groupBy("l_orderkey").agg(held(1).alias("a"), held(2).alias("b"))
    return sets.select("l_orderkey", F.array_max(F.array_except("b", "a")).alias("added"), F.array_max(F.array_except("a", "b")).alias("removed"))


@query("doc_unresolved_refs", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_unresolved_refs(spark, sf_dir):
    wanted = load(spark, sf_dir, "documents").select("doc_id").distinct()
    return documents.unresolved(wanted, load(spark, sf_dir, "labels"), "doc_id")


@query("doc_story_kinds", "SELECT role, count(DISTINCT conv_id) AS conversations, count(*) AS turns FROM conversations GROUP BY role")
def doc_story_kinds(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("turns"))


@query("doc_latest_notes", "SELECT user_id, arg_max(event_type, event_id) AS note FROM events GROUP BY user_id")
def doc_latest_notes(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("note"))


@query("doc_schedule_due", "SELECT user_id, CAST(max(epoch_us(ts)) + 86400000000 AS BIGINT) AS next_due, max(epoch_us(ts)) + 86400000000 <= epoch_us(TIMESTAMP '2024-01-30') AS due FROM events GROUP BY user_id")
def doc_schedule_due(spark, sf_dir):
    now = F.unix_micros(F.lit("2024-01-30").cast("timestamp"))
    last = load(spark, sf_dir, "events").groupBy("user_id").agg((F.max(micros(F.col("ts"))) + 86_400_000_000).alias("next_due"))
    return last.withColumn("due", F.col("next_due") <= now)


@query("doc_item_timings", """
WITH n AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, lead(event_type) OVER w AS after, lead(epoch_us(ts)) OVER w AS then_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, then_us - us AS took FROM n WHERE event_type = 'view' AND after = 'purchase'
""")
def doc_item_timings(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = micros(F.col("ts"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", us.alias("us"), F.lead("event_type").over(w).alias("after"), F.lead(us).over(w).alias("at"))
    return rows.where("event_type = 'view' and after = 'purchase'").select("user_id", "event_id", (F.col("at") - F.col("us")).alias("took"))


@query("doc_families", """
WITH RECURSIVE u AS (SELECT label, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label WHERE list_dot_product(a.v, b.v) >= 0.25), r(node, root) AS (SELECT vec_id, vec_id FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT label, node AS vec_id, family FROM (SELECT node, min(root) AS family FROM r GROUP BY node) JOIN u ON vec_id = node
""")
def doc_families(spark, sf_dir):
    return documents.family_phases(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.25)
