"""Queries: runs of a clustering and their choice, captions and provenance, the queue, schedules and catching up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, jobs
from ..operators.graph import agreement
from ..operators.ranking import bm25
from ..operators.similarity import range_pairs
from ..sources import library
from ..sources.snapshots import Space, registered
from ..sources.tables import load
from ..storage import materialise
from .graphs import PARTS_SQL, THRESHOLD
from .registry import query
from .retrieval import BM25_SQL, WORDS

RUNS_SQL = "WITH r AS (SELECT 1 AS run, vec_id AS node, vec_id % 7 AS label FROM embeddings UNION ALL SELECT 2, vec_id, label FROM embeddings UNION ALL SELECT 3, vec_id, CASE WHEN vec_id % 10 < 6 THEN 0 ELSE vec_id END FROM embeddings UNION ALL SELECT 4, vec_id, vec_id FROM embeddings)"
HEALTH_SQL = RUNS_SQL + """, z AS (SELECT run, label, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n >= 2) AS clusters, max(n)::DOUBLE / sum(n) AS largest_share, (sum(n) - coalesce(sum(n) FILTER (n >= 2), 0))::DOUBLE / sum(n) AS alone_share FROM z GROUP BY run),
b AS (SELECT *, CASE WHEN clusters = 0 THEN 'it grouped nothing' WHEN items < 20 THEN NULL WHEN largest_share > 0.5 THEN 'it chained' WHEN alone_share > 0.95 THEN 'it grouped nothing much' END AS barred FROM h)
"""


def runs(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    labels = {1: F.col("vec_id") % 7, 2: F.col("label").cast("long"), 3: F.when(F.col("vec_id") % 10 < 6, 0).otherwise(F.col("vec_id")), 4: F.col("vec_id")}
    parts = [rows.select(F.lit(k).alias("run"), F.col("vec_id").alias("node"), c.cast("long").alias("label")) for k, c in labels.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def barred(spark, sf_dir):
    found = runs(spark, sf_dir)
    shape = clusters.health(found, found.groupBy("run").agg(F.count(F.lit(1)).alias("items")))
    return shape.withColumn("barred", clusters.disqualified(F.col("clusters"), F.col("items"), F.col("largest_share"), F.col("alone_share"), F.lit(1.0)))


@query("cluster_gates", HEALTH_SQL + "SELECT run, items, clusters, round(largest_share, 9) AS largest_share, round(alone_share, 9) AS alone_share, barred FROM b")
def cluster_gates(spark, sf_dir):
    return barred(spark, sf_dir).select("run", "items", "clusters", F.round("largest_share", 9).alias("largest_share"), F.round("alone_share", 9).alias("alone_share"), "barred")


@query("cluster_choose_primary", HEALTH_SQL + """
, t AS (SELECT run, e.label AS truth, count(DISTINCT r.label) AS n FROM r JOIN embeddings e ON e.vec_id = node WHERE e.vec_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT run, r.label, count(DISTINCT e.label) AS n FROM r JOIN embeddings e ON e.vec_id = node WHERE e.vec_id % 3 = 0 GROUP BY 1, 2),
g AS (SELECT b.run, (SELECT count(*) FROM t WHERE t.run = b.run AND n = 1) - (SELECT count(*) FROM t WHERE t.run = b.run AND n > 1) - (SELECT count(*) FROM x WHERE x.run = b.run AND n > 1) AS score FROM b WHERE barred IS NULL)
SELECT run FROM g ORDER BY score DESC, abs(0.3 + 0.1 * run - 0.35), run LIMIT 1
""")
def cluster_choose_primary(spark, sf_dir):
    """By agreement with the labels that were told (of every third vector), then by threshold."""
    truth = load(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("node"), F.col("label").alias("truth"))
    found = materialise(runs(spark, sf_dir), "runs")
    parts = [agreement(found.where(F.col("run") == k).select("node", "label"), truth).withColumn("run", F.lit(k)) for k in (1, 2, 3, 4)]
    said = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    told = barred(spark, sf_dir).select("run", "barred", (F.lit(0.3) + F.lit(0.1) * F.col("run")).alias("threshold"), F.lit(0.35).alias("measured"))
    return clusters.choose_primary(told, said)


@query("cluster_run", f"WITH RECURSIVE {PARTS_SQL} SELECT component AS label, count(*) AS members, 64 AS width FROM c GROUP BY component")
def cluster_run(spark, sf_dir):
    """A run as it is stored: its groups, with members and centroid."""
    _, groups = clusters.run("components", load(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD)
    return groups.select("label", "members", F.size("centroid").alias("width"))


@query("name_votes", """
WITH f AS (SELECT event_id % 497 AS label, event_id AS file, CAST(event_id % 5 AS DOUBLE) AS x, 0.0::DOUBLE AS y, 4.0::DOUBLE AS w, 4.0::DOUBLE AS h FROM events),
s AS (SELECT event_id AS file, event_type AS name, event_id % 20 <> 0 AS yes, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS DOUBLE) END AS x FROM events WHERE event_id % 4 = 0),
v AS (SELECT label, name, yes FROM f JOIN s ON f.file = s.file WHERE s.x IS NOT NULL AND greatest(0, least(f.x + 4, s.x + 4) - greatest(f.x, s.x)) * 4 / (32 - greatest(0, least(f.x + 4, s.x + 4) - greatest(f.x, s.x)) * 4) >= 0.3 UNION ALL SELECT label, name, yes FROM f JOIN s ON f.file = s.file WHERE s.x IS NULL),
n AS (SELECT DISTINCT label, name FROM v WHERE yes EXCEPT SELECT label, name FROM v WHERE NOT yes)
SELECT label, min(name) AS name FROM n GROUP BY label HAVING count(*) = 1
""")
def name_votes(spark, sf_dir):
    events, id = load(spark, sf_dir, "events"), F.col("event_id")
    four = F.lit(4.0)
    found = events.select((id % 497).alias("label"), id.alias("file"), (id % 5).cast("double").alias("x"), F.lit(0.0).alias("y"), four.alias("w"), four.alias("h"))
    box = lambda c: F.when(id % 3 == 0, c)
    said = events.where("event_id % 4 = 0").select(id.alias("file"), F.col("event_type").alias("name"), (id % 20 != 0).alias("is"), box((id % 7).cast("double")).alias("x"), box(F.lit(0.0)).alias("y"), box(four).alias("w"), box(four).alias("h"))
    return clusters.named(found, said)


@query("dupe_unverified", """
WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, a.vec_id % 3 <> 0 AND b.vec_id % 3 <> 0 AS verified FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35
 AND (a.vec_id % 3 = 0 OR b.vec_id % 3 = 0 OR bit_count(xor(a.vec_id % 64, b.vec_id % 64)) <= 3)
""")
def dupe_unverified(spark, sf_dir):
    """Near pairs by vector, verified by a hash that every third item lacks."""
    vectors = load(spark, sf_dir, "embeddings")
    hashes = vectors.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("node"), (F.col("vec_id") % 64).alias("h"))
    return clusters.duplicate_edges(range_pairs(vectors, "vec_id", "embedding", THRESHOLD).select("a", "b"), hashes, 3)


@query("ret_caption_match", f"WITH {BM25_SQL}, m AS (SELECT doc_id % 50 AS file, max(score) AS score FROM b GROUP BY 1) SELECT file, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, file) AS position FROM m")
def ret_caption_match(spark, sf_dir):
    """Files by their best annotation that has any word of the phrase; fifty files, documents as their annotations."""
    scores = bm25(load(spark, sf_dir, "documents"), "doc_id", "text", WORDS)
    best = clusters.best_annotations(scores.select((F.col("doc_id") % 50).alias("file"), "score"), "file")
    return best.select("file", F.round("score", 6).alias("score"), "position")


@query("ret_provenance", """
SELECT * FROM (VALUES ('words', 'contributor', NULL), ('faces', 'missing', 'no embeddings recorded'), ('old', 'missing', 'no current embeddings'), ('captions', 'unmatched', 'no caption mentions a word of the phrase in this scope')) t(space, standing, reason)
""")
def ret_provenance(spark, sf_dir):
    n = load(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    spaces = n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("space"), (F.col("n") * r).alias("recorded"), (F.col("n") * c).alias("current")) for s, r, c in (("words", 1, 1), ("faces", 0, 0), ("old", 1, 0), ("captions", 1, 1))])).alias("s")).select("s.*")
    answered = load(spark, sf_dir, "embeddings").limit(5).select(F.lit("words").alias("space"))
    return clusters.provenance(spaces, answered)


@query("space_registry", "SELECT * FROM (VALUES (1, 1), (2, 2), (3, 1)) t(step, space_id)")
def space_registry(spark, sf_dir):
    """Two spaces registered, and the first asked for again: it keeps its id."""
    width = len(load(spark, sf_dir, "embeddings").first().embedding)
    held, out = spark.createDataFrame([], "space_id int, identity string, spec string"), []
    for step, version in enumerate(("1", "2", "1"), 1):
        held, at = registered(held, Space("words", width, "cosine", "hasher", version))
        out.append((step, at))
    return spark.createDataFrame(out, "step int, space_id int")


# -- jobs -------------------------------------------------------------------------

JOBS_SQL = """
j AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'queued' ELSE 'failed' END AS state, CASE WHEN event_id % 5 = 3 THEN event_id - 1 WHEN event_id % 10 = 0 THEN event_id - 1 END AS after_id,
 event_id % 4 AS fence, CASE WHEN event_id % 5 = 1 THEN CAST(event_id % 100 AS DOUBLE) END AS leased_until, event_id % 11 = 0 AS cancel, event_id % 13 = 0 AS paused, 'c' || (event_id % 7) AS collection FROM events)
"""


def queue(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr(
        "event_id as id", "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'queued' ELSE 'failed' END as state", "CASE WHEN event_id % 5 = 3 THEN event_id - 1 WHEN event_id % 10 = 0 THEN event_id - 1 END as after_id",
        "event_id % 4 as fence", "CASE WHEN event_id % 5 = 1 THEN CAST(event_id % 100 AS DOUBLE) END as leased_until", "event_id % 11 = 0 as cancel", "event_id % 13 = 0 as paused", "concat('c', event_id % 7) as collection",
    )


CLAIM_SQL = JOBS_SQL + ", k AS (SELECT id FROM j WHERE (state = 'queued' OR state = 'running' AND leased_until < 50) AND NOT cancel AND NOT paused AND (after_id IS NULL OR after_id IN (SELECT id FROM j WHERE state = 'done')))"


@query("queue_claimable", f"WITH {CLAIM_SQL} SELECT id FROM k")
def queue_claimable(spark, sf_dir):
    return jobs.claimable(queue(spark, sf_dir), F.lit(50.0)).select("id")


@query("queue_claimed", f"WITH {CLAIM_SQL}, t AS (SELECT id FROM k ORDER BY id LIMIT 25) SELECT id, CASE WHEN id IN (FROM t) THEN 'running' ELSE state END AS state, fence + CASE WHEN id IN (FROM t) THEN 1 ELSE 0 END AS fence, CASE WHEN id IN (FROM t) THEN 110.0::DOUBLE ELSE leased_until END AS leased_until FROM j")
def queue_claimed(spark, sf_dir):
    return jobs.claimed(queue(spark, sf_dir), F.lit(50.0), 25).select("id", "state", "fence", "leased_until")


@query("queue_settled", f"""
WITH {JOBS_SQL} SELECT id, CASE WHEN state = 'running' AND id % 3 <> 0 THEN CASE WHEN cancel THEN 'cancelled' ELSE 'done' END WHEN cancel AND state = 'queued' THEN 'cancelled' ELSE state END AS state, CASE WHEN state = 'running' AND id % 3 = 0 THEN leased_until END AS leased_until FROM j
""")
def queue_settled(spark, sf_dir):
    """Reports under the job's fence count; every third is late, under an older one."""
    held = queue(spark, sf_dir)
    reports = held.where("state = 'running'").select("id", F.when(F.col("id") % 3 == 0, F.col("fence") - 1).otherwise(F.col("fence")).alias("fence"), F.lit("done").alias("state"))
    return jobs.settled(held, reports).select("id", "state", "leased_until")


@query("schedule_due", """
SELECT user_id AS collection, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 0.0::DOUBLE ELSE user_id * 100.0::DOUBLE + (1 + user_id % 3) * 3600 END AS next_due,
 user_id % 5 <> 0 AND user_id % 7 <> 0 AND (user_id % 4 = 0 OR user_id * 100 + (1 + user_id % 3) * 3600 <= 15000) AS due FROM (SELECT DISTINCT user_id FROM events)
""")
def schedule_due(spark, sf_dir):
    who = load(spark, sf_dir, "events").select("user_id").distinct()
    schedules = who.select(F.col("user_id").alias("collection"), (F.col("user_id") % 5 != 0).alias("enabled"), F.when(F.col("user_id") % 4 != 0, F.col("user_id") * 100.0).alias("last_started"), (1 + F.col("user_id") % 3).alias("every_hours"))
    busy = who.where("user_id % 7 = 0").select(F.col("user_id").alias("collection"), F.lit("running").alias("state"))
    return jobs.due(schedules, busy, F.lit(15000.0))


@query("catch_up", "SELECT * FROM (VALUES (1, 'walk', NULL), (2, 'ingest', 1), (3, 'events', 2), (4, 'embed', 3), (5, 'captions', 4)) t(id, kind, after_id)")
def catch_up(spark, sf_dir):
    """Steps that have units, in their order; faces, context and clusters have none here."""
    n = load(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    kinds = ("captions", "embed", "faces", "walk", "events", "cluster", "ingest", "context", "other")
    work = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("n") * (0 if k in ("faces", "context", "cluster") else 1)).alias("units")) for k in kinds])).alias("w")).select("w.*")
    return jobs.catch_up(work)


@query("answers_current", "SELECT event_id AS answer, event_id % 2 <> 0 OR event_id % 3 <> 0 AS current FROM events")
def answers_current(spark, sf_dir):
    """Answers that read three tables; of the even ones, items have moved on under every third."""
    read = load(spark, sf_dir, "events").select(F.col("event_id").alias("answer"), F.explode(F.array(F.lit("items"), F.lit("labels"), F.lit("ledger"))).alias("name"))
    held = read.withColumn("generation", F.when((F.col("name") == "items") & (F.col("answer") % 2 == 0) & (F.col("answer") % 3 == 0), 4).when(F.col("name") == "ledger", 1).otherwise(5))
    tables = spark.createDataFrame([("items", 5), ("labels", 5), ("ledger", 99)], "name string, generation int")
    return jobs.current(held, tables)


@query("runs_proven", "SELECT DISTINCT user_id AS run FROM events WHERE user_id % 3 = 2 AND user_id % 2 = 1 AND user_id % 5 <> 0")
def runs_proven(spark, sf_dir):
    found = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("user_id") % 3).alias("generation"), (F.col("user_id") % 2).alias("policy")).distinct()
    return jobs.proven(found, 2, 1, F.col("run") % 5 != 0).select("run")


@query("catch_up_counted", """
SELECT 'ingest' AS kind, count(*) FILTER (event_id % 4 <> 0) AS units FROM events UNION ALL SELECT 'embed', count(*) FILTER (event_id % 6 NOT IN (1, 2) AND event_id % 5 <> 0) FROM events UNION ALL SELECT 'captions', count(*) FILTER (event_id % 6 IN (4, 5) AND event_id % 7 <> 0) FROM events
""")
def catch_up_counted(spark, sf_dir):
    files = library.tables(spark, sf_dir)["item"].select("id", "kind")
    return jobs.counted({"files": files, "read": files.where("id % 4 = 0"), "vectors": files.where("id % 5 = 0"), "said": files.where("id % 7 = 0")})


@query("views_saved", """
WITH v AS (SELECT user_id AS id, 'view ' || user_id AS name, CASE WHEN user_id % 4 = 0 THEN 'f=tag:eq:x&sort=-id' ELSE 'old' END AS question, user_id * 10 AS created_at, CASE WHEN user_id % 3 = 0 THEN 5000 - user_id END AS last_used_at FROM (SELECT DISTINCT user_id FROM events)),
w AS (SELECT * FROM v UNION ALL SELECT max(id) + 1, 'another', 'a=1', 7777, NULL FROM v)
SELECT id, name, question, row_number() OVER (ORDER BY coalesce(last_used_at, created_at) DESC, name) AS place FROM w
""")
def views_saved(spark, sf_dir):
    who = load(spark, sf_dir, "events").select("user_id").distinct()
    id = F.col("user_id")
    views = who.select(id.alias("id"), F.concat(F.lit("view "), id).alias("name"), F.lit("old").alias("question"), (id * 10).alias("created_at"), F.when(id % 3 == 0, 5000 - id).alias("last_used_at"))
    refined = who.where("user_id % 4 = 0").select(F.concat(F.lit(" view "), id, F.lit(" ")).alias("name"), F.lit("?f=tag:eq:x&page=3&sort=-id&").alias("question"), F.lit(7777).cast("long").alias("at"))
    another = spark.createDataFrame([("another", "a=1", 7777)], "name string, question string, at long")
    return jobs.recently_used(jobs.remembered(views, refined.unionByName(another))).select("id", "name", "question", "place")
