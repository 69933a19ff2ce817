"""Queries: evidence, plans, their grammar and rendering, and how a session's members evolve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stories
from ..sources.tables import load, seconds
from .registry import query

GAP = 7200.0
MEMBERS_SQL = "m AS (SELECT user_id AS subject, event_id AS member, event_type AS kind, value, epoch(date_trunc('second', ts)) AS tm FROM events)"
PLAN_SQL = f"""
{MEMBERS_SQL}, p AS (SELECT *, tm - lag(tm) OVER w AS pause FROM m WINDOW w AS (PARTITION BY subject ORDER BY tm, member)), f AS (SELECT *, sum(CASE WHEN pause > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY tm, member ROWS UNBOUNDED PRECEDING) AS phase FROM p),
k AS (SELECT subject, arg_max(kind, (n, kind)) AS kind, max(n) AS n FROM (SELECT subject, kind, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1), s AS (SELECT subject, count(*) AS size, count(DISTINCT phase) AS phases, max(pause) AS longest FROM f GROUP BY 1)
"""


def members(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("member"), F.col("event_type").alias("kind"), "value", F.floor(seconds(F.col("ts"))).cast("double").alias("at"))


@query("story_evidence", f"WITH {MEMBERS_SQL} SELECT subject, CAST(min(tm) AS DOUBLE) AS first, CAST(max(tm) AS DOUBLE) AS last, count(*) AS size, count(DISTINCT kind) AS kinds, round(min(value), 6) AS least, round(max(value), 6) AS most FROM m GROUP BY subject")
def story_evidence(spark, sf_dir):
    found = stories.collected(members(spark, sf_dir))
    return found.select("subject", "span.first", "span.last", "size", F.size("kinds").cast("long").alias("kinds"), "values.least", "values.most")


@query("story_plan", f"WITH {PLAN_SQL} SELECT s.subject, size, phases, CAST(coalesce(longest, 0) AS DOUBLE) AS pause, kind, n, CASE WHEN coalesce(longest, 0) <= 0 THEN 'pause' ELSE '' END AS unsupported FROM s JOIN k ON k.subject = s.subject")
def story_plan(spark, sf_dir):
    plans = stories.planned(members(spark, sf_dir), "capture", GAP)
    of = lambda kind: F.get(F.filter("claims", lambda c: c["kind"] == kind), F.lit(0))
    return plans.select(
        "subject", of("size")["number"].cast("long").alias("size"), F.size("phases").cast("long").alias("phases"), F.coalesce(of("pause")["number"], F.lit(0.0)).alias("pause"),
        of("kind")["word"].alias("kind"), of("kind")["number"].cast("long").alias("n"), F.array_join("unsupported", ",").alias("unsupported"),
    )


@query("story_faults", "SELECT DISTINCT user_id AS subject, CASE user_id % 3 WHEN 0 THEN 'a claim rests on what isn''t a member' ELSE 'a version that isn''t known' END AS fault FROM events WHERE user_id % 3 <> 2")
def story_faults(spark, sf_dir):
    """Plans damaged on purpose: some claims rest on others' members, some versions are unknown; a third are whole."""
    plans = stories.planned(members(spark, sf_dir), "file")
    strange = F.transform("claims", lambda c, i: F.struct(c["kind"].alias("kind"), F.when(i == 0, F.concat(c["refs"], F.array(F.lit(-1).cast("long")))).otherwise(c["refs"]).alias("refs"), c["number"].alias("number"), c["word"].alias("word")))
    damaged = plans.withColumn("claims", F.when(F.col("subject") % 3 == 0, strange).otherwise(F.col("claims"))).withColumn("version", F.when(F.col("subject") % 3 == 1, 9).otherwise(F.col("version")))
    return stories.faults(damaged)


@query("story_rendered", f"""
WITH {PLAN_SQL} SELECT s.subject, 'memory' AS style, size || ' items, in ' || phases || ' phases, ' || CASE WHEN longest > 0 THEN 'a pause of ' || CAST(longest AS BIGINT) || ' seconds, ' ELSE '' END || 'mostly ' || kind || ' (' || n || ').' AS text FROM s JOIN k ON k.subject = s.subject
UNION ALL SELECT s.subject, 'compact', size || ' items' FROM s
""")
def story_rendered(spark, sf_dir):
    plans = stories.planned(members(spark, sf_dir), "capture", GAP)
    return stories.rendered(plans, "memory").unionAll(stories.rendered(plans, "compact")).select("subject", "style", "text")


@query("story_violations", "SELECT DISTINCT user_id AS subject, CASE user_id % 2 WHEN 0 THEN 'number 987654321' ELSE 'word surely' END AS violation FROM events")
def story_violations(spark, sf_dir):
    plans = stories.planned(members(spark, sf_dir), "generation")
    texts = stories.rendered(plans, "technical")
    said = texts.withColumn("text", F.concat("text", F.when(F.col("subject") % 2 == 0, "; x=987654321").otherwise("; Surely")))
    return stories.violations(said, plans, ("surely",))


@query("story_evolution", """
WITH u AS (SELECT label AS subject, vec_id AS member, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
s AS (SELECT *, lag(v) OVER w AS before, first_value(v) OVER w AS head FROM u WINDOW w AS (PARTITION BY subject ORDER BY member))
SELECT subject, member, round(list_dot_product(v, before), 6) AS to_previous, round(list_dot_product(v, head), 6) AS to_first, CASE WHEN before IS NULL THEN 'start' WHEN list_dot_product(v, before) >= 1 - 1e-9 THEN 'same' WHEN list_dot_product(v, before) >= 0.9 THEN 'near' ELSE 'turn' END AS transition FROM s
""")
def story_evolution(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("subject"), F.col("vec_id").alias("member"), F.lit(0).alias("at"), "embedding")
    return stories.evolution(rows, "embedding")
