"""Queries: joins, hierarchies, set operations, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import asof, iou, overlapping, reconcile, symmetric_difference
from ..sources.tables import load, micros
from .registry import query


@query("join_inner_hydrate", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def join_inner_hydrate(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").where("o_totalprice > 300000")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("join_left_sort_column", "SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left_sort_column(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, sf_dir):
    rich = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(spark, sf_dir):
    """Customers without a large order; every customer has some order."""
    some = load(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(some, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("join_self_bridge", """
SELECT a.l_partkey AS part, b.l_suppkey AS supplier, count(DISTINCT a.l_orderkey) AS together FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 GROUP BY 1, 2
""")
def join_self_bridge(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("part"))
    second = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("supplier"))
    return first.join(second, "l_orderkey").groupBy("part", "supplier").agg(F.countDistinct("l_orderkey").alias("together"))


@query("join_twins", """
WITH g AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, group_id, members FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS group_id, count(*) OVER (PARTITION BY h) AS members FROM g WHERE h IS NOT NULL) WHERE members > 1
""")
def join_twins(spark, sf_dir):
    """All documents that have a twin, with their group's smallest id and size: twins are those of one group."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).where("h is not null")
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return docs.join(groups, "h").select("doc_id", "group_id", "members")


SESSIONS_SQL = """
f AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM f),
s AS (SELECT user_id, CAST(k AS BIGINT) AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS members FROM r GROUP BY user_id, k HAVING count(*) >= 2)
"""


@query("join_interval_overlap", f"""
WITH {SESSIONS_SQL}, d AS (SELECT user_id, min(epoch_us(ts)) AS lo, min(epoch_us(ts)) + 172800000000 AS hi FROM events GROUP BY user_id)
SELECT s.user_id, s.first_us, d.lo FROM s JOIN d ON s.user_id = d.user_id AND s.first_us < d.hi AND s.last_us >= d.lo
""")
def join_interval_overlap(spark, sf_dir):
    from ..operators.timeline import sessions

    found = sessions(load(spark, sf_dir, "events"), "ts", "event_id", 21_600_000_000, "user_id")
    windows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min(micros(F.col("ts"))).alias("lo")).withColumn("hi", F.col("lo") + 172_800_000_000)
    return overlapping(found, windows, "user_id", 86_400_000_000, "first_us", "last_us", "lo", "hi").select("user_id", "first_us", "lo")


@query("join_asof_backward", """
WITH p AS (SELECT event_id AS buy_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.buy_id, p.user_id, v.event_id AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_asof_backward(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", "ts")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("seen"))
    return asof(buys, views, "user_id", "ts", "seen", ["view_id"]).select("buy_id", "user_id", "view_id")


@query("join_nearest_both", """
WITH p AS (SELECT event_id AS buy_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
j AS (SELECT buy_id, v.event_id AS near_id, abs(p.us - v.us) AS away, row_number() OVER (PARTITION BY buy_id ORDER BY abs(p.us - v.us), v.us) AS place FROM p JOIN v USING (user_id))
SELECT buy_id, near_id, away FROM j WHERE place = 1
""")
def join_nearest_both(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
    buys = events.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", "us")
    views = events.where("event_type = 'view'").select("user_id", F.col("us").alias("at"), F.struct("event_id", F.col("us").alias("at")).alias("v"))
    before = asof(buys, views.withColumnRenamed("v", "older"), "user_id", "us", "at", ["older"])
    both = asof(before, views.withColumnRenamed("v", "newer"), "user_id", "us", "at", ["newer"], forward=True)
    back, ahead = F.col("us") - F.col("older.at"), F.col("newer.at") - F.col("us")
    take_old = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    near = F.when(take_old, F.col("older.event_id")).otherwise(F.col("newer.event_id"))
    away = F.when(take_old, back).otherwise(ahead)
    return both.select("buy_id", near.alias("near_id"), away.alias("away")).where("near_id is not null")


@query("join_scalar_subquery", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest
FROM customer
""")
def join_scalar_subquery(spark, sf_dir):
    per = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    customers = load(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(per, customers.c_custkey == per.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "latest")


def two_scans(spark, sf_dir):
    """The documents as stored, and as a later walk would see them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    stored = docs.where("doc_id % 7 <> 0")
    moved = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "sha")).otherwise(F.col("sha"))
    return docs.where("doc_id % 13 <> 0").select(moved.alias("doc_id"), changed.alias("sha")), stored


RECONCILE_SQL = """
WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), s AS (SELECT * FROM d WHERE doc_id % 7 <> 0),
o AS (SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' || sha ELSE sha END AS sha FROM d WHERE doc_id % 13 <> 0),
m AS (SELECT o.doc_id FROM o JOIN s ON o.doc_id = s.doc_id AND o.sha = s.sha),
o1 AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM m)), s1 AS (SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM m)),
c AS (SELECT a.sha, a.n AS o_n, b.n AS s_n, a.k AS o_key, b.k AS s_key FROM (SELECT sha, count(*) AS n, min(doc_id) AS k FROM o1 GROUP BY sha) a JOIN (SELECT sha, count(*) AS n, min(doc_id) AS k FROM s1 GROUP BY sha) b ON a.sha = b.sha),
v AS (SELECT o_key, s_key FROM c WHERE s_n = 1),
u AS (SELECT doc_id FROM o1 WHERE sha IN (SELECT sha FROM c WHERE s_n > 1)),
r AS (SELECT o2.doc_id AS o_key, s2.doc_id AS s_key, o2.sha FROM (SELECT * FROM o1 WHERE doc_id NOT IN (SELECT o_key FROM v) AND doc_id NOT IN (SELECT doc_id FROM u)) o2 FULL JOIN (SELECT * FROM s1 WHERE doc_id NOT IN (SELECT s_key FROM v)) s2 ON o2.doc_id = s2.doc_id),
x AS (SELECT doc_id AS o_key, doc_id AS s_key, 'matched' AS outcome FROM m UNION ALL SELECT o_key, s_key, 'moved' FROM v
UNION ALL SELECT doc_id, NULL, 'ambiguous' FROM u
UNION ALL SELECT o_key, s_key, CASE WHEN o_key IS NULL THEN 'missing' WHEN s_key IS NOT NULL THEN 'replaced' ELSE 'new' END FROM r)
"""


@query("join_full_reconcile", RECONCILE_SQL + "SELECT * FROM x")
def join_full_reconcile(spark, sf_dir):
    return reconcile(*two_scans(spark, sf_dir), "doc_id", "sha")


@query("scan_result", RECONCILE_SQL + "SELECT outcome, count(*) AS n FROM x GROUP BY outcome")
def scan_result(spark, sf_dir):
    return reconcile(*two_scans(spark, sf_dir), "doc_id", "sha").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("join_region_match", """
WITH b AS (SELECT event_id, user_id % 10 AS x, event_id % 7 AS y, 4.0::DOUBLE + event_id % 3 AS w, 4.0::DOUBLE AS h, user_id FROM events),
p AS (SELECT a.event_id AS a_id, c.event_id AS c_id, greatest(0.0::DOUBLE, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0.0::DOUBLE, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS i, a.w * a.h + c.w * c.h AS s
 FROM b a JOIN b c ON a.user_id = c.user_id AND a.event_id < c.event_id)
SELECT a_id, c_id, i / (s - i) AS iou FROM p WHERE i / (s - i) >= 0.3
""")
def join_region_match(spark, sf_dir):
    return region_matches(load(spark, sf_dir, "events"))


def region_matches(events):
    """Pairs of a user's boxes that overlap by 0.3 at least."""
    box = events.selectExpr("event_id", "user_id", "cast(user_id % 10 as double) x", "cast(event_id % 7 as double) y", "4.0D + event_id % 3 as w", "4.0D as h")
    a = box.select("user_id", *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "w", "h")], F.col("event_id").alias("a_id"))
    c = box.select("user_id", *[F.col(x).alias(f"c_{x}") for x in ("x", "y", "w", "h")], F.col("event_id").alias("c_id"))
    pairs = a.join(c, "user_id").where("a_id < c_id")
    return pairs.withColumn("iou", iou(("a_x", "a_y", "a_w", "a_h"), ("c_x", "c_y", "c_w", "c_h"))).where("iou >= 0.3").select("a_id", "c_id", "iou")


@query("recursive_breadcrumb", """
WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]*(/[^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, path, 1 AS depth, path AS trail FROM p WHERE path <> '' UNION ALL SELECT page_id, path, depth + 1, regexp_replace(trail, '/[^/]*$', '') FROM c WHERE regexp_replace(trail, '/[^/]*$', '') <> '')
SELECT page_id, CAST(depth AS BIGINT) AS depth, trail FROM c
""")
def recursive_breadcrumb(spark, sf_dir):
    # A path names all its ancestors, so the chain is an array and needs no recursion.
    path = F.regexp_extract("url", r"^[^:]+://[^/]*(/[^?#]*)", 1)
    parts = load(spark, sf_dir, "pages").select("page_id", path.alias("path")).where("path <> ''").withColumn("steps", F.split("path", "/"))
    up = parts.select("page_id", "path", "steps", F.posexplode(F.sequence(F.size("steps"), F.lit(2), F.lit(-1))).alias("k", "take"))
    return up.select("page_id", (F.col("k") + 1).cast("long").alias("depth"), F.array_join(F.slice("steps", 1, F.col("take")), "/").alias("trail"))


@query("recursive_subtree_counts", """
WITH RECURSIVE t(id, parent) AS (SELECT 'r' || r_regionkey, NULL::VARCHAR FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT id AS top, id FROM t UNION ALL SELECT w.top, t.id FROM w JOIN t ON t.parent = w.id), c AS (SELECT 'n' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1)
SELECT top, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM w LEFT JOIN c USING (id) GROUP BY top
""")
def recursive_subtree_counts(spark, sf_dir):
    sql = """
        WITH RECURSIVE t(id, parent) AS (SELECT concat('r', r_regionkey), cast(null as string) FROM {region} UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM {nation}),
        w(top, id) AS (SELECT id, id FROM t UNION ALL SELECT w.top, t.id FROM w JOIN t ON t.parent = w.id),
        c AS (SELECT concat('n', c_nationkey) AS id, count(*) AS n FROM {customer} GROUP BY 1)
        SELECT top, coalesce(sum(n), 0) AS members FROM w LEFT JOIN c ON w.id = c.id GROUP BY top
    """
    return spark.sql(sql, **{name: load(spark, sf_dir, name) for name in ("region", "nation", "customer")})


@query("place_chain", "SELECT s_suppkey, n_name || ' < ' || r_name AS chain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def place_chain(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.concat_ws(" < ", "n_name", "r_name").alias("chain"))


@query("join_producer_contest", """
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS left_id, b.l_suppkey AS right_id, count(*) AS shared FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2
""")
def join_producer_contest(spark, sf_dir):
    return contests(load(spark, sf_dir, "lineitem"))


def contests(lines):
    """Pairs of suppliers and how many parts both have made."""
    made = lines.select("l_partkey", "l_suppkey").distinct()
    a, b = made.withColumnRenamed("l_suppkey", "left_id"), made.withColumnRenamed("l_suppkey", "right_id")
    return a.join(b, "l_partkey").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"))


def sides(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return events.where("event_type = 'click'").select("user_id"), events.where("event_type = 'purchase'").select("user_id")


A, B = "SELECT user_id FROM events WHERE event_type = 'click'", "SELECT user_id FROM events WHERE event_type = 'purchase'"


@query("set_union_all", f"{A} UNION ALL {B}")
def set_union_all(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.unionAll(b)


@query("set_union_distinct", f"{A} UNION {B}")
def set_union_distinct(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.unionAll(b).distinct()


@query("set_intersect", f"{A} INTERSECT {B}")
def set_intersect(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def set_except(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return sides(spark, sf_dir)[0].subtract(events.where("event_type = 'purchase' and value > 50").select("user_id"))


@query("set_except_all", f"{A} EXCEPT ALL {B}")
def set_except_all(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return a.exceptAll(b)


@query("set_symmetric_difference", f"({A} EXCEPT {B}) UNION ALL ({B} EXCEPT {A}) UNION ALL (SELECT -l_partkey FROM lineitem WHERE l_linenumber = 6 EXCEPT SELECT -l_partkey FROM lineitem WHERE l_linenumber = 7) UNION ALL (SELECT -l_partkey FROM lineitem WHERE l_linenumber = 7 EXCEPT SELECT -l_partkey FROM lineitem WHERE l_linenumber = 6)")
def set_symmetric_difference(spark, sf_dir):
    """Of two pairs of sets; the second's members are negative here, to tell them apart."""
    line = lambda n: load(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select((-F.col("l_partkey")).alias("user_id"))
    return symmetric_difference(*sides(spark, sf_dir)).unionAll(symmetric_difference(line(6), line(7)))


@query("set_lineage_edges", "SELECT DISTINCT conv_id, role AS from_role, next_role AS to_role FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL")
def set_lineage_edges(spark, sf_dir):
    from pyspark.sql import Window

    step = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return load(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("from_role"), step.alias("to_role")).where("to_role is not null").dropDuplicates()


@query("set_heterogeneous_export", "SELECT 'label' AS kind, doc_id AS id, quality, NULL::VARCHAR AS name FROM labels UNION ALL SELECT 'nation', n_nationkey, NULL, n_name FROM nation")
def set_heterogeneous_export(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id"), "quality")
    nations = load(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return labels.unionByName(nations, allowMissingColumns=True)
