"""Queries: the ordered answer and its views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answer
from ..sources.tables import load
from .filters import ask, ids
from .registry import query

LONGEST = "ORDER BY n_chars DESC NULLS LAST, doc_id DESC"
PLACED = f"SELECT doc_id, lang, n_chars, row_number() OVER ({LONGEST}) AS ordinal FROM documents WHERE lang = 'en'"


def english(spark, sf_dir):
    return ids(ask(spark, sf_dir, "media.kind:eq:en"))


def longest():
    return answer.total_order("n_chars", "doc_id", True)


@query("page_n", f"SELECT * FROM ({PLACED}) WHERE ordinal BETWEEN 21 AND 40")
def page_n(spark, sf_dir):
    return answer.page(english(spark, sf_dir), longest(), 2, 20)


@query("page_clamped", f"WITH p AS ({PLACED}) SELECT * FROM p WHERE ordinal > (SELECT (greatest(1, ceil(count(*) / 60.0)) - 1) * 60 FROM p)")
def page_clamped(spark, sf_dir):
    return answer.page(english(spark, sf_dir), longest(), 10**6, 60)


@query("peek", f"SELECT * FROM ({PLACED}) WHERE ordinal <= 9")
def peek(spark, sf_dir):
    return answer.peek(english(spark, sf_dir), longest())


@query("order_newest", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS ordinal FROM events")
def order_newest(spark, sf_dir):
    return answer.ordered(load(spark, sf_dir, "events").select("event_id", "ts"), answer.total_order("ts", "event_id", True)).select("event_id", "ordinal")


@query("order_oldest", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events")
def order_oldest(spark, sf_dir):
    return answer.ordered(load(spark, sf_dir, "events").select("event_id", "ts"), answer.total_order("ts", "event_id", False)).select("event_id", "ordinal")


def rated(spark, sf_dir):
    """Documents with a sort column that most lack."""
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("order_column_nulls_last", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id DESC) AS ordinal FROM documents LEFT JOIN labels USING (doc_id)")
def order_column_nulls_last(spark, sf_dir):
    return answer.ordered(rated(spark, sf_dir), answer.total_order("quality", "doc_id", True))


@query("order_column_ascending", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id ASC) AS ordinal FROM documents LEFT JOIN labels USING (doc_id)")
def order_column_ascending(spark, sf_dir):
    return answer.ordered(rated(spark, sf_dir), answer.total_order("quality", "doc_id", False))


@query("locate", f"""
WITH p AS ({PLACED}), m AS (SELECT max(doc_id) AS id FROM p WHERE doc_id <= 100), n AS (SELECT count(*) AS total FROM p)
SELECT o.doc_id AS member, o.ordinal, (SELECT doc_id FROM p WHERE ordinal = o.ordinal - 1) AS previous_id, (SELECT doc_id FROM p WHERE ordinal = o.ordinal + 1) AS next_id,
  (SELECT doc_id FROM p WHERE ordinal = 1) AS first_id, (SELECT doc_id FROM p WHERE ordinal = total) AS last_id, total, CAST(ceil(o.ordinal / 60.0) AS BIGINT) AS page
FROM p o, m, n WHERE o.doc_id = m.id
""")
def locate(spark, sf_dir):
    items = english(spark, sf_dir)
    member = items.where("doc_id <= 100").agg(F.max("doc_id")).first()[0]
    return answer.located(items, "doc_id", longest(), member, 60)


@query("neighborhood", f"""
WITH p AS ({PLACED}), m AS (SELECT max(doc_id) AS id FROM p WHERE doc_id <= 100), n AS (SELECT count(*) AS total FROM p),
w AS (SELECT greatest(0, least(o.ordinal - 1 - 7, total - 15)) AS start FROM p o, m, n WHERE o.doc_id = m.id)
SELECT p.* FROM p, w WHERE ordinal > start AND ordinal <= start + 15
""")
def neighborhood(spark, sf_dir):
    items = english(spark, sf_dir)
    member = items.where("doc_id <= 100").agg(F.max("doc_id")).first()[0]
    return answer.neighbourhood(items, "doc_id", longest(), member, 15)


@query("neighborhood_edge", f"SELECT * FROM ({PLACED}) WHERE ordinal <= 15")
def neighborhood_edge(spark, sf_dir):
    items = english(spark, sf_dir)
    first = items.orderBy(*longest()).first()["doc_id"]
    return answer.neighbourhood(items, "doc_id", longest(), first, 15)


@query("nth_in_range", """
WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12')
SELECT event_id, n AS members FROM r WHERE k = least(greatest(100, 0), n - 1)
""")
def nth_in_range(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' and ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id", "ts")
    total = rows.count()
    k = min(max(100, 0), total - 1)
    return rows.orderBy("ts", "event_id").limit(k + 1).orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", F.lit(total).cast("long").alias("members"))


@query("spread_even", """
WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS cnt FROM events)
SELECT event_id, rn AS ordinal FROM r WHERE (rn - 1) % greatest(1, (cnt + 19) // 20) = 0 ORDER BY rn LIMIT 20
""")
def spread_even(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "ts")
    step = max(1, (rows.count() + 19) // 20)
    placed = answer.ordered(rows, answer.total_order("ts", "event_id", False))
    return placed.where((F.col("ordinal") - 1) % step == 0).orderBy("ordinal").limit(20).select("event_id", "ordinal")


@query("topk_overflow", """
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS place, count(*) OVER () AS total FROM c)
SELECT l_partkey, n, place, total > 40 AS more FROM r WHERE place <= 40
""")
def topk_overflow(spark, sf_dir):
    counts = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return answer.top_with_more(counts, [F.desc("n"), F.asc("l_partkey")], 40)


@query("keyset_neighbour", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (100000.0, 500) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5")
def keyset_neighbour(spark, sf_dir):
    return answer.keyset_next(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (100000.0, 500), 5)


@query("answer_digest", f"""
WITH p AS ({PLACED}), b AS (SELECT (ordinal - 1) // 4096 AS block, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY ordinal)) AS h, count(*) AS n FROM p GROUP BY 1)
SELECT substr(sha256(string_agg(h, ',' ORDER BY block)), 1, 16) AS digest, CAST(sum(n) AS BIGINT) AS members FROM b
""")
def answer_digest(spark, sf_dir):
    return answer.digest(english(spark, sf_dir), "doc_id", longest())


@query("answer_members_in_order", "SELECT doc_id, lang, CAST(k AS BIGINT) AS position FROM (SELECT unnest([55::BIGINT, 3, 34, 8]) AS doc_id, unnest([0, 1, 2, 3]) AS k) JOIN documents USING (doc_id)")
def answer_members_in_order(spark, sf_dir):
    given = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (55, 3, 34, 8)])).alias("position", "doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(given), "doc_id").select("doc_id", "lang", F.col("position").cast("long").alias("position"))


@query("subset_proof", "SELECT count(*) AS outsiders FROM (SELECT doc_id FROM documents WHERE n_chars > 1000) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def subset_proof(spark, sf_dir):
    return answer.proven(load(spark, sf_dir, "documents").where("n_chars > 1000"), english(spark, sf_dir), "doc_id")


@query("best_member", "SELECT lang, arg_max(doc_id, (n_chars, -doc_id)) AS best_id, max(n_chars) AS n_chars FROM documents GROUP BY lang")
def best_member(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best_id"), F.max("n_chars").alias("n_chars"))


@query("ledger_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def ledger_page(spark, sf_dir):
    return load(spark, sf_dir, "events").where("event_id > 500").orderBy("event_id").limit(50).select("event_id", "event_type")


@query("ledger_page_before", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT event_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 50)")
def ledger_page_before(spark, sf_dir):
    back = load(spark, sf_dir, "events").where("event_id < 500").orderBy(F.desc("event_id")).limit(50).select("event_id")
    return back.withColumn("place", F.row_number().over(Window.orderBy("event_id")).cast("long"))
