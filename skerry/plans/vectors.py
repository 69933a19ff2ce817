"""Queries: vectors, bit hashes and what is near to what."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import doubles, dot, hamming, norm, sign_bits, unit
from ..operators.similarity import centroids, hamming_pairs, range_pairs, top_k
from ..sources.tables import load
from .registry import query

UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
THRESHOLD = 0.35


@query("vec_normalize", f"WITH {UNIT_SQL} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 9) AS length, round(v[1], 9) AS first FROM u")
def vec_normalize(spark, sf_dir):
    v = unit(doubles(F.col("embedding")))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, v), 9).alias("length"), F.round(v[0], 9).alias("first"))


@query("vec_topk", f"""
WITH {UNIT_SQL}, q AS (SELECT * FROM u WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, u.vec_id AS id, list_dot_product(q.v, u.v) AS similarity FROM q JOIN u ON q.vec_id <> u.vec_id)
SELECT query_id, id, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM s) WHERE place <= 10
""")
def vec_topk(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query("vec_range_pairs", f"WITH {UNIT_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {THRESHOLD}")
def vec_range_pairs(spark, sf_dir):
    return range_pairs(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD).withColumn("similarity", F.round("similarity", 6))


BITS_SQL = "h AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END)) AS bits FROM embeddings)"


@query("vec_hamming_pairs", f"WITH {BITS_SQL} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS bits FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)) <= 16")
def vec_hamming_pairs(spark, sf_dir):
    hashes = load(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
    return hamming_pairs(hashes, "vec_id", "bits", 16)


@query("vec_centroid_by_label", f"""
WITH {UNIT_SQL}, e AS (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM u, range(1, 65) t(i) GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS length, max(n) AS members FROM e GROUP BY label)
SELECT label, i, round(m / length, 6) AS value, members FROM e JOIN l USING (label)
""")
def vec_centroid_by_label(spark, sf_dir):
    found = centroids(load(spark, sf_dir, "embeddings"), "label", "embedding")
    spread = found.select("label", "members", F.posexplode("centroid").alias("i", "value"))
    return spread.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("value", 6).alias("value"), "members")


@query("vec_medoid", f"""
WITH {UNIT_SQL}, m AS (SELECT a.label, a.vec_id, avg(list_dot_product(a.v, b.v)) AS mean FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT label, arg_max(vec_id, (round(mean, 9), -vec_id)) AS medoid FROM m GROUP BY label
""")
def vec_medoid(spark, sf_dir):
    # The mean cosine to the others follows from the sum of the group's unit vectors: no pairs.
    u = load(spark, sf_dir, "embeddings").select("vec_id", "label", unit(doubles(F.col("embedding"))).alias("v"))
    parts = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("total"), F.max("n").alias("n"))
    mean = (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)
    return u.join(F.broadcast(sums), "label").groupBy("label").agg(F.max_by("vec_id", F.struct(F.round(mean, 9), -F.col("vec_id"))).alias("medoid"))


@query("vec_silhouette", f"""
WITH {UNIT_SQL}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
m AS (SELECT vec_id, label, min(s / n) FILTER (label <> other) AS b, max(s / n) FILTER (label = other) AS a FROM d GROUP BY 1, 2)
SELECT label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS members FROM m GROUP BY label
""")
def vec_silhouette(spark, sf_dir):
    """Mean cosine silhouette by label, from sums of unit vectors per label."""
    u = load(spark, sf_dir, "embeddings").select("vec_id", "label", unit(doubles(F.col("embedding"))).alias("v"))
    parts = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("total"), F.max("n").alias("n")).withColumnRenamed("label", "other")
    # Distance to a label is one minus the mean cosine to its members; labels are a few.
    each = u.join(F.broadcast(sums))
    mine = F.col("label") == F.col("other")
    away = F.when(mine, 1 - (dot(F.col("v"), F.col("total")) - 1) / (F.col("n") - 1)).otherwise(1 - dot(F.col("v"), F.col("total")) / F.col("n"))
    pair = each.groupBy("vec_id", "label").agg(F.min(F.when(~mine, away)).alias("b"), F.max(F.when(mine, away)).alias("a"))
    return pair.groupBy("label").agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"), F.count(F.lit(1)).alias("members"))


@query("vec_lengths", "SELECT label, count(*) AS n, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS longest FROM embeddings GROUP BY label")
def vec_lengths(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(norm(doubles(F.col("embedding")))), 6).alias("longest"))


@query("vec_align", "SELECT coalesce(e.vec_id, w.id) AS id, CASE WHEN e.vec_id IS NULL THEN 'add' WHEN w.id IS NULL THEN 'remove' ELSE 'keep' END AS action FROM embeddings e FULL JOIN (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0) w ON e.vec_id = w.id")
def vec_align(spark, sf_dir):
    have = load(spark, sf_dir, "embeddings").select("vec_id")
    want = load(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    action = F.when(F.col("vec_id").isNull(), "add").when(F.col("id").isNull(), "remove").otherwise("keep")
    return have.join(want, F.col("vec_id") == F.col("id"), "full").select(F.coalesce("vec_id", "id").alias("id"), action.alias("action"))


@query("bits_popcount", f"WITH {BITS_SQL} SELECT vec_id, CAST(bit_count(bits) AS BIGINT) AS ones FROM h")
def bits_popcount(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.bit_count(sign_bits(F.col("embedding"))).cast("long").alias("ones"))


@query("bits_distance_next", f"WITH {BITS_SQL} SELECT vec_id, CAST(bit_count(xor(bits, lag(bits) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id))) AS BIGINT) AS bits FROM h")
def bits_distance_next(spark, sf_dir):
    hashes = load(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("h"))
    w = Window.partitionBy(F.expr("vec_id div 100")).orderBy("vec_id")
    return hashes.select("vec_id", hamming(F.col("h"), F.lag("h").over(w)).cast("long").alias("bits"))
