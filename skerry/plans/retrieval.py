"""Queries: retrieval and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import semantic
from ..operators.ranking import bm25, fused_spaces, head_of_spaces, ranked, standing_in_spaces, tokens
from ..operators.similarity import scores
from ..sources.tables import load
from .registry import query
from .vectors import UNIT_SQL

WORDS = ["there", "nation", "stupid", "idiot", "clown"]
BM25_SQL = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS average FROM w),
f AS (SELECT doc_id, len(t) AS length, word, len(list_filter(t, lambda x: x = word)) AS tf FROM w, (SELECT unnest(['there', 'nation', 'stupid', 'idiot', 'clown']) AS word) WHERE list_contains(t, word)),
d AS (SELECT word, count(*) AS df FROM f GROUP BY word),
b AS (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score FROM f JOIN d USING (word), s GROUP BY doc_id)
"""
SPACES_SQL = f"""
{UNIT_SQL}, q AS (SELECT vec_id AS query_id, v FROM u WHERE vec_id % 50 = 0),
sc AS (SELECT query_id, u.vec_id, round(list_dot_product(q.v, u.v), 9) AS score FROM q, u WHERE q.query_id <> u.vec_id)
"""


def sides(spark, sf_dir, allowed=None):
    """The allowed vectors and all stated queries, the rows whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    among = vectors if allowed is None else vectors.join(allowed, "vec_id", "left_semi")
    return among, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding"


def spaces(spark, sf_dir, allowed=None):
    """Scores of the allowed vectors against all stated queries."""
    return scores(*sides(spark, sf_dir, allowed)).withColumnRenamed("id", "vec_id")


def english(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))


def in_role(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where("label < 5").select("vec_id")


@query("ret_bm25", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b")
def ret_bm25(spark, sf_dir):
    return bm25(load(spark, sf_dir, "documents"), "doc_id", "text", WORDS).select("doc_id", F.round("score", 6).alias("score"))


@query("ret_rrf", f"WITH {SPACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM sc) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + position)), 9) AS fusion, count(*) AS spaces FROM r GROUP BY vec_id")
def ret_rrf(spark, sf_dir):
    found = fused_spaces(*sides(spark, sf_dir))
    return found.select("vec_id", F.round("fusion", 9).alias("fusion"), "spaces")


@query("ret_rrf_constrained", f"WITH {SPACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM sc WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + position)), 9) AS fusion FROM r GROUP BY vec_id ORDER BY sum(1.0::DOUBLE / (60 + position)) DESC, vec_id LIMIT 50")
def ret_rrf_constrained(spark, sf_dir):
    found = fused_spaces(*sides(spark, sf_dir, english(spark, sf_dir)))
    return found.orderBy(F.desc("fusion"), "vec_id").limit(50).select("vec_id", F.round("fusion", 9).alias("fusion"))


HEAD_SQL = f"{SPACES_SQL}, l AS (SELECT query_id, median(score) AS middle, max(score) AS best FROM sc GROUP BY query_id)"


@query("ret_head_cut", f"WITH {HEAD_SQL} SELECT query_id, vec_id, score FROM sc JOIN l USING (query_id) WHERE best > middle AND score >= middle + 0.5 * (best - middle)")
def ret_head_cut(spark, sf_dir):
    return head_of_spaces(*sides(spark, sf_dir))


@query("ret_standing", f"WITH {HEAD_SQL} SELECT vec_id, max(round(CASE WHEN best > middle THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score - middle) / (best - middle))) ELSE 0.0::DOUBLE END, 4)) AS relevance FROM sc JOIN l USING (query_id) GROUP BY vec_id")
def ret_standing(spark, sf_dir):
    return standing_in_spaces(*sides(spark, sf_dir)).select("vec_id", "relevance")


@query("ret_answering_set", f"WITH {HEAD_SQL} SELECT DISTINCT vec_id FROM sc JOIN l USING (query_id) WHERE best > middle AND score >= middle + 0.5 * (best - middle)")
def ret_answering_set(spark, sf_dir):
    return standing_in_spaces(*sides(spark, sf_dir)).where("answers").select("vec_id")


@query("ret_neighbours", f"WITH {SPACES_SQL} SELECT query_id, vec_id, place FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM sc WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label < 5)) WHERE place <= 10")
def ret_neighbours(spark, sf_dir):
    return nearest(spaces(spark, sf_dir, in_role(spark, sf_dir)))


def nearest(scored):
    """Each query's ten best, by place."""
    return ranked(scored, "vec_id", "query_id", 10).select("query_id", "vec_id", F.col("position").alias("place"))


@query("ret_lexical_cosine", r"""
WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM conversations),
c AS (SELECT conv_id, turn, word, count(*) AS n FROM w GROUP BY 1, 2, 3), l AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS length FROM c GROUP BY 1, 2)
SELECT a.conv_id, a.turn, round(sum(a.n * b.n) / (any_value(x.length) * any_value(y.length)), 6) AS cosine FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word
JOIN l x ON x.conv_id = a.conv_id AND x.turn = a.turn JOIN l y ON y.conv_id = b.conv_id AND y.turn = b.turn GROUP BY 1, 2
""")
def ret_lexical_cosine(spark, sf_dir):
    words = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    after = counts.select("conv_id", (F.col("turn") - 1).alias("turn"), "word", F.col("n").alias("m"))
    shared = counts.join(after, ["conv_id", "turn", "word"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    nexts = lengths.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("length").alias("next"))
    return shared.join(lengths, ["conv_id", "turn"]).join(nexts, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.col("s") / (F.col("length") * F.col("next")), 6).alias("cosine"))


@query("ret_semantic")
def ret_semantic(spark, sf_dir):
    """Conversation turns ranked by a phrase in two hashed spaces, fused: the first hundred of each."""
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return semantic.answered({name: semantic.embedded(turns, "id", "text", name) for name in semantic.PROVIDERS}, "how do i write a letter", "id", 100)
