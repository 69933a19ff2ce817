"""Queries: the predicate algebra of typed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.question import Key, Question, eligible, facet, parse
from ..sources.tables import DOCUMENTS, load
from .registry import query

NUMBERS = ("eq", "gte", "gt", "lt", "lte")
REGISTRY = {
    k.name: k
    for k in (
        Key("media.kind", "text", ("eq", "any"), column="lang"),
        Key("media.length", "int", NUMBERS, column="n_chars"),
        Key("folder", "text", ("eq", "any"), column="source"),
        Key("folder.folded", "text", ("eq", "any"), column="source", fold=True),
        Key("has.label", "int", ("eq",), rows="labels", on="doc_id", presence=True),
        Key("label.quality", "int", ("eq", "any"), rows="labels", on="doc_id", column="quality"),
        Key("label.toxic", "int", ("eq", "any"), rows="labels", on="doc_id", column="toxic"),
        Key("param.has", "text", ("eq", "any"), rows="params", on="doc_id", column="key"),
        Key("param.is", "pair", ("eq",), rows="params", on="doc_id", pair=("key", "value_text")),
        Key("param.num", "numpair", ("eq", "gte", "lte"), rows="params", on="doc_id", pair=("key", "value_num")),
    )
}


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tail of key and value per document: what its own columns and labels say."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "value_text"))
    labels = load(spark, sf_dir, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("key", "value"))
    return docs.withColumn("value_num", F.lit(None).cast("double")).unionByName(labels.select("doc_id", "key", F.col("value").cast("string").alias("value_text"), F.col("value").cast("double").alias("value_num")))


def ask(spark: SparkSession, sf_dir: str, *facets: str) -> DataFrame:
    tables = {"labels": load(spark, sf_dir, "labels"), "params": params(spark, sf_dir)}
    question = parse(REGISTRY, DOCUMENTS.sorts, list(facets))
    return eligible(DOCUMENTS.read(spark, sf_dir), "doc_id", question, REGISTRY, tables)


def ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "n_chars")


SELECT = "SELECT doc_id, lang, n_chars FROM documents d WHERE "


@query("filter_eq", SELECT + "lang = 'en'")
def filter_eq(spark, sf_dir):
    return ids(ask(spark, sf_dir, "media.kind:eq:en"))


@query("filter_any_or", SELECT + "lang IN ('de', 'fr') AND source IN ('src0', 'src1')")
def filter_any_or(spark, sf_dir):
    return ids(ask(spark, sf_dir, "media.kind:any:de", "folder:any:src0", "media.kind:any:fr", "folder:any:src1"))


@query("filter_range", SELECT + "n_chars >= 500 AND n_chars < 2000")
def filter_range(spark, sf_dir):
    return ids(ask(spark, sf_dir, "media.length:gte:500", "media.length:lt:2000"))


@query("filter_and_of_semis", SELECT + "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0)")
def filter_and_of_semis(spark, sf_dir):
    return ids(ask(spark, sf_dir, "label.quality:eq:1", "label.toxic:eq:0"))


@query("filter_not_exists", SELECT + "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def filter_not_exists(spark, sf_dir):
    return ids(ask(spark, sf_dir, "has.label:eq:0"))


@query("filter_has_flag", SELECT + "lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def filter_has_flag(spark, sf_dir):
    return ids(ask(spark, sf_dir, "has.label:eq:1", "media.kind:eq:en"))


@query("filter_param_has", SELECT + "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic IS NOT NULL)")
def filter_param_has(spark, sf_dir):
    return ids(ask(spark, sf_dir, "param.has:eq:toxic"))


@query("filter_param_key_value", SELECT + "source = 'src3' AND lang = 'en'")
def filter_param_key_value(spark, sf_dir):
    return ids(ask(spark, sf_dir, "param.is:eq:source=src3", "param.is:eq:lang=en"))


@query("filter_param_num", SELECT + "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality >= 1)")
def filter_param_num(spark, sf_dir):
    return ids(ask(spark, sf_dir, "param.num:gte:quality=1"))


@query("filter_fold_case", SELECT + "lower(source) = 'src2'")
def filter_fold_case(spark, sf_dir):
    return ids(ask(spark, sf_dir, "folder.folded:eq:SRC2"))


@query("filter_disputed", "SELECT doc_id, coalesce(quality = 1 AND toxic = 1, false) AS disputed FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1 AND toxic = 1, false)")
def filter_disputed(spark, sf_dir):
    told = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return told.withColumn("disputed", F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit(False))).where("disputed").select("doc_id", "disputed")


@query("filter_local_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-07'")
def filter_local_day(spark, sf_dir):
    # The range is put on the moment itself, which the scan can use; the day is only shown.
    events = load(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' and ts < TIMESTAMP_NTZ '2024-01-08'")
    return events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("filter_moment_range", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-10 18:00:00' AND event_type IN ('click', 'view')")
def filter_moment_range(spark, sf_dir):
    events = load(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 06:00:00' and ts < TIMESTAMP_NTZ '2024-01-10 18:00:00'")
    return events.where(F.col("event_type").isin("click", "view")).select("event_id", "user_id")


@query("filter_granule", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 86400.0::DOUBLE WHEN o_orderpriority LIKE '2%' THEN 2629746.0::DOUBLE ELSE 31556952.0::DOUBLE END AS granule FROM orders
WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'
""")
def filter_granule(spark, sf_dir):
    from ..functions.moments import SPANS

    precision = F.when(F.col("o_orderpriority").startswith("1"), "day").when(F.col("o_orderpriority").startswith("2"), "month").otherwise("year")
    width = F.create_map(*[x for k, v in SPANS.items() for x in (F.lit(k), F.lit(v))])
    return load(spark, sf_dir, "orders").withColumn("granule", width[precision]).where(F.col("granule") <= SPANS["month"]).select("o_orderkey", "granule")


@query("filter_stale", "SELECT a.doc_id FROM documents a LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def filter_stale(spark, sf_dir):
    told = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return told.where(~F.col("quality").eqNullSafe(F.lit(1))).select("doc_id")


@query("filter_smart_rule", "SELECT doc_id, lang, n_chars FROM (SELECT * FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id DESC LIMIT 100) WHERE lang = 'en'")
def filter_smart_rule(spark, sf_dir):
    from ..operators.answer import total_order

    rule = load(spark, sf_dir, "documents").orderBy(*total_order("n_chars", "doc_id", True)).limit(100).select("doc_id")
    return ids(ask(spark, sf_dir, "media.kind:eq:en").join(rule, "doc_id", "left_semi"))


@query("filter_question_without", SELECT + "n_chars >= 1000")
def filter_question_without(spark, sf_dir):
    question = Question((facet(REGISTRY, "media.kind:eq:de"), facet(REGISTRY, "media.length:gte:1000"))).without("media.kind")
    return ids(eligible(DOCUMENTS.read(spark, sf_dir), "doc_id", question, REGISTRY, {}))


@query("filter_named_set", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def filter_named_set(spark, sf_dir):
    named = spark.range(1).select(F.explode(F.from_json(F.lit("[3, 5, 8, 13, 21, 34, 55, 89]"), "array<bigint>")).alias("doc_id"))
    return ids(load(spark, sf_dir, "documents").join(named, "doc_id", "left_semi"))


@query("filter_person_in_phrase", """
SELECT c_custkey AS phrase_id, CASE WHEN c_custkey % 3 = 0 THEN 'n' || n_nationkey ELSE 'f' || n_nationkey END AS slug, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE n_name || ' van der Berg' END AS name,
 CASE WHEN c_custkey % 3 = 0 THEN 'photos of by the sea' ELSE 'photos of at home' END AS rest FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2
""")
def filter_person_in_phrase(spark, sf_dir):
    """The longest name counts, and a name inside a word doesn't."""
    nations = load(spark, sf_dir, "nation")
    names = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.col("n_name").alias("name")).unionAll(nations.select(F.concat(F.lit("f"), "n_nationkey"), F.concat("n_name", F.lit(" van der Berg"))))
    held = load(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Photos of "), F.lower("n_name"), F.lit(", by the sea"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("photos of "), "n_name", F.lit(" Van der Berg at home"))).otherwise(F.concat(F.lit("photos of x"), "n_name", F.lit("x")))
    return text.name_in_phrase(held.select(F.col("c_custkey").alias("phrase_id"), said.alias("phrase")), names)


@query("filter_redacted_nested", """
SELECT event_id, '{"user":{"id":' || user_id || ',"api_key":"***"},"list":[{"Password":"***","k":' || json_extract_string(props, '$.k') || '}],"n":null}' AS props FROM events
""")
def filter_redacted_nested(spark, sf_dir):
    nested = F.concat(F.lit('{"user": {"id": '), F.col("user_id"), F.lit(', "api_key": "abc"}, "list": [{"Password": {"a": 1}, "k": '), F.get_json_object("props", "$.k"), F.lit('}], "n": null}'))
    return load(spark, sf_dir, "events").select("event_id", text.redacted(nested).alias("props"))


@query("filter_currency", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0")
def filter_currency(spark, sf_dir):
    """Derived rows count only if they were made of the content that is there now: their hash is the document's."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    derived = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("of"), F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("sha")).alias("source_sha"))
    return docs.join(derived, (F.col("doc_id") == F.col("of")) & (F.col("sha") == F.col("source_sha")), "left_semi").select("doc_id")


@query("filter_redacted", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{\"k\":\"***\"}' ELSE props END AS props FROM events")
def filter_redacted(spark, sf_dir):
    return redacted(load(spark, sf_dir, "events"))


def redacted(events):
    """Events with secrets in the props of purchases hidden."""
    seen = F.from_json("props", "map<string,string>")
    hidden = F.to_json(F.transform_values(seen, lambda k, v: F.when(k.rlike("(?i)token|secret|password|^k$"), F.lit("***")).otherwise(v)))
    return events.select("event_id", F.when(F.col("event_type") == "purchase", hidden).otherwise(F.col("props")).alias("props"))
