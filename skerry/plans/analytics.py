"""Queries: counts, breakdowns, catalog, terms and tallies over one scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.answer import top_with_overflow
from ..sources.tables import load
from .filters import ask
from .registry import query


def rows_n() -> Column:
    return F.count(F.lit(1))


@query("agg_present_count", "SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def agg_present_count(spark, sf_dir):
    return ask(spark, sf_dir, "media.kind:eq:en").agg(rows_n().alias("n"))


@query("agg_summary", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM events) AS events")
def agg_summary(spark, sf_dir):
    one = lambda t, c: load(spark, sf_dir, t).agg(c.alias("conversations" if t == "conversations" else t))
    out = one("documents", rows_n())
    for name, column in (("labels", rows_n()), ("pages", rows_n()), ("conversations", F.countDistinct("conv_id")), ("events", rows_n())):
        out = out.crossJoin(one(name, column))  # one row each
    return out


@query("agg_options_without_self", "SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY lang")
def agg_options_without_self(spark, sf_dir):
    # Asked about lang=de and length: the options of lang are counted without its own facet.
    from ..operators.question import Question, eligible, facet
    from .filters import REGISTRY

    question = Question((facet(REGISTRY, "media.kind:eq:de"), facet(REGISTRY, "media.length:gte:500")))
    docs = load(spark, sf_dir, "documents")
    return eligible(docs, "doc_id", question.without("media.kind"), REGISTRY, {}).groupBy("lang").agg(rows_n().alias("n"))


@query("agg_options_searched", "SELECT source, count(*) AS n FROM documents WHERE source LIKE '%1%' GROUP BY source ORDER BY n DESC, source LIMIT 5")
def agg_options_searched(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.col("source").contains("1")).groupBy("source").agg(rows_n().alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("agg_breakdown", "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 500 GROUP BY source")
def agg_breakdown(spark, sf_dir):
    return ask(spark, sf_dir, "media.kind:eq:en", "media.length:gte:500").groupBy("source").agg(rows_n().alias("n"))


@query("agg_share_covered", "SELECT lang, n, round(100.0 * n / total, 1) AS share, total AS covered FROM (SELECT lang, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents GROUP BY lang) WHERE n < total")
def agg_share_covered(spark, sf_dir):
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(rows_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per value
    return counts.withColumn("covered", total).where("n < covered").select("lang", "n", F.round(F.lit(100.0) * F.col("n") / F.col("covered"), 1).alias("share"), "covered")


@query("agg_analyze", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def agg_analyze(spark, sf_dir):
    # All breakdowns of one scope in one pass.
    sets = load(spark, sf_dir, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(rows_n().alias("n"), F.grouping("lang").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("dimension"), F.when(F.col("g") == 0, F.col("lang")).otherwise(F.col("source")).alias("value"), "n")


@query("agg_yes_no", "SELECT flag, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest([0, 1]) AS flag) LEFT JOIN (SELECT CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS flag, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1) USING (flag)")
def agg_yes_no(spark, sf_dir):
    some = load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("flag"))
    told = load(spark, sf_dir, "documents").select("doc_id").join(some, "doc_id", "left").groupBy(F.coalesce("flag", F.lit(0)).alias("flag")).agg(rows_n().alias("n"))
    return spark.range(2).select(F.col("id").cast("int").alias("flag")).join(told, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_prompt_use", """
WITH g AS (SELECT role, sha256(text) AS prompt, count(*) AS n FROM conversations GROUP BY role, text), h AS (SELECT * FROM g ORDER BY n DESC, role, prompt LIMIT 40)
SELECT *, (SELECT count(*) FROM g) - (SELECT count(*) FROM h) AS more_groups, CAST((SELECT sum(n) FROM g) - (SELECT sum(n) FROM h) AS BIGINT) AS more_members FROM h
""")
def agg_prompt_use(spark, sf_dir):
    use = load(spark, sf_dir, "conversations").groupBy("role", F.sha2(F.col("text").cast("binary"), 256).alias("prompt")).agg(rows_n().alias("n"))
    return top_with_overflow(use, [F.desc("n"), F.col("role"), F.col("prompt")], 40)


@query("agg_terms", r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(lower(text), '[\n.]', ',', 'g'), ',')) AS raw FROM documents),
t AS (SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), ':[0-9.]+\)|[()\[\]{}]', '', 'g'), ' ') AS term FROM w)
SELECT term, count(*) AS files FROM t WHERE term <> '' GROUP BY term ORDER BY files DESC, term LIMIT 100
""")
def agg_terms(spark, sf_dir):
    parts = F.split(F.regexp_replace(F.lower("text"), r"[\n.]", ","), ",")
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r":[0-9.]+\)|[()\[\]{}]", "")))
    terms = load(spark, sf_dir, "documents").select(F.explode(F.array_distinct(clean)).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(rows_n().alias("files")).orderBy(F.desc("files"), "term").limit(100)


@query("agg_weights_median", "SELECT l_partkey, count(DISTINCT l_orderkey) AS files, min(l_quantity) AS least, max(l_quantity) AS most, median(l_quantity) AS middle FROM lineitem GROUP BY l_partkey")
def agg_weights_median(spark, sf_dir):
    """Medians from counted weights and files from distinct pairs: both shrink before they are shuffled, which one aggregate of both can't."""
    lines = load(spark, sf_dir, "lineitem")
    weights = lines.groupBy("l_partkey", "l_quantity").agg(rows_n().alias("n")).groupBy("l_partkey").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.percentile("l_quantity", 0.5, F.col("n")).alias("middle"))
    files = lines.select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(rows_n().alias("files"))
    return weights.join(files, "l_partkey").select("l_partkey", "files", "least", "most", "middle")


def long_tail(spark, sf_dir) -> DataFrame:
    """Key and value of every event, with keys that repeat by an index."""
    events = load(spark, sf_dir, "events")
    pairs = F.map_concat(F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, v: F.concat(F.lit("props."), k)), F.create_map(F.lit("type"), F.col("event_type"), F.concat(F.lit("user."), (F.col("user_id") % 3).cast("string")), F.col("user_id").cast("string")))
    return events.select("event_id", F.explode(pairs).alias("key", "value"))


TAIL_SQL = """
WITH p AS (SELECT event_id, 'props.k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'user.' || (user_id % 3), CAST(user_id AS VARCHAR) FROM events),
c AS (SELECT key, count(DISTINCT event_id) AS covered, count(DISTINCT value) AS vals FROM p GROUP BY key),
f AS (SELECT regexp_replace(key, '\\.[0-9]+$', '') AS family, max(covered) AS covered, CAST(sum(vals) AS BIGINT) AS vals, count(*) FILTER (regexp_matches(key, '\\.[0-9]+$')) AS repeats FROM c GROUP BY 1)
"""


def families(spark, sf_dir) -> DataFrame:
    keys = long_tail(spark, sf_dir).groupBy("key").agg(F.countDistinct("event_id").alias("covered"), F.countDistinct("value").alias("vals"))
    indexed = F.col("key").rlike(r"\.[0-9]+$")
    return keys.groupBy(F.regexp_replace("key", r"\.[0-9]+$", "").alias("family")).agg(F.max("covered").alias("covered"), F.sum("vals").alias("vals"), F.count_if(indexed).alias("repeats"))


@query("agg_catalog", TAIL_SQL + "SELECT * FROM f")
def agg_catalog(spark, sf_dir):
    return families(spark, sf_dir)


@query("agg_usefulness", TAIL_SQL + "SELECT family, CASE WHEN vals <= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, covered::DOUBLE / (SELECT count(*) FROM events)) * CASE WHEN vals <= 50 THEN 1.0::DOUBLE ELSE 50.0::DOUBLE / vals END END AS score FROM f")
def agg_usefulness(spark, sf_dir):
    total = load(spark, sf_dir, "events").agg(rows_n().alias("total"))
    share = F.least(F.lit(1.0), F.col("covered") / F.col("total"))
    few = F.when(F.col("vals") <= 50, F.lit(1.0)).otherwise(F.lit(50.0) / F.col("vals"))
    return families(spark, sf_dir).crossJoin(total).select("family", F.when(F.col("vals") <= 1, F.lit(0.0)).otherwise(share * few).alias("score"))


@query("agg_catalog_values", TAIL_SQL + """
, g AS (SELECT value, count(*) AS n FROM p WHERE key = 'props.k' GROUP BY value), h AS (SELECT * FROM g ORDER BY n DESC, value LIMIT 20)
SELECT *, (SELECT count(*) FROM g) - (SELECT count(*) FROM h) AS more_groups, CAST((SELECT sum(n) FROM g) - (SELECT sum(n) FROM h) AS BIGINT) AS more_members FROM h
""")
def agg_catalog_values(spark, sf_dir):
    values = long_tail(spark, sf_dir).where("key = 'props.k'").groupBy("value").agg(rows_n().alias("n"))
    return top_with_overflow(values, [F.desc("n"), F.col("value")], 20)


@query("agg_key_registry", TAIL_SQL + "SELECT key, count(*) AS occurrences, CASE WHEN count(DISTINCT regexp_matches(value, '^[0-9.]+$')) > 1 THEN 'mixed' WHEN bool_and(regexp_matches(value, '^[0-9.]+$')) THEN 'number' ELSE 'text' END AS kind FROM p GROUP BY key")
def agg_key_registry(spark, sf_dir):
    number = F.col("value").rlike("^[0-9.]+$")
    kind = F.when(F.countDistinct(number) > 1, "mixed").when(F.bool_and(number), "number").otherwise("text")
    return long_tail(spark, sf_dir).groupBy("key").agg(rows_n().alias("occurrences"), kind.alias("kind"))


@query("agg_by_use", "SELECT p_brand, count(DISTINCT l_orderkey) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def agg_by_use(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return load(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("files"))


@query("agg_synergy", """
WITH a AS (SELECT DISTINCT l_orderkey, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_orderkey, p_size AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 2)
SELECT brand, size, count(*) AS together FROM a JOIN b USING (l_orderkey) GROUP BY brand, size
""")
def agg_synergy(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = load(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("p_brand").alias("brand")).distinct()
    b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("p_size").alias("size")).distinct()
    return a.join(b, "l_orderkey").groupBy("brand", "size").agg(rows_n().alias("together"))


@query("agg_people_by_folder", "SELECT n_name, c_mktsegment, count(DISTINCT c_custkey) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def agg_people_by_folder(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return load(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.countDistinct("c_custkey").alias("people"))


@query("agg_spans", "SELECT n_regionkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg_spans(spark, sf_dir):
    where = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    # Reduced per customer before the join, so that the join carries customers and not orders.
    per = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return per.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_regionkey").agg(F.min("a").alias("first"), F.max("b").alias("last"))


@query("agg_run_disagreement", """
WITH r AS (SELECT l_orderkey, string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, ',' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END) AS left_run,
 string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END, ',' ORDER BY CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END) AS right_run FROM lineitem GROUP BY 1)
SELECT * FROM r WHERE left_run IS DISTINCT FROM right_run
""")
def agg_run_disagreement(spark, sf_dir):
    run = lambda k: F.when(F.col("l_linenumber") % 2 == k, F.col("l_returnflag"))
    joined = lambda k: F.nullif(F.concat_ws(",", F.array_sort(F.collect_set(run(k)))), F.lit(""))
    found = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(joined(0).alias("left_run"), joined(1).alias("right_run"))
    return found.where(~F.col("left_run").eqNullSafe(F.col("right_run")))


@query("agg_verdict_pivot", "SELECT source, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS unsure FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_verdict_pivot(spark, sf_dir):
    told = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return told.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality").isNull()).alias("unsure"))


@query("agg_corrections", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY event_type")
def agg_corrections(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(rows_n().alias("n"), F.countDistinct("user_id").alias("people"))


@query("agg_contests", """
WITH p AS (SELECT doc_id, 'quality' AS who, quality AS says FROM labels UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM labels)
SELECT a.who AS left_who, b.who AS right_who, count(*) AS shared, count(*) FILTER (a.says <> b.says) AS differ FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.who < b.who GROUP BY 1, 2
""")
def agg_contests(spark, sf_dir):
    says = load(spark, sf_dir, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), 1 - F.col("toxic"))).alias("who", "says"))
    a, b = says.select("doc_id", F.col("who").alias("left_who"), F.col("says").alias("x")), says.select("doc_id", F.col("who").alias("right_who"), F.col("says").alias("y"))
    return a.join(b, "doc_id").where("left_who < right_who").groupBy("left_who", "right_who").agg(rows_n().alias("shared"), F.count_if(F.col("x") != F.col("y")).alias("differ"))


@query("agg_tag_vocabulary", "SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tag")
def agg_tag_vocabulary(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(rows_n().alias("n"))


@query("agg_removal_cost", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
SELECT 'customer' AS what, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT * FROM c) UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT * FROM c)
""")
def agg_removal_cost(spark, sf_dir):
    people = load(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf_dir, "orders").join(people, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = load(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi")
    each = [df.agg(rows_n().alias("n")).select(F.lit(what).alias("what"), "n") for what, df in (("customer", people), ("orders", orders), ("lineitem", lines))]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("agg_job_matrix", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'click') AS open, count(*) AS total FROM events GROUP BY user_id")
def agg_job_matrix(spark, sf_dir):
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "click").alias("open"), rows_n().alias("total"))


@query("agg_queue_coverage", "SELECT lang, count(*) AS waiting FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def agg_queue_coverage(spark, sf_dir):
    done = load(spark, sf_dir, "labels").select("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(done, "doc_id", "left_anti").groupBy("lang").agg(rows_n().alias("waiting"))


@query("agg_claims_extents", "SELECT o_orderstatus, min(o_totalprice) AS least, max(o_totalprice) AS most, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def agg_claims_extents(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(rows_n().alias("n"))


@query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(rows_n().alias("n"), F.sum("l_quantity").alias("quantity"))


@query("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark, sf_dir):
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(rows_n().alias("n"))


@query("agg_distinct", "SELECT DISTINCT lang, source FROM documents")
def agg_distinct(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("agg_approx_distinct")
def agg_approx_distinct(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_quantity", 0.5).alias("middle"))


@query("agg_one_or_null", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_type FROM events WHERE value > 95 GROUP BY user_id")
def agg_one_or_null(spark, sf_dir):
    only = F.when(F.countDistinct("event_type") == 1, F.min("event_type"))
    return load(spark, sf_dir, "events").where("value > 95").groupBy("user_id").agg(only.alias("only_type"))


@query("agg_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def agg_pricing_summary(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), rows_n().alias("n"))


@query("agg_authored_export", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS shelves, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY c_custkey")
def agg_authored_export(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").where("o_totalprice > 250000")
    members = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")))
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows_n().alias("shelves"), members.alias("members"))
