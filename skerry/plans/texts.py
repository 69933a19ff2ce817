"""Queries: text, markup, keys and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import moments, text
from ..operators.ranking import tokens
from ..sources.tables import load
from .registry import query

PROMPT_SQL = """
SELECT event_id, 'a cat, <lora:style' || (event_id % 7) || ':0.' || (event_id % 10) || ':0.5> sunny <LORA:STYLE' || (event_id % 7) || ':1> <lora::1> <LyCO:tone' || (event_id % 3) || ':te=0.25:unet=0.75> <lora:Solo:x>' || chr(10) ||
 'Negative prompt: blur, noise' || chr(10) || 'Steps: ' || (10 + event_id % 30) || ', Sampler: euler ' || event_type || ', CFG scale: 7.5, Hires-fix up/down: 2, Seed: ' || event_id || ', Size: 512x' || (256 + event_id % 5 * 64) || ', Note: "a, b: c"' AS prompt FROM events
"""


def prompts(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr(
        "event_id",
        """concat('a cat, <lora:style', event_id % 7, ':0.', event_id % 10, ':0.5> sunny <LORA:STYLE', event_id % 7, ':1> <lora::1> <LyCO:tone', event_id % 3, ':te=0.25:unet=0.75> <lora:Solo:x>', char(10),
        'Negative prompt: blur, noise', char(10), 'Steps: ', 10 + event_id % 30, ', Sampler: euler ', event_type, ', CFG scale: 7.5, Hires-fix up/down: 2, Seed: ', event_id, ', Size: 512x', 256 + event_id % 5 * 64, ', Note: "a, b: c"') as prompt""",
    )


@query("txt_lora_tags", f"""
WITH p AS ({PROMPT_SQL})
SELECT event_id, 'style' || (event_id % 7) AS name, CAST('0.' || (event_id % 10) AS DOUBLE) AS te, 0.5::DOUBLE AS unet FROM p UNION ALL SELECT event_id, 'tone' || (event_id % 3), 0.25::DOUBLE, 0.75::DOUBLE FROM p UNION ALL SELECT event_id, 'Solo', 1.0::DOUBLE, 1.0::DOUBLE FROM p
""")
def txt_lora_tags(spark, sf_dir):
    return lora_tags(prompts(spark, sf_dir))


def lora_tags(rows):
    found = rows.select("event_id", F.explode(text.network_tags(F.col("prompt"))).alias("t"))
    return found.select("event_id", "t.name", "t.te", "t.unet")


@query("txt_infotext", f"""
WITH p AS ({PROMPT_SQL}) SELECT event_id, regexp_extract(prompt, 'Steps: ([0-9]+)', 1) AS steps, regexp_extract(prompt, 'Sampler: ([^,]+)', 1) AS sampler, regexp_extract(prompt, 'Seed: ([0-9]+)', 1) AS seed, '7.5' AS cfg, '2' AS hires, 'a, b: c' AS note FROM p
""")
def txt_infotext(spark, sf_dir):
    return infotexts(prompts(spark, sf_dir))


def infotexts(rows):
    m = text.canonical_names(text.infotext(F.col("prompt")))
    return rows.withColumn("m", m).select("event_id", *[F.col("m")[k].alias(n) for k, n in (("steps", "steps"), ("sampler", "sampler"), ("seed", "seed"), ("cfg", "cfg"), ("Hires-fix up/down", "hires"), ("Note", "note"))])


@query("txt_sections", f"WITH p AS ({PROMPT_SQL}) SELECT event_id, split_part(prompt, chr(10), 1) AS positive, 'blur, noise' AS negative FROM p")
def txt_sections(spark, sf_dir):
    return sections(prompts(spark, sf_dir))


def sections(rows):
    return rows.withColumn("s", text.prompt_parts(F.col("prompt"))).select("event_id", "s.positive", "s.negative")


@query("txt_size", f"WITH p AS ({PROMPT_SQL}) SELECT event_id, CAST(regexp_extract(prompt, 'Size: ([0-9]+)x([0-9]+)', 1) AS BIGINT) AS width, CAST(regexp_extract(prompt, 'Size: ([0-9]+)x([0-9]+)', 2) AS BIGINT) AS height FROM p")
def txt_size(spark, sf_dir):
    return sizes(prompts(spark, sf_dir))


def sizes(rows):
    size = r"Size: (\d+)x(\d+)"
    return rows.select("event_id", *[F.regexp_extract("prompt", size, k).cast("long").alias(n) for k, n in ((1, "width"), (2, "height"))])


@query("txt_tokens_count", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
def txt_tokens_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("words"))


@query("txt_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def txt_slug(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("txt_name_key", "SELECT lower(trim(regexp_replace('  ' || c_mktsegment || '   X ', '\\s+', ' ', 'g'))) AS name_key, count(*) AS n FROM customer GROUP BY 1")
def txt_name_key(spark, sf_dir):
    key = text.name_key(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("   X ")))
    return load(spark, sf_dir, "customer").groupBy(key.alias("name_key")).agg(F.count(F.lit(1)).alias("n"))


@query("txt_trigram_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idio')")
def txt_trigram_search(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.lower("text").contains("idio")).select("doc_id")


@query("txt_prompt_sections", """
SELECT event_id, ordinal, kind, spec, text FROM (
SELECT event_id, 0 AS ordinal, 'main' AS kind, NULL::VARCHAR AS spec, 'a ' || event_type || ' by <random:a|b>' AS text FROM events
UNION ALL SELECT event_id, 1, 'segment', 'face,<var:x>,0.5', 'sharp eyes' FROM events
UNION ALL SELECT event_id, 2, 'refiner', NULL, 'fine < 3' FROM events WHERE event_id % 2 = 0)
""")
def txt_prompt_sections(spark, sf_dir):
    refiner = F.when(F.col("event_id") % 2 == 0, F.lit("<Refiner>  fine < 3")).otherwise(F.lit("<refiner> "))
    staged = F.concat(F.lit("a <lora:x:1>"), F.col("event_type"), F.lit(" <comment:no>by <random:a|b><segment[p]:face,<var:x>,0.5//cid=7> sharp\neyes "), refiner)
    rows = load(spark, sf_dir, "events").select("event_id", F.explode(text.prompt_sections(staged)).alias("s"))
    return rows.select("event_id", "s.*")


@query("txt_humanised", """
SELECT key, shown, count(*) AS n FROM (SELECT unnest([{'key': 'used_wildcards', 'shown': 'used wildcards'}, {'key': 'FocalPlaneXResolution', 'shown': 'Focal Plane X Resolution'}, {'key': 'file_param.key', 'shown': 'file param key'},
{'key': 'sourceSize', 'shown': 'source Size'}, {'key': 'ISO', 'shown': 'ISO'}, {'key': '--', 'shown': '--'}, {'key': 'XMPToolkit', 'shown': 'XMP Toolkit'}], recursive := true) FROM part) GROUP BY key, shown
""")
def txt_humanised(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("used_wildcards", "FocalPlaneXResolution", "file_param.key", "sourceSize", "ISO", "--", "XMPToolkit")])
    rows = load(spark, sf_dir, "part").select(F.explode(keys).alias("key"))
    return rows.groupBy("key", text.humanised(F.col("key")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("txt_match_score", "SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 's') THEN 0 WHEN contains(' ' || regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'), ' s') THEN 1 WHEN contains(lower(p_type), 's') THEN 2 WHEN contains(lower(p_name), 's') OR contains(lower(p_brand), 's') THEN 3 END AS score FROM part")
def txt_match_score(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.match_score(F.col("p_type"), F.lit("s"), F.array("p_name", "p_brand")).alias("score"))


@query("url_parts", r"SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    return load(spark, sf_dir, "pages").withColumn("u", text.url_parts(F.col("url"))).select("page_id", "u.*")


@query("url_host_counts", "SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS on_host FROM pages")
def url_host_counts(spark, sf_dir):
    from pyspark.sql import Window

    host = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.count(F.lit(1)).over(Window.partitionBy(host)).alias("on_host"))


@query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs FROM pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"))


@query("json_flatten", "SELECT event_id, 'props.k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'user.id', CAST(user_id AS VARCHAR) FROM events")
def json_flatten(spark, sf_dir):
    nested = F.to_json(F.struct(F.from_json("props", "struct<k: long>").alias("props"), F.struct(F.col("user_id").alias("id")).alias("user")))
    rows = load(spark, sf_dir, "events").select("event_id", nested.alias("j"))
    outer = rows.select("event_id", F.explode(F.from_json("j", "map<string,map<string,string>>")).alias("a", "m"))
    return outer.select("event_id", "a", F.explode("m").alias("b", "value")).select("event_id", F.concat_ws(".", "a", "b").alias("key"), "value")


@query("num_parse", "SELECT * FROM (VALUES ('1', 1.0::DOUBLE), (' 2.5 ', 2.5), ('1_000', NULL), ('nan', NULL), ('1e3', 1000.0), ('.5', 0.5), ('', NULL), ('12 px', NULL), ('-7', -7.0), ('1e999', NULL)) t(raw, value)")
def num_parse(spark, sf_dir):
    raw = spark.createDataFrame([(x,) for x in ("1", " 2.5 ", "1_000", "nan", "1e3", ".5", "", "12 px", "-7", "1e999")], "raw string")
    return raw.select("raw", moments.try_number(F.col("raw")).alias("value"))


@query("num_durations", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 + 0.25::DOUBLE WHEN 1 THEN (event_id % 100 + 0.5::DOUBLE) * 60 WHEN 2 THEN 1.0::DOUBLE * (event_id % 100) END AS seconds FROM events")
def num_durations(spark, sf_dir):
    n = F.col("event_id") % 100
    written = F.when(F.col("event_id") % 4 == 0, F.concat(n, F.lit(".25 sec"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), n, F.lit(".5 min"))).when(F.col("event_id") % 4 == 2, F.concat(n, F.lit(" seconds"))).otherwise(F.lit("a while"))
    return load(spark, sf_dir, "events").select("event_id", moments.duration(written).alias("seconds"))


@query("geo_degrees", "SELECT o_orderkey, round((o_orderkey % 90 + (o_orderkey % 60) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END, 9) AS degrees, CASE WHEN o_orderkey % 5 <> 0 THEN round(1.0::DOUBLE / (o_orderkey % 5), 9) END AS exposure FROM orders")
def geo_degrees(spark, sf_dir):
    key = F.col("o_orderkey")
    at = F.array((key % 90).cast("double"), (key % 60).cast("double"), F.lit(30.0))
    side = F.when(key % 2 == 0, "s").otherwise("N")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(moments.degrees(at, side), 9).alias("degrees"), F.round(moments.rational(F.concat(F.lit("1/"), key % 5)), 9).alias("exposure"))


@query("when_refine", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate) + 3600 ELSE epoch(o_orderdate) END AS at FROM orders")
def when_refine(spark, sf_dir):
    claim = F.col("o_orderdate").cast("timestamp").cast("double")
    estimate = F.when(F.col("o_orderkey") % 3 == 0, claim + 3600).otherwise(claim + 200000)
    return load(spark, sf_dir, "orders").select("o_orderkey", moments.refined(claim, F.lit("day"), estimate).alias("at"))


@query("sha_identity", "SELECT doc_id, substr(sha256(text), 1, 16) AS short FROM documents")
def sha_identity(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("short"))


@query("txt_words_match", r"""
WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, contains(t, ' there ') AND contains(t, ' the ') AS every, contains(t, ' there ') OR contains(t, ' than ') AS some, contains(t, ' of the ') AS phrase FROM w
""")
def txt_words_match(spark, sf_dir):
    words = text.word_line(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", text.matches(words, "there the", "all").alias("every"), text.matches(words, "there than", "any").alias("some"), text.matches(words, "of  the", "phrase").alias("phrase"))


@query("url_canonical", """
WITH u AS (SELECT page_id, 'b=2&a=' || (page_id % 7) || '&c=x%20y&a=' || (page_id % 7) || '&=z&b=1' AS q FROM pages) SELECT page_id, 'a=' || (page_id % 7) || '&b=1&b=2&c=x+y' AS canonical FROM u
""")
def url_canonical(spark, sf_dir):
    raw = F.concat(F.lit("b=2&a="), F.col("page_id") % 7, F.lit("&c=x%20y&a="), F.col("page_id") % 7, F.lit("&=z&b=1"))
    return load(spark, sf_dir, "pages").select("page_id", text.canonical_query(raw).alias("canonical"))
