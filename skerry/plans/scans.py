"""Queries: files as they are found, scans applied, sidecars, snapshots and exports that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import applied
from ..operators.similarity import centroids
from ..sources import files, snapshots
from ..sources.tables import load
from ..storage import fresh_path
from .joins import RECONCILE_SQL, two_scans
from .registry import query

#: A beginning of each format, as hex digits, with its kind and type.
HEADS = (
    ("89504E470D0A1A0A0000", "png", "image", "image/png"), ("FFD8FFE000104A464946", "jpeg", "image", "image/jpeg"), ("474946383961", "gif", "image", "image/gif"), ("474946383861", None, None, "application/octet-stream"),
    ("524946460000000057454250565038", "webp", "image", "image/webp"), ("524946460000000041564920AAAA", "avi", "video", "video/x-msvideo"), ("524946460000000057415645AAAA", "wav", "audio", "audio/wav"), ("49492A00", "tiff", "image", "image/tiff"),
    ("0000000C4A584C200D0A870A", "jxl", "image", "image/jxl"), ("38425053", "psd", "image", "image/vnd.adobe.photoshop"), ("0000000C6A502020", "jp2", "image", "image/jp2"), ("0000001C6674797068656963", "heif", "image", "image/heif"),
    ("0000001C6674797061766966", "avif", "image", "image/avif"), ("0000001C6674797063727820", "heif", "image", "image/heif"), ("0000001C667479704D344120", "m4a", "audio", "application/octet-stream"), ("0000001C6674797071742020", "mov", "video", "video/quicktime"),
    ("0000001C6674797069736F6D", "mp4", "video", "video/mp4"), ("1A45DFA3", "matroska", "video", "video/x-matroska"), ("464C5601", "flv", "video", "video/x-flv"), ("47" + "00" * 187 + "47", "mpeg-ts", "video", "video/mp2t"),
    ("4F676753", "ogg", "audio", "audio/ogg"), ("664C6143", "flac", "audio", "audio/flac"), ("FFFB9064", "mp3", "audio", "audio/mpeg"), ("49443303", "mp3", "audio", "audio/mpeg"), ("464F524D0000000041494646", "aiff", "audio", "audio/aiff"),
    ("FFF15080", "aac-adts", "audio", "audio/aac"), ("255044462D312E37", "pdf", "document", "application/pdf"), ("00", None, None, "application/octet-stream"),
)
_Q = lambda x: "NULL" if x is None else f"'{x}'"


@query("scan_sniff", f"WITH h(k, format, kind, mime) AS (VALUES {', '.join(f'({k}, {_Q(f)}, {_Q(d)}, {_Q(m)})' for k, (_, f, d, m) in enumerate(HEADS))}) SELECT doc_id, format, kind, mime FROM documents JOIN h ON doc_id % {len(HEADS)} = k")
def scan_sniff(spark, sf_dir):
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h, *_ in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int")))
    rows = load(spark, sf_dir, "documents").select("doc_id", files.sniffed(head).alias("s"))
    return rows.select("doc_id", "s.format", "s.kind", files.content_type(F.col("s.format")).alias("mime"))


SUFFIXES = (("PNG", "image"), ("nef", "image"), ("gif", "animated_image"), ("M2TS", "video"), ("opus", "audio"), ("pdf", "document"), ("zzz", None))


@query("scan_kinds", f"WITH h(k, kind) AS (VALUES {', '.join(f'({k}, {_Q(d)})' for k, (_, d) in enumerate(SUFFIXES))}) SELECT kind, count(*) AS n FROM documents JOIN h ON doc_id % {len(SUFFIXES)} = k GROUP BY kind")
def scan_kinds(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x, _ in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    named = load(spark, sf_dir, "documents").select(F.concat_ws(".", F.lit("a.b"), suffix).alias("name"))
    return named.groupBy(files.kind_of_name(F.col("name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


ROOTED_SQL = RECONCILE_SQL.replace("ELSE 'new' END FROM r)", "ELSE 'new' END FROM r WHERE o_key IS NOT NULL OR s_key % 2 = 0)")


@query("scan_one_root", ROOTED_SQL + "SELECT outcome, count(*) AS n, CAST(sum(coalesce(s_key, 0)) AS BIGINT) AS stored_sum FROM x GROUP BY outcome")
def scan_one_root(spark, sf_dir):
    """Only stored rows of the walked root (even ids) can be missing."""
    from ..operators.joins import reconcile

    found = reconcile(*two_scans(spark, sf_dir), "doc_id", "sha", F.col("doc_id") % 2 == 0)
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("s_key", F.lit(0))).alias("stored_sum"))


@query("scan_applied", RECONCILE_SQL + """
, f AS (SELECT x.s_key AS id, coalesce(x.o_key, x.s_key) AS path, CASE WHEN x.outcome = 'missing' THEN 7.0::DOUBLE END AS missing_since, x.outcome FROM x WHERE x.s_key IS NOT NULL),
a AS (SELECT (SELECT max(doc_id) FROM s) + row_number() OVER (ORDER BY o_key) AS id, o_key AS path, NULL::DOUBLE AS missing_since, outcome FROM x WHERE s_key IS NULL),
b AS (SELECT * FROM f UNION ALL SELECT * FROM a)
SELECT b.id, b.path, coalesce(o.sha, s.sha) AS sha, b.missing_since, b.outcome FROM b LEFT JOIN o ON o.doc_id = b.path AND b.outcome <> 'missing' LEFT JOIN s ON s.doc_id = b.path AND b.outcome = 'missing'
""")
def scan_applied(spark, sf_dir):
    seen, stored = two_scans(spark, sf_dir)
    held = stored.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path"), "sha", F.lit(None).cast("double").alias("missing_since"))
    return applied(seen.withColumnRenamed("doc_id", "path"), held, "id", "path", "sha", F.lit(7.0))


@query("scan_sidecar", """
SELECT event_id, key, value FROM (SELECT event_id, unnest([{'key': 'a.k', 'value': json_extract_string(props, '$.k')}, {'key': 'b.0', 'value': event_type}, {'key': 'b.1.c', 'value': CAST(user_id AS VARCHAR)}, {'key': 'd', 'value': 'true'}], recursive := true) FROM events WHERE event_id % 5 <> 0)
""")
def scan_sidecar(spark, sf_dir):
    made = F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "b": ["'), F.col("event_type"), F.lit('", {"c": '), F.col("user_id"), F.lit(', "none": null}], "d": true}'))
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("[1, not json")).otherwise(made)
    return load(spark, sf_dir, "events").select("event_id", F.explode(files.sidecar(raw)).alias("key", "value"))


@query("export_verdicts", "SELECT doc_id, CASE WHEN quality = 1 THEN 'right' ELSE 'wrong' END AS verdict, CASE WHEN toxic = 1 THEN 'toxic' END AS note, NULL::VARCHAR AS model FROM labels")
def export_verdicts(spark, sf_dir):
    """Verdicts with the optional columns that were asked for; written as JSON, and read back."""
    told = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "right").otherwise("wrong").alias("verdict"), F.when(F.col("toxic") == 1, "toxic").alias("note"), F.lit("m").alias("model"))
    path = fresh_path(spark, "verdicts")
    files.export_json(snapshots.included(told, ("doc_id", "verdict"), ("note", "model"), ("note",)), path)
    return spark.read.schema(told.schema).json(path)


@query("export_vectors", """
WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)
SELECT label AS space, count(*) AS vectors, CAST(sum(vec_id) AS BIGINT) AS ids, count(DISTINCT CAST(vec_id AS VARCHAR)) AS members, 64 AS width, true AS unit FROM u GROUP BY label
""")
def export_vectors(spark, sf_dir):
    """Per space its vectors and their centroid, one JSON object a space part; written, and read back."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("label").alias("space"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    middle = centroids(load(spark, sf_dir, "embeddings"), "label", "embedding").select(F.col("label").alias("space"), "members", "centroid")
    path = fresh_path(spark, "vectors")
    files.export_json(vectors.join(middle, "space"), path)
    back = spark.read.schema("space int, vec_id long, vector array<double>, members long, centroid array<double>").json(path)
    length = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)
    return back.groupBy("space").agg(F.count(F.lit(1)).alias("vectors"), F.sum("vec_id").alias("ids"), F.max("members").alias("members"), F.max(F.size("vector")).alias("width"), F.every(F.abs(length - 1) < 1e-9).alias("unit"))


@query("snapshot_restored", "SELECT count(*) AS rows, CAST(sum(vec_id) AS BIGINT) AS ids, true AS same, true AS refused FROM embeddings")
def snapshot_restored(spark, sf_dir):
    """A space written with what made it, and read back; another maker's is refused."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    spec = snapshots.Space("words", 64, "cosine", "hasher", "1")
    path = fresh_path(spark, "space")
    snapshots.write(vectors, path, spec)
    back = snapshots.restore(spark, path, spec)
    other = snapshots.restore(spark, path, snapshots.Space("words", 64, "cosine", "hasher", "2"))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("vec_id").alias("ids"), F.lit(back.schema == vectors.schema).alias("same"), F.lit(other is None).alias("refused"))
