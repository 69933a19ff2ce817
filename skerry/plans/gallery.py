"""Queries: the whole vocabulary of typed questions over a library: facets, scopes, sorts, values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import answer, vocabulary
from ..operators.question import eligible, facet, parse
from ..operators.ranking import bm25, head
from ..sources import library
from ..sources.tables import load
from .registry import query
from .retrieval import BM25_SQL, WORDS

REGISTRY = vocabulary.keys()
#: The columns that order an answer; text columns by their lower case.
SORTS = {
    "file": ("name", "kind", "size", "pixels", "length"),
    "recipe": ("seed", "steps", "cfg", "sampler", "checkpoint"),
    "camera": ("camera", "iso", "f_number", "focal_length", "rating"),
}
#: Questions about each key, by group; SQL for each is written from what the key means.
ASKED = {
    "recipe": (
        ("generation.sampler:eq:euler", "g.sampler = 'euler'"), ("generation.tool:any:B", "g.tool = 'B'"), ("generation.scheduler:eq:karras", "g.scheduler = 'karras'"), ("generation.seed:eq:7", "g.seed = 7"),
        ("generation.steps:gte:30", "g.steps >= 30"), ("generation.cfg:lte:2.5", "g.cfg <= 2.5"), ("generation.denoise:eq:0.5", "g.denoise = 0.5"), ("generation.clip_skip:gte:1", "g.clip_skip >= 1"), ("generation.workflow:eq:3", "g.workflow_id = 3"),
    ),
    "resources": (
        ("generation.checkpoint:eq:5", "a.role = 'checkpoint' AND a.artifact_id = 5"), ("generation.lora:eq:6", "a.role = 'lora' AND a.artifact_id = 6"),
        ("capture.camera:any:7", "a.role = 'captured_with' AND a.artifact_id = 7"), ("capture.lens:eq:8", "a.role = 'mounted_lens' AND a.artifact_id = 8"),
    ),
    "camera": (("capture.iso:lte:300", "c.iso <= 300"), ("capture.f_number:eq:1.5", "c.f_number = 1.5"), ("capture.focal_length:gte:50", "c.focal_length >= 50"), ("capture.exposure_time:lte:0.2", "c.exposure_time <= 0.2")),
    "context": (
        ("context.origin:eq:mixed", "x.origin = 'mixed'"), ("context.local_day:eq:2024-01-05", "x.local_day = '2024-01-05'"), ("context.local_day:gte:2024-01-20", "x.local_day >= '2024-01-20'"), ("context.moment:gte:1705000000", "x.moment >= 1705000000"),
        ("context.moment:lt:1705000000", "x.moment < 1705000000"), ("context.disputed:eq:1", "x.disputed = 1"), ("context.disputed:eq:0", "x.disputed = 0"), ("context.granule:lte:86400", "x.granule <= 86400"), ("place.id:any:3", "x.place_id = 3"),
    ),
    "people": (("people.person:eq:4", "p.person_id = 4"),),
    "tags": (("tag:eq:NO", "t.tag = 'no'"), ("tag:any:rf", "t.tag = 'rf'")),
    "sessions": (("event.id:eq:4", "s.session_id = 4"),),
    "params": (("param.has:eq:rank", "q.key = 'rank'"), ("param.is:eq:k=7", "q.key = 'k' AND q.value_text = '7'"), ("param.num:gte:rank=90", "q.key = 'rank' AND q.value_num >= 90")),
    "media": (("media.kind:eq:video", "i.kind = 'video'"), ("media.width:gte:400", "i.width >= 400"), ("media.height:lte:320", "i.height <= 320"), ("media.duration:gte:100", "i.duration >= 100"), ("media.duration:lte:10", "i.duration <= 10")),
}
RELATED = {"recipe": "generation g", "resources": "item_artifact a", "camera": "capture c", "context": "context x", "people": "item_person p", "tags": "item_tag t", "sessions": "item_session s", "params": "param q", "media": None}


def ask(held: library.Library, *facets: str) -> DataFrame:
    return eligible(held["item"], "id", parse(REGISTRY, (), list(facets)), REGISTRY, held)


def counted(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """question, n, id_sum: how many items answer each question, and which, as a sum."""
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum")).select(F.lit(name).alias("question"), "n", "id_sum") for name, df in rows]
    return reduce(DataFrame.unionAll, parts)


def counted_sql(rows: list[tuple[str, str]]) -> str:
    return library.WITH + " " + " UNION ALL ".join(f"SELECT '{name}' AS question, count(*) AS n, CAST(coalesce(sum(i.id), 0) AS BIGINT) AS id_sum FROM item i WHERE {where}" for name, where in rows)


def meaning(group: str, where: str) -> str:
    table = RELATED[group]
    return where if table is None else f"EXISTS (SELECT 1 FROM {table} WHERE {table.split()[1]}.item_id = i.id AND {where})"


def _facets(group: str) -> None:
    questions = [(facet(REGISTRY, spelling).spelling, spelling, meaning(group, where)) for spelling, where in ASKED[group]]

    @query(f"facet_{group}", counted_sql([(name, where) for name, _, where in questions]))
    def run(spark, sf_dir):
        held = library.tables(spark, sf_dir)
        return counted([(name, ask(held, spelling)) for name, spelling, _ in questions])


for _group in ASKED:
    _facets(_group)

HAS = {"has.generation": "EXISTS (SELECT 1 FROM generation y WHERE y.item_id = i.id)", "has.capture": "EXISTS (SELECT 1 FROM capture y WHERE y.item_id = i.id)", "has.people": "EXISTS (SELECT 1 FROM item_person y WHERE y.item_id = i.id)", "has.place": "EXISTS (SELECT 1 FROM context y WHERE y.item_id = i.id AND y.place_id IS NOT NULL)"}


@query("facet_has", counted_sql([(f"{k}:eq:{v}", ("" if v else "NOT ") + where) for k, where in HAS.items() for v in (1, 0)]))
def facet_has(spark, sf_dir):
    held = library.tables(spark, sf_dir)
    return counted([(f"{k}:eq:{v}", ask(held, f"{k}:eq:{v}")) for k in HAS for v in (1, 0)])


LORAS = "EXISTS (SELECT 1 FROM item_artifact a WHERE a.item_id = i.id AND a.role = 'lora' AND a.artifact_id {})"


@query("facet_combined", counted_sql([
    ("two loras", LORAS.format("= 6") + " AND " + LORAS.format("= 9")),
    ("any of two loras", LORAS.format("IN (6, 9)")),
    ("video or audio, fine, with a place", "i.kind IN ('video', 'audio') AND EXISTS (SELECT 1 FROM context x WHERE x.item_id = i.id AND x.granule <= 3600) AND EXISTS (SELECT 1 FROM context x WHERE x.item_id = i.id AND x.place_id IS NOT NULL)"),
]))
def facet_combined(spark, sf_dir):
    held = library.tables(spark, sf_dir)
    return counted([
        ("two loras", ask(held, "generation.lora:eq:6", "generation.lora:eq:9")),
        ("any of two loras", ask(held, "generation.lora:any:6", "generation.lora:any:9")),
        ("video or audio, fine, with a place", ask(held, "media.kind:any:video", "media.kind:any:audio", "context.granule:lte:3600", "has.place:eq:1")),
    ])


# -- scopes -----------------------------------------------------------------------


def scoped(held: library.Library, **scopes) -> DataFrame:
    """The items of a library inside scopes: folder, album, person (of the primary run), artifact, kind, favorite, rating_min.

    Marks are the actor's. An artifact counts in the role its kind has: a workflow in the
    recipe, others among the item's resources.
    """
    question = parse(REGISTRY, (), scopes=scopes, kinds=vocabulary.KINDS)
    items = held["item"]

    def among(rows: DataFrame, how: str = "left_semi") -> DataFrame:
        return items.join(rows.select(F.col("item_id").alias("__item")), F.col("id") == F.col("__item"), how)

    for name, value in question.scopes:
        if name in ("folder", "kind"):
            items = items.where(F.col(name) == value)
        elif name == "album":
            items = among(held["item_album"].where(F.col("album") == value))
        elif name == "person":
            items = among(held["item_person"].where(F.col("person_id") == value))
        elif name == "artifact":
            items = among(held["item_artifact"].where(F.col("artifact_id") == value))
        elif name == "workflow":
            items = among(held["generation"].where(F.col("workflow_id") == value))
        elif name == "favorite":
            items = among(held["favorite"].where(F.col("user_id") == library.ACTOR), "left_semi" if value else "left_anti")
        elif name == "rating_min":
            items = among(held["rating"].where((F.col("user_id") == library.ACTOR) & (F.col("rating") >= value)))
    return items


SCOPES = {
    "folder": ({"folder": "folder-3"}, "i.folder = 'folder-3'"),
    "album": ({"album": "album-4"}, "EXISTS (SELECT 1 FROM item_album y WHERE y.item_id = i.id AND y.album = 'album-4')"),
    "person": ({"person": 5}, "EXISTS (SELECT 1 FROM item_person y WHERE y.item_id = i.id AND y.person_id = 5)"),
    "artifact": ({"artifact": 12}, "EXISTS (SELECT 1 FROM item_artifact y WHERE y.item_id = i.id AND y.artifact_id = 12)"),
    "workflow": ({"workflow": 2}, "EXISTS (SELECT 1 FROM generation y WHERE y.item_id = i.id AND y.workflow_id = 2)"),
    "favorite": ({"favorite": 1}, "EXISTS (SELECT 1 FROM favorite y WHERE y.item_id = i.id AND y.user_id = 1)"),
    "not favorite": ({"favorite": 0}, "NOT EXISTS (SELECT 1 FROM favorite y WHERE y.item_id = i.id AND y.user_id = 1)"),
    "rating": ({"rating_min": 4}, "EXISTS (SELECT 1 FROM rating y WHERE y.item_id = i.id AND y.user_id = 1 AND y.rating >= 4)"),
    "person in album of a kind": ({"album": "album-2", "person": 7, "kind": "image"}, "i.kind = 'image' AND EXISTS (SELECT 1 FROM item_album y WHERE y.item_id = i.id AND y.album = 'album-2') AND EXISTS (SELECT 1 FROM item_person y WHERE y.item_id = i.id AND y.person_id = 7)"),
}


@query("scope_counts", counted_sql([(name, where) for name, (_, where) in SCOPES.items()]))
def scope_counts(spark, sf_dir):
    held = library.tables(spark, sf_dir)
    return counted([(name, scoped(held, **scopes)) for name, (scopes, _) in SCOPES.items()])


# -- sorts ------------------------------------------------------------------------

SORT_SQL = {
    "name": ("lower(i.name)", ""), "kind": ("i.kind", ""), "size": ("i.size", ""), "pixels": ("i.width * i.height", ""), "length": ("i.duration", ""),
    "seed": ("g.seed", "generation"), "steps": ("g.steps", "generation"), "cfg": ("g.cfg", "generation"), "sampler": ("g.sampler", "generation"),
    "checkpoint": ("lower(n.name)", "checkpoint"), "camera": ("lower(n.name)", "captured_with"), "iso": ("c.iso", "capture"), "f_number": ("c.f_number", "capture"), "focal_length": ("c.focal_length", "capture"), "rating": ("r.rating", "rating"),
}


def sort_from(table: str) -> str:
    if table in ("checkpoint", "captured_with"):
        return f"item i LEFT JOIN (SELECT * FROM item_artifact WHERE role = '{table}' AND ordinal = 0) a ON a.item_id = i.id LEFT JOIN artifact n ON n.id = a.artifact_id"
    if table == "rating":
        return "item i LEFT JOIN (SELECT * FROM rating WHERE user_id = 1) r ON r.item_id = i.id"
    return f"item i LEFT JOIN {table} {table[0]} ON {table[0]}.item_id = i.id" if table else "item i"


def sortable(held: library.Library, sort: str) -> DataFrame:
    """id and value of the column that orders an answer; items without one have null, and come last."""
    items = held["item"]
    own = {"name": F.lower("name"), "kind": F.col("kind"), "size": F.col("size"), "pixels": F.col("width") * F.col("height"), "length": F.col("duration")}
    if sort in own:
        return items.select("id", own[sort].alias("value"))
    if sort in ("checkpoint", "camera"):
        role = "captured_with" if sort == "camera" else sort
        first = held["item_artifact"].where((F.col("role") == role) & (F.col("ordinal") == 0))
        rows = first.join(held["artifact"], F.col("artifact_id") == F.col("id")).select("item_id", F.lower("name").alias("value"))
    elif sort == "rating":
        rows = held["rating"].where(F.col("user_id") == library.ACTOR).select("item_id", F.col("rating").alias("value"))
    else:
        rows = held["capture" if sort in SORTS["camera"] else "generation"].select("item_id", F.col(sort).alias("value"))
    return items.select("id").join(rows, F.col("id") == F.col("item_id"), "left").select("id", "value")


def _sorts(group: str) -> None:
    sql = []
    for name in SORTS[group]:
        expression, table = SORT_SQL[name]
        for way, label in (("ASC", name), ("DESC", f"{name}-desc")):
            sql.append(f"SELECT '{label}' AS sort, id, ordinal FROM (SELECT i.id, row_number() OVER (ORDER BY {expression} {way} NULLS LAST, i.id {way}) AS ordinal FROM {sort_from(table)}) WHERE ordinal <= 60")

    @query(f"sort_{group}", library.WITH + " " + " UNION ALL ".join(sql))
    def run(spark, sf_dir):
        parts, held = [], library.tables(spark, sf_dir)
        for name in SORTS[group]:
            rows = sortable(held, name)
            for descending in (False, True):
                order = answer.total_order("value", "id", descending)
                first = rows.orderBy(*order).limit(60).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long"))
                parts.append(first.select(F.lit(f"{name}-desc" if descending else name).alias("sort"), "id", "ordinal"))
        return reduce(DataFrame.unionAll, parts)


for _group in SORTS:
    _sorts(_group)


@query("sort_moment", library.WITH + " SELECT id, row_number() OVER (ORDER BY moment NULLS LAST, id) AS ordinal FROM item LEFT JOIN context ON item_id = id")
def sort_moment(spark, sf_dir):
    """The whole answer by the human moment; items without one last."""
    held = library.tables(spark, sf_dir)
    rows = held["item"].select("id").join(held["context"].select("item_id", "moment"), F.col("id") == F.col("item_id"), "left").select("id", "moment")
    return answer.ordered(rows, answer.total_order("moment", "id", False)).select("id", "ordinal")


# -- depth ------------------------------------------------------------------------


@query("depth_counts", f"""
WITH {BM25_SQL}, l AS (SELECT median(score) AS middle, max(score) AS best FROM b) SELECT 'all' AS depth, count(*) AS n, CAST(coalesce(sum(doc_id), 0) AS BIGINT) AS id_sum FROM b
UNION ALL SELECT 'head', count(*), CAST(coalesce(sum(doc_id), 0) AS BIGINT) FROM b, l WHERE best > middle AND score >= middle + 0.5 * (best - middle)
""")
def depth_counts(spark, sf_dir):
    """depth, n, id_sum of a phrase: the whole ranking, and its head."""
    ranking = bm25(load(spark, sf_dir, "documents"), "doc_id", "text", WORDS).withColumn("space", F.lit(1))
    judged = head(ranking, "space")
    parts = [(name, rows.select(F.col("doc_id").alias("id"))) for name, rows in (("all", judged), ("head", judged.where("answers")))]
    return counted(parts).withColumnRenamed("question", "depth")


# -- values -----------------------------------------------------------------------


def values_sql(d: vocabulary.Dimension) -> str:
    table, column, named, where = (*d.counted, None, None, None)[:4]
    if table is None:
        return f"SELECT '{d.key}' AS dimension, {column} AS value, {column} AS label, count(*) AS n FROM item GROUP BY {column}"
    allowed = f" AND {where}" if where else ""
    if column == "yes":
        fact = f"EXISTS (SELECT 1 FROM {table} y WHERE y.item_id = i.id{allowed})"
        return f"SELECT '{d.key}', '1', 'yes', count(*) FILTER ({fact}) FROM item i UNION ALL SELECT '{d.key}', '0', 'no', count(*) FILTER (NOT {fact}) FROM item i"
    label = "max(z.name)" if named in library.TABLES else f"CAST(max(y.{named or column}) AS VARCHAR)"
    names = f" JOIN {named} z ON z.id = y.{column}" if named in library.TABLES else ""
    return f"SELECT '{d.key}', CAST(y.{column} AS VARCHAR), {label}, count(DISTINCT i.id) FROM item i JOIN {table} y ON y.item_id = i.id{names} WHERE true{allowed} GROUP BY y.{column}"


def _values(group: str) -> None:
    listed = [d for d in vocabulary.DIMENSIONS.values() if d.group == group and d.counted]

    @query(f"discover_{group}", library.WITH + " SELECT dimension, value, label, n FROM (" + " UNION ALL ".join(["SELECT '' AS dimension, '' AS value, '' AS label, 0 AS n WHERE false", *[values_sql(d) for d in listed]]) + ")")
    def run(spark, sf_dir):
        held = library.tables(spark, sf_dir)
        parts = [vocabulary.discovered(d, held["item"], "id", held).select(F.lit(d.key).alias("dimension"), F.col("value").cast("string").alias("value"), F.col("label").cast("string").alias("label"), F.col("n").cast("long").alias("n")) for d in listed]
        return reduce(DataFrame.unionAll, parts)


for _group in vocabulary.GROUPS:
    _values(_group)


@query("discover_within", library.WITH + " SELECT y.tag AS value, max(y.label) AS label, count(DISTINCT i.id) AS n FROM item i JOIN item_tag y ON y.item_id = i.id WHERE i.kind = 'image' AND EXISTS (SELECT 1 FROM generation g WHERE g.item_id = i.id AND g.steps >= 20) GROUP BY y.tag")
def discover_within(spark, sf_dir):
    """Values of one dimension inside an answer, its own clauses left out."""
    held = library.tables(spark, sf_dir)
    question = parse(REGISTRY, (), ["media.kind:eq:image", "generation.steps:gte:20", "tag:eq:no"]).without("tag")
    items = eligible(held["item"], "id", question, REGISTRY, held)
    return vocabulary.discovered(vocabulary.DIMENSIONS["tag"], items, "id", held)


@query("vocabulary_chips")
def vocabulary_chips(spark, sf_dir):
    """heading, key, label, note, chip of every dimension that is offered, for each kind it applies to."""
    rows = [(kind, heading, d.key, d.label, d.note, vocabulary.chip(d.key, d.ops[0], 1)) for kind in vocabulary.KINDS for heading, held in vocabulary.grouped(kind) for d in held]
    return spark.createDataFrame(rows, "kind string, heading string, key string, label string, note string, chip string")
