"""A library of media items in the shape the typed questions are asked of, made of the test tables.

Each table is one projection of a stored table. Expressions are written once, in SQL that both
engines read; where they differ, the pair is (Spark, ANSI).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .tables import load

#: What the interpretation of the evidence is valid for, and its policy.
GENERATION, POLICY = 2, 2
#: Whose marks a question means, unless it says.
ACTOR = 1
SPANS = {"decade": 315569520.0, "year": 31556952.0, "month": 2629746.0, "day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0, "subsecond": 0.001}
_PRECISION = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(SPANS)) + " END"
_GRANULE = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN CAST({width!r} AS DOUBLE)" for k, width in enumerate(SPANS.values())) + " END"


@dataclass(frozen=True)
class Derived:
    base: str
    columns: dict[str, str | tuple[str, str]] = field(default_factory=dict)
    where: str = "true"
    distinct: bool = False

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = [f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in self.columns.items()]
        rows = load(spark, sf_dir, self.base).where(self.where).selectExpr(*chosen)
        return rows.distinct() if self.distinct else rows

    @property
    def sql(self) -> str:
        chosen = [f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in self.columns.items()]
        return f"SELECT {'DISTINCT ' * self.distinct}{', '.join(chosen)} FROM {self.base} WHERE {self.where}"


TABLES = {
    "item": Derived("events", {
        "id": "event_id", "name": "concat('Img ', CAST(event_id % 1000 AS STRING))", "folder": "concat('folder-', CAST(user_id % 12 AS STRING))",
        "kind": "CASE event_id % 6 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' WHEN 3 THEN 'animated_image' ELSE 'image' END",
        "size": "user_id * 100 + event_id % 97", "width": "CASE WHEN event_id % 6 NOT IN (1, 2) THEN 256 + event_id % 5 * 64 END",
        "height": "CASE WHEN event_id % 6 NOT IN (1, 2) THEN 256 + event_id % 7 * 64 END", "duration": "CASE WHEN event_id % 6 IN (0, 1, 3) THEN CAST(event_id % 600 AS DOUBLE) / 4 END", "ts": "ts",
    }),
    "generation": Derived("events", {
        "item_id": "event_id", "tool": "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END", "sampler": "CASE event_id % 4 WHEN 0 THEN 'euler' WHEN 1 THEN 'dpm' WHEN 2 THEN 'ddim' END",
        "scheduler": "CASE WHEN event_id % 5 < 3 THEN 'karras' ELSE 'simple' END", "seed": "event_id % 50", "steps": "10 + event_id % 30", "cfg": "CAST(event_id % 20 AS DOUBLE) / 2",
        "denoise": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 4 AS DOUBLE) / 4 END", "clip_skip": "event_id % 3", "workflow_id": "user_id % 9 + 1",
    }, "event_id % 3 <> 0"),
    "capture": Derived("events", {
        "item_id": "event_id", "iso": "100 * (1 + event_id % 6)", "f_number": "CAST(event_id % 9 AS DOUBLE) / 4 + 1", "focal_length": "CAST(20 + event_id % 50 AS DOUBLE)", "exposure_time": "CAST(1 AS DOUBLE) / (1 + event_id % 8)",
    }, "event_id % 4 = 0"),
    "artifact": Derived("part", {"id": "p_partkey", "name": "p_name"}),
    "item_artifact": Derived("lineitem", {
        "item_id": "l_orderkey", "role": "CASE l_linenumber WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'lora' WHEN 3 THEN 'lora' WHEN 4 THEN 'captured_with' ELSE 'mounted_lens' END",
        "ordinal": "CASE WHEN l_linenumber IN (1, 2, 4, 5) THEN 0 ELSE l_linenumber END", "artifact_id": "l_partkey % 40 + 1",
    }),
    "param": Derived("events", {"item_id": "event_id", "key": "CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'rank' END", "value_text": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), "value_num": ("CAST(get_json_object(props, '$.k') AS DOUBLE)", "CAST(json_extract_string(props, '$.k') AS DOUBLE)")}),
    "context": Derived("events", {
        "item_id": "event_id", "origin": "CASE event_id % 4 WHEN 0 THEN 'captured' WHEN 1 THEN 'generated' WHEN 2 THEN 'mixed' ELSE 'imported' END", "time_precision": _PRECISION, "granule": _GRANULE,
        "local_day": ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"), "moment": ("CAST(CAST(ts AS TIMESTAMP) AS DOUBLE)", "epoch(ts)"),
        "disputed": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END", "place_id": "CASE WHEN event_id % 3 = 0 THEN user_id % 25 END",
    }, "event_id % 11 <> 0"),
    "place": Derived("nation", {"id": "n_nationkey", "name": "n_name"}),
    "item_session": Derived("events", {"item_id": "event_id", "session_id": "user_id"}, f"user_id % 3 < {GENERATION}"),
    "session": Derived("events", {"id": "user_id", "generation": f"CASE WHEN user_id % 3 < {GENERATION} THEN {GENERATION} ELSE 1 END"}, distinct=True),
    "item_tag": Derived("lineitem", {"item_id": "l_orderkey", "tag": "lower(concat(l_returnflag, l_linestatus))", "label": "concat(l_returnflag, l_linestatus)"}, distinct=True),
    "person": Derived("customer", {"id": "c_custkey", "name": "c_name"}),
    "item_person": Derived("orders", {"item_id": "o_orderkey", "person_id": "o_custkey % 30 + 1"}, "o_orderkey % 4 <> 0"),
    "rating": Derived("labels", {"item_id": "doc_id", "user_id": "1 + doc_id % 2", "rating": "1 + doc_id % 5"}),
    "favorite": Derived("labels", {"item_id": "doc_id", "user_id": "1 + doc_id % 2"}, "toxic = 0"),
    "item_album": Derived("events", {"item_id": "event_id", "album": "concat('album-', CAST(user_id % 10 AS STRING))"}, "user_id % 2 = 0 AND user_id % 10 <> 8"),
}


class Library(Mapping):
    """The tables by name; one is read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._held = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:
            self._held[name] = TABLES[name].read(self._spark, self._dir)
        return self._held[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def tables(spark: SparkSession, sf_dir: str) -> Library:
    return Library(spark, sf_dir)


#: The same tables, as the beginning of a query.
WITH = "WITH " + ", ".join(f"{name} AS ({t.sql})" for name, t in TABLES.items())
