"""The vocabulary of questions: every filterable fact with its label, group and values, and how a clause reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .question import Key

#: Kinds of items, those with a picture, those with a length, where an item's evidence comes from.
KINDS = ("image", "animated_image", "video", "audio", "document")
VISUAL, LASTING = ("image", "animated_image", "video"), ("animated_image", "video", "audio")
ORIGINS = ("captured", "generated", "mixed", "imported")
#: The groups, in order, and their headings.
GROUPS = {"mine": "my stuff", "media": "media", "people": "people", "places": "places", "time": "time", "generation": "generation", "camera": "camera", "advanced": "advanced metadata"}
ONE, SEVERAL, RANGE = ("eq",), ("eq", "any"), ("eq", "gte", "lte")


def keys() -> dict[str, Key]:
    """The facet registry over the tables of a library."""
    recipe = {"sampler": ("text", SEVERAL), "tool": ("text", SEVERAL), "scheduler": ("text", SEVERAL), "seed": ("int", ONE), "steps": ("int", RANGE), "cfg": ("num", RANGE), "denoise": ("num", RANGE), "clip_skip": ("int", RANGE)}
    roles = {"generation.checkpoint": "checkpoint", "generation.lora": "lora", "capture.camera": "captured_with", "capture.lens": "mounted_lens"}
    out = [Key(f"generation.{c}", kind, ops, column=c, rows="generation", on="item_id") for c, (kind, ops) in recipe.items()]
    out += [Key(name, "int", SEVERAL, column="artifact_id", rows="item_artifact", on="item_id", where=f"role = '{role}'") for name, role in roles.items()]
    out += [Key(f"capture.{c}", "int" if c == "iso" else "num", RANGE, column=c, rows="capture", on="item_id") for c in ("iso", "f_number", "focal_length", "exposure_time")]
    out += [Key(f"has.{t}", "int", ONE, rows=t, on="item_id", presence=True) for t in ("generation", "capture")]
    out += [
        Key("generation.workflow", "int", SEVERAL, column="workflow_id", rows="generation", on="item_id"),
        Key("has.people", "int", ONE, rows="item_person", on="item_id", presence=True),
        Key("has.place", "int", ONE, rows="context", on="item_id", presence=True, where="place_id is not null"),
        Key("tag", "text", SEVERAL, column="tag", rows="item_tag", on="item_id", fold=True),
        Key("people.person", "int", SEVERAL, column="person_id", rows="item_person", on="item_id"),
        Key("place.id", "int", SEVERAL, column="place_id", rows="context", on="item_id"),
        Key("event.id", "int", ONE, column="session_id", rows="item_session", on="item_id"),
        Key("context.origin", "text", SEVERAL, column="origin", rows="context", on="item_id", choices=ORIGINS),
        Key("context.local_day", "date", RANGE, column="local_day", rows="context", on="item_id"),
        Key("context.moment", "int", ("gte", "lt", "lte"), column="moment", rows="context", on="item_id"),
        Key("context.disputed", "int", ONE, column="disputed", rows="context", on="item_id"),
        Key("context.granule", "int", ("lte",), column="granule", rows="context", on="item_id"),
        Key("param.has", "text", SEVERAL, column="key", rows="param", on="item_id"),
        Key("param.is", "pair", SEVERAL, rows="param", on="item_id", pair=("key", "value_text")),
        Key("param.num", "numpair", RANGE, rows="param", on="item_id", pair=("key", "value_num")),
        Key("media.kind", "text", SEVERAL, column="kind", choices=KINDS),
        Key("media.width", "int", RANGE, column="width"),
        Key("media.height", "int", RANGE, column="height"),
        Key("media.duration", "num", ("gte", "lte"), column="duration"),
    ]
    return {k.name: k for k in out}


@dataclass(frozen=True)
class Dimension:
    """One filterable fact: carried as a scope (one value) or a facet; multi: how several values read ('', any, both)."""

    key: str
    label: str
    group: str
    carried: str = "facet"
    values: str = "text"
    ops: tuple[str, ...] = ONE
    kinds: tuple[str, ...] = ()
    note: str = ""
    multi: str = ""
    offered: bool = True
    #: Where the values are counted: table, value column, table and column of the label (by id), filter; 'yes' for two values.
    counted: tuple | None = None


def _dimensions() -> tuple[Dimension, ...]:
    def recipe(column: str, label: str, values: str, listed: bool, **more) -> Dimension:
        counted = ("generation", column, None, f"{column} is not null") if listed else None
        return Dimension(f"generation.{column}", label, "generation", values=values, ops=("any", "eq") if listed else more.pop("ops", RANGE), multi="any" if listed else "", counted=counted, **more)

    def role(key: str, label: str, group: str, name: str, note: str = "") -> Dimension:
        return Dimension(key, label, group, values="id", ops=("any", "eq"), note=note, multi="both", counted=("item_artifact", "artifact_id", "artifact", f"role = '{name}'"))

    return (
        Dimension("favorite", "favorite", "mine", "scope", "bool", note="your own mark, never anyone else's"),
        Dimension("rating_min", "rating", "mine", "scope", "int", ("gte",), note="at least this many stars"),
        Dimension("tag", "keyword", "mine", ops=SEVERAL, note="a word you wrote on a picture", multi="both", counted=("item_tag", "tag", "label", None)),
        Dimension("album", "album", "mine", "scope", "slug", counted=("item_album", "album", None, None)),
        Dimension("folder", "folder", "mine", "scope", "slug", counted=(None, "folder", None, None)),
        Dimension("kind", "kind", "media", "scope", offered=False),
        Dimension("media.kind", "kind", "media", ops=("any", "eq"), multi="any", counted=(None, "kind", None, None)),
        Dimension("media.width", "width", "media", values="int", ops=RANGE, kinds=VISUAL, note="the pixels on disk, not what a recipe asked for"),
        Dimension("media.height", "height", "media", values="int", ops=RANGE, kinds=VISUAL),
        Dimension("media.duration", "length", "media", values="num", ops=("gte", "lte"), kinds=LASTING, note="seconds"),
        Dimension("person", "person", "people", "scope", "slug", offered=False),
        Dimension("people.person", "person", "people", values="id", ops=("any", "eq"), note="any of them, or all of them in one picture", multi="both", counted=("item_person", "person_id", "person", None)),
        Dimension("has.people", "anybody in it", "people", values="bool", counted=("item_person", "yes")),
        Dimension("place.id", "place", "places", values="id", ops=("any", "eq"), multi="both", counted=("context", "place_id", "place", "place_id is not null")),
        Dimension("has.place", "anywhere said", "places", values="bool", counted=("context", "yes", None, "place_id is not null")),
        Dimension("context.local_day", "day", "time", values="date", ops=RANGE, note="the local calendar day, the way the timeline counts one"),
        Dimension("context.origin", "origin", "time", ops=("any", "eq"), note="what the evidence adds up to; `mixed` carries both kinds", multi="any", counted=("context", "origin", None, None)),
        Dimension("context.disputed", "date disputed", "time", values="bool", counted=("context", "yes", None, "disputed = 1")),
        Dimension("context.moment", "moment", "time", values="int", ops=("gte", "lt", "lte"), offered=False),
        Dimension("context.granule", "claimed within", "time", values="int", ops=("lte",), offered=False),
        Dimension("event.id", "session", "time", values="id", offered=False),
        Dimension("artifact", "resource", "generation", "scope", "slug", offered=False),
        Dimension("has.generation", "AI generated", "generation", values="bool", note="has a recorded recipe -- which `mixed` files do too", counted=("generation", "yes")),
        role("generation.checkpoint", "checkpoint", "generation", "checkpoint"),
        role("generation.lora", "LoRA", "generation", "lora", "choosing two means both were applied"),
        Dimension("generation.workflow", "workflow", "generation", values="id", ops=("any", "eq"), multi="both", counted=("generation", "workflow_id", "artifact", None)),
        recipe("tool", "tool", "text", True),
        recipe("sampler", "sampler", "text", True),
        recipe("scheduler", "scheduler", "text", True),
        recipe("steps", "steps", "int", False),
        recipe("cfg", "CFG", "num", False),
        recipe("denoise", "denoise", "num", False),
        recipe("clip_skip", "clip skip", "int", False),
        recipe("seed", "seed", "int", False, ops=ONE),
        Dimension("has.capture", "from a camera", "camera", values="bool", counted=("capture", "yes")),
        role("capture.camera", "camera", "camera", "captured_with"),
        role("capture.lens", "lens", "camera", "mounted_lens"),
        Dimension("capture.iso", "ISO", "camera", values="int", ops=RANGE, counted=("capture", "iso", None, "iso is not null")),
        Dimension("capture.f_number", "aperture", "camera", values="num", ops=RANGE),
        Dimension("capture.focal_length", "focal length", "camera", values="num", ops=RANGE, note="mm"),
        Dimension("capture.exposure_time", "exposure", "camera", values="num", ops=RANGE, note="seconds"),
        Dimension("param.has", "carries the field", "advanced", ops=("any", "eq"), note="every metadata key any tool wrote, as the registry recorded it", multi="any", counted=("param", "key", None, None)),
        Dimension("param.is", "field is", "advanced", values="pair", ops=SEVERAL, note="written key=value, for a field this application has no name of its own for", multi="any"),
        Dimension("param.num", "field above or below", "advanced", values="numpair", ops=RANGE, note="written key=number, for a field whose values parsed as numbers", multi="any"),
    )


DIMENSIONS = {d.key: d for d in _dimensions()}


def applies(dimension: Dimension, kind: str | None) -> bool:
    """Whether items of a kind can have this fact; with no kind chosen, all facts apply."""
    return kind is None or not dimension.kinds or kind in dimension.kinds


def grouped(kind: str | None = None) -> list[tuple[str, list[Dimension]]]:
    """Heading and offered dimensions of each group that has any for this kind."""
    out = [(heading, [d for d in DIMENSIONS.values() if d.offered and d.group == group and applies(d, kind)]) for group, heading in GROUPS.items()]
    return [(heading, held) for heading, held in out if held]


def discovered(dimension: Dimension, items: DataFrame, id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """value, label, n of the dimension over an answer's items; n counts items, not rows.

    Values are counted by id and named afterwards, by a join with one row a value.
    """
    table, column, named, where = (*dimension.counted, None, None, None)[:4]
    if table is None:
        return items.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select("value", F.col("value").alias("label"), "n")
    rows = tables[table] if where is None else tables[table].where(where)
    if column == "yes":
        have = items.join(rows.select(F.col("item_id").alias("__item")), F.col(id) == F.col("__item"), "left_semi").agg(F.count(F.lit(1)).alias("yes"))
        both = items.agg(F.count(F.lit(1)).alias("all")).crossJoin(have)  # two rows of one
        pair = F.array(F.struct(F.lit("1").alias("value"), F.lit("yes").alias("label"), F.col("yes").alias("n")), F.struct(F.lit("0").alias("value"), F.lit("no").alias("label"), (F.col("all") - F.col("yes")).alias("n")))
        return both.select(F.explode(pair).alias("v")).select("v.*")
    label = F.col(named) if named is not None and named not in tables else F.col(column)
    held = rows.select(F.col("item_id").alias("__item"), F.col(column).alias("value"), label.alias("label")).distinct()
    counts = held.join(items.select(id), F.col("__item") == F.col(id), "left_semi").groupBy("value").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    if named in tables:
        names = tables[named].select(F.col("id").alias("__id"), F.col("name").alias("__name"))
        counts = counts.join(names, F.col("value") == F.col("__id")).select("value", F.col("__name").alias("label"), "n")
    return counts.select(F.col("value").cast("string").alias("value"), F.col("label").cast("string").alias("label"), "n")


#: How an operator reads.
WORDS = {"eq": "", "any": "any ", "gte": "from ", "lte": "to ", "lt": "under "}


def _spelled(dimension: Dimension, value: object, names: dict) -> str:
    if dimension.values == "bool":
        return "no" if str(value) in ("0", "False") else "yes"
    return str(names.get(value) or f"#{value} (gone)") if dimension.values == "id" else str(value)


def chip(key: str, op: str, *values: object, names: dict | None = None) -> str:
    """A clause as a person reads it; several values are one chip: `any` as "a or b", else "all of a, b"."""
    dimension = DIMENSIONS[key]
    told = [_spelled(dimension, v, names or {}) for v in values]
    if len(told) == 1:
        return f"{dimension.label} {'' if op == 'any' else WORDS[op]}{told[0]}".strip()
    return f"{dimension.label} {', '.join(told[:-1])} or {told[-1]}" if op == "any" else f"{dimension.label} all of {', '.join(told)}"
