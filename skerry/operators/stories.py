"""Stories: evidence gathered per session, plans over frozen evidence, their rendering, and what it may not say.

A plan is one row a subject: members in order, phases, claims, and what is unsupported. A claim
has a kind, the members it rests on, and a number; a renderer only says what claims say, so a
rendered text can be held against its plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, doubles, unit

VERSION = 1
#: Name -> function of the members (subject, member, at, ...) that returns subject and a column of evidence of that name.
COLLECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "span": lambda m: m.groupBy("subject").agg(F.struct(F.min("at").alias("first"), F.max("at").alias("last")).alias("span")),
    "kinds": lambda m: m.groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds")),
    "values": lambda m: m.groupBy("subject").agg(F.struct(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most")).alias("values")),
    "size": lambda m: m.groupBy("subject").agg(F.count(F.lit(1)).alias("size")),
}


def collected(members: DataFrame, names: tuple[str, ...] = tuple(COLLECTORS)) -> DataFrame:
    """subject and a column of each collector's evidence."""
    out = members.select("subject").distinct()
    for name in names:
        out = out.join(COLLECTORS[name](members), "subject", "left")
    return out


def phased(members: DataFrame, gap: float) -> DataFrame:
    """members with `phase`: a new one after a pause of more than `gap` seconds."""
    w = Window.partitionBy("subject").orderBy("at", "member")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) > gap).cast("int"), F.lit(0))
    return members.withColumn("__new", new).withColumn("phase", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def planned(members: DataFrame, planner: str, gap: float = 1800.0) -> DataFrame:
    """subject, planner, version, members, phases, claims, unsupported: one plan a subject.

    Every member is in exactly one phase. Claims: how many members, how many phases, the longest
    pause, the commonest kind. A pause or kind that the evidence doesn't have is unsupported.
    """
    if planner not in PLANNERS:
        raise ValueError(f"no planner {planner!r}; one of {', '.join(PLANNERS)}")
    rows = PLANNERS[planner](members, gap)
    w = Window.partitionBy("subject").orderBy("at", "member")
    rows = rows.withColumn("pause", F.col("at") - F.lag("at").over(w))
    phases = rows.groupBy("subject", "phase").agg(F.array_sort(F.collect_list(F.struct("at", "member"))).alias("m"))
    phases = phases.select("subject", F.struct("phase", F.transform("m", lambda x: x["member"]).alias("members")).alias("p")).groupBy("subject").agg(F.array_sort(F.collect_list("p")).alias("phases"))
    kinds = rows.where("kind is not null").groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("one")).groupBy("subject").agg(F.max_by(F.struct("kind", "n", "one"), F.struct("n", F.col("kind"))).alias("k"))
    whole = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.coalesce("pause", F.lit(-1.0)).alias("pause"), F.col("member"))).alias("longest"), F.array_sort(F.collect_list(F.struct("at", "member"))).alias("m"))
    joined = whole.join(phases, "subject").join(kinds, "subject", "left")
    members_ = F.transform("m", lambda x: x["member"])
    claim = lambda kind, refs, number, word: F.struct(F.lit(kind).alias("kind"), refs.alias("refs"), number.cast("double").alias("number"), word.alias("word"))
    none = F.lit(None).cast("string")
    claims = F.array(
        claim("size", members_, F.col("size"), none), claim("phases", F.transform("phases", lambda p: p["members"][0]), F.size("phases"), none),
        F.when(F.col("longest.pause") > 0, claim("pause", F.array("longest.member"), F.col("longest.pause"), none)),
        F.when(F.col("k").isNotNull(), claim("kind", F.array("k.one"), F.col("k.n"), F.col("k.kind"))),
    )
    unsupported = F.array(F.when(F.col("longest.pause") <= 0, F.lit("pause")), F.when(F.col("k").isNull(), F.lit("kind")))
    return joined.select("subject", F.lit(planner).alias("planner"), F.lit(VERSION).alias("version"), members_.alias("members"), "phases", F.array_compact(claims).alias("claims"), F.array_compact(unsupported).alias("unsupported"))


#: Name -> function of (members, gap) that returns them with `phase`.
PLANNERS: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    "capture": phased,
    "generation": lambda members, gap: members.withColumn("phase", (F.dense_rank().over(Window.partitionBy("subject").orderBy(F.col("kind").asc_nulls_last())) - 1).cast("int")),
    "file": lambda members, gap: members.withColumn("phase", F.lit(0)),
}


def faults(plans: DataFrame) -> DataFrame:
    """subject, fault of plans that break the grammar: members left out or twice in phases, claims that rest on nothing or on others' members."""
    inside = F.flatten(F.transform("phases", lambda p: p["members"]))
    checks = F.array(
        F.when(F.array_sort(inside) != F.array_sort("members"), F.lit("phases don't part the members")),
        F.when(F.exists("claims", lambda c: F.size(c["refs"]) == 0), F.lit("a claim rests on nothing")),
        F.when(F.exists("claims", lambda c: F.size(F.array_except(c["refs"], F.col("members"))) > 0), F.lit("a claim rests on what isn't a member")),
        F.when(F.col("version") != VERSION, F.lit("a version that isn't known")),
    )
    return plans.select("subject", F.explode(F.array_compact(checks)).alias("fault"))


def _said(c: Column) -> Column:
    n = F.format_string("%d", c["number"].cast("long"))
    return (
        F.when(c["kind"] == "size", F.concat(n, F.lit(" items"))).when(c["kind"] == "phases", F.concat(F.lit("in "), n, F.lit(" phases")))
        .when(c["kind"] == "pause", F.concat(F.lit("a pause of "), n, F.lit(" seconds"))).when(c["kind"] == "kind", F.concat(F.lit("mostly "), c["word"], F.lit(" ("), n, F.lit(")")))
    )


#: Style -> text of a plan's claims. Only claims are said, in their order.
RENDERERS: dict[str, Callable[[Column], Column]] = {
    "memory": lambda claims: F.concat(F.array_join(F.transform(claims, _said), ", "), F.lit(".")),
    "technical": lambda claims: F.array_join(F.transform(claims, lambda c: F.concat(c["kind"], F.lit("="), F.format_string("%d", c["number"].cast("long")))), "; "),
    "compact": lambda claims: F.coalesce(_said(F.get(claims, F.lit(0))), F.lit("")),
}


def rendered(plans: DataFrame, style: str) -> DataFrame:
    """subject, style, text, sha256 of each plan; the hash names plan, style and version, so that equal requests are one."""
    if style not in RENDERERS:
        raise ValueError(f"no style {style!r}; one of {', '.join(RENDERERS)}")
    key = F.sha2(F.concat_ws("|", F.lit(style), F.lit(str(VERSION)), F.to_json(F.struct("subject", "claims"))).cast("binary"), 256)
    return plans.select("subject", F.lit(style).alias("style"), RENDERERS[style](F.col("claims")).alias("text"), key.alias("sha256"))


def violations(texts: DataFrame, plans: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """subject, violation of rendered texts: numbers that no claim has, words that aren't allowed."""
    joined = texts.join(plans.select("subject", "claims"), "subject")
    numbers = F.regexp_extract_all("text", F.lit(r"\d+"), 0)
    known = F.transform("claims", lambda c: F.format_string("%d", c["number"].cast("long")))
    strange = F.transform(F.array_except(numbers, known), lambda n: F.concat(F.lit("number "), n))
    words = F.array_compact(F.array(*[F.when(F.lower("text").contains(w.lower()), F.lit(f"word {w}")) for w in forbidden])) if forbidden else F.array().cast("array<string>")
    return joined.select("subject", F.explode(F.concat(strange, words)).alias("violation"))


def evolution(members: DataFrame, vector: str) -> DataFrame:
    """subject, member, to_previous, to_first, transition: how each member stands to the one before and to the first, by cosine.

    transition: `start`, `same` (the vector is the one before), `near` (0.9 or more) or `turn`.
    """
    w = Window.partitionBy("subject").orderBy("at", "member")
    rows = members.select("subject", "member", "at", unit(doubles(F.col(vector))).alias("v"))
    seen = rows.select("subject", "member", "v", F.lag("v").over(w).alias("before"), F.first("v").over(w).alias("head"))
    back, first = dot(F.col("v"), F.col("before")), dot(F.col("v"), F.col("head"))
    step = F.when(F.col("before").isNull(), "start").when(back >= 1 - 1e-9, "same").when(back >= 0.9, "near").otherwise("turn")
    return seen.select("subject", "member", F.round(back, 6).alias("to_previous"), F.round(first, 6).alias("to_first"), step.alias("transition"))
