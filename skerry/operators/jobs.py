"""Jobs: a leased queue, its currency, schedules, and the order in which a library catches up.

A queue is a table of one row a job: id, kind, state (queued, running, done, failed, cancelled),
after_id (a job that must be done first), fence, leased_until, cancel, paused, collection. Steps
return the whole next table; a lease is taken only under its fence, so a worker that lost its
lease can't settle the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lease in seconds; what a library does to catch up, in order.
LEASE = 60.0
CATCH_UP = ("walk", "ingest", "context", "events", "embed", "faces", "cluster", "captions")
SETTLED = ("done", "failed", "cancelled")


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that may be taken: queued, or running on a lease that ran out; not paused, not cancelled, their predecessor done."""
    done = jobs.where("state = 'done'").select(F.col("id").alias("__done"))
    free = (F.col("state") == "queued") | ((F.col("state") == "running") & (F.col("leased_until") < now))
    open_ = jobs.where(free & ~F.col("paused") & ~F.col("cancel"))
    return open_.join(done, F.col("after_id") == F.col("__done"), "left").where("after_id is null or __done is not null").drop("__done")


def claimed(jobs: DataFrame, now: Column, most: int, lease: float = LEASE) -> DataFrame:
    """The table after the first `most` claimable jobs were taken: running, leased, fence moved on."""
    taken = claimable(jobs, now).orderBy("id").limit(most).select(F.col("id").alias("__taken"))
    told = jobs.join(F.broadcast(taken), F.col("id") == F.col("__taken"), "left")  # `most` rows
    hit = F.col("__taken").isNotNull()
    return told.select(
        *[c for c in jobs.columns if c not in ("state", "fence", "leased_until")], F.when(hit, "running").otherwise(F.col("state")).alias("state"),
        (F.col("fence") + hit.cast("int")).alias("fence"), F.when(hit, now + lease).otherwise(F.col("leased_until")).alias("leased_until"),
    ).select(*jobs.columns)


def settled(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """The table after reports (id, fence, state): only a report under the job's own fence counts; a cancelled job ends cancelled."""
    told = jobs.join(reports.select("id", F.col("fence").alias("__fence"), F.col("state").alias("__state")), "id", "left")
    hit = (F.col("__fence") == F.col("fence")) & (F.col("state") == "running")
    state = F.when(hit & F.col("cancel"), "cancelled").when(hit, F.col("__state")).when(F.col("cancel") & (F.col("state") == "queued"), "cancelled").otherwise(F.col("state"))
    return told.withColumn("state", state).withColumn("leased_until", F.when(~F.col("state").isin(*SETTLED), F.col("leased_until"))).select(*jobs.columns)


def due(schedules: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """collection, next_due, due: 0 if never started, null if disabled; not due while a job of the collection is unsettled."""
    when = F.when(~F.col("enabled"), None).when(F.col("last_started").isNull(), F.lit(0.0)).otherwise(F.col("last_started") + F.col("every_hours") * 3600.0)
    busy = jobs.where("state in ('queued', 'running')").select(F.col("collection").alias("__busy")).distinct()
    told = schedules.select("collection", when.alias("next_due")).join(busy, F.col("collection") == F.col("__busy"), "left")
    return told.select("collection", "next_due", F.coalesce((F.col("next_due") <= now) & F.col("__busy").isNull(), F.lit(False)).alias("due"))


def catch_up(work: DataFrame, first_id: int = 1) -> DataFrame:
    """id, kind, after_id: a job for each step of CATCH_UP that has units, each after the last one that has.

    work: kind, units. A step without units is left out and leaves no gap. One row a step.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in CATCH_UP]), F.col("kind"))
    steps = work.where(F.col("kind").isin(*CATCH_UP) & (F.col("units") > 0)).withColumn("__step", order)
    w = Window.orderBy("__step")
    placed = steps.withColumn("id", F.row_number().over(w) + (first_id - 1))
    return placed.select("id", "kind", F.lag("id").over(w).alias("after_id"))


def current(answers: DataFrame, tables: DataFrame) -> DataFrame:
    """answer, current: whether every table an answer read still has the generation it was read at; the ledger counts for none."""
    told = answers.join(tables.where("name <> 'ledger'").select("name", F.col("generation").alias("__now")), "name", "left")
    return told.groupBy("answer").agg(F.every(F.col("__now").isNull() | (F.col("__now") == F.col("generation"))).alias("current"))


def proven(runs: DataFrame, generation: int, policy: int, covered: Column) -> DataFrame:
    """Runs whose hypothesis still stands: this generation, this policy, and everything covered."""
    return runs.where((F.col("generation") == generation) & (F.col("policy") == policy) & covered)


#: Step -> rows that are still to do, of the tables by name. A step's units are counted when it is claimed, not before.
COUNTERS = {
    "ingest": lambda tables: tables["files"].join(tables["read"].select("id"), "id", "left_anti"),
    "embed": lambda tables: tables["files"].where("kind in ('image', 'animated_image', 'video')").join(tables["vectors"].select("id"), "id", "left_anti"),
    "captions": lambda tables: tables["files"].where("kind = 'image'").join(tables["said"].select("id"), "id", "left_anti"),
}


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, units of every step that counts its own."""
    out = None
    for kind, rest in COUNTERS.items():
        one = rest(tables).agg(F.count(F.lit(1)).alias("units")).select(F.lit(kind).alias("kind"), "units")
        out = one if out is None else out.unionAll(one)
    return out


# -- remembered questions -------------------------------------------------------


def remembered(views: DataFrame, new: DataFrame) -> DataFrame:
    """The views (id, name, question, created_at, last_used_at) with the new ones (name, question, at): a name that is known is refined, not doubled.

    The page isn't part of a question. Blank names are refused before they come here.
    """
    parts = F.filter(F.split(F.regexp_replace("question", r"^\?", ""), "&"), lambda p: (p != "") & ~p.startswith("page="))
    told = new.select(F.trim("name").alias("__name"), F.array_join(parts, "&").alias("__question"), F.col("at").alias("__at"))
    kept = views.join(told, F.col("name") == F.col("__name"), "left").select("id", "name", F.coalesce("__question", "question").alias("question"), "created_at", "last_used_at")
    last = views.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = told.join(views.select("name"), F.col("__name") == F.col("name"), "left_anti")
    placed = fresh.withColumn("__place", F.row_number().over(Window.orderBy("__at", "__name"))).crossJoin(F.broadcast(last))  # one row
    added = placed.select((F.col("__last") + F.col("__place")).alias("id"), F.col("__name").alias("name"), F.col("__question").alias("question"), F.col("__at").alias("created_at"), F.lit(None).cast(dict(views.dtypes)["last_used_at"]).alias("last_used_at"))
    return kept.unionByName(added)


def recently_used(views: DataFrame) -> DataFrame:
    """Views with their place: the most recently used first, those never used by when they were made."""
    order = Window.orderBy(F.coalesce("last_used_at", "created_at").desc(), "name")
    return views.withColumn("place", F.row_number().over(order).cast("long"))
