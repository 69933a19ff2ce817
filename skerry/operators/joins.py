"""Joins that Spark has no operator for: as-of, nearest, interval overlap, staged reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .answer import ordered


def asof(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: list[str], forward: bool = False) -> DataFrame:
    """Each left row with `values` of the last right row of its `by` at or before it (or the first at or after).

    One shuffle of the union by `by`, one sort, one running window; no pairs are made.
    """
    shape = [F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(1 if not forward else 0).alias("__side")]
    a = left.select(*shape, F.struct("*").alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    b = right.select(F.col(by).alias("__by"), F.col(right_at).alias("__at"), F.lit(0 if not forward else 1).alias("__side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__left"), F.struct(*values).alias("__right"))
    order = Window.partitionBy("__by").orderBy("__at", "__side")
    if forward:
        # Ties: at equal times the right side comes last, so that it's ahead of the left row.
        found = F.first("__right", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("__found", found).where("__left is not null")
    return both.select("__left.*", *[F.col("__found")[v].alias(v) for v in values])


def overlapping(left: DataFrame, right: DataFrame, on: str, width: int, start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """Pairs of rows equal in `on` whose intervals [start, end] and [other_start, other_end) meet.

    Both sides are dealt to buckets of `width`; a pair is kept in the first bucket that both
    lie in, so it appears once. The join is an equi-join on (on, bucket).
    """

    def buckets(first: str, last: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))

    a = left.withColumn("__bucket", buckets(start, end))
    b = right.withColumn("__other", buckets(other_start, other_end)).withColumnRenamed(on, "__on")
    first = F.floor(F.greatest(F.col(start), F.col(other_start)) / width)
    joined = a.join(b, (F.col(on) == F.col("__on")) & (F.col("__bucket") == F.col("__other")))
    return joined.where((F.col(start) < F.col(other_end)) & (F.col(end) >= F.col(other_start)) & (F.col("__bucket") == first)).drop("__bucket", "__other", "__on")


def reconcile(observed: DataFrame, stored: DataFrame, key: str, content: str, walked: Column | None = None) -> DataFrame:
    """o_key, s_key, outcome of every observed and stored row: matched, moved, replaced, new, ambiguous or missing.

    Same key, and same content or one that was never stored: matched. Then a content that one
    unmatched stored row has goes to the first observed row with it: moved; if several stored
    rows have it, the observed ones are ambiguous. Then same key with another content: replaced.
    What is left of the observed is new; of the stored, missing, but only where `walked` (a
    condition on the stored rows) says that it was looked for.
    """
    o = observed.select(F.col(key).alias("o_key"), F.col(content).alias("o_content"))
    s = stored.select(F.col(key).alias("s_key"), F.col(content).alias("s_content"), (F.lit(True) if walked is None else walked).alias("s_walked"))

    def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
        return rows.join(gone.select(F.col(name).alias("k")), F.col(name) == F.col("k"), "left_anti")

    same = o.join(s, (F.col("o_key") == F.col("s_key")) & (F.col("s_content").isNull() | (F.col("o_content") == F.col("s_content"))))
    o1, s1 = without(o, "o_key", same), without(s, "s_key", same)
    o_one = o1.groupBy("o_content").agg(F.min("o_key").alias("o_key"))
    s_one = s1.where("s_content is not null").groupBy("s_content").agg(F.count(F.lit(1)).alias("sn"), F.min("s_key").alias("s_key"))
    met = o_one.join(s_one, F.col("o_content") == F.col("s_content"))
    moved = met.where("sn = 1").select("o_key", "s_key")
    o2, s2 = without(o1, "o_key", moved), without(s1, "s_key", moved)
    unclear = o2.join(met.where("sn > 1").select(F.col("o_content").alias("u")), F.col("o_content") == F.col("u"), "left_semi")
    rest = without(o2, "o_key", unclear).join(s2, F.col("o_key") == F.col("s_key"), "full")
    outcome = F.when(F.col("o_key").isNull(), "missing").when(F.col("s_key").isNotNull(), "replaced").otherwise("new")
    return (
        same.select("o_key", "s_key", F.lit("matched").alias("outcome"))
        .unionByName(moved.withColumn("outcome", F.lit("moved")))
        .unionByName(unclear.select("o_key", F.lit(None).cast(dict(s.dtypes)["s_key"]).alias("s_key"), F.lit("ambiguous").alias("outcome")))
        .unionByName(rest.where("o_key is not null or s_walked").select("o_key", "s_key", outcome.alias("outcome")))
    )


def applied(observed: DataFrame, stored: DataFrame, id: str, key: str, content: str, now: Column, walked: Column | None = None) -> DataFrame:
    """The stored rows after a scan: id, key, content, missing_since, outcome. Nothing is deleted.

    Matched, moved and replaced rows keep their id and take the observed key and content; new and
    ambiguous ones get ids behind the largest; missing ones keep everything and get `now`, unless
    they were missing already; what wasn't walked stays as it is (outcome null).
    """
    told = materialise(reconcile(observed, stored, key, content, walked), "scan")
    seen = observed.select(F.col(key).alias("__key"), F.col(content).alias("__content"))
    kept = stored.select(id, key, content, "missing_since").join(told.where("s_key is not null").select("s_key", "o_key", "outcome"), F.col(key) == F.col("s_key"), "left").join(seen, F.col("o_key") == F.col("__key"), "left")
    found = F.col("outcome").isin("matched", "moved", "replaced")
    after = kept.select(
        F.col(id), F.when(found, F.col("o_key")).otherwise(F.col(key)).alias(key), F.when(found, F.col("__content")).otherwise(F.col(content)).alias(content),
        F.when(F.col("outcome") == "missing", F.coalesce("missing_since", now)).when(F.col("outcome").isNull(), F.col("missing_since")).alias("missing_since"), "outcome",
    )
    added = told.where("outcome in ('new', 'ambiguous')").join(seen, F.col("o_key") == F.col("__key")).select("o_key", "__content", "outcome")
    placed = ordered(added, [F.col("o_key")])
    last = stored.agg(F.coalesce(F.max(id), F.lit(0)).alias("__last"))
    fresh = placed.crossJoin(F.broadcast(last)).select((F.col("__last") + F.col("ordinal")).alias(id), F.col("o_key").alias(key), F.col("__content").alias(content), F.lit(None).cast(dict(after.dtypes)["missing_since"]).alias("missing_since"), "outcome")
    return after.unionByName(fresh)


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Intersection over union of boxes given as columns x, y, w, h."""
    ax, ay, aw, ah = map(F.col, a)
    bx, by, bw, bh = map(F.col, b)
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = wide * high
    whole = aw * ah + bw * bh - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two sets has and the other hasn't, each once: one shuffle of both, combined before."""
    both = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(2)))
    return both.groupBy(*left.columns).agg(F.bit_or("__side").alias("__sides")).where("__sides < 3").select(*left.columns)
