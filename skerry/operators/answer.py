"""One ordered answer, and the views of it: page, peek, place, neighbourhood, digest.

The order is total: the sort column, nulls last in both directions, then the id in the sort's
direction. Pages near either end come from a top-k (`orderBy` with `limit`), which keeps only
the head of each partition; other positions come from a range partitioning with per-partition
counts, so no task sees the whole answer. Which partition a row fell into is written down once:
a range partitioning that is planned twice may sample other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Rows of a peek; neighbours shown, and at most.
PEEK = 9
NEIGHBOURS, NEIGHBOURS_MOST = 15, 51
#: Fixed value: items that a selection holds at most.
SELECTED_MOST = 5000
#: Rows that a page takes from an end of the answer at most; a page further in is found by positions.
DEEP = 50_000


class Order(list):
    """Columns to order by, and those of the same order from its other end."""

    def __init__(self, columns: list[Column], backwards: list[Column]) -> None:
        super().__init__(columns)
        self.backwards = backwards


def total_order(sort: str | None, id: str, descending: bool) -> Order:
    names = dict.fromkeys([*([sort] if sort else []), id])
    if descending:
        return Order([F.col(c).desc_nulls_last() for c in names], [F.col(c).asc_nulls_first() for c in names])
    return Order([F.col(c).asc_nulls_last() for c in names], [F.col(c).desc_nulls_first() for c in names])


def ordered(items: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Every row with its 1-based position, without gathering the answer in one task.

    Rows are range-partitioned by the order, sorted, and written with their partition and their
    place in it; the rows of the partitions before, one number a partition, are added.
    """
    spread = items.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = spread.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    placed = materialise(placed, "ordered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # One row a partition.
    return placed.join(F.broadcast(before), placed["__part"] == before["__p"]).withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__p", "__before")


def page(items: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of page `number`, clamped to the pages there are, with their ordinals."""
    total = items.count()
    pages = max(1, -(-total // size))
    first = (min(max(1, number), pages) - 1) * size
    behind = max(0, total - first - size)
    backwards = getattr(order, "backwards", None)
    if first <= behind or not backwards:
        if first + size <= DEEP or not backwards:
            head = items.orderBy(*order).limit(first + size)
            return head.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("ordinal") > first)
    elif total - first <= DEEP:
        tail = items.orderBy(*backwards).limit(total - first)
        placed = tail.withColumn("ordinal", (F.lit(total + 1) - F.row_number().over(Window.orderBy(*backwards))).cast("long"))
        return placed.where(F.col("ordinal") <= first + size)
    return ordered(items, order).where((F.col("ordinal") > first) & (F.col("ordinal") <= first + size))


def peek(items: DataFrame, order: list[Column], most: int = PEEK) -> DataFrame:
    return page(items, order, 1, min(most, PEEK))


def top_with_more(items: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows, and whether there are more."""
    head = items.orderBy(*order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(*order))
    return head.withColumn("place", place.cast("long")).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > most).where(F.col("place") <= most)


def located(items: DataFrame, id: str, order: list[Column], value: int, size: int) -> DataFrame:
    """Position, page, neighbours and ends of one member; no row if it is none."""
    place = ordered(items, order).select(F.col(id).alias("__id"), "ordinal")
    one = place.where(F.col("__id") == value).select(F.col("__id").alias("member"), F.col("ordinal").alias("at"))
    total = place.agg(F.count(F.lit(1)).alias("total"))
    # One row by its id, and one row of a count.
    near = place.crossJoin(F.broadcast(one.crossJoin(total))).where(F.col("ordinal").isin(1) | (F.col("ordinal") == F.col("total")) | (F.abs(F.col("ordinal") - F.col("at")) <= 1))

    def at(where: Column) -> Column:
        return F.max(F.when(where, F.col("__id")))

    found = near.groupBy("member", F.col("at").alias("ordinal"), "total").agg(
        at(F.col("ordinal") == F.col("at") - 1).alias("previous_id"), at(F.col("ordinal") == F.col("at") + 1).alias("next_id"),
        at(F.col("ordinal") == 1).alias("first_id"), at(F.col("ordinal") == F.col("total")).alias("last_id"),
    )
    return found.withColumn("page", F.ceil(F.col("ordinal") / F.lit(size)).cast("long"))


def neighbourhood(items: DataFrame, id: str, order: list[Column], value: int, take: int = NEIGHBOURS) -> DataFrame:
    """A window of `take` members around one; it slides at the ends, so that it stays full."""
    take = min(max(1, take), NEIGHBOURS_MOST)
    place = ordered(items, order)
    one = place.where(F.col(id) == value).select(F.col("ordinal").alias("at"))
    total = place.agg(F.count(F.lit(1)).alias("total"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - 1 - take // 2, F.col("total") - take))
    window = one.crossJoin(total).select(start.alias("start"))
    return place.join(F.broadcast(window), (F.col("ordinal") > F.col("start")) & (F.col("ordinal") <= F.col("start") + take)).drop("start")


def digest(items: DataFrame, id: str, order: list[Column], blocks: int = 4096) -> DataFrame:
    """16 hex digits that name the ordered answer, and its size.

    Ids are hashed in blocks of consecutive positions, then the blocks' hashes in order; one
    row per block reaches the last step.
    """
    place = ordered(items, order)
    block = place.groupBy(((F.col("ordinal") - 1) / F.lit(blocks)).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.col(id).alias("id")))).alias("ids"), F.count(F.lit(1)).alias("n")
    )
    text = F.concat_ws(",", F.transform("ids", lambda x: x["id"].cast("string")))
    hashed = block.select("block", "n", F.sha2(text, 256).alias("h"))
    whole = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]))
    return hashed.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def keyset_next(items: DataFrame, sort: str, id: str, after: tuple, most: int = 1, descending: bool = True) -> DataFrame:
    """Rows right behind the member (sort value, id) `after`, without counting those before."""
    value, member = after
    beyond = F.col(id) < member if descending else F.col(id) > member
    if value is None:
        here = F.col(sort).isNull() & beyond
    else:
        here = F.col(sort).isNull() | (F.col(sort) < value if descending else F.col(sort) > value) | ((F.col(sort) == value) & beyond)
    return items.where(here).orderBy(*total_order(sort, id, descending)).limit(most)


def proven(selected: DataFrame, answer: DataFrame, id: str) -> DataFrame:
    """How many of `selected` aren't members of `answer`; 0 proves the selection a subset."""
    missing = selected.select(id).join(answer.select(F.col(id).alias("__m")), F.col(id) == F.col("__m"), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("outsiders"))


class Changed(Exception):
    """A selection was made against an answer that is another one now."""


def held_to(selected: DataFrame, items: DataFrame, id: str, order: list[Column], expected: str) -> DataFrame:
    """`selected`, if it is a subset of the answer that `expected` names by its digest; else Changed. SELECTED_MOST rows at most."""
    if selected.limit(SELECTED_MOST + 1).count() > SELECTED_MOST:
        raise ValueError(f"a selection holds {SELECTED_MOST} at most")
    if digest(items, id, order).first()["digest"] != expected:
        raise Changed("the answer isn't the one that the selection was made from")
    if proven(selected, items, id).first()["outsiders"]:
        raise Changed("the selection holds items that the answer doesn't")
    return selected


def top_with_overflow(groups: DataFrame, order: list[Column], most: int, count: str = "n") -> DataFrame:
    """The first `most` rows of counted groups, each with how many groups and members come behind them."""
    total = groups.agg(F.count(F.lit(1)).alias("__groups"), F.sum(count).alias("__members"))
    head = groups.orderBy(*order).limit(most)
    w = Window.partitionBy()  # over `most` rows
    told = head.withColumn("__shown", F.count(F.lit(1)).over(w)).withColumn("__held", F.sum(count).over(w)).crossJoin(F.broadcast(total))
    return told.select(*groups.columns, (F.col("__groups") - F.col("__shown")).alias("more_groups"), (F.col("__members") - F.col("__held")).alias("more_members"))
