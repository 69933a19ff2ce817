"""The time axis as drawn: empty stretches folded away, the bin width that fits, sampled moments."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import merged

#: An empty stretch longer than this share of the span is folded to it; bins that a strip shows.
FOLD_SHARE, STRIP_BINS = 0.04, 40
#: Bin widths in seconds, finest first.
WIDTHS = (3600, 6 * 3600, 86_400, 7 * 86_400, 30 * 86_400, 365 * 86_400)


def projection(intervals: DataFrame, start: str, end: str, lo: int, hi: int) -> DataFrame:
    """start, end, at: where each occupied stretch begins on the folded axis (0 at its left end).

    Stretches are few (they don't touch), so the running sum over them is one small task.
    """
    clipped = intervals.where((F.col(start) < hi) & (F.col(end) > lo)).select(F.lit(0).alias("__one"), F.greatest(F.col(start), F.lit(lo)).alias(start), F.least(F.col(end), F.lit(hi)).alias(end))
    held = merged(clipped, "__one", start, end)
    order = Window.partitionBy("__one").orderBy(start)
    gap = F.col(start) - F.coalesce(F.lag(end).over(order), F.lit(lo))
    fold = int((hi - lo) * FOLD_SHARE)
    shown = held.withColumn("gap", F.least(gap, F.lit(fold)))
    before = F.sum(F.col("gap") + F.col(end) - F.col(start)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shown.select(start, end, (before - (F.col(end) - F.col(start))).cast("long").alias("at"))


def strip_width(moments: DataFrame, seconds: Column, widths: tuple[int, ...] = WIDTHS, most: int = STRIP_BINS) -> DataFrame:
    """width and bins of the finest width that leaves at most `most` occupied bins, all widths in one pass."""
    counts = moments.agg(*[F.countDistinct(F.floor(seconds / w)).alias(str(w)) for w in widths])
    stacked = counts.select(F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("width"), F.col(str(w)).alias("bins")) for w in widths])).alias("s")).select("s.*")
    fits = stacked.where((F.col("bins") <= most) | (F.col("width") == widths[-1]))
    return fits.orderBy("width").limit(1)


def sampled(duration: Column, every_ms: int, most: int) -> Column:
    """Moments (ms) to look at in something `duration` ms long: every so often, evenly spread if too many."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(duration / every_ms))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor((k + 0.5) * duration / n).cast("long"))


def calendar_sheet(rows: DataFrame, moment: Column, year: int, month: int) -> DataFrame:
    """day, week, weekday (1: Monday), inside, n: a month's sheet, whole weeks; days without rows count 0."""
    first = date(year, month, 1)
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    begin, end = first - timedelta(days=first.weekday()), last + timedelta(days=6 - last.weekday())
    days = [(str(begin + timedelta(days=k)), k // 7, k % 7 + 1, (begin + timedelta(days=k)).month == month) for k in range((end - begin).days + 1)]
    sheet = rows.sparkSession.createDataFrame(days, "day string, week long, weekday long, inside boolean")
    held = rows.where((moment >= F.lit(begin)) & (moment < F.lit(end + timedelta(days=1)))).groupBy(F.date_format(moment, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sheet.join(held, "day", "left").fillna(0, ["n"])


def year_grid(rows: DataFrame, moment: Column, year: int) -> DataFrame:
    """month, n, first_day of a year's twelve months."""
    months = rows.sparkSession.range(1, 13).select(F.col("id").alias("month"))
    own = rows.where((moment >= F.lit(date(year, 1, 1))) & (moment < F.lit(date(year + 1, 1, 1))))
    held = own.groupBy(F.month(moment).cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(F.dayofmonth(moment)).alias("first_day"))
    return months.join(held, "month", "left").fillna(0, ["n"])


def presets(today: date) -> dict[str, tuple[date, date]]:
    """Windows that a timeline offers by name: first day, day after the last."""
    day = timedelta(days=1)
    monday = today - timedelta(days=today.weekday())
    following = date(today.year + today.month // 12, today.month % 12 + 1, 1)
    return {
        "today": (today, today + day), "yesterday": (today - day, today), "this week": (monday, monday + 7 * day), "this month": (today.replace(day=1), following),
        "this year": (date(today.year, 1, 1), date(today.year + 1, 1, 1)), "last 7 days": (today - 6 * day, today + day), "last 30 days": (today - 29 * day, today + day),
    }


def preset_counts(rows: DataFrame, moment: Column, today: date) -> DataFrame:
    """name, n of each preset, all in one pass."""
    named = presets(today)
    counts = rows.agg(*[F.count_if((moment >= F.lit(lo)) & (moment < F.lit(hi))).alias(name) for name, (lo, hi) in named.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").alias("n")) for name in named])).alias("p")).select("p.*")
