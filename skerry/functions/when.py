"""When something was made: stamps in names and folders, and claims weighed against the file's own times.

A moment is a wall clock's reading as epoch seconds; the session's zone is UTC, and so is the
host's wall clock. Verdicts are structs of VERDICT: `at` (wall clock) or `instant`, `precision`,
`basis`, `supports`, `conflicts`, `finished_at`, `estimated_at`, `ordinal`, `zone_min`. A conflict
reads `who: what`, so that it can be counted by who disagrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .moments import SPANS

#: Years that can be a picture's; seconds that a file may be written after its claim.
YEARS, SLACK = (1826, 2100), 90.0
VERDICT = "struct<at: double, instant: double, precision: string, basis: string, supports: array<string>, conflicts: array<string>, finished_at: double, estimated_at: double, ordinal: int, zone_min: int>"
#: The grammars of stamped names, finest first; groups year, month, day, hour, minute, second, separator, milliseconds.
STAMPS = (
    r"(?<!\d)(\d{4})(\d{2})(\d{2})([_T-]?)(\d{2})h?(\d{2})m?(\d{2})s?(?:[._](\d{3})(?:ms)?|(\d{3})(?:ms)?)?(?!\d)",
    r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[ _T-](?:at[ _])?(\d{2})[.:-]?(\d{2})[.:-]?(\d{2})(?!\d)",
    r"(?<!\d)(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})(?!\d)",
)
EPOCH_MS, EPOCH_S = r"(?<!\d)(1[3-9]\d{11})(?!\d)", r"(?<!\d)(1\d{9})(?!\d)"
#: Folders that name a day, a month, a year, a decade.
DAY, MONTH, YEAR, DECADE = r"^(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})$", r"^(\d{4})[-_.](\d{2})$", r"^(\d{4})$", r"(?i)^(\d{3})0'?s$"


def seconds_of(year: Column, month: Column | int = 1, day: Column | int = 1) -> Column:
    """Epoch seconds of a day's beginning, or null if it is none or not in YEARS."""
    y, m, d = (F.lit(x) if isinstance(x, int) else x.try_cast("int") for x in (year, month, day))
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(y.between(*YEARS), F.unix_seconds(made.cast("timestamp")).cast("double"))


def _stamp(at: Column, precision: str) -> Column:
    return F.when(at.isNotNull(), F.struct(at.cast("double").alias("at"), F.lit(precision).alias("precision")))


def name_stamp(name: Column) -> Column:
    """Struct of `at` and `precision` (day, second, subsecond) that a name carries; the finest grammar counts."""

    def first(pattern: str, read) -> Column:
        """What `read` makes of the first match that is a moment."""
        matches = F.regexp_extract_all(name, F.lit(pattern), 0)
        return F.get(F.filter(F.transform(matches, read), lambda x: x.isNotNull()), F.lit(0))

    def group(pattern: str, m: Column, k: int) -> Column:
        return F.regexp_extract(m, pattern.replace(r"(?<!\d)", "^").replace(r"(?!\d)", "$"), k)

    def clocked(pattern: str, hour: int):
        def read(m: Column) -> Column:
            part = lambda k: group(pattern, m, k)
            h, mi, s = (part(hour + k).try_cast("int") for k in range(3))
            at = seconds_of(part(1), part(2), part(3)) + h * 3600 + mi * 60 + s
            fits = (h <= 23) & (mi <= 59) & (s <= 60)
            if hour == 4:
                return F.when(fits, _stamp(at, "second"))
            # Milliseconds behind a dot, or glued to the seconds after an underscore; glued otherwise they are a counter.
            ms = F.coalesce(part(8).try_cast("int"), F.when(part(4) == "_", part(9).try_cast("int")))
            return F.when(fits, F.coalesce(_stamp(at + ms / 1000.0, "subsecond"), _stamp(at, "second")))

        return first(pattern, read)

    whole = lambda m: _stamp(seconds_of(*(group(STAMPS[2], m, k) for k in (1, 2, 3))), "day")
    ms, s = (F.regexp_extract(name, p, 1).try_cast("double") for p in (EPOCH_MS, EPOCH_S))
    return F.coalesce(clocked(STAMPS[0], 5), clocked(STAMPS[1], 4), first(STAMPS[2], whole), _stamp(ms / 1000.0, "subsecond"), _stamp(s, "second"))


def folder_stamp(folders: Column) -> Column:
    """Struct of `at` and `precision` (day, month, year, decade) that the nearest naming folder of an array gives."""

    def digits(i: Column, long: int, least: int) -> Column:
        return F.get(folders, i).rlike(rf"^\d{{{least},{long}}}$")

    def one(f: Column, i: Column) -> Column:
        back = lambda n: F.get(folders, i - n)
        chain = (i >= 2) & digits(i - 2, 4, 4) & digits(i - 1, 2, 1) & digits(i, 2, 1)
        pair = (i >= 1) & digits(i - 1, 4, 4) & digits(i, 2, 1)
        get = lambda p, k: F.regexp_extract(f, p, k)
        return F.coalesce(
            _stamp(seconds_of(get(DAY, 1), get(DAY, 2), get(DAY, 3)), "day"),
            F.when(chain, _stamp(seconds_of(back(2), back(1), f), "day")),
            _stamp(seconds_of(get(MONTH, 1), get(MONTH, 2)), "month"),
            F.when(pair, _stamp(seconds_of(back(1), f), "month")),
            _stamp(seconds_of(get(YEAR, 1)), "year"),
            _stamp(seconds_of(F.concat(get(DECADE, 1), F.lit("0"))), "decade"),
        )

    found = F.filter(F.transform(folders, one), lambda x: x.isNotNull())
    return F.get(found, F.size(found) - 1)


def span(precision: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SPANS.items() for x in pair]), precision)


def _said(*tags: Column) -> Column:
    return F.array_compact(F.array(*tags))


def _verdict(at=None, instant=None, precision=None, basis=None, supports=None, conflicts=None, finished_at=None, estimated_at=None, ordinal=None, zone_min=None) -> Column:
    none = F.lit(None)
    empty = F.array().cast("array<string>")
    fields = {"at": at, "instant": instant, "precision": precision, "basis": basis, "supports": supports if supports is not None else empty, "conflicts": conflicts if conflicts is not None else empty, "finished_at": finished_at, "estimated_at": estimated_at, "ordinal": ordinal, "zone_min": zone_min}
    return F.struct(*[(none if v is None else F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]).cast(VERDICT)


def judge_filesystem(mtime: Column, btime: Column) -> Column:
    """A file without a claim: its mtime, else its btime, as an instant; a btime within a day supports the mtime."""
    near = F.when(F.abs(btime - mtime) <= 86400, F.lit("btime_consistent"))
    return F.when(mtime.isNotNull(), _verdict(instant=mtime, precision="subsecond", basis="mtime", supports=_said(near))).when(btime.isNotNull(), _verdict(instant=btime, precision="subsecond", basis="btime"))


def judge_file(stamp: Column, dated: Column, mtime: Column, btime: Column) -> Column:
    """The file's own claims: a stamped name, else a dated folder, at its own precision; else its earliest known existence.

    stamp, dated: columns that hold what name_stamp and folder_stamp found; they are read often.
    """
    both = stamp.isNotNull() & dated.isNotNull()
    at, precision = F.coalesce(stamp["at"], dated["at"]), F.coalesce(stamp["precision"], dated["precision"])
    holds = (stamp["at"] >= dated["at"]) & (stamp["at"] < dated["at"] + span(dated["precision"]))
    end = at + span(precision)
    written = (mtime >= at - 2) & (mtime < end + SLACK)
    supports = _said(
        F.when(both & holds, F.concat(F.lit("folder_"), dated["precision"])), F.when(written, F.lit("mtime_consistent")),
        F.when(btime >= at - 1, F.lit("btime_after_claim")), F.when(mtime.isNotNull() | btime.isNotNull(), F.lit("host_zone_assumed")),
    )
    conflicts = _said(
        F.when(both & ~holds, F.lit("file: the folder doesn't hold the name's moment")),
        F.when(mtime < at - 2, F.lit("filesystem: mtime before the claim")), F.when(mtime >= end + SLACK, F.lit("filesystem: mtime after the claim")),
        F.when(btime < at - 1, F.lit("filesystem: btime before the claim")),
    )
    claim = _verdict(at=at, precision=precision, basis=F.when(stamp.isNotNull(), "filename").otherwise("folder"), supports=supports, conflicts=conflicts, finished_at=F.when(written, mtime))
    near = _said(F.when(F.abs(btime - mtime) <= 86400, F.lit("btime_consistent")))
    earlier = btime.isNotNull() & (mtime.isNull() | (btime < mtime))
    rest = F.when(earlier, _verdict(instant=btime, precision="subsecond", basis="btime", supports=near)).when(mtime.isNotNull(), _verdict(instant=mtime, precision="subsecond", basis="mtime", supports=near))
    return F.when(at.isNotNull(), claim).otherwise(rest)


def judge_capture(captured: Column, subsec_ms: Column, offset_min: Column, maker_min: Column, mtime: Column, btime: Column, length: Column | None = None) -> Column:
    """A camera's claim: its clock, made an instant by the zone it wrote, or its maker note's; mtime is when it closed the file."""
    local = captured + F.coalesce(subsec_ms, F.lit(0)) / 1000.0
    zone = F.coalesce(offset_min, maker_min)
    instant = local - zone * 60.0
    start = F.coalesce(instant, local)
    end = start + (F.coalesce(length, F.lit(0.0)) if length is not None else F.lit(0.0))
    written = (mtime >= start - 2) & (mtime <= end + SLACK)
    agree = offset_min == maker_min
    supports = _said(
        F.when(subsec_ms.isNotNull(), F.lit("exif_subsecond")), F.when(offset_min.isNotNull(), F.lit("exif_offset")),
        F.when(maker_min.isNotNull() & F.coalesce(agree, F.lit(True)), F.lit("maker_timezone")),
        F.when(zone.isNull() & (mtime.isNotNull() | btime.isNotNull()), F.lit("host_zone_assumed")),
        F.when(written, F.lit("mtime_write_consistent")), F.when(btime >= start - 1, F.lit("btime_after_capture")),
    )
    conflicts = _said(
        F.when(~agree, F.lit("camera: its zones disagree")), F.when(~written & (mtime < start), F.lit("filesystem: mtime before the capture")),
        F.when(~written & (mtime >= start), F.lit("filesystem: mtime after the capture")), F.when(btime < start - 1, F.lit("filesystem: btime before the capture")),
    )
    precision = F.when(subsec_ms.isNotNull(), "subsecond").otherwise("second")
    return F.when(captured.isNotNull(), _verdict(at=local, instant=instant, precision=precision, basis="capture", supports=supports, conflicts=conflicts, finished_at=F.when(written, mtime), zone_min=zone))


def judge_generation(claimed: Column, precision: Column, stamped: Column, ordinal: Column, mtime: Column, btime: Column, took: Column) -> Column:
    """A generator's claim: the moment its file's name was stamped with, else what it embedded (`second` or `day`).

    mtime is when it finished: with the time it took, the start must lie in the claim's window.
    """
    by_name = stamped.isNotNull()
    daily = F.coalesce(precision, F.lit("day")) != "second"
    at = F.coalesce(stamped, claimed)
    fine = F.when(by_name | ~daily, "second").otherwise("day")
    end = at + F.when(fine == "second", F.lit(1.0)).otherwise(F.lit(86400.0))
    inside = F.when(daily, (stamped >= claimed) & (stamped < claimed + 86400)).otherwise(F.abs(stamped - claimed) < 1)
    started = mtime - took
    begun = (started >= at - SLACK) & (started < end + SLACK)
    finished = (mtime >= at) & (mtime < end + SLACK)
    good = F.when(took.isNotNull(), begun).otherwise(finished)
    supports = _said(
        F.when(by_name & inside, F.when(daily, "embedded_day").otherwise("embedded_stamp")),
        F.when(good & took.isNotNull(), F.lit("mtime_finish_consistent")), F.when(good & took.isNull(), F.lit("mtime_consistent")),
        F.when(btime >= at - 1, F.lit("btime_after_generation")), F.when(mtime.isNotNull() | btime.isNotNull(), F.lit("host_zone_assumed")),
    )
    conflicts = _said(
        F.when(by_name & ~inside, F.lit("generator: the name's moment isn't in the embedded claim")),
        F.when(~good & (mtime < at), F.lit("filesystem: mtime before the claim")), F.when(~good & (mtime >= at), F.lit("filesystem: mtime after the claim")),
        F.when(btime < at - 1, F.lit("filesystem: btime before the claim")),
    )
    made = _verdict(at=at, precision=fine, basis=F.when(by_name, "filename").otherwise("embedded"), supports=supports, conflicts=conflicts, finished_at=F.when(good, mtime), estimated_at=F.when(good & took.isNotNull(), started), ordinal=ordinal)
    return F.when(at.isNotNull(), made)
