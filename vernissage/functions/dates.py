"""Days at the venues, parsed timestamps, written dates. Pure Column expressions.

Timestamps inside the package are TIMESTAMP_NTZ holding UTC, so no result depends on the session
time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage import vocab


def to_local(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(vocab.SITE_TIMEZONE), ts.cast("timestamp_ntz"))


def local_day(ts: Column) -> Column:
    return F.to_date(to_local(ts))


def local_time(ts: Column) -> Column:
    return F.date_format(to_local(ts), "HH:mm:ss")


def instant_to_utc(ts: Column) -> Column:
    """A TIMESTAMP (an instant) as TIMESTAMP_NTZ in UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def utc_to_instant(ts: Column) -> Column:
    """The reverse: what a watermark needs."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def parse_instant(c: Column, *, assume_utc: bool = False) -> Column:
    """An ISO 8601 text as UTC. A text without an offset is no instant, unless `assume_utc`."""
    text = F.regexp_replace(F.trim(c), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    naive = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    aware = F.when(zoned, instant_to_utc(text.try_cast("timestamp")))
    if not assume_utc:
        return aware
    return F.coalesce(aware, F.when(naive, text.try_cast("timestamp_ntz")))


def _day(year: Column, month: Column, day: Column, last: bool) -> Column:
    """That day, null when it does not exist; a missing day is the month's first or last."""
    first = F.try_make_timestamp(
        year.cast("int"), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    ).cast("date")
    bound = F.last_day(first) if last else first
    given = F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, day.cast("int") - 1))
    return F.when(day.isNull(), bound).otherwise(given)


def resolve_dates(start: Column, end: Column, fetched_on: Column) -> Column:
    """struct(start_date, end_date) for a run written as `start`-`end` on a page fetched that day.

    `start` and `end` are struct(day, month, year), null when not written. A year not written comes
    from the other end, else from the run nearest to the fetch day, the later one on a tie. A run
    that cannot exist is null at both ends.

    Every pair of years that may be meant is written out once, with what it is judged by, and the
    least is taken; a date that stands alone is the run from itself to itself."""
    alone = start.isNull() | end.isNull()
    undated = start["year"].isNull() & end["year"].isNull()
    middle = F.coalesce(start["year"], end["year"], F.year(fetched_on)).cast("int")
    nearby = [F.struct((middle + d).alias("a"), (middle + d + k).alias("b")) for d in (-1, 0, 1) for k in (0, 1)]
    as_written = F.struct(start["year"].cast("int").alias("a"), end["year"].cast("int").alias("b"))

    def opens(year: Column) -> Column:
        return F.when(start.isNull(), _day(year, end["month"], end["day"], True)).otherwise(
            _day(year, start["month"], start["day"], False))

    def closes(year: Column) -> Column:
        return F.when(end.isNull(), opens(year)).otherwise(_day(year, end["month"], end["day"], True))

    def judged(years: Column) -> Column:
        first, last = opens(years["a"]), closes(years["b"])
        meant = (
            F.coalesce(start["year"] == years["a"], F.lit(True)) & F.coalesce(end["year"] == years["b"], F.lit(True))
            & (~alone | (years["a"] == years["b"]))
            # Over the turn of a year only if the run does not fit into one, or both years say so.
            & ((years["a"] == years["b"]) | end["year"].isNotNull() | ~F.coalesce(closes(years["a"]) >= first, F.lit(False)))
        )
        away = F.greatest(F.datediff(first, fetched_on), F.datediff(fetched_on, last), F.lit(0))
        return F.when(meant & (last >= first), F.struct(
            F.when(undated, away).alias("away"), (-F.unix_date(first)).alias("later"), first.alias("first"), last.alias("last")))

    pairs = F.array(as_written, *nearby)
    best = F.array_min(F.array_compact(F.transform(pairs, judged)))
    return F.struct(
        F.when(start.isNotNull(), best["first"]).alias("start_date"), F.when(end.isNotNull(), best["last"]).alias("end_date"))


def resolve_day(spec: Column, today: Column, on_or_after: Column | None = None) -> Column:
    """The day a spec names: today, tomorrow or a weekday (the first on or after), then `+N` days.
    Null for anything else."""
    shape = "^(today|tomorrow|" + "|".join(vocab.WEEKDAYS) + r")(?:\+([0-9]+))?$"
    word = F.regexp_extract(spec, shape, 1)
    plus = F.coalesce(F.regexp_extract(spec, shape, 2).try_cast("int"), F.lit(0))
    start = today if on_or_after is None else F.coalesce(on_or_after, today)
    wanted = F.array_position(F.array(*map(F.lit, vocab.WEEKDAYS)), word) - 1
    weekday = F.date_add(start, F.pmod(wanted - F.weekday(start), F.lit(7)).cast("int"))
    day = (
        F.when(word == "today", today)
        .when(word == "tomorrow", F.date_add(today, 1))
        .when(word != "", weekday)
    )
    return F.date_add(day, plus)
