"""Calendar and duration functions. Durations are whole microseconds."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class TimeUnit(Enum):
    """Thirteen units, from small to large."""

    MICROSECOND = 0
    MILLISECOND = 1
    SECOND = 2
    MINUTE = 3
    HOUR = 4
    DAY = 5
    WEEK = 6
    MONTH = 7
    QUARTER = 8
    YEAR = 9
    DECADE = 10
    CENTURY = 11
    MILLENNIUM = 12


_DAY = 86_400_000_000
#: Microseconds in a unit: months of 30 and years of 365 days.
CASUAL = dict(zip(TimeUnit, [1, 1000, 1_000_000, 60_000_000, 3_600_000_000, _DAY, 7 * _DAY, 30 * _DAY, 90 * _DAY, 365 * _DAY, 3650 * _DAY, 36500 * _DAY, 365000 * _DAY]))
#: The same by the Gregorian cycle of 146097 days in 400 years.
ACCURATE = CASUAL | {
    TimeUnit.MONTH: 146097 * _DAY // 4800,
    TimeUnit.QUARTER: 146097 * _DAY // 1600,
    TimeUnit.YEAR: 146097 * _DAY // 400,
    TimeUnit.DECADE: 146097 * _DAY // 40,
    TimeUnit.CENTURY: 146097 * _DAY // 4,
    TimeUnit.MILLENNIUM: 146097 * _DAY * 10 // 4,
}


def is_leap_year(d: Column) -> Column:
    y = F.year(d)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_year(d: Column) -> Column:
    return F.when(is_leap_year(d), 366).otherwise(365)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def week_year(d: Column) -> Column:
    """The year of the ISO week."""
    return F.extract(F.lit("YEAROFWEEK"), d)


def week_number(d: Column) -> Column:
    return F.weekofyear(d)


def weeks_in_year(d: Column) -> Column:
    """ISO weeks in the date's calendar year: 28 December lies in the last."""
    return F.weekofyear(F.make_date(F.year(d), F.lit(12), F.lit(28)))


def hour12(t: Column) -> Column:
    return (F.hour(t) + 11) % 12 + 1


_NATIVE = {TimeUnit.MICROSECOND: "microsecond", TimeUnit.MILLISECOND: "millisecond", TimeUnit.SECOND: "second", TimeUnit.MINUTE: "minute", TimeUnit.HOUR: "hour", TimeUnit.DAY: "day", TimeUnit.MONTH: "month", TimeUnit.QUARTER: "quarter", TimeUnit.YEAR: "year"}
_YEARS = {TimeUnit.DECADE: 10, TimeUnit.CENTURY: 100, TimeUnit.MILLENNIUM: 1000}


def truncate(t: Column, unit: TimeUnit, start_weekday: int = 1) -> Column:
    """The start of the unit that holds t; weeks start on the given day, Monday 1 to Sunday 7."""
    if not 1 <= start_weekday <= 7:
        raise ValueError("start_weekday must be from 1 to 7")
    if unit in _NATIVE:
        return F.date_trunc(_NATIVE[unit], t).cast("timestamp_ntz")
    if unit is TimeUnit.WEEK:
        back = F.pmod(F.weekday(t) + 1 - start_weekday, F.lit(7))
        return F.date_sub(t.cast("date"), back).cast("timestamp_ntz")
    n = _YEARS[unit]
    return F.make_date(F.year(t) - F.pmod(F.year(t), F.lit(n)), F.lit(1), F.lit(1)).cast("timestamp_ntz")


def shift_months(t: Column, months: Column) -> Column:
    """So many calendar months on; days beyond a month's end run over into the next, unlike add_months."""
    first = F.make_date(F.year(t), F.month(t), F.lit(1))
    moved = F.date_add(F.add_months(first, months), F.dayofmonth(t) - 1)
    midnight = F.date_trunc("day", t).cast("timestamp_ntz")
    return moved.cast("timestamp_ntz") + (t.cast("timestamp_ntz") - midnight)


def periodical(spark: SparkSession, start: str, unit: TimeUnit, count: int, step: int = 1) -> DataFrame:
    """place, at: ``count`` times from start, a step of units apart.

    Months and longer step the calendar field and let days overflow; each step
    starts from the one before, so an overflow stays (31 January, 2 March, 2 April).
    """
    if step == 0:
        raise ValueError("step must not be 0")
    t0 = F.lit(start).cast("timestamp_ntz")
    months = {TimeUnit.MONTH: 1, TimeUnit.QUARTER: 3, TimeUnit.YEAR: 12, TimeUnit.DECADE: 120, TimeUnit.CENTURY: 1200, TimeUnit.MILLENNIUM: 12000}
    rows = spark.range(count)
    if unit not in months:
        us = F.col("id") * F.lit(step * CASUAL[unit])
        return rows.select(F.col("id").alias("place"), (t0 + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1_000_000).cast("decimal(18,6)"))).alias("at"))
    n = months[unit] * step
    # Until a day first overflows, every time is counted from the start; after that its day
    # is 3 at most and never overflows again, so every time is counted from there.
    turn, day = _first_overflow(datetime.fromisoformat(start), n, count)
    early = shift_months(t0, F.col("id").cast("int") * n)
    late = shift_months(F.lit(day.isoformat(sep=" ")).cast("timestamp_ntz"), (F.col("id") - turn).cast("int") * n)
    return rows.select(F.col("id").alias("place"), F.when(F.col("id") < turn, early).otherwise(late).alias("at"))


def _first_overflow(start: datetime, months: int, count: int) -> tuple[int, datetime]:
    """(step, time) of the first step that runs over a month's end; the last one looked at if none does.

    The calendar repeats after 400 years, so no more steps than that takes need be tried.
    """
    for k in range(1, min(count, 4801)):
        year, month = divmod(start.year * 12 + start.month - 1 + months * k, 12)
        if not 1 <= year < 9999:
            break
        over = start.day - monthrange(year, month + 1)[1]
        if over > 0:
            year, month = divmod(year * 12 + month + 1, 12)
            return k, start.replace(year=year, month=month + 1, day=over)
    return count, start


def convert_to(us: Column, unit: TimeUnit, table=None) -> Column:
    """A duration in a unit, as a double."""
    return us / F.lit(float((table or CASUAL)[unit]))


def convert_to_all(us: Column, units, table=None) -> Column:
    """map(unit name, count): the largest units first, the rest in microseconds, which are always there."""
    table = table or CASUAL
    rest, parts = us, []
    for unit in sorted(set(units) | {TimeUnit.MICROSECOND}, key=lambda u: -u.value):
        n = F.call_function("div", rest, F.lit(table[unit]).cast("long"))
        parts += [F.lit(unit.name.lower()), n]
        rest = rest - n * F.lit(table[unit]).cast("long")
    return F.create_map(*parts)


def interval_duration(start: Column, end: Column) -> Column:
    """Length of an interval in microseconds, at a resolution of milliseconds."""
    us = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.call_function("div", us, F.lit(1000).cast("long")) * 1000
