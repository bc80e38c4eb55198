"""Wall times and instants as integers: no session zone, no loss below microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOVIE_EPOCH = 2_082_844_800  # seconds from 1904-01-01 to 1970-01-01
MOST_OFFSET = 14 * 60


def micros(name: str) -> Column:
    """Microseconds of a zoneless timestamp column from 1970 on its own scale, whatever the session zone."""
    return F.expr(f"CAST(CAST(CAST(CAST(`{name}` AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")


def seconds(name: str) -> Column:
    """Floor seconds of ``micros``."""
    m = micros(name)
    return ((m - F.pmod(m, F.lit(1_000_000))) / F.lit(1_000_000).cast("decimal(10,0)")).cast("bigint")


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def days(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 in the proleptic Gregorian calendar; null for dates that don't exist or years outside 1 to 9999."""

    def count(p: Column) -> Column:
        y, m, d = p.y, p.m, p.d
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)
        # March as the first month makes the leap day the last of its year.
        a = F.when(m <= 2, y - 1).otherwise(y)
        floor = lambda x, n: F.floor(x / n).cast("bigint")
        return F.when(ok, 365 * a + floor(a, 4) - floor(a, 100) + floor(a, 400) + floor(153 * ((m + 9) % 12) + 2, 5) + d - 1 - 719468)

    return let(F.struct(year.cast("bigint").alias("y"), month.cast("bigint").alias("m"), day.cast("bigint").alias("d")), count)


def wall_seconds(parts: list[Column]) -> Column:
    """Seconds of a wall time (year to second) from 1970 on the wall scale; seconds go to 59."""

    def count(p: Column) -> Column:
        y, mo, d, h, mi, s = (F.get(p, F.lit(k)) for k in range(6))
        ok = h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
        return F.when(ok, days(y, mo, d) * 86400 + h * 3600 + mi * 60 + s)

    return let(F.array(*(x.cast("bigint") for x in parts)), count)


_EXIF = r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$"
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?([Zz]|[+-][0-9]{2}:?[0-9]{2})?$"


def exif_wall(text: Column) -> Column:
    """Wall seconds of ``YYYY:MM:DD HH:MM:SS``; null if it isn't exactly that."""
    return wall_seconds([_part(text, _EXIF, k) for k in range(1, 7)])


def offset_minutes(text: Column) -> Column:
    """Minutes of ``+HH:MM`` up to 14 hours either way; ``-00:00`` means unknown and gives null."""
    p = r"^([+-])([0-9]{2}):([0-9]{2})$"
    h, m = _part(text, p, 2).cast("int"), _part(text, p, 3).cast("int")
    total = h * 60 + m
    return F.when((m <= 59) & (total <= MOST_OFFSET) & (text != "-00:00"), F.when(_part(text, p, 1) == "-", -total).otherwise(total))


def subsecond_nanos(text: Column) -> Column:
    """Nanoseconds of 1 to 9 decimal digits."""
    return F.when(text.rlike("^[0-9]{1,9}$"), F.rpad(text, 9, "0").cast("bigint"))


def subsecond_precision(text: Column) -> Column:
    """Nanoseconds of the last digit given."""
    return F.when(text.rlike("^[0-9]{1,9}$"), F.rpad(F.lit("1"), 10 - F.length(text), "0").cast("bigint"))


def iso_wall(text: Column) -> Column:
    return wall_seconds([_part(text, _ISO, k) for k in range(1, 7)])


def iso_nanos(text: Column) -> Column:
    return F.coalesce(subsecond_nanos(_part(text, _ISO, 7)), F.lit(0).cast("bigint"))


def iso_offset(text: Column) -> Column:
    """Minutes of the zone; null if none is given (a floating time) or it isn't valid."""
    z = _part(text, _ISO, 8)
    colon = F.when(F.length(z) == 5, F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))).otherwise(z)
    return F.when(F.lower(z) == "z", 0).otherwise(offset_minutes(colon))


def instant_seconds(wall: Column, minutes: Column) -> Column:
    """UTC seconds; null without an offset, which is never guessed."""
    return wall - minutes.cast("bigint") * 60


def movie_seconds(value: Column) -> Column:
    """UTC seconds of a count from 1904."""
    return value.cast("bigint") - MOVIE_EPOCH


def total_nanos(seconds: Column, nanos: Column) -> Column:
    return seconds.cast("decimal(38,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + nanos.cast("decimal(10,0)")


def split_nanos(total: Column) -> tuple[Column, Column]:
    """Floor seconds and nanoseconds from 0 to 999999999, also before 1970; ``total`` is a bigint."""
    nanos = F.pmod(total, F.lit(1_000_000_000))
    return ((total - nanos).cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("bigint"), nanos


def civil(day: Column) -> Column:
    """``YYYY-MM-DD`` of days from 1970-01-01."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")


def display_utc(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC``, or the number itself outside the years 1 to 9999."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    return F.when(seconds.between(-62135596800, 253402300799), F.concat(civil(day), F.lit(" "), clock, F.lit(" UTC"))).otherwise(F.concat(seconds.cast("string"), F.lit(" s")))


def whole_hours_apart(difference: Column, tolerance: int = 2) -> Column:
    """Whether a difference of seconds is within the tolerance (5 at most) of 1 to 14 whole hours: a likely zone mistake."""
    near = min(tolerance, 5)
    d = F.abs(difference)
    hours = F.floor((d + near) / 3600)
    return hours.between(1, 14) & (F.abs(d - hours * 3600) <= near)


def sentinel(year: Column) -> Column:
    """Years that clocks without a setting show."""
    return year.isin(1904, 1970, 1980)


def obvious_future(seconds: Column, reference: Column, tolerance: int = 86400) -> Column:
    return seconds > reference + min(tolerance, 7 * 86400)


def file_time_relation(a: Column, b: Column, granularity: Column, precision: Column) -> Column:
    """``matches`` or ``differs`` for two nanosecond times at the coarser of both precisions; ``review`` if the file system's is unknown."""
    return F.when(granularity.isNull(), "review").when(F.abs(a - b) <= F.greatest(granularity, precision), "matches").otherwise("differs")
