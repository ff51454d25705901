"""Date and time expressions, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
#: Modified Julian date of 1970-01-01.
MJD_EPOCH = 40_587


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, as long."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def from_micros(us: Column) -> Column:
    """The timestamp without time zone of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def mjd(us: Column) -> Column:
    """Modified Julian date of microseconds since 1970."""
    return us / (24.0 * MICROS_PER_HOUR) + MJD_EPOCH


def night(us: Column, longitude: Column | float = 0.0) -> Column:
    """Observing night: the date of local mean solar time less 12 hours; longitude null counts as 0."""
    lon = longitude if isinstance(longitude, Column) else F.lit(float(longitude))
    shift = (F.coalesce(lon, F.lit(0.0)) / 15 - 12) * MICROS_PER_HOUR
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((us + shift.cast("long")) / (24 * MICROS_PER_HOUR)).cast("int"))


def season_of(us: Column, ra_hours: Column | float) -> Column:
    """Year of the season centred on the solar opposition of a right ascension (hours)."""
    ra = ra_hours if isinstance(ra_hours, Column) else F.lit(float(ra_hours))
    # the sun stands at 0 h about 80 days into the year, opposite to 12 h
    opposition = F.pmod((ra - 12) / 24 * 365.25 + 80, F.lit(365.25))
    years = (us / (24.0 * MICROS_PER_HOUR) - opposition) / 365.25
    return (1970 + F.floor(years + 0.5)).cast("int")
