"""New York and broker clocks as Catalyst expressions.  Sessions must run with a UTC session time zone."""

from pyspark.sql import Column, functions as F

from .scalars import col

NEW_YORK = "America/New_York"


def ny_local(t="time") -> Column:
    return F.from_utc_timestamp(col(t), NEW_YORK)


def ny_minute(t="time") -> Column:
    n = ny_local(t)
    return F.hour(n) * 60 + F.minute(n)


def ny_weekday(t="time") -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ny_local(t)) - 1


def ny_day(t="time") -> Column:
    return F.unix_date(F.to_date(ny_local(t)))


def session_index(t="time") -> Column:
    """Trading day number, rolling at 17:00 New York."""
    return F.unix_date(F.to_date(ny_local(t) - F.expr("INTERVAL 17 HOURS")))


def broker_local(t="time") -> Column:
    """UTC+3 while New York is on daylight time, else UTC+2: always New York plus seven hours."""
    return ny_local(t) + F.expr("INTERVAL 7 HOURS")


def broker_day(t="time") -> Column:
    return F.unix_date(F.to_date(broker_local(t)))


def broker_week(t="time") -> Column:
    return F.floor((broker_day(t) + 3) / 7)


def server_to_utc(t) -> Column:
    """Server wall clock (New York + 7 h) to UTC."""
    return F.to_utc_timestamp(col(t) - F.expr("INTERVAL 7 HOURS"), NEW_YORK)


def hhmm(v) -> int:
    v = int(round(max(float(v), 0.0)))
    return v // 100 * 60 + v % 100


def in_window(minute, start: int, stop: int) -> Column:
    """Half-open minute window; wraps midnight when start > stop."""
    m = col(minute)
    return (m >= start) & (m < stop) if start <= stop else (m >= start) | (m < stop)


def in_sessions(minute, windows) -> Column:
    out = F.lit(False)
    for a, b in windows:
        out = out | in_window(minute, a, b)
    return out


def weekday_in(mask: int, t="time") -> Column:
    return ny_weekday(t).isin([d for d in range(7) if mask >> d & 1])


def past_weekend_cutoff(t="time", friday_hhmm: int = 1600) -> Column:
    d = ny_weekday(t)
    return ((d == 5) & (ny_minute(t) >= hhmm(friday_hhmm))) | (d == 6)


def swap_nights(entry, exit_) -> Column:
    """17:00 New York boundaries crossed; the boundary on a Wednesday counts three."""
    a, b = session_index(entry), session_index(exit_)
    # Boundary days are a+1 .. b.  Day 0 of the epoch is a Thursday, so Wednesdays are days = 6 (mod 7).
    wednesdays = F.floor((b + 1) / 7) - F.floor((a + 1) / 7)
    return F.when(col(exit_) > col(entry), b - a + 2 * wednesdays).otherwise(F.lit(0)).cast("long")


def iso_week(t="time") -> Column:
    return F.weekofyear(col(t))
