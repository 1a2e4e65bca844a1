"""Contract status, SLA deadlines and French date rendering, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US, _HOUR_US = 86_400_000_000, 3_600_000_000
# Business hours (seconds of the day) and week days.
_OPEN_S, _CLOSE_S, _DAY_S = 8 * 3600, 18 * 3600, 10 * 3600
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def business_clock(ts: Column, timezone: str = "Europe/Paris") -> Column:
    """Naive wall-clock time of the business for a UTC instant."""
    return F.from_utc_timestamp(ts.cast("timestamp"), timezone).cast("timestamp_ntz")


def is_active(day: Column, start: Column, end: Column) -> Column:
    """Both bounds included."""
    return day.between(start, end)


def fr_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def contract_status(day: Column, start: Column, end: Column) -> Column:
    return (
        F.when(is_active(day, start, end), "contrat actif")
        .when(day > end, F.concat(F.lit("contrat échu (fin de validité le "), fr_date(end), F.lit(")")))
        .otherwise(F.concat(F.lit("contrat non encore en vigueur (début le "), fr_date(start), F.lit(")")))
    )


def add_microseconds(ts: Column, micros: Column) -> Column:
    """Add whole microseconds to a naive timestamp."""
    seconds = F.expr("INTERVAL '1' MICROSECOND")
    return ts + micros.cast("bigint") * seconds


def around_the_clock_deadline(ts: Column, hours: Column) -> Column:
    return ts + hours * F.expr("INTERVAL '1' HOUR")


def business_deadline(ts: Column, hours: Column) -> Column:
    """End of `hours` business hours (Monday to Friday, 08:00 to 18:00) counted from `ts`.

    Closed form: the start is expressed as a weekday and an offset inside the opening hours, the
    number of whole days is a division, and weekends are skipped five business days at a time.
    """
    weekday = F.weekday(ts)
    midnight = F.date_trunc("day", ts)
    second = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(midnight.cast("timestamp"))) / F.lit(1e6)
    closed_today = (weekday >= 5) | (second >= _CLOSE_S)
    next_week = (weekday >= 5) | ((weekday == 4) & (second >= _CLOSE_S))
    first_day = F.when(next_week, F.lit(0)).when(second >= _CLOSE_S, weekday + 1).otherwise(weekday)
    offset = F.when(closed_today | (second < _OPEN_S), F.lit(0.0)).otherwise(second - _OPEN_S)
    total = offset + hours * 3600
    whole_days = F.greatest(F.ceil(total / _DAY_S) - 1, F.lit(0)).cast("bigint")
    index = first_day + whole_days
    days = (
        -weekday + F.when(next_week, F.lit(7)).otherwise(F.lit(0))
        + F.lit(7) * F.floor(index / 5) + index % 5
    ).cast("bigint")
    micros = days * F.lit(_DAY_US) + F.round((F.lit(_OPEN_S) + total - whole_days * _DAY_S) * F.lit(1e6)).cast("bigint")
    return add_microseconds(midnight.cast("timestamp_ntz"), micros)


def sla_deadline(ts: Column, hours: Column, always_on: Column) -> Column:
    return F.when(always_on, around_the_clock_deadline(ts, hours)).otherwise(business_deadline(ts, hours))


def fr_datetime(ts: Column) -> Column:
    """E.g. "lundi 05/10/2026 à 11 h 00"."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.concat(
        F.get(names, F.weekday(ts)), F.lit(" "), fr_date(ts), F.lit(" à "),
        F.hour(ts).cast("string"), F.lit(" h "), F.date_format(ts, "mm"),
    )
