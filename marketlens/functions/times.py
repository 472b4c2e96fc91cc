"""Clock expressions: fixed-offset settlement days, civil windows, floors and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * F.lit(1e6)).cast("bigint"))


def settlement_start(day: Column, offset_hours: Column) -> Column:
    """UTC start of the local-standard day; the offset is fixed, daylight saving never applies."""
    return plus_seconds(day.cast("timestamp"), -offset_hours * 3600)


def settlement_end(day: Column, offset_hours: Column) -> Column:
    return plus_seconds(settlement_start(day, offset_hours), F.lit(86_400))


def settlement_date(ts: Column, offset_hours: Column) -> Column:
    """Local-standard date of a UTC instant: turns the day-interval join into an equi-join."""
    return F.to_date(plus_seconds(ts, offset_hours * 3600))


def civil_window(day: Column, zone: Column | str, start: str = "00:00", end: str = "24:00") -> tuple[Column, Column]:
    """UTC bounds of a local clock range on a date; an end at or before the start is next day."""

    def at(base: Column, clock: str) -> Column:
        text = F.concat(F.date_format(base, "yyyy-MM-dd"), F.lit(f" {clock}:00"))
        return F.to_utc_timestamp(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"), zone)

    low = at(day, start)
    if end == "24:00":
        return low, at(F.date_add(day, 1), "00:00")
    return low, at(F.date_add(day, 1) if end <= start else day, end)


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def floor_quarter_hour(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)


def segments(start: Column, end: Column, hours: int) -> Column:
    """Array of ``{seg_start, seg_end}`` that cover ``[start, end)``; the last may be short."""
    width = hours * 3600 * 1_000_000
    lo, hi = F.unix_micros(start), F.unix_micros(end)
    starts = F.filter(F.sequence(lo, F.greatest(lo, hi - 1), F.lit(width)), lambda s: s < hi)
    return F.transform(
        starts,
        lambda s: F.struct(
            F.timestamp_micros(s).alias("seg_start"),
            F.timestamp_micros(F.least(s + F.lit(width), hi)).alias("seg_end"),
        ),
    )


def hours_ending_at(end: Column, hours: int) -> Column:
    """The last ``hours`` whole UTC hours before an exclusive end."""
    last = F.date_trunc("hour", plus_seconds(end, F.lit(-0.000001)))
    return F.sequence(plus_seconds(last, F.lit(-3600 * (hours - 1))), last, F.expr("interval 1 hour"))


def day_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def naive(ts: Column) -> Column:
    """UTC clock reading without a zone, as the driver files store it."""
    return ts.cast("timestamp_ntz")
