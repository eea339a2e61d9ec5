"""Numbers, durations and points in time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mark that stands for "never synced".
EPOCH = "0001-01-01 00:00:00"


def as_column(value: Column | dt.datetime | str) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def duration_ms(text: Column) -> Column:
    """``hh:mm:ss.fff`` as whole milliseconds; other texts give NULL."""
    parts = F.split(text, ":")
    hours = F.try_element_at(parts, F.lit(1)).try_cast("decimal(12,0)")
    minutes = F.try_element_at(parts, F.lit(2)).try_cast("decimal(12,0)")
    seconds = F.try_element_at(parts, F.lit(3)).try_cast("decimal(16,6)")
    total = (hours * 3600 + minutes * 60 + seconds) * 1000
    return F.when(F.size(parts) == 3, F.floor(total).cast("long"))


def interval_ms(interval: Column) -> Column:
    """A day-time interval as whole milliseconds."""
    whole = interval.cast("interval day to second")

    def part(name: str) -> Column:
        return F.extract(F.lit(name), whole)

    seconds = (
        part("DAY").cast("long") * 86400
        + part("HOUR").cast("long") * 3600
        + part("MINUTE").cast("long") * 60
    )
    return F.floor(
        (seconds.cast("decimal(20,6)") + part("SECOND").cast("decimal(20,6)")) * 1000
    ).cast("long")


def now_seconds() -> Column:
    return F.date_trunc("second", F.current_timestamp())


def mark_or_epoch(mark: Column) -> Column:
    return F.coalesce(mark, F.lit(EPOCH).cast("timestamp"))


def cutoff(as_of: Column | dt.datetime | str, hours: int = 2) -> Column:
    return as_column(as_of) - F.make_dt_interval(hours=F.lit(hours))


def cpc_micros(cpc: Column) -> Column:
    """Bid in millionths, truncated; NULL and 0 give NULL."""
    return F.when(cpc != 0, (cpc * F.lit(1e6)).cast("long"))


def floor_zero(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), c)


def price_double(price: Column) -> Column:
    """``value`` of a price struct as double."""
    return price.getField("value").cast("double")


def init_counter(existing: Column) -> Column:
    """An increment by nothing: create as 0, keep if present."""
    return F.coalesce(existing, F.lit(0)).cast("long")
