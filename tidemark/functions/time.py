"""Calendar arithmetic on zone-less timestamps (one UTC number line)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.config import YEAR_DAYS, Span

MICROS_PER_DAY = 8.64e10


def to_ts(text, strict: bool = True) -> Column:
    """Parse date-only and offset stamps to UTC; unparsable text raises, or is null when not strict."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    if not strict:
        return parsed
    bad = F.raise_error(F.concat(F.lit("unparsable timestamp: "), text)).cast("timestamp_ntz")
    return F.when(text.isNotNull() & parsed.isNull(), bad).otherwise(parsed)


def midnight(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.cast("date").cast("timestamp_ntz")


def span_of(span: Span, times=1) -> Column:
    """The span, ``times`` over, as an interval column. ``times`` may be a column."""
    times = times if isinstance(times, Column) else F.lit(times)
    amount = (times * F.lit(span.n)).cast("int")
    if span.unit == "year":
        return F.make_ym_interval(amount)
    if span.unit == "day":
        return F.make_dt_interval(amount)
    raise ValueError(f"unknown span unit {span.unit!r}")


def days_between(start, end) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY)


def years_between(start, end) -> Column:
    return days_between(start, end) / F.lit(YEAR_DAYS)


def minus_days(ts, days: float) -> Column:
    """``ts`` minus a fixed number of days, which may be fractional."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = int(days)
    seconds = (days - whole) * 86400.0
    return ts - F.make_dt_interval(F.lit(whole), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
