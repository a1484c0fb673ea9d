"""Time columns on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the accepted shape of a timestamp text. An offset or a bare year is refused.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?$"


def minutes(n: float | Column) -> Column:
    """An interval of ``n`` minutes; fractions are kept."""
    amount = n if isinstance(n, Column) else F.lit(float(n))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (amount * 60).cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 60


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def parse_iso(text: Column) -> Column:
    """Zone-free timestamp of an ISO text, or null when the text has another shape."""
    return F.when(text.rlike(ISO_PATTERN), F.regexp_replace(text, ",", ".").try_cast("timestamp_ntz"))


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, with six fraction digits only when the fraction is not zero."""
    # The text of a zone-free time does not depend on the session's zone; its fraction comes without trailing zeros.
    text = ts.cast("string")
    whole = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.when(F.length(text) > 19, F.concat(whole, F.lit("."), fraction)).otherwise(whole)


def step_of(ts: Column, step_minutes: int) -> Column:
    """Number of whole steps since the epoch: the equi-join key that interval joins are cut into."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(seconds_between(epoch, ts) / (step_minutes * 60))
