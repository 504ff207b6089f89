"""Time stamps arrive as text (ISO or epoch) and stay text; these derive instants and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_ts(timestamp: Column) -> Column:
    """Instant of an ISO or epoch-seconds string, null when it is neither."""
    epoch = timestamp.try_cast("double")
    return F.coalesce(F.try_to_timestamp(timestamp), F.timestamp_seconds(epoch))


def utc_day(timestamp: Column) -> Column:
    """Day of the instant; sessions run in UTC."""
    return F.to_date(event_ts(timestamp))


def partition_day(timestamp: Column) -> Column:
    """UTC day as text, "Unknown" for a time stamp that is no instant; for storage by day."""
    return F.coalesce(F.date_format(utc_day(timestamp), "yyyy-MM-dd"), F.lit("Unknown"))


def text_day(timestamp: Column) -> Column:
    """Leading ten characters, "Unknown" when there is no time stamp."""
    present = F.coalesce(timestamp, F.lit("")) != ""
    return F.when(present, F.substring(timestamp, 1, 10)).otherwise("Unknown")
