"""Keyed and windowed state over event streams, bounded by a watermark on the event time."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wireloom.functions.times import event_ts
from wireloom.operators import dashboard
from wireloom.operators.incidents import INCIDENT_KEY, detect_suspicious

DELAY = "1 hour"
# keyed state that is large lies on disk, and a micro-batch writes what it changed; the engine's usual store copies all
# of a state in memory for every micro-batch
_STATE = "spark.sql.streaming.stateStore."
LARGE_STATE = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}rocksdb.trackTotalNumberOfRows": "false",
}


def with_event_time(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with ``event_time``, the instant of their stamp, and a watermark ``delay`` behind it."""
    return events.withColumn("event_time", event_ts(F.col("timestamp"))).withWatermark("event_time", delay)


def first_of_key(events: DataFrame, delay: str = DELAY, per_tenant: bool = True) -> DataFrame:
    """Each event of a stream once: the first to arrive of those with the same incident key.

    The key holds the time stamp, so copies share their event time. A key is remembered until the
    watermark is ``delay`` past it; whatever is older than the watermark when it arrives is late and
    dropped, copy or not. Null equals null in a key. Lateness goes by the
    watermark that the micro-batch before has left. Events without an instant never advance the
    watermark nor are they late; their key is forgotten when the watermark next advances.
    """
    keys = INCIDENT_KEY if per_tenant else INCIDENT_KEY[1:]
    return with_event_time(events, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """(day, high, medium, low) of suspicious events, one row per UTC day once it is closed.

    A day is closed when the watermark has passed its end; events that come later than that are
    dropped. Events without an instant belong to no day.
    """
    found = detect_suspicious(with_event_time(events, delay))
    days = found.groupBy(F.window("event_time", "1 day")).agg(*dashboard.risk_counts())
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "high", "medium", "low")


def append_to(frame: DataFrame, path: str, checkpoint: str, large_state: bool = False) -> StreamingQuery:
    """Work off what is there and append what is settled to a parquet table, exactly once.

    ``large_state`` keeps the state of a new checkpoint on disk, unless the session names a store itself;
    an old checkpoint goes on with the store that it has.
    """
    writer = frame.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    conf = frame.sparkSession.conf
    own = [k for k in LARGE_STATE if k not in conf.getAll] if large_state else []
    try:
        for k in own:
            conf.set(k, LARGE_STATE[k])
        return writer.start()
    finally:
        for k in own:
            conf.unset(k)


def closed_timeline(spark: SparkSession, path: str, days: int = 10) -> DataFrame:
    """The last ``days`` closed days of a table of ``daily_counts`` with their shares."""
    table = spark.read.schema("day string, high long, medium long, low long").parquet(path)
    return dashboard.timeline_shares(table, days)


def mark_end(spark: SparkSession, folder: str, after: dt.datetime) -> None:
    """Add a line stamped ``after`` to a folder that is tailed: it moves the watermark past all days before.

    The line is an event of its own and stays open itself.
    """
    line = {
        "event_type": "alert", "timestamp": after.strftime("%Y-%m-%dT%H:%M:%S"), "src_ip": "0.0.0.0", "dest_ip": "0.0.0.0",
        "domain": "end.of.feed",
    }
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.mode("append").text(folder)
