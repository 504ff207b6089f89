"""Watermarks: copies, late events, closed days."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wireloom.plans import queries
from wireloom.sources import json_lines
from wireloom.streaming import live, windows

KEY = ["source_ip", "destination_ip", "timestamp", "alert_type"]


def event(stamp, source="1.1.1.1", alert="Port Scan"):
    out = {"src_ip": source, "dest_ip": "2.2.2.2", "alert": alert, "domain": "x.com"}
    return json.dumps(out if stamp is None else {**out, "timestamp": stamp, "time": stamp})


@pytest.fixture
def feed(spark, tmp_path):
    """Files that a stream reads one per micro-batch, in the order in which they were added."""
    (tmp_path / "in").mkdir()

    class Feed:
        n = 0

        def add(self, *lines):
            path = tmp_path / "in" / f"{self.n:03d}.json"
            path.write_text("\n".join(lines))
            os.utime(path, (1_700_000_000 + 10 * self.n,) * 2)
            self.n += 1

        def run(self, make, name="out"):
            events = json_lines.normalize_generic_json(live.tail(spark, str(tmp_path / "in"), max_files=1))
            windows.append_to(make(events), f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp").awaitTermination()
            return spark.read.schema(make(events).schema).parquet(f"{tmp_path}/{name}")

    return Feed()


def stamps(frame):
    return sorted((r.source_ip, r.timestamp) for r in frame.collect())


def test_copies_and_late_events(spark, feed):
    unique = lambda e: windows.first_of_key(e, "1 hour").select(*KEY)
    feed.add(event("2024-01-01T10:00:00"), event("2024-01-01T10:00:00"), event("2024-01-01T10:00:00", alert="Bot"))
    feed.add(event("2024-01-01T10:30:00"), event("2024-01-01T10:00:00"))  # a late copy, within the delay
    feed.add(event("2024-01-01T09:45:00", "3.3.3.3"))  # late, but within the delay: kept
    assert len(feed.run(unique).collect()) == 4
    feed.add(event("2024-01-01T15:00:00"))
    feed.add(event("2024-01-01T15:10:00"))  # lateness goes by the watermark that the batch before this one set
    feed.add(event("2024-01-01T10:00:00"), event("2024-01-01T11:00:00", "4.4.4.4"))  # behind the watermark: dropped
    feed.add(event("2024-01-01T14:30:00", "5.5.5.5"), event("2024-01-01T15:00:00"))
    got = stamps(feed.run(unique))  # a second run resumes with the keys it remembers
    assert got == sorted([
        ("1.1.1.1", "2024-01-01T10:00:00"), ("1.1.1.1", "2024-01-01T10:00:00"), ("1.1.1.1", "2024-01-01T10:30:00"),
        ("3.3.3.3", "2024-01-01T09:45:00"), ("1.1.1.1", "2024-01-01T15:00:00"), ("1.1.1.1", "2024-01-01T15:10:00"), ("5.5.5.5", "2024-01-01T14:30:00"),
    ])


def test_events_without_an_instant(spark, feed):
    unique = lambda e: windows.first_of_key(e, "1 hour").select(*KEY)
    feed.add(event(None), event(None), event("no time"), event("2024-01-01T10:00:00"))
    feed.add(event(None), event("2024-01-01T10:00:00"))
    feed.add(event(None), event("2024-01-01T10:00:00"))
    assert stamps(feed.run(unique)) == [("1.1.1.1", "")] * 2 + [("1.1.1.1", "2024-01-01T10:00:00"), ("1.1.1.1", "no time")]


def test_days_close_behind_the_watermark(spark, feed):
    days = lambda e: windows.daily_counts(e, "6 hours")
    got = lambda: sorted(tuple(r) for r in feed.run(days).collect())
    feed.add(event("2024-01-01T10:00:00"), event("2024-01-01T11:00:00", alert="trojan"), event(None))
    feed.add(event("2024-01-02T02:00:00"))
    assert got() == []
    feed.add(event("2024-01-01T22:00:00"))  # late within the delay: counted
    feed.add(event("2024-01-02T07:00:00"))
    feed.add(event("2024-01-02T07:30:00"))
    first = got()
    assert [r[0] for r in first] == ["2024-01-01"] and sum(first[0][1:]) == 3
    feed.add(event("2024-01-01T23:00:00"))  # its day is closed: dropped
    feed.add(event("2024-01-03T06:30:00"))
    assert [(r[0], sum(r[1:])) for r in got()] == [("2024-01-01", 3), ("2024-01-02", 3)]


def test_plans_are_compiled(spark):
    """The parser with the live filter and the classification stay within what a generated method may hold."""
    lines = spark.createDataFrame([(1, "f", 0, 0, event("2024-01-01T10:00:00"))], "organization_id long, batch_id string, block long, line_id long, value string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert windows.daily_counts(live.tail_events(lines)).count() == 0
        assert windows.daily_counts(json_lines.parse_json(lines)).count() == 1
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_large_state_lies_on_disk_and_few_files_are_written(spark, tmp_path):
    """De-duplication stores what a micro-batch changed, and a folder of logs has a bounded number of files."""
    rows = [{"src_ip": f"10.0.0.{i % 7}", "dest_ip": "1.1.1.1", "time": "2024-01-01T00:00:00", "alert": f"Port Scan {i % 5}"} for i in range(70)]
    for part in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.log").write_text("".join(json.dumps(r) + "\n" for r in rows))
    events = json_lines.normalize_generic_json(live.tail(spark, str(tmp_path / "in"), max_files=1))
    unique = windows.first_of_key(events, "60 days").select("source_ip", "alert_type")
    windows.append_to(unique, str(tmp_path / "out"), str(tmp_path / "cp"), large_state=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 35
    assert list((tmp_path / "cp" / "state").rglob("*.changelog"))
    assert not set(windows.LARGE_STATE) & set(spark.conf.getAll)

    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("user_id"),
        F.lit("click").alias("event_type"), F.format_string('{"k": %d}', "id").alias("props"),
    )
    cores = spark.sparkContext.defaultParallelism
    events.repartition(5 * cores).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    folder = queries._generic_folder(spark, str(tmp_path / "sf"), 1)
    assert len(set(spark.read.text(folder).inputFiles())) <= 2 * cores and spark.read.text(folder).count() == 300
