"""Byte ranges of log files, and the tail of files that grow, roll and are truncated."""

import json
import os

import pytest

from wireloom.sources import growing, lines, router
from wireloom.sources.sinks import IncidentTable
from wireloom.streaming import live

from test_streaming import eve


def text_of(frame):
    return [r.value for r in frame.orderBy("batch_id", "block", "line_id").collect()]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_cut_anywhere_give_every_line_once(spark, tmp_path, monkeypatch, size):
    content = b"first\n\nsecond line\r\n" + "größe\n".encode() + b"x" * 200 + b"\n\n\nbroken \xff byte\nlast without end"
    (tmp_path / "a.log").write_bytes(content)
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "c.log").write_bytes(b"only\n")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    monkeypatch.setattr(growing, "READ_BYTES", 50)
    store = growing.Store([str(tmp_path)], False)
    reader = growing.RangeReader(store, size)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = content.decode("utf-8", "replace").replace("\r", "").split("\n")
    assert [r["value"] for r in rows if r["path"].endswith("a.log")] == want
    assert [r["value"] for r in rows if r["path"].endswith("c.log")] == ["only"]
    starts = [i for i in range(len(content)) if i == 0 or content[i - 1 : i] == b"\n"]
    assert [r["offset"] for r in rows if r["path"].endswith("a.log")] == starts
    assert all(r["block"] <= r["offset"] < r["block"] + size and r["block"] % size == 0 for r in rows)
    scanned = lines.scan_log_lines(spark, str(tmp_path), split_bytes=max(size, 7))
    assert text_of(scanned) == [*want, "only"]


def test_line_identity_does_not_follow_the_session(spark, tmp_path):
    """Split settings that change between the passes of format detection change no event."""
    rows = [f"2024-01-01T00:00:{i % 60:02d},10.0.0.{i},192.168.0.1,d{i}.com,alert {i}" for i in range(4000)]
    (tmp_path / "big.csv").write_text("\n".join(["timestamp,source_ip,destination_ip,domain,alert_type", *rows]))
    scanned = lines.scan_log_lines(spark, str(tmp_path), split_bytes=30_000)
    found = []
    try:
        for first, second in (("1", "50"), ("50", "1")):
            spark.conf.set("spark.sql.files.minPartitionNum", first)
            routes = router.choose_routes(scanned)
            spark.conf.set("spark.sql.files.minPartitionNum", second)
            events = lines.number_events(router.parse_logs(scanned, routes))
            found.append([(r.seq, r.alert_type) for r in events.orderBy("seq").collect()])
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] == [(i, f"alert {i}") for i in range(4000)]


class Feed:
    """A tail run step by step: each ``poll`` plays one trigger."""

    def __init__(self, folder, **options):
        settings = {"settle": 1e9, "size": 64, "most": 0, **options}
        self.reader = growing.TailReader(growing.Store([str(folder)], True), settings["size"], settings["settle"], settings["most"])
        self.at = json.loads(json.dumps(self.reader.initialOffset()))

    def poll(self):
        end = json.loads(json.dumps(self.reader.latestOffset()))
        spans = self.reader.partitions(self.at, end)
        rows = [r["value"] for p in spans for b in self.reader.read(p) for r in b.to_pylist()]
        self.at = end
        return rows


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_appended_lines_are_read_once(tmp_path):
    log = tmp_path / "eve.json"
    feed = Feed(tmp_path)
    assert feed.poll() == []
    append(log, "one\ntwo\nthr")
    assert feed.poll() == ["one", "two"]
    assert feed.poll() == []
    append(log, "ee\nfour\n")
    append(tmp_path / "other.json", "more\n")
    assert feed.poll() == ["three", "four", "more"]


def test_truncated_file_starts_over(tmp_path):
    log = tmp_path / "eve.json"
    feed = Feed(tmp_path)
    append(log, "one\ntwo\n")
    assert feed.poll() == ["one", "two"]
    log.write_text("new\n")
    assert feed.poll() == ["new"]
    log.write_text("ne")
    append(log, "w\n")
    assert feed.poll() == []


def test_rolled_file_is_finished_under_its_new_name(tmp_path):
    """Lines written between the last poll and the rotation are not lost, known ones not read again."""
    log = tmp_path / "eve.json"
    feed = Feed(tmp_path)
    append(log, "one\ntwo\n")
    assert feed.poll() == ["one", "two"]
    append(log, "three\n")
    os.rename(log, tmp_path / "eve.json.1")
    append(log, "a new file that is longer than the old one was\nand more\n")
    assert sorted(feed.poll()) == ["a new file that is longer than the old one was", "and more", "three"]
    assert feed.poll() == []


def test_copies_that_begin_alike_are_separate_files(tmp_path):
    feed = Feed(tmp_path)
    append(tmp_path / "a", "head\n1\n")
    assert feed.poll() == ["head", "1"]
    append(tmp_path / "b", "head\n1\n2\n")
    assert feed.poll() == ["head", "1", "2"]


def test_last_line_without_end_waits_until_the_file_settles(tmp_path):
    append(tmp_path / "a", "one\ntwo")
    assert Feed(tmp_path).poll() == ["one"]
    assert Feed(tmp_path, settle=0).poll() == ["one", "two"]


def test_batches_are_capped_at_whole_lines(tmp_path):
    for name in "abc":
        append(tmp_path / name, "".join(f"{name}{i:03d}\n" for i in range(100)))
    feed = Feed(tmp_path, most=120)
    got = []
    for _ in range(60):
        rows = feed.poll()
        assert len(rows) <= 26
        got += rows
    assert got == [f"{n}{i:03d}" for n in "abc" for i in range(100)]


def test_planned_batch_survives_a_rotation(tmp_path):
    log = tmp_path / "eve.json"
    feed = Feed(tmp_path)
    append(log, "one\ntwo\n")
    end = feed.reader.latestOffset()
    os.rename(log, tmp_path / "eve.json.1")
    append(log, "other\n")
    again = Feed(tmp_path)
    rows = [r["value"] for p in again.reader.partitions({"files": {}}, end) for b in again.reader.read(p) for r in b.to_pylist()]
    assert rows == ["one", "two"]
    (tmp_path / "eve.json.1").unlink()
    with pytest.raises(FileNotFoundError):
        again.reader.partitions({"files": {}}, end)


def test_live_detection_follows_a_growing_file(spark, tmp_path):
    """Appends, a rotation and restarts: every event becomes one incident."""
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "eve.json"

    def run():
        live.run_live(
            spark, str(folder), f"{tmp_path}/table", f"{tmp_path}/cp", f"{tmp_path}/feed", organization_id=3, once=True, growing=True
        ).awaitTermination()
        return IncidentTable(spark, f"{tmp_path}/table").read()

    append(log, "\n".join(eve(10)) + "\n{broken\n")
    assert run().count() == 10
    append(log, "\n".join(eve(5, 10)) + "\n")
    assert run().count() == 15
    append(log, "\n".join(eve(3, 15)) + "\n")
    os.rename(log, folder / "eve.json.1")
    append(log, "\n".join(eve(40, 18)) + "\n")
    table = run()
    assert table.count() == 58 and table.select("id").distinct().count() == 58
    assert table.select("source_ip").distinct().count() == 58
    assert spark.read.json(f"{tmp_path}/feed").count() == 58
