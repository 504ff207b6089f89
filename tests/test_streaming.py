"""Live detection: same result as batch, safe to repeat and to restart."""

import json

from wireloom.plans.detect import detect_incidents
from wireloom.sources import lines, router
from wireloom.sources.sinks import IncidentTable, alert_feed, write_feed
from wireloom.streaming import live

KEY = ["source_ip", "destination_ip", "timestamp", "alert_type", "risk_level", "summary"]


def eve(n, start=0):
    out = []
    for i in range(start, start + n):
        out.append(json.dumps({
            "timestamp": f"2026-03-2{i % 3}T00:00:{i % 60:02d}Z", "event_type": "alert", "src_ip": f"10.0.0.{i}",
            "dest_ip": "203.0.113.5", "alert": {"signature": "Port Scan" if i % 2 else "trojan x", "severity": 3},
        }))
    return out


def run(spark, base, once=True, **options):
    query = live.run_live(spark, f"{base}/in", f"{base}/table", f"{base}/cp", f"{base}/feed", organization_id=3, once=once, **options)
    query.awaitTermination()
    return IncidentTable(spark, f"{base}/table")


def test_stream_equals_batch_resumes_and_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        (folder / f"{f}.json").write_text("\n".join([*eve(10, 10 * f), "{broken", "5", ""]))
    table = run(spark, tmp_path, max_files=2)
    batch = detect_incidents(router.read_events(lines.scan_log_lines(spark, str(folder), 3)))
    stored = table.read()
    assert stored.count() == 30
    assert stored.select(KEY).exceptAll(batch.select(KEY)).count() == 0
    assert stored.select("id").distinct().count() == 30

    # restart: nothing new, then one more file with ten known and five new events
    run(spark, tmp_path)
    assert table.read().count() == 30
    (folder / "more.json").write_text("\n".join(eve(15, 20)))
    run(spark, tmp_path)
    assert table.read().count() == 35

    # the feed announces every stored incident once
    feed = spark.read.json(f"{tmp_path}/feed")
    assert feed.count() == 35
    assert {r.organization_id for r in feed.select("organization_id").distinct().collect()} == {3}
    assert set(json.loads(feed.first().payload)) == {
        "incident_id", "source_ip", "destination_ip", "alert_type", "risk_level", "timestamp", "mitre_tactic",
        "mitre_technique", "attack_category", "threat_score", "risk_tier",
    }


def test_repeated_batch_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(8)))
    table = IncidentTable(spark, f"{tmp_path}/table")
    run_batch = live.process_batch(table, f"{tmp_path}/feed")
    raw = live.tail_events(lines.scan_log_lines(spark, f"{tmp_path}/in", 3))
    for _ in range(2):
        run_batch(raw, 7)
    assert table.read().count() == 8
    assert spark.read.json(f"{tmp_path}/feed").count() == 8


def test_purge_drops_one_tenant(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(6)))
    table = IncidentTable(spark, f"{tmp_path}/table")
    for org in (1, 2):
        events = router.read_events(lines.scan_log_lines(spark, f"{tmp_path}/in", org), "json")
        table.append_new(detect_incidents(events))
    write_feed(alert_feed(table.read()), f"{tmp_path}/feed")
    assert spark.read.json(f"{tmp_path}/feed").count() == 12
    assert table.purge(1, "ADMIN") == 6
    assert [r.organization_id for r in table.read().select("organization_id").distinct().collect()] == [2]


def test_reads_prune_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(6)))
    table = IncidentTable(spark, f"{tmp_path}/table")
    incoming = detect_incidents(router.read_events(lines.scan_log_lines(spark, f"{tmp_path}/in", 1), "json"))
    table.append_new(incoming)
    plan = table.stored_for(incoming.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event_day" in plan.split("PartitionFilters")[1]


def _incident(spark, rows):
    from wireloom.schemas import INCIDENT_SCHEMA

    blank = {f.name: None for f in INCIDENT_SCHEMA}
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], INCIDENT_SCHEMA)


def test_epoch_stamps_and_null_tenants_are_stored_once(spark, tmp_path):
    rows = [{"id": i, "organization_id": None if i % 2 else 1, "timestamp": str(1773964800 + i), "source_ip": "10.0.0.1",
             "destination_ip": "10.0.0.2", "alert_type": "x", "status": "Active"} for i in range(40)]
    table = IncidentTable(spark, f"{tmp_path}/table")
    incoming = _incident(spark, rows)
    table.append_new(incoming)
    table.append_new(incoming)
    assert table.read().count() == 40
    assert table.read().select("event_day").distinct().count() == 1


def test_half_written_epoch_is_replaced(spark, tmp_path):
    """An append that broke off half-way and is repeated loses no row, doubles none and announces all."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(20)))
    (tmp_path / "in" / "b.json").write_text("\n".join(eve(4, 18)))
    table = IncidentTable(spark, f"{tmp_path}/table")
    parsed = live.tail_events(lines.scan_log_lines(spark, f"{tmp_path}/in/a.json", 3))
    run_batch = live.process_batch(table, f"{tmp_path}/feed", stream="s")
    run_batch(parsed, 7)
    whole = sorted(map(str, table.read().collect()))
    half = table.rows().limit(9).drop("event_day", "epoch").collect()
    table.write_epoch(spark.createDataFrame(half, table.rows().drop("event_day", "epoch").schema), "s-7")
    assert table.read().count() == 9
    for _ in range(2):
        run_batch(parsed, 7)
        assert sorted(map(str, table.read().collect())) == whole and len(whole) == 20
    # an earlier epoch still hides what it has stored
    run_batch(live.tail_events(lines.scan_log_lines(spark, f"{tmp_path}/in/b.json", 3)), 8)
    assert table.read().count() == 22
    feed = spark.read.json(f"{tmp_path}/feed")
    assert feed.count() == 22 and feed.select("incident_id").distinct().count() == 22


def test_status_changes_are_merged_on_read(spark, tmp_path):
    rows = [{"id": i, "organization_id": i % 3 if i < 23 else None, "timestamp": f"2026-03-2{i % 4}T00:00:00", "status": "Active"} for i in range(24)]
    table = IncidentTable(spark, f"{tmp_path}/table")
    table.append(_incident(spark, rows))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    schema = "organization_id long, incident_id long, action string, role string, changed_at string"
    change = lambda *r: table.change_status(spark.createDataFrame(list(r), schema), f"{tmp_path}/feed").collect()
    t = "2026-03-25T00:00:0{}".format
    feed = change(
        (0, 3, "approve", "ADMIN", t(1)), (0, 3, "reject", "ANALYST", t(2)),  # twice the same incident: the later one
        (1, 4, "reject", "ANALYST", t(2)), (1, 4, "approve", "ANALYST", t(1)),
        (2, 5, "approve", "VIEWER", t(1)),  # a viewer
        (1, 6, "approve", "ADMIN", t(1)),  # another tenant's incident
        (0, 999, "approve", "ADMIN", t(1)), (0, 9, "delete", "ADMIN", t(1)), (None, 23, "approve", "ADMIN", t(1)),
    )
    assert {(r.incident_id, json.loads(r.payload)["status"]) for r in feed} == {(3, "Rejected"), (4, "Rejected")}
    states = {r.id: r.status for r in table.read().collect()}
    assert table.read().count() == 24
    assert {i: s for i, s in states.items() if s != "Active"} == {3: "Rejected", 4: "Rejected"}
    # a later call wins over an earlier one, an older request does not
    change((0, 3, "approve", "ADMIN", t(5)), (1, 4, "approve", "ADMIN", t(0)))
    states = {r.id: r.status for r in table.read().collect()}
    assert (states[3], states[4]) == ("Approved", "Rejected")
    # no incident was rewritten, so a stream may append meanwhile
    assert all(p.stat().st_mtime_ns == m for p, m in before.items())
    table.append(_incident(spark, [{"id": 100, "organization_id": 0, "timestamp": "2026-03-20", "status": "Active"}]))
    state = sorted(map(str, table.read().collect()))
    table.compact()
    assert sorted(map(str, table.read().collect())) == state and table.status_changes() is None
    assert table.rows().select("epoch").distinct().count() == 1
    change((0, 0, "approve", "ADMIN", t(7)))
    assert {r.id: r.status for r in table.read().collect()}[0] == "Approved"
    assert table.purge(0, "ADMIN") == 9
    assert table.read().count() == 16 and not (tmp_path / "table" / "_status" / "organization_id=0").exists()


def test_ids_do_not_overflow_at_late_epochs(spark, tmp_path):
    from wireloom.streaming.live import process_batch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(3)))
    raw = live.tail_events(lines.scan_log_lines(spark, f"{tmp_path}/in", 1))
    table = IncidentTable(spark, f"{tmp_path}/table")
    process_batch(table)(raw, 1 << 24)
    assert table.read().agg({"id": "min"}).first()[0] >= 1 << 56


def test_incoming_incidents_are_settled_before_they_are_compared(spark, tmp_path):
    """Days, comparison and rows to store read a stored copy, not the detection three times."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(eve(8)))
    found = detect_incidents(router.read_events(lines.scan_log_lines(spark, f"{tmp_path}/in", 3)))
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()
    fresh = IncidentTable(spark, f"{tmp_path}/table").new_incidents(found)
    assert "Window" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    assert fresh.count() == 8
