"""Detection on known alert kinds, de-duplication, lifecycle, dashboards, report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wireloom.operators import dashboard, evaluation, incidents, sequences
from wireloom.operators.features import fit_baseline, flow_features, robust_zscore, scale_with, tidy
from wireloom.plans import detect, report
from wireloom.schemas import INCIDENT_SCHEMA
from wireloom.sources import router

# kind of alert, domain, rows; then risk, status, category, tier, tactic, technique
KINDS = [
    ("Port Scan", "", 5, "Medium", "Monitoring", "PortScan", 2, "TA0043", "T1046"),
    ("DDoS Flood", "", 3, "Medium", "Monitoring", "DDoS", 3, "TA0001", "T1190"),
    ("Bot C2 Beacon", "xk2mq9f.biz", 3, "High", "Active", "Bot", 3, "TA0011", "T1071"),
    ("SSH Brute Force", "", 3, "Medium", "Monitoring", "SSH-Patator", 2, "TA0001", "T1190"),
    ("Ransomware Staging", "ransomware-c2.xyz", 2, "High", "Active", "Ransomware", 3, "TA0011", "T1568.002"),
    ("DoS Flood", "", 3, "Medium", "Monitoring", "DoS-Hulk", 3, None, None),
    ("FTP Brute Force", "", 3, "Medium", "Monitoring", "FTP-Patator", 2, "TA0001", "T1190"),
    ("Heartbleed Exploit", "heartbleed-test.io", 1, "High", "Active", "Heartbleed", 3, "TA0001", "T1190"),
    ("Data Exfiltration", "", 2, "High", "Active", "Infiltration", 3, "TA0010", "T1041"),
    ("Web Brute Force", "", 3, "Medium", "Monitoring", "Web-BruteForce", 2, "TA0001", "T1190"),
]


@pytest.fixture(scope="module")
def sample(spark):
    """The known kinds as one CSV upload."""
    text = ["timestamp,source_ip,destination_ip,domain,alert_type,bytes_sent"]
    for n, (alert, domain, rows, *_) in enumerate(KINDS):
        text += [f"2026-03-20T08:{n:02d}:{i:02d},10.0.{n}.5,203.0.113.{n},{domain},{alert},80" for i in range(rows)]
    rows = [(1, "upload", 0, i, v) for i, v in enumerate(text)]
    frame = spark.createDataFrame(rows, "organization_id long, batch_id string, block long, line_id long, value string")
    return router.read_events(frame).cache()


def test_known_kinds(sample):
    found = detect.detect_incidents(sample)
    got = {
        (r.alert_type, r.risk_level, r.status, r.attack_category, r.risk_tier, r.mitre_tactic_id, r.mitre_technique_id,
         r.threat_score): r["count"]
        for r in found.groupBy("alert_type", "risk_level", "status", "attack_category", "risk_tier", "mitre_tactic_id",
                               "mitre_technique_id", "threat_score").count().collect()
    }
    assert got == {(k[0], *k[3:9], 0.65): k[2] for k in KINDS}


def test_first_event_of_a_pair_decides(spark, sample):
    pair = sample.withColumns({"source_ip": F.lit("1.1.1.1"), "destination_ip": F.lit("2.2.2.2")})
    found = detect.detect_incidents(pair)
    assert [r[0] for r in found.select("attack_category").distinct().collect()] == ["PortScan"]


def test_dedup_is_idempotent_and_keeps_batch_copies(spark, sample):
    once = incidents.detect_suspicious(sample)
    twice = once.withColumn("seq", F.col("seq") + 1000)
    both = once.unionByName(twice)
    nothing = once.limit(0)
    assert incidents.dedup_incidents(both, nothing).count() == 56
    assert incidents.dedup_incidents(both, nothing, within_batch=True).count() == 28
    low = incidents.dedup_incidents(both, nothing, within_batch=True).agg(F.max("seq")).first()[0]
    assert low < 1000
    assert incidents.dedup_incidents(both, once).count() == 0
    other = once.withColumn("organization_id", F.lit(2).cast("long"))
    assert incidents.dedup_incidents(other, once).count() == 28
    assert incidents.dedup_incidents(other, once, per_tenant=False).count() == 0


def test_null_keys_match_each_other(spark, sample):
    bare = incidents.detect_suspicious(sample).withColumn("timestamp", F.lit(None).cast("string"))
    assert incidents.dedup_incidents(bare, bare).count() == 0


def test_status_changes(spark):
    row = lambda i, org: (i, org, *[None] * 19)
    stored = spark.createDataFrame([row(1, 1), row(2, 1), row(3, 2), row(4, 1)], INCIDENT_SCHEMA).withColumn("status", F.lit("Active"))
    changes = spark.createDataFrame(
        [(1, 1, "approve", "ANALYST", 1), (1, 1, "reject", "ADMIN", 2), (1, 2, "approve", "VIEWER", 9),
         (1, 3, "approve", "ADMIN", 1), (1, 4, "unknown", "ADMIN", 1)],
        "organization_id long, incident_id long, action string, role string, changed_at int",
    )
    got = {r.id: r.status for r in incidents.apply_status_changes(stored, changes).collect()}
    assert got == {1: "Rejected", 2: "Active", 3: "Active", 4: "Active"}
    assert incidents.purge_tenant(stored, 1, "ADMIN").count() == 1
    with pytest.raises(PermissionError):
        incidents.purge_tenant(stored, 1, "ANALYST")


def test_timeline_unknown_day_and_risk(spark):
    rows = [(None, "odd"), ("", "High"), *[(f"2026-01-{d:02d}T00", "Medium") for d in range(1, 13)]]
    frame = spark.createDataFrame(rows, "timestamp string, risk_level string")
    got = dashboard.risk_timeline(frame).collect()
    assert len(got) == 10 and got[-1].day == "Unknown" and got[0].day == "2026-01-04"
    assert (got[-1].high, got[-1].low, got[-1].height_pct) == (1, 1, 100.0)


def test_heatmap_of_nothing(spark):
    empty = spark.createDataFrame([], "mitre_tactic string")
    got = dashboard.mitre_heatmap(empty).collect()
    assert len(got) == 14 and all(r.incidents == 0 and r.intensity == 0 for r in got)


def test_facets_and_search(spark, sample):
    found = detect.detect_incidents(sample).cache()
    assert incidents.facet_filter(found, "all").count() == 28
    assert incidents.facet_filter(found, "high").count() == incidents.facet_filter(found, "active").count() == 8
    assert incidents.search_incidents(found, "RECON").count() == 5
    assert incidents.search_incidents(found, "").count() == 28
    assert dashboard.high_risk_list(found).count() == 8


def test_report(spark, sample, tmp_path):
    found = detect.detect_incidents(sample)
    lines = report.ordered(report.daily_report(found, dt.date(2026, 3, 20))).collect()
    text = [r.line for r in lines]
    assert text[6] == "  Total Incidents Today : 28" and "HIGH RISK INCIDENTS (8)" in text
    ids = [int(t.split("#")[1]) for t in text if t.startswith("  Incident #")]
    assert len(ids) == 28 and ids[:8] == sorted(ids[:8], reverse=True)
    assert "  None" in text  # no low-risk incident
    none = report.daily_report(found, dt.date(2026, 3, 21)).filter("line like '  Total%'").first().line
    assert none.endswith(": 0")
    report.write_report(report.daily_report(found, dt.date(2026, 3, 20)), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(text)


def test_sequences_by_batch_size(spark):
    sizes = {"a": 1, "b": 19, "c": 20, "d": 21, "e": 50}
    rows = [(1, b, i, float(i)) for b, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "organization_id long, batch_id string, seq long, v double")
    made = sequences.event_sequences(frame, ["v"]).collect()
    counts = {}
    for r in made:
        counts[r.batch_id] = counts.get(r.batch_id, 0) + 1
        assert len(r.steps) == 20
        real = [s[0] for s in r.steps[: r.real_steps]]
        assert real == [float(r.seq_id * 20 + i) for i in range(r.real_steps)]
        assert all(s == [0.0] for s in r.steps[r.real_steps:])
    assert counts == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2}


def test_majority_tie_goes_to_lowest(spark):
    frame = spark.createDataFrame([(1, "a", i, 5 if i < 10 else 3) for i in range(20)],
                                  "organization_id long, batch_id string, seq long, label int")
    row = sequences.sequence_majority(frame).first()
    assert (row.label, row.votes) == (3, 10)


def test_zscore_can_be_undone_and_fitted(spark, sample):
    from wireloom.functions import fixed_values as fixed

    raw = flow_features(sample, ["seq"]).orderBy("seq").first().asDict()
    scaled = robust_zscore(flow_features(sample, ["seq"])).orderBy("seq").first().asDict()
    for name, median, iqr in zip(fixed.FEATURE_NAMES, fixed.FEATURE_MEDIANS, fixed.FEATURE_IQRS):
        assert scaled[name] * (iqr + 1e-8) + median == pytest.approx(raw[name], abs=1e-6)
    features = flow_features(sample, ["seq"], ["ip_diversity"])
    baseline = fit_baseline(features, ["ip_diversity"])
    values = sorted(r[0] for r in features.select("ip_diversity").collect())
    assert values[0] <= baseline["ip_diversity"][0] <= values[-1]
    centred = scale_with(features, baseline)
    assert abs(centred.agg(F.percentile_approx("ip_diversity", 0.5, 10000)).first()[0]) < 1e-9


def test_tidy(spark):
    frame = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in frame.select(tidy(F.col("v"))).collect()] == [0.0, 1e6, -1e6, 0.0, 2.0]


def test_parsed_ports_are_optional(spark, sample):
    with_ports = sample.withColumns({"destination_port": F.lit("53"), "source_port": F.lit("1024")})
    plain = flow_features(with_ports, ["seq"], ["dst_port", "src_port", "protocol"]).first()
    parsed = flow_features(with_ports, ["seq"], ["dst_port", "src_port", "protocol"], use_parsed_ports=True).first()
    assert (plain.dst_port, plain.src_port, plain.protocol) == (443, 52000, 6)
    assert (parsed.dst_port, parsed.src_port, parsed.protocol) == (53, 1024, 17)


def test_split_is_exact_disjoint_and_stable(spark):
    frame = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))
    split = evaluation.stratified_split(frame, "id")
    got = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 135, (0, "validation"): 135, (0, "train"): 630,
                   (1, "test"): 15, (1, "validation"): 15, (1, "train"): 70}
    again = evaluation.stratified_split(frame.repartition(7), "id")
    assert split.exceptAll(again).count() == 0


def test_report_of_perfect_and_absent_classes(spark):
    frame = spark.createDataFrame([(0, 0), (1, 2), (1, 1)], "label int, prediction int")
    got = {r["class"]: r for r in evaluation.classification_report(frame).collect()}
    assert got["2"].precision == 0 and got["2"].recall == 0 and got["2"].support == 0
    assert got["1"].precision == 1 and got["1"].recall == 0.5
    assert got["accuracy"].f1 == pytest.approx(2 / 3)
