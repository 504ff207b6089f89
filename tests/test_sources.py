"""Parsers, file routing and file scans on edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from wireloom.sources import flows, json_lines, lines, router


def as_lines(spark, text, batch="f"):
    rows = [(1, batch, 0, i, v) for i, v in enumerate(text)]
    return spark.createDataFrame(rows, "organization_id long, batch_id string, block long, line_id long, value string")


def events(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("line_id").collect()]


ENDS = {"src_ip": "1.1.1.1", "dest_ip": "2.2.2.2"}


def test_eve_severity_and_dns(spark):
    objects = [
        {"event_type": "alert", **ENDS, "alert": {"signature": "s", "severity": s}} for s in (1, 2, 3)
    ] + [
        {"event_type": "alert", **ENDS, "alert": {"category": "c"}},
        {"event_type": "dns", **ENDS, "dns": {"queries": []}},
        {"event_type": "dns", **ENDS, "dns": {"queries": [{"rrname": "q.com"}]}},
        {"event_type": "dns", **ENDS, "dns": {"queries": [], "answers": [{"rrname": "a.com"}]}},
        {"event_type": "flow", **ENDS, "proto": "TCP"},
        {"event_type": "netflow", **ENDS},
        {"event_type": "alert", "src_ip": None, "source_ip": "3.3.3.3", "destination_ip": "4.4.4.4"},
        {"event_type": "alert", "src_ip": "1.1.1.1"},
    ]
    got = events(json_lines.parse_json(as_lines(spark, map(json.dumps, objects))), "alert_type", "domain", "risk_level")
    assert got == [
        ("s", "", "High"), ("s", "", "Medium"), ("s", "", "Low"), ("c", "", "Low"), ("dns", "", "Low"),
        ("dns-query: q.com", "q.com", "Low"), ("dns-query: a.com", "a.com", "Low"), ("flow:tcp", "", "Low"),
        ("netflow", "", "Low"), ("alert", "", "Low"),
    ]


def test_truth_of_json_values(spark):
    """Zero, false and empty values are passed over where a truth test decides; their texts are not."""
    alert = lambda s: {"event_type": "alert", **ENDS, "alert": {"signature": "s", "severity": s}}
    severities = [1, "1", 1.0, 1.9, True, False, 2, "2", None, [1], 3]
    got = events(json_lines.parse_json(as_lines(spark, [json.dumps(alert(s)) for s in severities])), "risk_level")
    assert [r for (r,) in got] == ["High", "Low", "High", "Low", "High", "Low", "Medium", "Low", "Low", "Low", "Low"]
    objects = [
        {"event_type": "alert", "src_ip": 0, "source_ip": "3.3.3.3", "dest_ip": "2.2.2.2"},
        {"event_type": "alert", "src_ip": "0", "source_ip": "3.3.3.3", "dest_ip": "2.2.2.2"},
        {"event_type": "alert", "src_ip": 7, "dest_ip": "2.2.2.2"},
        {"event_type": "alert", "src_ip": False, "source_ip": 0.0, "dest_ip": "2.2.2.2"},
        {"src": "1", "dst": "2", "alert": False, "type": "t"}, {"src": "1", "dst": "2", "alert": "false"},
        {"src": "1", "dst": "2", "alert": 0.0, "signature": [], "type": "t"}, {"src": "1", "dst": "2", "alert": {}, "type": "0"},
        {"src": "1", "dst": "2", "hostname": "a: 0, b", "domain": 0, "alert": "x"},
        {"src": "1", "dst": "2", "hostname": 'q": 0, \\', "x": {"y": -0.0e5, "z": [0, False]}, "domain": "d", "alert": "é" * 20_000, "last": 0},
    ]
    got = events(json_lines.parse_json(as_lines(spark, map(json.dumps, objects))), "source_ip", "alert_type", "domain")
    assert got == [
        ("3.3.3.3", "alert", ""), ("0", "alert", ""), ("7", "alert", ""), ("1", "t", ""), ("1", "false", ""), ("1", "t", ""),
        ("1", "0", ""), ("1", "x", "a: 0, b"), ("1", "é" * 20_000, "d"),
    ]


def test_dialects(spark):
    objects = [
        {"event_type": "dns", "src_ip": None}, {"event_type": "dns"}, {"id.orig_h": "1"}, {"_path": "conn"},
        {"orig_h": None, "x": 1}, {"event_type": "", "src_ip": "1"}, {},
    ]
    text = [json.dumps(o) for o in objects] + ["5", "[1]", "{bad", ""]
    got = [d for (d,) in events(json_lines.with_dialect(as_lines(spark, text)), "dialect")]
    assert got == ["eve", "generic", "zeek", "zeek", "zeek", "generic", "generic", None, None, None, None]


def test_generic_alert_may_be_an_object(spark):
    objects = [
        {"src": "1", "dst": "2", "alert": {"signature": "s"}}, {"src": "1", "dst": "2", "alert": {"category": "c"}},
        {"src": "1", "dst": "2", "alert": {}, "type": "t"}, {"src": "1", "dst": "2", "alert": "text"},
        {"src": "1", "dst": "2", "alert_type": "first", "alert": {"signature": "s"}}, {"src": "1"},
    ]
    got = events(json_lines.parse_json(as_lines(spark, map(json.dumps, objects))), "alert_type")
    assert got == [("s",), ("c",), ("t",), ("text",), ("first",)]


def test_corrupt_lines_are_counted_and_ratio_is_strict(spark):
    good = json.dumps({"src": "1", "dst": "2"})
    text = ["", good, "5", "[1]", "", "{bad", ""]
    profile = router.file_profile(as_lines(spark, text)).first()
    assert (profile.n_lines, profile.n_json, profile.n_corrupt) == (5, 1, 3)
    accepted = router.file_profile(as_lines(spark, text)).select(router.json_accepted()).first()[0]
    assert accepted is False  # one in five is not more than a fifth


HEAD = ["#separator \\x09", "#path\tx.conn", "#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tconn_state"]


def test_zeek_rows(spark):
    body = ["1.5\t1.1.1.1\t5\t2.2.2.2\tS0", "1.5\t-\t5\t2.2.2.2\tSF", "a\tb\tc", "2.5\t1.1.1.1\t(empty)\t2.2.2.2"]
    got = events(router.normalize_zeek_tsv(as_lines(spark, HEAD + body)),
                 "timestamp", "source_port", "alert_type", "risk_level")
    assert got == [("1.5", "5", "zeek-conn::unknown:S0", "Medium"), ("2.5", None, "zeek-conn::unknown:", "Low")]


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        (["#path\tdns"], "dns"), (["#path\tweird"], None), (["#fields\ta\tconn_state"], "conn"),
        (["#fields\tquery\tqtype_name"], "dns"), (["#fields\tmethod\thost"], "http"), (["#fields\tnote"], "notice"),
        (["#path\tweird", "#fields\tnote"], "notice"), (["#fields\tconn_state", "#path\tssl"], "ssl"),
        (["x"] * 10 + ["#path\tdns"], None),
    ],
)
def test_zeek_type(spark, head, kind):
    assert router.file_profile(as_lines(spark, head + ["row"])).first().zeek_type == kind


def test_csv_quotes_and_late_duplicates(spark):
    text = ["src,dst,event,src", '9,2,"a, ""b""",1', ",2,x,", "1,2", "9,2,z,", "", "9,2,w,5,extra"]
    got = events(router.normalize_csv(as_lines(spark, text)), "source_ip", "alert_type")
    assert got == [("1", 'a, "b"'), ("5", "w")]


def test_plain_parts(spark):
    text = ["a,b,c,d", " t , s ,d,, x ", "t,s,d,dom,al,udp", "t,s,d,dom,al,udp,more"]
    got = events(router.normalize_plain(as_lines(spark, text)), "timestamp", "source_ip", "alert_type", "protocol")
    assert got == [("t", "s", "x", ""), ("t", "s", "al", "udp"), ("t", "s", "al", "udp")]


def test_routes_fall_through(spark):
    good = json.dumps({"src": "1", "dst": "2"})
    files = {
        "json": [good, "x"],
        "zeek-without-rows": HEAD + ["a\tb"] + [good] * 9,
        "csv": ["source_ip,dest_ip", "1,2"],
        "few-json": [good] + ["t,s,d,dom,al"] * 9,
        "empty-csv": ["source_ip,dest_ip", ",2"],
        "zeek": HEAD + ["1.5\t1.1.1.1\t5\t2.2.2.2\tS0"],
        "late-header": ["x"] * 5 + HEAD + ["1.5\t1.1.1.1\t5\t2.2.2.2\tS0"],
    }
    frames = [as_lines(spark, text, name) for name, text in files.items()]
    all_lines = frames[0]
    for frame in frames[1:]:
        all_lines = all_lines.unionByName(frame)
    got = {r.batch_id: r.route for r in router.choose_routes(all_lines).collect()}
    assert got == {"json": "json", "zeek-without-rows": "json", "csv": "csv", "few-json": "plain",
                   "empty-csv": "plain", "zeek": "zeek_tsv", "late-header": "plain"}
    parsed = router.read_events(all_lines)
    counts = {r.batch_id: r["count"] for r in parsed.groupBy("batch_id").count().collect()}
    assert counts == {"json": 1, "zeek-without-rows": 9, "csv": 1, "few-json": 9, "zeek": 1}


def test_split_file_keeps_order_and_profile(spark, tmp_path):
    """A file read in many pieces gives the same events in the same order, and the same counts."""
    rows = [f"2024-01-01T00:00:{i % 60:02d},10.0.0.{i},192.168.0.1,d{i}.com,alert {i}" for i in range(3000)]
    text = ["", "  "] + ["timestamp,source_ip,destination_ip,domain,alert_type"] + rows[:1500] + [""] + rows[1500:] + ["", ""]
    (tmp_path / "big.csv").write_text("\n".join(text) + "\n")
    (tmp_path / "small.log").write_text("t,1.1.1.1,2.2.2.2,x.com,scan\n")
    scanned = lines.scan_log_lines(spark, str(tmp_path), organization_id=7, split_bytes=20_000)
    assert scanned.select("block").distinct().count() > 5
    profile = {r.batch_id.rsplit("/", 1)[1]: r.n_lines for r in router.file_profile(scanned).collect()}
    got = router.read_events(scanned).orderBy("batch_id", "seq").collect()
    assert profile == {"big.csv": 3002, "small.log": 1}
    big = [r for r in got if r.batch_id.endswith("big.csv")]
    assert [r.seq for r in big] == list(range(3000))
    assert [r.alert_type for r in big] == [f"alert {i}" for i in range(3000)]
    assert {r.source for r in got} == {"csv", "plain-text"} and {r.organization_id for r in got} == {7}


def test_relevance(spark):
    cases = [
        ({"event_type": "alert"}, True), ({"event_type": "flow", **ENDS}, False),
        ({"event_type": "dns", "src_ip": "10.0.0.1", "dest_ip": "224.0.0.251"}, True),
        ({"event_type": "dns", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2"}, False),
        ({"event_type": "dns", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "dns": {"rrname": "x"}}, True),
        ({"event_type": "dns", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "dns": {"rrname": " "}}, False),
        ({"event_type": "ssh", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2"}, True),
        ({"event_type": "ssh", "src_ip": "10.0.0.1"}, False),
    ]
    frame = as_lines(spark, [json.dumps(o) for o, _ in cases] + ["5", "{x"])
    kept = {r.line_id for r in json_lines.relevant_lines(frame).collect()}
    assert kept == {i for i, (_, keep) in enumerate(cases) if keep}


def test_blank_files_give_nothing(spark):
    assert router.file_profile(as_lines(spark, ["", " "])).count() == 0
    assert lines.drop_blank(as_lines(spark, ["", " ", "x"])).count() == 1


def test_tasks_of_a_scan_have_bounded_rows(spark):
    """Many rows in a single piece are spread over tasks by their number, not only over the cores."""
    n = 40 * flows.SCAN_ROWS
    spread = flows.spread_scan(spark.range(n).coalesce(1))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * flows.SCAN_ROWS
    assert flows.spread_scan(spark.range(0)).count() == 0
