"""Scalar operators against plain Python."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wireloom.functions import entropy, network, rules, times
from wireloom.functions.mitre import mitre_struct, rule_text, with_technique_names
from wireloom.functions.text import first_truthy


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v"))).collect()]


def brute_entropy(text):
    counts = Counter(text)
    return -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values()) if text else 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), max_size=30))
def test_entropy_equals_definition_and_is_bounded(spark, texts):
    got = column(spark, texts, entropy.char_entropy)
    for text, value in zip(texts, got):
        assert value == pytest.approx(brute_entropy(text), abs=1e-9)
        assert value <= math.log2(max(len(text), 1)) + 1e-9


def test_domain_entropy_edges(spark):
    got = column(spark, ["ab", "abcdefghijklmnop.com", "AAAA.com", "", None, ".com"], entropy.domain_entropy)
    assert got[0] == 0 and got[1] == pytest.approx(4.0) and got[2] == 0 and got[3:] == [0, 0, 0]
    assert column(spark, ["", None, "aab"], entropy.full_domain_entropy)[:2] == [1.5, 1.5]


def test_generated_domains(spark):
    values = ["abcdefghijklmnopqrst.biz", "google.com", "", None]
    assert column(spark, values, entropy.looks_generated) == [True, False, False, False]


def test_ports(spark):
    cases = {
        "scan on port 22": 22, "to (8080), now": 8080, "70000 then 53": 53, "0 443": 443, "none": 443, "": 443,
        "x80 +25": 25, "-5 :77/": 77, "8_0": 80, "1.5 65535": 65535, "65536": 443, "007": 7, "a\t99\nb": 99,
    }
    assert column(spark, list(cases), network.extract_port) == list(cases.values())


def test_private_addresses(spark):
    cases = {"10.1.1.1": True, "172.15.0.1": False, "172.31.0.1": True, "172.32.0.1": False, "::1": True,
             "fe80::2": True, "fd00::": True, "8.8.8.8": False, "": False, "110.0.0.1": False}
    assert column(spark, list(cases), network.is_private) == list(cases.values())


def test_protocol(spark):
    port = F.lit(53)
    assert column(spark, ["ICMP ping", "x"], lambda c: network.protocol_number(c, port)) == [1, 17]
    assert column(spark, ["udp", "tcp"], lambda c: network.protocol_number(c, F.lit(443))) == [17, 6]


def test_reason_percent_is_cut_off(spark):
    row = spark.sql("SELECT 'Bot' AS c, 0.29D AS s").select(rules.threat_reason(F.col("c"), F.col("s"))).first()
    assert row[0].endswith("(28%)")


def test_titles(spark):
    cases = {
        None: "Network Event", "": "Network Event", "dns-query: a.b": "DNS Lookup: a.b", "tls:x": "Secure Connection: ",
        "dns-query": "DNS Lookup", "netflow:tcp": "TCP Network Flow", "flow:udp": "UDP Connection",
        "my-BAR it's": "My BAR It'S", "suspicious_dns": "DNS Activity", "zeek_x:yZ": "Zeek X YZ",
    }
    assert column(spark, list(cases), rules.friendly_title) == list(cases.values())


def test_hint_decides_without_words(spark):
    frame = spark.createDataFrame([("x", "", "High"), ("x", "", "Medium"), ("x", "", None)], "a string, d string, h string")
    got = frame.select(rules.risk_level(F.col("a"), F.col("d"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["High", "Medium", "Low"]


def test_first_truthy(spark):
    frame = spark.createDataFrame([("", None, "c"), (None, None, None), ("a", "b", "c")], "x string, y string, z string")
    assert [r[0] for r in frame.select(first_truthy(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["c", "", "a"]


def test_times(spark):
    values = ["2026-03-20T10:00:00Z", "2026-03-20T10:00:00.123456+0000", "1774000800.5", "bad", "", None]
    days = [str(d) if d else None for d in column(spark, values, times.utc_day)]
    assert days == ["2026-03-20", "2026-03-20", "2026-03-20", None, None, None]
    assert column(spark, ["2026-03-20T1", None, ""], times.text_day) == ["2026-03-20", "Unknown", "Unknown"]


def mitre_of(spark, alert, domain="", reason="", summary="", **options):
    frame = spark.createDataFrame([(alert, domain, reason, summary)], "a string, d string, r string, s string")
    text = rule_text(F.col("a"), F.col("d"), F.col("r"), F.col("s"))
    m = frame.withColumn("t", text).select(mitre_struct(F.col("t"), F.col("d"), **options).alias("m")).first().m
    return (m.mitre_tactic_id, m.mitre_technique_id) if m else None


def test_mitre_rules(spark):
    assert mitre_of(spark, "source check") == ("TA0001", "T1190")  # "rce" inside a word
    assert mitre_of(spark, "source check", word_boundaries=True) is None
    assert mitre_of(spark, "password spray attack") == ("TA0006", "T1110")
    assert mitre_of(spark, "password", reason="x\nattack") is None  # a gap does not cross lines
    assert mitre_of(spark, "attack password") is None  # pieces in the wrong order
    assert mitre_of(spark, "x", domain="abcdefghijklmnopqrst.biz") == ("TA0011", "T1568.002")
    assert mitre_of(spark, "x", domain="evil.com") == ("TA0001", "T1566")
    assert mitre_of(spark, "x") is None


def test_technique_names(spark):
    frame = spark.createDataFrame([("TA0011", "T1071"), ("TA0010", "T1041"), (None, None)],
                                  "mitre_tactic_id string, mitre_technique_id string")
    names = {r.mitre_technique_id: r.mitre_technique for r in with_technique_names(frame).collect()}
    assert names == {"T1071": "Application Layer Protocol", "T1041": "T1041", None: None}
