"""Network events derived from the ``events`` table, and the same events as raw log lines.

The given tables hold no network logs. ``flows`` turns every row of ``events`` into one
normalised event; the ``render_*`` functions write those events as the text formats the
parsers read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.text import choose
from wireloom.operators.ordering import SPLIT_ROWS
from wireloom.sources.lines import LINE_COLUMNS

ALERTS = [
    "Port Scan", "DDoS Flood", "Bot C2 Beacon", "SSH Brute Force", "Ransomware Staging", "DoS Flood",
    "FTP Brute Force", "Heartbleed Exploit", "Data Exfiltration", "Web Brute Force",
    "dns-query: google.com", "flow:tcp",
]
# events per batch, the size of a live upload
BATCH_EVENTS = 50
# rows that one task reads and works on up to the first shuffle, about
SCAN_ROWS = 50_000

CSV_HEADERS = [
    "timestamp,source_ip,destination_ip,domain,alert_type,proto",
    "ts,src,dst,hostname,event,protocol",
    "time,src_ip,dest_ip,query,alert,proto",
]
ZEEK_TYPES = ["conn", "dns", "http", "notice", "ssl", "files"]
ZEEK_HEADERS = {
    "conn": "ts id.orig_h id.orig_p id.resp_h id.resp_p proto service conn_state host",
    "dns": "ts id.orig_h id.orig_p id.resp_h id.resp_p proto query qtype_name",
    "http": "ts id.orig_h id.orig_p id.resp_h id.resp_p method host status_code",
    "notice": "ts src dst note server_name",
    "ssl": "ts id.orig_h id.orig_p id.resp_h id.resp_p version server_name validation_status",
    "files": "ts src dst filename",
}


def spread_scan(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few pieces, and give no task more than about SCAN_ROWS rows.

    Rows take a few bytes in the file, so a piece of the usual number of bytes holds millions of
    them, and everything up to the first shuffle would run there. They are counted from the file's footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // SCAN_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def flows(spark: SparkSession, sf_dir: str, hints: bool = False) -> DataFrame:
    """Every row of ``events`` as a normalised event in batches of 50."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    e = spread_scan(e.select("event_id", "ts", "user_id", "event_type", k.alias("k")))
    text = lambda c: c.cast("string")
    user, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    domain = choose(
        [
            (k % 5 == 0, F.lit("")),
            (k % 5 == 1, F.lit("google.com")),
            (k % 5 == 2, F.concat(F.md5(text(eid)), F.lit(".biz"))),
            (k % 5 == 3, F.lit("malicious-login.com")),
        ],
        F.lit("ransomware-c2.xyz"),
    )
    source = F.concat(F.lit("10.0."), text(F.floor(user / 256)), F.lit("."), text(user % 256))
    hint = choose(((k % 4 == i, F.lit(v)) for i, v in enumerate(["High", "Medium", "Low"])))
    return e.select(
        eid.alias("seq"),
        (user % 3).cast("long").alias("organization_id"),
        text(F.floor(eid / BATCH_EVENTS)).alias("batch_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(k % 25 == 7, "").otherwise(source).alias("source_ip"),
        F.concat(F.when(k % 2 == 0, "192.168.1.").otherwise("203.0.113."), text(k % 50)).alias("destination_ip"),
        domain.alias("domain"),
        F.get(F.array(*[F.lit(a) for a in ALERTS]), (k % 12).cast("int")).alias("alert_type"),
        (hint if hints else F.lit(None).cast("string")).alias("risk_level"),
        k.alias("k"),
        F.col("event_type"),
    )


def _as_lines(df: DataFrame, batch: Column, value: Column) -> DataFrame:
    """Lines of one file per ``batch``; four places at the top are left for headers."""
    return df.select(
        "organization_id",
        batch.alias("batch_id"),
        (F.floor(F.col("seq") / SPLIT_ROWS) * SPLIT_ROWS).cast("long").alias("block"),
        (F.col("seq") + 4).alias("line_id"),
        value.alias("value"),
    )


def _org_file(kind: str) -> Column:
    return F.concat(F.lit(kind + "-"), F.col("organization_id").cast("string"))


def eve_type() -> Column:
    k = F.col("k") % 12
    return choose(
        [(k == 10, F.lit("dns")), (k == 11, F.lit("flow")), (k == 9, F.lit("http")), (k == 6, F.lit("tls"))],
        F.lit("alert"),
    )


def eve_json() -> Column:
    """One EVE object; the place of the domain depends on the event type."""
    k = F.col("k")
    kind = F.col("eve_type")
    domain = F.when(F.col("domain") != "", F.col("domain"))
    name_in = lambda i: F.when(k % 3 == i, domain)
    alert = F.when(
        kind == "alert",
        F.struct(
            F.when(k % 7 != 0, F.col("alert_type")).alias("signature"),
            F.col("alert_type").alias("category"),
            F.when(k % 4 != 0, k % 4).alias("severity"),
            (k + 2000000).alias("signature_id"),
            F.lit("allowed").alias("action"),
        ),
    )
    dns = F.when(
        kind == "dns",
        F.struct(
            name_in(0).alias("rrname"),
            F.array(F.struct(name_in(1).alias("rrname"))).alias("queries"),
            F.array(F.struct(name_in(2).alias("rrname"))).alias("answers"),
        ),
    )
    return F.to_json(
        F.struct(
            "timestamp",
            kind.alias("event_type"),
            F.col("source_ip").alias("src_ip"),
            F.col("destination_ip").alias("dest_ip"),
            (k + 40000).alias("src_port"),
            F.lit(443).alias("dest_port"),
            F.when(k % 2 == 0, "TCP").otherwise("UDP").alias("proto"),
            alert.alias("alert"),
            dns.alias("dns"),
            F.when(kind == "http", F.struct(domain.alias("hostname"))).alias("http"),
            F.when(kind == "tls", F.struct(domain.alias("sni"))).alias("tls"),
            F.when(kind.isin("alert", "flow"), domain).alias("domain"),
        )
    )


def render_eve(df: DataFrame, line: Column | None = None) -> DataFrame:
    return _as_lines(df.withColumn("eve_type", eve_type()), _org_file("eve"), eve_json() if line is None else line)


def render_zeek_json(df: DataFrame) -> DataFrame:
    k = F.col("k")
    domain = F.when(F.col("domain") != "", F.col("domain"))
    line = F.to_json(
        F.struct(
            F.when(k % 3 != 0, F.get(F.array(F.lit("conn"), F.lit("dns"), F.lit("notice")), (k % 3).cast("int"))).alias(
                "_path"
            ),
            F.col("timestamp").alias("ts"),
            F.col("source_ip").alias("id.orig_h"),
            F.col("destination_ip").alias("id.resp_h"),
            F.when(k % 2 == 0, domain).alias("query"),
            F.when(k % 2 == 1, domain).alias("host"),
            F.when(k % 4 != 0, "tcp").alias("proto"),
            F.when(k % 6 < 3, "ssl").alias("service"),
            F.when(k % 6 == 5, "Scan::Port_Scan").alias("note"),
        )
    )
    return _as_lines(df, _org_file("zeek-json"), line)


def render_generic_json(df: DataFrame) -> DataFrame:
    k = F.col("k")
    pick = lambda n, i, value: F.when(k % n == i, value)
    src, dst, domain = F.col("source_ip"), F.col("destination_ip"), F.when(F.col("domain") != "", F.col("domain"))
    common = [
        pick(4, 0, src).alias("src_ip"), pick(4, 1, src).alias("source_ip"),
        pick(4, 2, src).alias("src"), pick(4, 3, src).alias("orig_h"),
        pick(5, 0, dst).alias("dest_ip"), pick(5, 1, dst).alias("destination_ip"), pick(5, 2, dst).alias("dst_ip"),
        pick(5, 3, dst).alias("dst"), pick(5, 4, dst).alias("resp_h"),
        pick(3, 0, domain).alias("domain"), pick(3, 1, domain).alias("query"), pick(3, 2, domain).alias("hostname"),
        pick(2, 0, F.col("timestamp")).alias("time"), pick(2, 1, F.col("timestamp")).alias("@timestamp"),
        pick(2, 0, F.lit("tcp")).alias("protocol"),
    ]
    as_text = F.to_json(F.struct(*common, F.col("alert_type").alias("alert")))
    as_object = F.to_json(F.struct(*common, F.struct(F.col("alert_type").alias("signature")).alias("alert")))
    as_type = F.to_json(F.struct(*common, F.col("alert_type").alias("type")))
    line = choose([(k % 3 == 0, as_text), (k % 3 == 1, as_object)], as_type)
    return _as_lines(df, _org_file("generic"), line)


def _headers(spark: SparkSession, df: DataFrame, batch: Column, lines: Column) -> DataFrame:
    """Header lines of every file, placed before its data."""
    files = df.select("organization_id", batch.alias("batch_id"), lines.alias("_lines")).distinct()
    placed = files.select("organization_id", "batch_id", F.posexplode("_lines").alias("_place", "value"))
    return placed.select(
        "organization_id", "batch_id", F.lit(0).cast("long").alias("block"),
        F.col("_place").cast("long").alias("line_id"), "value",
    ).select(*LINE_COLUMNS)


def csv_line() -> Column:
    quoted = F.concat(F.lit('"'), F.col("alert_type"), F.lit('"'))
    proto = F.when(F.col("k") % 2 == 0, "tcp").otherwise("")
    return F.concat_ws(",", "timestamp", "source_ip", "destination_ip", "domain", quoted, proto)


def render_csv(df: DataFrame) -> DataFrame:
    """One CSV file per tenant, each with its own header names."""
    header = F.get(F.array(*[F.lit(h) for h in CSV_HEADERS]), F.col("organization_id").cast("int"))
    top = _headers(df.sparkSession, df, _org_file("csv"), F.array(header))
    return top.unionByName(_as_lines(df, _org_file("csv"), csv_line()))


# lines of a block of the CSV files whose records span lines; no multiple of a record's places
SPANNING_BLOCK = 1001
# places kept for the lines of one event
EVENT_PLACES = 4


def render_spanning_csv(df: DataFrame) -> DataFrame:
    """CSV files in which every third alert is broken over lines, cut into blocks anywhere."""
    alert = F.when(F.col("k") % 3 == 0, F.replace("alert_type", F.lit(" "), F.lit('\n""x"",'))).otherwise(F.col("alert_type"))
    header = F.get(F.array(*[F.lit(h) for h in CSV_HEADERS]), F.col("organization_id").cast("int"))
    top = _headers(df.sparkSession, df, _org_file("csv"), F.array(header))
    whole = _as_lines(df.withColumn("alert_type", alert), _org_file("csv"), csv_line())
    parts = whole.select("organization_id", "batch_id", "line_id", F.posexplode(F.split("value", "\n")).alias("_part", "value"))
    place = F.col("line_id") * EVENT_PLACES + F.col("_part")
    body = parts.select(
        "organization_id", "batch_id", (F.floor(place / SPANNING_BLOCK) * SPANNING_BLOCK).cast("long").alias("block"),
        place.alias("line_id"), "value",
    )
    return top.unionByName(body)


def render_plain(df: DataFrame) -> DataFrame:
    five = F.concat_ws(" , ", "timestamp", "source_ip", "destination_ip", "domain", "alert_type")
    line = F.when(F.col("k") % 2 == 0, F.concat(five, F.lit(",tcp"))).otherwise(five)
    return _as_lines(df, _org_file("plain"), line)


def zeek_type() -> Column:
    return F.get(F.array(*[F.lit(t) for t in ZEEK_TYPES]), (F.col("k") % 6).cast("int"))


def zeek_line() -> Column:
    k = F.col("k")
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    src, dst, domain = dash(F.col("source_ip")), F.col("destination_ip"), dash(F.col("domain"))
    ports = F.lit("40000"), F.lit("443")
    conn = [src, ports[0], dst, ports[1]]
    state = F.get(F.array(*[F.lit(s) for s in ["S0", "SF", "REJ", "-"]]), (k % 4).cast("int"))
    note = F.get(F.array(*[F.lit(s) for s in ["Scan::Port_Scan", "Weird::Activity", "-"]]), (k % 3).cast("int"))
    valid = F.get(F.array(*[F.lit(s) for s in ["ok", "chain Failure", "-"]]), (k % 3).cast("int"))
    rows = {
        "conn": [*conn, F.lit("tcp"), F.when(k % 4 == 0, "http").otherwise("-"), state, domain],
        "dns": [*conn, F.lit("udp"), domain, F.when(k % 4 == 1, "AAAA").otherwise("-")],
        "http": [*conn, F.when(k % 4 == 2, "POST").otherwise("-"), domain, F.lit("200")],
        "notice": [src, dst, note, domain],
        "ssl": [*conn, F.lit("TLSv12"), domain, valid],
        "files": [src, dst, domain],
    }
    kind = F.col("zeek_type")
    return choose((kind == t, F.concat_ws("\t", "timestamp", *cells)) for t, cells in rows.items())


def render_zeek_tsv(df: DataFrame) -> DataFrame:
    """One Zeek file per tenant and log type; the log type of half of them shows in #path only."""
    typed = df.withColumn("zeek_type", zeek_type())
    kind = F.col("zeek_type")
    batch = F.concat(F.lit("zeek-"), kind, F.lit("-"), F.col("organization_id").cast("string"))
    fields = choose(
        (kind == t, F.lit("#fields\t" + h.replace(" ", "\t"))) for t, h in ZEEK_HEADERS.items()
    )
    header = F.array(F.lit("#separator \\x09"), F.concat(F.lit("#path\tsite."), kind), fields)
    top = _headers(df.sparkSession, typed, batch, header)
    return top.unionByName(_as_lines(typed, batch, zeek_line()))


def render_mixed(df: DataFrame) -> DataFrame:
    """Four files per tenant, one in each format."""
    part = lambda i: df.filter(F.col("k") % 4 == i)
    zeek = part(2).withColumn("k", F.col("k") - F.col("k") % 6)  # connection rows only
    frames = [render_eve(part(0)), render_csv(part(1)), render_zeek_tsv(zeek), render_plain(part(3))]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
