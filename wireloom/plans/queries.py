"""The query catalogue: every operator applied to the given tables.

Each query takes the session and the folder of the tables and returns a frame whose columns
are all named. Events come from ``flows`` (see ``sources.flows``), so every query works over
the whole ``events`` table, or over ``labels``, ``pages``, ``customer`` and ``nation``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions import entropy, network, rules
from wireloom.functions.fixed_values import ATTACK_LABELS, FEATURE_NAMES
from wireloom.functions.mitre import with_mitre
from wireloom.functions.text import first_truthy
from wireloom.models import classifiers
from wireloom.models.ensemble import Ensemble
from wireloom.models.vectors import scaled_vectors
from wireloom.operators import dashboard, evaluation, incidents, sequences
from wireloom.operators.features import (
    HEURISTIC_FEATURES,
    flow_features,
    heuristic_category,
    robust_zscore,
    with_context,
)
from wireloom.operators.ordering import SPLIT_ROWS, distributed_row_number
from wireloom.operators.scoring import EVENT_KEYS, heuristic_predictions
from wireloom.plans import detect, report, train
from wireloom.schemas import INCIDENT_COLUMNS, PARSED_COLUMNS, PREDICTION_COLUMNS
from wireloom.session import materialize, scratch_path
from wireloom.sources import flows as fl
from wireloom.sources import json_lines, lines, router, sinks
from wireloom.streaming import live, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_DAY = dt.date(2024, 1, 3)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_incidents(fl.flows(spark, sf))


def _tenant_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a tenant as one batch, with their dense position in it."""
    events = fl.flows(spark, sf).withColumnRenamed("seq", "event_id").withColumn("batch_id", F.lit("all"))
    events = events.withColumn("_bucket", F.floor(F.col("event_id") / SPLIT_ROWS))
    return distributed_row_number(events, sequences.BATCH, ["_bucket"], ["event_id"], "seq").drop("_bucket")


def _category_label() -> Column:
    """Class number of the category the alert names; 0 is Benign."""
    category = F.coalesce(rules.attack_category(F.col("alert_type")), F.lit("Benign"))
    return (F.array_position(F.array(*[F.lit(c) for c in ATTACK_LABELS]), category) - 1).cast("int")


def _line_seq() -> list:
    return [(F.col("line_id") - 4).alias("seq")]


# --- sources ----------------------------------------------------------------------
@query
def scan_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "scan")
    fl.render_plain(fl.flows(spark, sf)).select("value").write.text(path)
    return lines.drop_blank(lines.scan_log_lines(spark, path)).select("organization_id", "value")


@query
def route_formats(spark: SparkSession, sf: str) -> DataFrame:
    mixed = materialize(fl.render_mixed(fl.flows(spark, sf)))
    profile = router.choose_routes(mixed)
    routes = profile.select(*lines.FILE_KEYS, "route")
    found = router.parse_logs(mixed, profile).groupBy(*lines.FILE_KEYS).agg(F.count(F.lit(1)).alias("events"))
    return routes.join(found, lines.FILE_KEYS, "left")


# Parsers that need a file's header pass over its lines more than once. Lines made from
# ``flows`` are written once for them, which is what a log file on storage would be.
def _parsed(events: DataFrame) -> DataFrame:
    shown = [c for c in PARSED_COLUMNS if c != "raw"]
    return events.select("organization_id", "batch_id", *_line_seq(), *shown)


@query
def normalize_eve(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(json_lines.normalize_eve(fl.render_eve(fl.flows(spark, sf))))


@query
def normalize_zeek_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(router.normalize_zeek_tsv(materialize(fl.render_zeek_tsv(fl.flows(spark, sf)))))


@query
def zeek_log_type(spark: SparkSession, sf: str) -> DataFrame:
    profile = router.file_profile(materialize(fl.render_zeek_tsv(fl.flows(spark, sf))), count_json=False)
    return profile.select("organization_id", "batch_id", "has_zeek_header", "zeek_type", "n_lines")


@query
def normalize_zeek_json(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(json_lines.normalize_zeek_json(fl.render_zeek_json(fl.flows(spark, sf))))


@query
def normalize_generic_json(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(json_lines.normalize_generic_json(fl.render_generic_json(fl.flows(spark, sf))))


@query
def json_dialect(spark: SparkSession, sf: str) -> DataFrame:
    f = fl.flows(spark, sf)
    all_lines = fl.render_eve(f).unionByName(fl.render_zeek_json(f)).unionByName(fl.render_generic_json(f))
    return json_lines.with_dialect(all_lines).select("batch_id", *_line_seq(), "dialect")


@query
def json_accept_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a falling share of JSON lines; some other lines are blank."""
    share = F.get(F.array(F.lit(1), F.lit(3), F.lit(9)), F.col("organization_id").cast("int"))
    digit = F.col("k") % 10
    other = F.when(digit == 9, "").otherwise("no event here")
    text = fl.render_eve(_tenant_stream(spark, sf), F.when(digit < share, fl.eve_json()).otherwise(other))
    profile = router.file_profile(materialize(text))
    return profile.select("batch_id", "n_lines", "n_json", "n_corrupt", router.json_accepted().alias("accepted"))


@query
def normalize_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(router.normalize_csv(materialize(fl.render_csv(fl.flows(spark, sf)))))


@query
def normalize_spanning_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Records over up to three lines, some of which lie in two blocks."""
    events = router.normalize_csv(materialize(fl.render_spanning_csv(fl.flows(spark, sf))))
    seq = (F.floor(F.col("line_id") / fl.EVENT_PLACES) - 4).cast("long").alias("seq")
    shown = [c for c in PARSED_COLUMNS if c != "raw"]
    return events.select("organization_id", "batch_id", seq, *shown)


@query
def normalize_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(router.normalize_plain(fl.render_plain(fl.flows(spark, sf))))


@query
def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """The raw text that events of three formats keep."""
    f = fl.flows(spark, sf)
    csv = router.normalize_csv(materialize(fl.render_csv(f)))
    zeek = router.normalize_zeek_tsv(materialize(fl.render_zeek_tsv(f)))
    plain = router.normalize_plain(fl.render_plain(f))
    kept = [e.select("batch_id", *_line_seq(), "raw") for e in (csv, zeek.filter("source = 'zeek-conn'"), plain)]
    return kept[0].union(kept[1]).union(kept[2])


# --- predicates and scalar rules ---------------------------------------------------
@query
def first_truthy_value(spark: SparkSession, sf: str) -> DataFrame:
    value = first_truthy(F.col("domain"), F.col("source_ip"), F.col("alert_type"))
    return fl.flows(spark, sf).select("seq", value.alias("value"))


def _eve_fields(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines.with_fields(fl.render_eve(fl.flows(spark, sf)))


@query
def dns_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _eve_fields(spark, sf).select(*_line_seq(), json_lines.dns_domain().alias("dns_domain"))


@query
def event_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _eve_fields(spark, sf).select(*_line_seq(), F.col("_name").alias("event_domain"))


@query
def has_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _eve_fields(spark, sf).select(*_line_seq(), json_lines.has_domain().alias("has_domain"))


@query
def display_alert(spark: SparkSession, sf: str) -> DataFrame:
    return _eve_fields(spark, sf).select(*_line_seq(), json_lines.eve_columns()["alert_type"].alias("alert_type"))


@query
def relevant_events(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines.relevant_lines(fl.render_eve(fl.flows(spark, sf))).select("batch_id", *_line_seq())


@query
def valid_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    ok = network.valid_endpoints(F.col("source_ip"), F.col("destination_ip"))
    return fl.flows(spark, sf).filter(ok).select("seq", "source_ip", "destination_ip")


@query
def is_private(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    shapes = F.array(
        F.col("source_ip"), F.col("destination_ip"), F.concat(F.lit("172."), k, F.lit(".0.1")),
        F.concat(F.lit("fe80::"), k), F.concat(F.lit("f"), F.col("k") % 10, F.lit("::1")), F.concat(F.lit("::"), k),
    )
    address = F.get(shapes, (F.col("seq") % 6).cast("int"))
    return fl.flows(spark, sf).select("seq", address.alias("address")).select(
        "seq", "address", network.is_private(F.col("address")).alias("is_private")
    )


@query
def classify_risk(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.classify_risk(fl.flows(spark, sf, hints=True)).select(
        "seq", "organization_id", "risk_level", "status", "recommended_action"
    )


@query
def incident_summary(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.detect_suspicious(fl.flows(spark, sf)).select("seq", "risk_level", "summary")


@query
def zeek_risk(spark: SparkSession, sf: str) -> DataFrame:
    events = router.normalize_zeek_tsv(materialize(fl.render_zeek_tsv(fl.flows(spark, sf))))
    return events.groupBy("source", "alert_type", "risk_level").agg(F.count(F.lit(1)).alias("events"))


def _with_category(spark: SparkSession, sf: str) -> DataFrame:
    category = F.coalesce(rules.attack_category(F.col("alert_type")), F.lit("Benign"))
    score = (F.col("k") % 101) / F.lit(100.0)
    return fl.flows(spark, sf).select("seq", "alert_type", category.alias("category"), score.alias("score"))


@query
def attack_category(spark: SparkSession, sf: str) -> DataFrame:
    f = fl.flows(spark, sf)
    return f.select("seq", "alert_type", rules.attack_category(F.col("alert_type")).alias("attack_category"))


@query
def risk_tier(spark: SparkSession, sf: str) -> DataFrame:
    tiers = _with_category(spark, sf).withColumn("risk_tier", rules.risk_tier(F.col("category")))
    return tiers.select("seq", "category", "risk_tier", rules.tier_description(F.col("risk_tier")).alias("description"))


@query
def threat_reason(spark: SparkSession, sf: str) -> DataFrame:
    reason = rules.threat_reason(F.col("category"), F.col("score"))
    return _with_category(spark, sf).select("seq", "category", reason.alias("ai_reason"))


@query
def heuristic_classify(spark: SparkSession, sf: str) -> DataFrame:
    features = flow_features(fl.flows(spark, sf), ["seq"], HEURISTIC_FEATURES)
    return features.select(
        "seq", heuristic_category(False).alias("category_raw"), heuristic_category(True).alias("category_scaled")
    )


@query
def apply_alert_override(spark: SparkSession, sf: str) -> DataFrame:
    return heuristic_predictions(fl.flows(spark, sf)).select("seq", *PREDICTION_COLUMNS)


@query
def score_backfill(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    f = incidents.classify_risk(fl.flows(spark, sf)).withColumns(
        {
            "ai_score": F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 1, (k % 100) / F.lit(100.0)),
            "ai_prediction": F.when(k % 2 == 0, "suspicious"),
            "ai_reason": F.when(k % 5 == 0, "").when(k % 5 == 1, "model reason"),
        }
    )
    return incidents.backfill_predictions(f).select("seq", "ai_score", "ai_prediction", "ai_reason")


@query
def map_mitre(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions come along with the events, so that these are read and ordered once."""
    events = fl.flows(spark, sf)
    found = incidents.detect_suspicious(heuristic_predictions(events, keep=events.columns))
    return with_mitre(found).select("seq", "mitre_tactic_id", "mitre_tactic", "mitre_technique_id", "mitre_technique")


@query
def dga_domains(spark: SparkSession, sf: str) -> DataFrame:
    domain = F.col("domain")
    return fl.flows(spark, sf).select(
        "seq", "domain", F.round(entropy.domain_entropy(domain), 6).alias("entropy"),
        entropy.looks_generated(domain).alias("generated"),
    )


@query
def friendly_title(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat_ws("-", "event_type", F.concat(F.lit("bAR:x_"), (F.col("k") % 7).cast("string")))
    shapes = F.array(F.col("alert_type"), odd, F.concat(F.lit("tls: "), F.col("domain")),
                     F.concat(F.lit("http:"), F.col("domain")))
    alert = F.get(shapes, (F.col("seq") % 4).cast("int"))
    f = fl.flows(spark, sf).select("seq", alert.alias("alert_type"))
    return f.select("seq", "alert_type", rules.friendly_title(F.col("alert_type")).alias("title"))


# --- scalar functions ---------------------------------------------------------------
@query
def domain_entropy(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    named = pages.select("page_id", host.alias("host"))
    return named.select(
        "page_id", "host", F.round(entropy.domain_entropy(F.col("host")), 6).alias("label_entropy"),
        F.round(entropy.full_domain_entropy(F.col("host")), 6).alias("full_entropy"),
    )


@query
def payload_entropy(spark: SparkSession, sf: str) -> DataFrame:
    value = entropy.payload_entropy(*[F.col(c) for c in ("source_ip", "destination_ip", "alert_type", "domain")])
    return fl.flows(spark, sf).select("seq", F.round(value, 6).alias("payload_entropy"))


@query
def extract_port(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.col("alert_type"), F.lit(" ("), (F.col("k") * 997).cast("string"), F.lit(") :"),
        F.col("seq").cast("string"), F.lit("/ x80"),
    )
    f = fl.flows(spark, sf).select("seq", text.alias("text"))
    return f.select("seq", "text", network.extract_port(F.col("text")).alias("port"))


# --- joins ----------------------------------------------------------------------------
@query
def first_match_join(spark: SparkSession, sf: str) -> DataFrame:
    f = fl.flows(spark, sf)
    suspicious = incidents.detect_suspicious(f)
    predictions = heuristic_predictions(f)
    return incidents.first_match_predictions(suspicious, predictions).select("seq", *PREDICTION_COLUMNS)


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Incidents by day, and those of viewing events as the ones stored already."""
    day = F.substring("timestamp", 1, 10)
    found = incidents.detect_suspicious(fl.flows(spark, sf)).withColumn("timestamp", day)
    return found, found.filter(F.col("event_type") == "view")


@query
def dedup_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.dedup_incidents(*_daily(spark, sf)).select("seq", *incidents.INCIDENT_KEY)


@query
def ingest_result(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.ingest_result(incidents.flag_duplicates(*_daily(spark, sf)))


@query
def tenant_directory(spark: SparkSession, sf: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    organizations = nation.select(
        F.col("n_nationkey").cast("long").alias("organization_id"), F.col("n_name").alias("organization_name")
    )
    return incidents.tenant_directory(organizations, _users(spark, sf), _incidents(spark, sf))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    return customer.select(
        F.col("c_nationkey").cast("long").alias("organization_id"), F.col("c_custkey").alias("user_id"),
        F.col("c_acctbal").alias("created_at"),
    )


# --- aggregates -------------------------------------------------------------------------
@query
def incident_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.incident_stats(incidents.detect_suspicious(fl.flows(spark, sf)), ["organization_id"])


@query
def mitre_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    heat = dashboard.mitre_heatmap(_incidents(spark, sf))
    return heat.select("position", "tactic", "incidents", F.round("intensity", 6).alias("intensity"))


@query
def risk_timeline(spark: SparkSession, sf: str) -> DataFrame:
    days = dashboard.risk_timeline(_incidents(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ("height_pct", "high_pct", "medium_pct", "low_pct")]
    return days.select("day", "high", "medium", "low", "total", *rounded)


@query
def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    kinds = F.array(F.lit("counter"), F.lit("gauge"), F.lit("timer"))
    samples = e.select(
        F.col("event_type").alias("name"), F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("kind"),
        "value", "ts", F.col("event_id").alias("sample_id"),
    )
    rolled = dashboard.metric_rollup(samples)
    return rolled.withColumns({"total": F.round("total", 4), "avg_ms": F.round("avg_ms", 4)})


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    dist = evaluation.class_distribution(_labels(spark, sf).withColumnRenamed("quality", "label"))
    return dist.select("label", "n", F.round("percent", 6).alias("percent"))


@query
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = evaluation.balanced_weights(_labels(spark, sf).withColumnRenamed("quality", "label"), "doc_id")
    return weighted.select("doc_id", "label", F.round("weight", 6).alias("weight"))


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = evaluation.classification_report(_labels(spark, sf), "quality", "toxic")
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return rep.select("class", *rounded, "support")


@query
def member_roles(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.member_roles(_users(spark, sf)).select("organization_id", "user_id", "role")


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    split = evaluation.stratified_split(_labels(spark, sf), "doc_id", "quality")
    return split.select("doc_id", "quality", "split")


# --- windows ----------------------------------------------------------------------------
@query
def ip_diversity(spark: SparkSession, sf: str) -> DataFrame:
    framed = with_context(_tenant_stream(spark, sf), ["ip_diversity"])
    return framed.select("event_id", "organization_id", "seq", "ip_diversity")


@query
def port_diversity(spark: SparkSession, sf: str) -> DataFrame:
    framed = with_context(fl.flows(spark, sf), ["port_diversity"])
    return framed.select("seq", "port_diversity")


@query
def event_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Both shapes: a tenant's stream (many windows) and small batches (mostly padded ones)."""
    stream = _tenant_stream(spark, sf)
    small = fl.flows(spark, sf).withColumnRenamed("seq", "event_id")
    small = distributed_row_number(small, sequences.BATCH, [], ["event_id"], "seq")
    values = [F.col("k").cast("double").alias("k")]
    both = stream.select(*sequences.BATCH, "seq", *values).unionByName(small.select(*sequences.BATCH, "seq", *values))
    made = sequences.event_sequences(both, ["k"])
    total = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[0])
    first, last = F.get("steps", F.lit(0))[0], F.get("steps", F.lit(19))[0]
    return made.select(
        *sequences.SEQUENCE, F.col("real_steps").cast("long").alias("real_steps"),
        F.size("steps").cast("long").alias("length"), total.alias("total"),
        first.alias("first_value"), last.alias("last_value"),
    )


@query
def sequence_majority(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _tenant_stream(spark, sf).withColumn("label", _category_label())
    return sequences.sequence_majority(labelled).select("organization_id", "seq_id", "label", "votes")


# --- incident reads and changes -----------------------------------------------------------
@query
def detect_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return _incidents(spark, sf).select(*INCIDENT_COLUMNS)


@query
def tenant_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.tenant_incidents(_incidents(spark, sf), 1)


@query
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = _incidents(spark, sf)
    return incidents.facet_filter(found, "monitoring").select("id", "risk_level", "status")


@query
def search_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.search_incidents(_incidents(spark, sf), "C2").select("id", "alert_type", "domain", "mitre_tactic")


@query
def latest_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.latest_incidents(_incidents(spark, sf), 50).select("id", "alert_type", "risk_level")


def _status_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests come from events: each event asks about its own and the next incident."""
    f = spark.read.parquet(f"{sf}/events.parquet")
    asked = F.explode(F.array(F.col("event_id"), F.col("event_id") + 1))
    return f.select(
        (F.col("user_id") % 3).cast("long").alias("organization_id"), asked.alias("incident_id"),
        F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject").otherwise(
            "none").alias("action"),
        F.when(F.col("user_id") % 5 == 0, "VIEWER").otherwise("ANALYST").alias("role"),
        F.col("ts").alias("changed_at"),
    )


@query
def apply_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    changed = incidents.apply_status_changes(_incidents(spark, sf), _status_requests(spark, sf))
    return changed.select("id", "organization_id", "status")


@query
def purge_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.purge_tenant(_incidents(spark, sf), 2, "ADMIN").select("id", "organization_id", "alert_type")


@query
def daily_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.ordered(report.daily_report(_incidents(spark, sf), REPORT_DAY))


@query
def alert_feed(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.alert_feed(_incidents(spark, sf))


# --- features -----------------------------------------------------------------------------
@query
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    features = flow_features(fl.flows(spark, sf), ["seq"])
    return features.select("seq", *[F.round(c, 6).alias(c) for c in features.columns if c != "seq"])


@query
def robust_zscores(spark: SparkSession, sf: str) -> DataFrame:
    features = flow_features(fl.flows(spark, sf), ["seq"])
    scaled = robust_zscore(features)
    return scaled.select("seq", *[F.round(c, 6).alias(c) for c in scaled.columns if c != "seq"])


# --- sinks and streams ----------------------------------------------------------------------
@query
def incident_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Append all incidents twice; the second time nothing is new."""
    table = sinks.IncidentTable(spark, scratch_path(spark, "incidents"))
    for _ in range(2):
        table.append_new(_incidents(spark, sf))
    return table.read()


def _log_folder(spark: SparkSession, sf: str) -> str:
    folder = scratch_path(spark, "logs")
    fl.render_eve(fl.flows(spark, sf)).select("value").write.text(folder)
    return folder


@query
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "tail")
    live.tail_to_table(spark, _log_folder(spark, sf), out, scratch_path(spark, "tail-cp"), 4).awaitTermination()
    return spark.read.parquet(out).select(
        "timestamp", "source_ip", "destination_ip", "domain", "alert_type", "event_type", "risk_level"
    )


@query
def stream_detect(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "live")
    live.run_live(
        spark, _log_folder(spark, sf), f"{out}/incidents", f"{out}/checkpoint", f"{out}/feed", once=True
    ).awaitTermination()
    table = sinks.IncidentTable(spark, f"{out}/incidents").read()
    return table.select("source_ip", "destination_ip", "domain", "timestamp", "alert_type", "risk_level", "status")


@query
def stream_grow(spark: SparkSession, sf: str) -> DataFrame:
    """The log is tailed while it grows: half of it is there at first, the rest is added before a second run."""
    folder, out, cp = scratch_path(spark, "grow"), scratch_path(spark, "tail"), scratch_path(spark, "tail-cp")
    text = fl.render_eve(fl.flows(spark, sf))
    late = F.pmod(F.xxhash64("line_id"), F.lit(2)) == 1
    for part in (~late, late):
        text.filter(part).select("value").write.mode("append").text(folder)
        live.tail_to_table(spark, folder, out, cp, growing=True).awaitTermination()
    return spark.read.parquet(out).select(
        "timestamp", "source_ip", "destination_ip", "domain", "alert_type", "event_type", "risk_level"
    )


# longer than the events span, so that no order of files makes one late
STREAM_DELAY = "60 days"


def _generic_folder(spark: SparkSession, sf: str, copies: int) -> str:
    """All lines, ``copies`` times, in two files a core at most: a stream that takes few files at a time then has a bounded number of micro-batches."""
    folder = scratch_path(spark, "logs")
    for _ in range(copies):
        lines = fl.render_generic_json(fl.flows(spark, sf)).select("value")
        lines.coalesce(2 * spark.sparkContext.defaultParallelism).write.mode("append").text(folder)
    return folder


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is there twice, in different files."""
    out = scratch_path(spark, "dedup")
    events = json_lines.normalize_generic_json(live.tail(spark, _generic_folder(spark, sf, 2), max_files=5))
    unique = windows.first_of_key(events, STREAM_DELAY).select(*incidents.INCIDENT_KEY)
    windows.append_to(unique, f"{out}/events", f"{out}/checkpoint", large_state=True).awaitTermination()
    return spark.read.parquet(f"{out}/events").drop("organization_id")


@query
def stream_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Days are closed by a last line far ahead, read by a second run that resumes the first."""
    folder, out = _generic_folder(spark, sf, 1), scratch_path(spark, "days")
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0] or dt.datetime(2024, 1, 1)
    for end in (None, last + dt.timedelta(days=62)):
        if end:
            windows.mark_end(spark, folder, end)
        days = windows.daily_counts(json_lines.normalize_generic_json(live.tail(spark, folder, max_files=4)), STREAM_DELAY)
        windows.append_to(days, f"{out}/days", f"{out}/checkpoint").awaitTermination()
    rounded = [F.round(c, 6).alias(c) for c in ("height_pct", "high_pct", "medium_pct", "low_pct")]
    return windows.closed_timeline(spark, f"{out}/days").select("day", "high", "medium", "low", "total", *rounded)


@query
def stored_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The requests of ``apply_status_changes``, recorded in two parts on a stored table and read back merged."""
    table = sinks.IncidentTable(spark, scratch_path(spark, "incidents"))
    table.append(_incidents(spark, sf))
    changes = _status_requests(spark, sf)
    for part in (0, 1):
        table.change_status(changes.filter(F.pmod(F.xxhash64("incident_id", "changed_at"), F.lit(2)) == part))
    return table.read().select("id", "organization_id", "status")


# --- models -----------------------------------------------------------------------------------
_TRAINED: dict[tuple[str, str], tuple[Ensemble, DataFrame]] = {}


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _tenant_stream(spark, sf).withColumn("label", _category_label())


def _trained(spark: SparkSession, sf: str) -> tuple[Ensemble, DataFrame]:
    """One training run per session and folder, shared by the queries that only use its models."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = train.train_all(_labelled(spark, sf))
    return _TRAINED[key]


@query
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    score = ensemble.forest.decision(F.col("x"))
    return rows.select("event_id", "label", score.alias("score")).withColumn(
        "verdict", F.when(F.col("score") < 0, -1).otherwise(1)
    )


@query
def one_class_novelty(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    return rows.select("event_id", "label", ensemble.novelty.decision(F.col("x")).alias("score")).withColumn(
        "outlier", F.col("score") < 0
    )


@query
def direct_classifier(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    scored = classifiers.with_probabilities(ensemble.direct, rows.select("event_id", "label", "x"), "p")
    return scored.select("event_id", "label", classifiers.most_likely(F.col("p")).alias("prediction"))


@query
def sequence_classifier(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    scored = classifiers.with_probabilities(ensemble.sequence, train.windows_with_labels(rows), "p")
    return scored.select(*sequences.SEQUENCE, "label", classifiers.most_likely(F.col("p")).alias("prediction"))


@query
def train_meta(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    return ensemble.classify(rows, "pos").select("event_id", "label", "prediction", "has_seq", "threat_score")


@query
def ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, _ = _trained(spark, sf)
    return ensemble.predict(_tenant_stream(spark, sf)).select("organization_id", "seq", *PREDICTION_COLUMNS)


@query
def train_all(spark: SparkSession, sf: str) -> DataFrame:
    ensemble, rows = _trained(spark, sf)
    return train.evaluate(ensemble, rows)


@query
def model_io(spark: SparkSession, sf: str) -> DataFrame:
    """Classify with the ensemble read back from storage."""
    ensemble, rows = _trained(spark, sf)
    path = scratch_path(spark, "models")
    ensemble.save(spark, path)
    again = Ensemble.load(spark, path)
    return again.classify(rows, "pos").select("event_id", "prediction", "threat_score")


@query
def model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per tenant: what every scored event must satisfy, whatever the models have learnt."""
    ensemble, rows = _trained(spark, sf)
    events = _tenant_stream(spark, sf)
    whole = materialize(scaled_vectors(events, EVENT_KEYS))
    scored = ensemble.predict(events, vectors=whole).withColumn("position", F.col("seq"))
    category, count = F.col("attack_category"), lambda c: F.count_if(c).cast("long")
    finite = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    windowed = ensemble.classify(whole).groupBy("organization_id").agg(count(F.col("has_seq")).alias("windowed"))
    clean = whole.groupBy("organization_id").agg(count(finite & (F.size("x") == len(FEATURE_NAMES))).alias("clean_vectors"))
    path = scratch_path(spark, "models")
    ensemble.save(spark, path)
    again = Ensemble.load(spark, path).predict(events, vectors=whole).select("organization_id", "seq", *[F.col(c).alias(f"_{c}") for c in PREDICTION_COLUMNS])
    differs = F.struct(*PREDICTION_COLUMNS) != F.struct(*[F.col(f"_{c}").alias(c) for c in PREDICTION_COLUMNS])
    named = rules.attack_category(F.col("alert_type"))
    judged = scored.join(again, ["organization_id", "seq"]).groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("scored"),
        count(F.col("risk_tier") != rules.risk_tier(category)).alias("wrong_tiers"),
        count(F.col("ai_prediction") != rules.prediction_label(category)).alias("wrong_verdicts"),
        count(F.col("ai_reason") != rules.threat_reason(category, F.col("threat_score"))).alias("wrong_reasons"),
        count(~F.col("ai_score").between(0, 1) | F.isnan("ai_score")).alias("wrong_scores"),
        count((category == "Benign") & named.isNotNull()).alias("missed_alerts"),
        count(differs).alias("loaded_differs"),
    )
    splits = rows.groupBy("organization_id").agg(F.count(F.lit(1)).alias("split_rows"))
    return judged.join(windowed, "organization_id").join(clean, "organization_id").join(splits, "organization_id")


# the catalogue uses the operator names
QUERIES["first_truthy"] = QUERIES.pop("first_truthy_value")
QUERIES["flow_features"] = QUERIES.pop("feature_table")
QUERIES["robust_zscore"] = QUERIES.pop("robust_zscores")
