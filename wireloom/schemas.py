"""Fixed schemas: the normalised event and the stored incident."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("organization_id", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.StringType()),
        T.StructField("destination_port", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("signature_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# The part of the event every parser sets (ports and alert detail come from some only).
PARSED_COLUMNS = [
    "source", "timestamp", "source_ip", "destination_ip", "source_port", "destination_port",
    "domain", "alert_type", "protocol", "event_type", "risk_level", "signature_id",
    "category", "action", "raw",
]

INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("organization_id", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ai_prediction", T.StringType()),
        T.StructField("ai_score", T.DoubleType()),
        T.StructField("ai_reason", T.StringType()),
        T.StructField("attack_category", T.StringType()),
        T.StructField("threat_score", T.DoubleType()),
        T.StructField("risk_tier", T.IntegerType()),
        T.StructField("mitre_tactic_id", T.StringType()),
        T.StructField("mitre_tactic", T.StringType()),
        T.StructField("mitre_technique_id", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
    ]
)
INCIDENT_COLUMNS = INCIDENT_SCHEMA.fieldNames()

# What a tenant sees: the incident without the tenant key.
PUBLIC_INCIDENT_COLUMNS = [c for c in INCIDENT_COLUMNS if c != "organization_id"]

PREDICTION_COLUMNS = [
    "attack_category", "threat_score", "risk_tier", "ai_prediction", "ai_score", "ai_reason",
]
