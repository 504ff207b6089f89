"""Detection, first-match lookup, de-duplication and the life of an incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import rules
from wireloom.functions.network import valid_endpoints
from wireloom.operators.lookups import key_lookup
from wireloom.schemas import PREDICTION_COLUMNS, PUBLIC_INCIDENT_COLUMNS

BATCH_PAIR = ["organization_id", "batch_id", "source_ip", "destination_ip"]
INCIDENT_KEY = ["organization_id", "source_ip", "destination_ip", "timestamp", "alert_type"]


def classify_risk(events: DataFrame) -> DataFrame:
    """Risk, status and recommended action of every event with both ends known."""
    risk = rules.risk_level(F.col("alert_type"), F.col("domain"), F.col("risk_level"))
    known = events.filter(valid_endpoints(F.col("source_ip"), F.col("destination_ip")))
    return known.withColumn("risk_level", risk).withColumns(
        {
            "status": rules.risk_status(F.col("risk_level")),
            "recommended_action": rules.recommended_action(F.col("risk_level")),
        }
    )


def detect_suspicious(events: DataFrame) -> DataFrame:
    """Classified events with their summary; low-risk events without a domain are dropped."""
    classified = classify_risk(events)
    kept = classified.filter((F.col("risk_level") != "Low") | (F.coalesce("domain", F.lit("")) != ""))
    return kept.withColumn(
        "summary",
        rules.incident_summary(
            F.col("risk_level"), F.col("alert_type"), F.col("source_ip"), F.col("destination_ip"), F.col("domain")
        ),
    )


def first_match_predictions(
    incidents: DataFrame,
    predictions: DataFrame,
    values: Sequence[str] = PREDICTION_COLUMNS,
    keys: Sequence[str] = BATCH_PAIR,
    order: str = "seq",
) -> DataFrame:
    """Give each incident the prediction of the first event of its batch with the same two ends.

    The first event per pair is found by a map-side combined aggregate, so the lookup table has
    one row per pair however often a pair occurs.
    """
    firsts = predictions.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_first"))
    joined = key_lookup(incidents, firsts, keys)
    return joined.select(*incidents.columns, *[F.col(f"_first.{v}").alias(v) for v in values])


def flag_duplicates(
    incoming: DataFrame, stored: DataFrame, per_tenant: bool = True
) -> DataFrame:
    """Add ``is_duplicate``: an incident with the same key is stored already.

    Null equals null. The key holds the tenant unless ``per_tenant`` is off, in which case one
    tenant's stored incident hides the same incident of another tenant.
    """
    keys = INCIDENT_KEY if per_tenant else INCIDENT_KEY[1:]
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    looked_up = key_lookup(incoming, known, keys)
    return looked_up.withColumn("is_duplicate", F.coalesce("_known", F.lit(False))).drop("_known")


def dedup_incidents(
    incoming: DataFrame,
    stored: DataFrame,
    per_tenant: bool = True,
    within_batch: bool = False,
    order: str = "seq",
) -> DataFrame:
    """Incidents not stored yet.

    Equal incidents inside one batch all stay, as the stored side is read before the batch is
    written; ``within_batch`` keeps only the one with the lowest ``order``.
    """
    fresh = flag_duplicates(incoming, stored, per_tenant).filter(~F.col("is_duplicate"))
    fresh = fresh.drop("is_duplicate")
    if not within_batch:
        return fresh
    keys = INCIDENT_KEY if per_tenant else INCIDENT_KEY[1:]
    rest = [c for c in fresh.columns if c not in keys]
    # an aggregate, not a row number: copies of a hot key are combined before the shuffle
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in fresh.columns])


def ingest_result(flagged: DataFrame, by: Sequence[str] = ("organization_id",)) -> DataFrame:
    """Created and skipped counts of one ingest."""
    return flagged.groupBy(*by).agg(
        F.count_if(~F.col("is_duplicate")).alias("incidents_found"),
        F.count_if("is_duplicate").alias("duplicates_skipped"),
    )


def backfill_predictions(incidents: DataFrame) -> DataFrame:
    """Fill score, prediction and reason from the risk level where the model gave none."""
    risk = F.col("risk_level")
    return incidents.withColumns(
        {
            "ai_score": rules.backfilled_score(F.col("ai_score"), risk),
            "ai_prediction": rules.backfilled_prediction(F.col("ai_prediction"), risk),
            "ai_reason": rules.backfilled_reason(F.col("ai_reason"), risk),
        }
    )


def tenant_incidents(incidents: DataFrame, organization_id: int) -> DataFrame:
    """A tenant's incidents, newest first, without the tenant key."""
    own = incidents.filter(F.col("organization_id") == organization_id)
    return own.select(*PUBLIC_INCIDENT_COLUMNS).orderBy(F.desc("id"))


def latest_incidents(incidents: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest incidents (a top-k, so only k rows per task travel)."""
    return incidents.orderBy(F.desc("id")).limit(k)


def facet_filter(incidents: DataFrame, facet: str) -> DataFrame:
    """Incidents whose risk or status equals the facet; ``all`` keeps everything."""
    if facet == "all":
        return incidents
    hit = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) == facet
    return incidents.filter(hit("risk_level") | hit("status"))


def search_incidents(incidents: DataFrame, text: str) -> DataFrame:
    """Incidents that hold ``text`` in an address, the alert, the domain or the tactic.

    The needle is lower-cased; addresses are compared as they are.
    """
    if not text:
        return incidents
    needle = F.lit(text.lower())
    raw = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), needle)
    low = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
    return incidents.filter(
        raw("source_ip") | raw("destination_ip") | low("alert_type") | low("domain") | low("mitre_tactic")
    )


def allowed_changes(changes: DataFrame) -> DataFrame:
    """Approve and reject requests that may be carried out, with the ``status`` each asks for.

    ``changes``: ``organization_id, incident_id, action, role, changed_at``. Viewers may not change
    anything.
    """
    allowed = changes.filter((F.col("role") != "VIEWER") & F.col("action").isin("approve", "reject"))
    return allowed.withColumn("status", F.when(F.col("action") == "approve", "Approved").otherwise("Rejected"))


def latest_status(changes: DataFrame) -> DataFrame:
    """The latest ``status`` of each incident; of requests at the same time a rejection counts."""
    return changes.groupBy("organization_id", "incident_id").agg(F.max_by("status", F.struct("changed_at", "status")).alias("status"))


def with_latest_status(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents in the state that their own tenant's latest change gave them."""
    latest = latest_status(changes).select("organization_id", F.col("incident_id").alias("id"), F.col("status").alias("_status"))
    joined = key_lookup(incidents, latest, ["organization_id", "id"])
    return joined.withColumn("status", F.coalesce("_status", "status")).select(*incidents.columns)


def apply_status_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply approve and reject requests: ``organization_id, incident_id, action, role, changed_at``.

    Viewers may not change anything and a request reaches its own tenant only. Of several
    requests for one incident the latest counts.
    """
    return with_latest_status(incidents, allowed_changes(changes))


def purge_tenant(incidents: DataFrame, organization_id: int, role: str) -> DataFrame:
    """What stays after a tenant deletes all its incidents; administrators only."""
    if role != "ADMIN":
        raise PermissionError("only an ADMIN may delete incidents")
    return incidents.filter(~F.col("organization_id").eqNullSafe(organization_id))


def member_roles(users: DataFrame) -> DataFrame:
    """Role of each user (``organization_id, user_id, created_at``): an organization's first
    member is its ADMIN, later ones are ANALYST.

    The first member is found by an aggregate and matched on the user, so no task ever sorts
    all members of one organization.
    """
    first = users.groupBy("organization_id").agg(F.min(F.struct("created_at", "user_id")).alias("_f"))
    admins = first.select("organization_id", F.col("_f.user_id").alias("user_id"), F.lit("ADMIN").alias("_role"))
    joined = users.join(admins, ["organization_id", "user_id"], "left")
    return joined.select(*users.columns, F.coalesce("_role", F.lit("ANALYST")).alias("role"))


def tenant_directory(organizations: DataFrame, users: DataFrame, incidents: DataFrame) -> DataFrame:
    """Organizations with their member and incident counts.

    Both sides are counted per organization before they meet, so the joins never fan out.
    """
    members = users.groupBy("organization_id").agg(F.count(F.lit(1)).alias("members"))
    counted = incidents.groupBy("organization_id").agg(F.count(F.lit(1)).alias("incidents"))
    joined = organizations.join(members, "organization_id", "left").join(counted, "organization_id", "left")
    return joined.select(
        "organization_id", "organization_name",
        F.coalesce("members", F.lit(0)).alias("members"),
        F.coalesce("incidents", F.lit(0)).alias("incidents"),
    )
