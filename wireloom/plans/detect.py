"""From normalised events to incidents ready to store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions.mitre import with_mitre
from wireloom.operators.incidents import (
    backfill_predictions,
    dedup_incidents,
    detect_suspicious,
    first_match_predictions,
)
from wireloom.operators.ordering import SPLIT_ROWS
from wireloom.operators.scoring import heuristic_predictions
from wireloom.schemas import INCIDENT_COLUMNS, INCIDENT_SCHEMA, PREDICTION_COLUMNS

Scorer = Callable[[DataFrame], DataFrame]


def heuristic_scorer(scaled: bool = True, split_rows: int | None = SPLIT_ROWS) -> Scorer:
    """The scorer used when no trained model is at hand."""
    return lambda events: heuristic_predictions(events, scaled, split_rows)


def score_incidents(events: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Suspicious events with prediction and ATT&CK columns, before any comparison with the store.

    All events are scored, also those that raise no incident: the windows of later events and
    the first-match rule need them. The reason that decides the ATT&CK mapping is the model's
    own; the score and texts are filled up after it.
    """
    scorer = scorer or heuristic_scorer()
    suspicious = detect_suspicious(events)
    matched = first_match_predictions(suspicious, scorer(events), PREDICTION_COLUMNS)
    return backfill_predictions(with_mitre(matched))


def as_incidents(scored: DataFrame, id_column: str = "seq") -> DataFrame:
    """Fixed incident schema plus ``seq``."""
    typed = [F.col(f.name).cast(f.dataType) for f in INCIDENT_SCHEMA if f.name != "id"]
    return scored.select(F.col(id_column).cast("long").alias("id"), *typed).select(*INCIDENT_COLUMNS)


def detect_incidents(
    events: DataFrame,
    stored: DataFrame | None = None,
    scorer: Scorer | None = None,
    per_tenant: bool = True,
    within_batch: bool = False,
) -> DataFrame:
    """Incidents that are new with respect to ``stored``."""
    scored = score_incidents(events, scorer)
    if stored is not None:
        scored = dedup_incidents(scored, stored, per_tenant, within_batch)
    return as_incidents(scored)
