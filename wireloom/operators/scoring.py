"""From a category and a score to the six prediction columns, and the alert override."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions import rules
from wireloom.functions.text import lookup
from wireloom.operators.features import HEURISTIC_FEATURES, flow_features, heuristic_category
from wireloom.operators.ordering import SPLIT_ROWS
from wireloom.schemas import PREDICTION_COLUMNS


def clip_unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def with_predictions(scored: DataFrame, override: bool = True) -> DataFrame:
    """Complete ``attack_category`` and ``threat_score`` to all prediction columns.

    With ``override`` an event called Benign whose alert names an attack takes the category of
    the alert, and at least a middling score.
    """
    plain = scored.withColumn("threat_score", clip_unit(F.col("threat_score")))
    if override:
        named = plain.withColumn("_named", rules.attack_category(F.col("alert_type")))
        hit = (F.col("attack_category") == "Benign") & F.col("_named").isNotNull()
        low = F.col("threat_score") < fixed.OVERRIDE_FLOOR
        plain = named.withColumns(
            {
                "attack_category": F.when(hit, F.col("_named")).otherwise(F.col("attack_category")),
                "threat_score": F.when(hit & low, F.lit(fixed.OVERRIDE_SCORE)).otherwise(F.col("threat_score")),
            }
        ).drop("_named")
    category, score = F.col("attack_category"), F.col("threat_score")
    return plain.withColumns(
        {
            "risk_tier": rules.risk_tier(category),
            "ai_prediction": rules.prediction_label(category),
            "ai_score": F.bround(score, 4),
            "ai_reason": rules.threat_reason(category, score),
        }
    )


def heuristic_scores(
    events: DataFrame, keep: Sequence[str], scaled: bool = True, split_rows: int | None = SPLIT_ROWS
) -> DataFrame:
    """``keep`` plus category and score of the heuristic classifier (used without a model)."""
    features = flow_features(events, keep, HEURISTIC_FEATURES, split_rows)
    judged = features.withColumn("attack_category", heuristic_category(scaled))
    score = lookup(F.col("attack_category"), fixed.HEURISTIC_SCORES, F.lit(0.0))
    return judged.select(*keep, "attack_category", score.alias("threat_score"))


EVENT_KEYS = ("organization_id", "batch_id", "seq", "source_ip", "destination_ip", "alert_type")


def heuristic_predictions(
    events: DataFrame, scaled: bool = True, split_rows: int | None = SPLIT_ROWS, override: bool = True,
    keep: Sequence[str] = EVENT_KEYS,
) -> DataFrame:
    """Events' keys, or the columns to ``keep`` (``alert_type`` among them), with the six prediction
    columns of the model-free path."""
    scored = heuristic_scores(events, list(keep), scaled, split_rows)
    return with_predictions(scored, override).select(*keep, *PREDICTION_COLUMNS)
