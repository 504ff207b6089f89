"""Rule classification: risk, category, tier, reason, score and title, all as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.text import choose, contains_any, lookup


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def risk_level(alert: Column, domain: Column, hint: Column | None = None) -> Column:
    """High, Medium or Low from the hint, the alert words and the domain words.

    A missing hint must not turn a test into null, hence the null-safe comparisons.
    """
    hint = F.lit(None).cast("string") if hint is None else hint
    high = (
        hint.eqNullSafe("High")
        | contains_any(_lower(alert), fixed.HIGH_ALERT_WORDS)
        | contains_any(_lower(domain), fixed.BAD_DOMAIN_WORDS)
    )
    medium = hint.eqNullSafe("Medium") | contains_any(_lower(alert), fixed.MEDIUM_ALERT_WORDS)
    return F.when(high, "High").when(medium, "Medium").otherwise("Low")


def risk_status(risk: Column) -> Column:
    return lookup(risk, fixed.RISK_STATUS)


def recommended_action(risk: Column) -> Column:
    return lookup(risk, fixed.RISK_ACTION)


def incident_summary(risk: Column, alert: Column, source_ip: Column, destination_ip: Column, domain: Column) -> Column:
    """One sentence: signal, alert, both ends and, when known, the domain."""
    domain_clause = F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit(" | Domain: "), domain)).otherwise("")
    return F.concat(
        lookup(risk, fixed.RISK_SIGNAL), F.lit(": "), alert, F.lit(" | "),
        source_ip, F.lit(" → "), destination_ip, domain_clause, F.lit("."),
    )


def attack_category(alert: Column) -> Column:
    """Category named by the alert words, or null."""
    text = _lower(alert)
    return choose((contains_any(text, words), F.lit(name)) for words, name in fixed.ALERT_CATEGORY_WORDS)


def risk_tier(category: Column, default: int = 2) -> Column:
    return lookup(category, fixed.CATEGORY_TIER, F.lit(default))


def tier_description(tier: Column) -> Column:
    return lookup(tier, fixed.TIER_TEXT, F.lit("Unknown tier"))


def threat_reason(category: Column, score: Column) -> Column:
    """Reason text; the percent is cut off, not rounded (0.29 reads 28)."""
    percent = F.floor(score * F.lit(100.0)).cast("string")
    texts = [
        (category == F.lit(name), F.concat(F.lit(before), percent, F.lit(after)))
        for name, (before, after) in fixed.REASON_TEXT.items()
    ]
    benign = (category == F.lit("Benign"), F.lit(fixed.BENIGN_REASON))
    before, after = fixed.OTHER_REASON
    return choose([benign, *texts], F.concat(F.lit(before), percent, F.lit(after)))


def prediction_label(category: Column) -> Column:
    return F.when(category == "Benign", "normal").otherwise("suspicious")


def backfilled_score(score: Column, risk: Column) -> Column:
    """The model's score, or the default of the risk level when it gave none or zero."""
    return F.coalesce(F.when(score != 0.0, score), lookup(risk, fixed.RISK_DEFAULT_SCORE, F.lit(0.28)))


def backfilled_prediction(prediction: Column, risk: Column) -> Column:
    return F.coalesce(F.when(prediction != "", prediction), F.when(risk != "Low", "suspicious").otherwise("normal"))


def backfilled_reason(reason: Column, risk: Column) -> Column:
    by_rule = F.concat(F.lit("Rule-based detection: "), risk, F.lit(" risk threat signature identified."))
    return F.coalesce(F.when(reason != "", reason), by_rule)


def _title_case(text: Column) -> Column:
    """Upper-case the first letter of every word and leave the rest as it is."""
    edges = r"(?<=[A-Za-z0-9_])(?=[^A-Za-z0-9_])|(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])"
    head = lambda w: F.substring(w, 1, 1)
    words = F.transform(
        F.split(F.translate(text, "-_:", "   "), edges),
        lambda w: F.when((head(w) >= "a") & (head(w) <= "z"), F.concat(F.upper(head(w)), F.substr(w, F.lit(2)))).otherwise(w),
    )
    return F.array_join(words, "")


def friendly_title(alert: Column) -> Column:
    """Readable title of an incident."""
    text = F.lower(alert)
    detail = F.coalesce(F.get(F.split(alert, ": "), F.lit(1)), F.lit(""))
    cases = [(F.coalesce(alert, F.lit("")) == "", F.lit(fixed.NO_ALERT_TITLE))]
    for kind, words, title in fixed.TITLE_RULES:
        if kind == "detail":
            cases.append((F.startswith(text, F.lit(words[0])), F.concat(F.lit(title), detail)))
        elif kind == "prefix":
            cases.append((F.startswith(text, F.lit(words[0])), F.lit(title)))
        else:
            cases.append((contains_any(text, words), F.lit(title)))
    return choose(cases, _title_case(alert))
