"""Daily text report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.text import choose
from wireloom.functions.times import utc_day

DOUBLE_RULE = "═" * 70
RULE = "─" * 70
SECTIONS = [("High", "HIGH RISK INCIDENTS"), ("Medium", "MEDIUM RISK INCIDENTS"), ("Low", "LOW RISK INCIDENTS")]


def report_day(incidents: DataFrame, day: dt.date) -> DataFrame:
    """Incidents of one UTC day; those without a readable time stamp are left out."""
    return incidents.filter(utc_day(F.col("timestamp")) == F.lit(day))


def _or_na(column: str) -> Column:
    text = F.col(column)
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise("N/A")


def _incident_lines() -> Column:
    tactic = F.concat(
        _or_na("mitre_tactic"),
        F.when(F.coalesce("mitre_tactic_id", F.lit("")) != "",
               F.concat(F.lit(" ("), F.col("mitre_tactic_id"), F.lit(")"))).otherwise(""),
    )
    score = F.coalesce(F.format_string("%.4f", F.col("ai_score")), F.lit("N/A"))
    score = F.when(F.col("ai_score").isNull(), "N/A").otherwise(score)
    label = lambda name, value: F.concat(F.lit(f"  {name:<10}: "), value)
    return F.array(
        F.concat(F.lit("  Incident #"), F.col("id").cast("string")),
        label("Time", _or_na("timestamp")),
        label("Alert", _or_na("alert_type")),
        label("Source IP", _or_na("source_ip")),
        label("Dest IP", _or_na("destination_ip")),
        label("Domain", _or_na("domain")),
        label("Status", _or_na("status")),
        label("MITRE", tactic),
        label("AI Score", score),
        label("Summary", _or_na("summary")),
        label("Action", _or_na("recommended_action")),
        F.lit(""),
    )


def daily_report(incidents: DataFrame, day: dt.date) -> DataFrame:
    """Report lines with their order: ``section, neg_id, line_no, line``.

    Section 0 is the head with the counts, 1 to 3 the risk levels (newest incident first), 4
    the end. Lines are rows, so a day of any size is sorted and written by many tasks.
    """
    today = report_day(incidents, day)
    counts = today.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_level") == r).alias(r) for r, _ in SECTIONS],
    )
    text = lambda c: F.col(c).cast("string")
    head = F.array(
        F.lit(DOUBLE_RULE),
        F.lit("  NETWORK ACTIVITY REPORT"),
        F.lit(f"  Date       : {day.isoformat()}"),
        F.lit(DOUBLE_RULE),
        F.lit(""),
        F.lit("SUMMARY"),
        F.concat(F.lit("  Total Incidents Today : "), text("total")),
        *[F.concat(F.lit(f"  {r + ' Risk':<22}: "), text(r)) for r, _ in SECTIONS],
        F.lit(""),
    )

    def block(section: int, lines: Column) -> Column:
        return F.transform(lines, lambda line, at: F.struct(
            F.lit(section).alias("section"), F.lit(None).cast("long").alias("neg_id"), at.cast("int").alias("line_no"), line.alias("line")))

    blocks = [block(0, head)]
    for i, (risk, title) in enumerate(SECTIONS, start=1):
        heading = F.concat(F.lit(f"{title} ("), text(risk), F.lit(")"))
        none = F.when(F.col(risk) == 0, F.array(F.lit("  None"), F.lit(""))).otherwise(F.array().cast("array<string>"))
        blocks.append(block(i, F.concat(F.array(F.lit(RULE), heading, F.lit(RULE)), none)))
    blocks.append(block(4, F.array(F.lit(DOUBLE_RULE), F.lit("  END OF REPORT"), F.lit(DOUBLE_RULE))))
    frame = counts.select(F.inline(F.concat(*blocks)))  # the counts are computed once
    section = choose((F.col("risk_level") == r, F.lit(i)) for i, (r, _) in enumerate(SECTIONS, start=1))
    body = today.filter(F.col("risk_level").isin([r for r, _ in SECTIONS]))
    body = body.select(section.alias("section"), (-F.col("id")).alias("neg_id"),
                       F.posexplode(_incident_lines()).alias("line_no", "line"))
    return frame.unionByName(body)


def ordered(report: DataFrame) -> DataFrame:
    """Reading order; a range-partitioned sort. Headings have no id and come first."""
    return report.orderBy("section", F.col("neg_id").asc_nulls_first(), "line_no")


def write_report(report: DataFrame, path: str) -> None:
    """Write the lines as text; part files follow the reading order."""
    ordered(report).select("line").write.mode("errorifexists").text(path)
