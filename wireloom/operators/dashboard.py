"""Dashboard aggregates over stored incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.times import text_day


def incident_stats(incidents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tiles: total, counts per risk and status; ``high`` is also the alert banner's count."""
    is_risk = lambda v: F.count_if(F.col("risk_level") == v)
    is_status = lambda v: F.count_if(F.col("status") == v)
    return incidents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        is_risk("High").alias("high"), is_risk("Medium").alias("medium"), is_risk("Low").alias("low"),
        is_status("Active").alias("active"), is_status("Monitoring").alias("monitoring"),
        is_status("Cleared").alias("cleared"),
    )


def high_risk_list(incidents: DataFrame) -> DataFrame:
    """The incidents behind the banner."""
    return incidents.filter(F.col("risk_level") == "High")


def mitre_heatmap(incidents: DataFrame) -> DataFrame:
    """Count and intensity of each of the 14 tactics; other tactics are left out.

    At most 14 counted rows remain after the filter, so broadcasting them is safe and the
    unpartitioned maximum runs over 14 rows.
    """
    spark = incidents.sparkSession
    cells = spark.createDataFrame(list(enumerate(fixed.HEATMAP_TACTICS)), "position int, tactic string")
    counted = (
        incidents.filter(F.col("mitre_tactic").isin(fixed.HEATMAP_TACTICS))
        .groupBy(F.col("mitre_tactic").alias("tactic"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = cells.join(F.broadcast(counted), "tactic", "left").select(
        "position", "tactic", F.coalesce("n", F.lit(0)).alias("incidents")
    )
    peak = F.greatest(F.max("incidents").over(W.partitionBy()), F.lit(1))
    return filled.withColumn("intensity", F.col("incidents") / peak)


def risk_counts() -> list[Column]:
    """High, medium and low; anything that is neither high nor medium counts as low."""
    risk = F.lower(F.coalesce("risk_level", F.lit("")))
    return [
        F.count_if(risk == "high").alias("high"), F.count_if(risk == "medium").alias("medium"),
        F.count_if(~risk.isin("high", "medium")).alias("low"),
    ]


def timeline_shares(per_day: DataFrame, days: int = 10) -> DataFrame:
    """The last ``days`` rows of (day, high, medium, low) with shares for drawing."""
    recent = per_day.orderBy(F.desc("day")).limit(days).withColumn("total", F.expr("high + medium + low"))
    peak = F.greatest(F.max("total").over(W.partitionBy()), F.lit(1))
    share = lambda c: F.col(c) / F.greatest("total", F.lit(1)) * 100
    return recent.select(
        "day", "high", "medium", "low", "total",
        (F.col("total") / peak * 100).alias("height_pct"),
        share("high").alias("high_pct"), share("medium").alias("medium_pct"), share("low").alias("low_pct"),
    ).orderBy("day")


def risk_timeline(incidents: DataFrame, days: int = 10) -> DataFrame:
    """High, medium and low incidents of the last ``days`` days, with shares for drawing.

    Days are the leading ten characters of the time stamp; incidents without one count under
    "Unknown", which sorts last.
    """
    per_day = incidents.groupBy(text_day(F.col("timestamp")).alias("day")).agg(*risk_counts())
    return timeline_shares(per_day, days)


def metric_rollup(samples: DataFrame) -> DataFrame:
    """Counters summed, gauges at their last value, timers as count, average, minimum, maximum.

    ``samples`` has ``name, kind, value, ts, sample_id``; the id settles equal times.
    """
    kind = F.col("kind")
    only = lambda k, c: F.when(kind == k, c)
    value = F.col("value")
    return samples.groupBy("kind", "name").agg(
        F.sum(only("counter", value)).alias("total"),
        F.max_by(only("gauge", value), F.struct("ts", "sample_id")).alias("last_value"),
        F.count(only("timer", value)).alias("timer_count"),
        F.avg(only("timer", value)).alias("avg_ms"),
        F.min(only("timer", value)).alias("min_ms"),
        F.max(only("timer", value)).alias("max_ms"),
    )
