"""ATT&CK mapping: ordered text rules, generated-domain test, domain words, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.entropy import looks_generated
from wireloom.functions.text import any_of, choose, computed_once, contains_any


def taxonomy(spark: SparkSession) -> DataFrame:
    """Techniques with the name of their tactic (a fixed table)."""
    tactics = dict(fixed.TACTICS)
    rows = [(tactic, tactics[tactic], technique, name) for tactic, technique, name in fixed.TECHNIQUES]
    return spark.createDataFrame(rows, "tactic_id string, tactic string, technique_id string, technique string")


def rule_text(alert: Column, domain: Column, reason: Column, summary: Column) -> Column:
    """The text the rules read: four fields joined by blanks, lower-cased."""
    parts = [F.coalesce(c, F.lit("")) for c in (alert, domain, reason, summary)]
    return F.lower(F.concat_ws(" ", *parts))


def _matches(text: Column, patterns: list[str], word_boundaries: bool) -> Column:
    """Test of one rule.

    The text is long, so plain words are substring tests, which cost a fraction of a regular
    expression over it. A pattern with a gap first asks for its pieces, and only a text that
    has them all meets the expression. A pattern one of whose pieces is already a plain word of
    the rule can add no hit and is left out.
    """
    if word_boundaries:
        return F.rlike(text, F.lit(r"(?d)\b(?:" + "|".join(patterns) + r")\b"))
    has = lambda piece: F.contains(text, F.lit(piece))
    plain = [p for p in patterns if ".*" not in p]
    tests = [has(p) for p in plain]
    for pattern in patterns:
        pieces = pattern.split(".*")
        if len(pieces) > 1 and not any(piece in plain for piece in pieces):
            together = reduce(lambda a, b: a & b, (has(piece) for piece in pieces))
            tests.append(together & F.rlike(text, F.lit("(?d)" + pattern)))
    return any_of(tests)


def _names(tactic_id: str, technique_id: str, technique: str | None = None) -> Column:
    """Struct of the four result fields; a technique outside the taxonomy is named by its id."""
    tactic = dict(fixed.TACTICS)[tactic_id]
    known = {(t, q): n for t, q, n in fixed.TECHNIQUES}
    technique = technique or known.get((tactic_id, technique_id), technique_id)
    return F.struct(
        F.lit(tactic_id).alias("mitre_tactic_id"),
        F.lit(tactic).alias("mitre_tactic"),
        F.lit(technique_id).alias("mitre_technique_id"),
        F.lit(technique).alias("mitre_technique"),
    )


def mitre_struct(text: Column, domain: Column, word_boundaries: bool = False) -> Column:
    """Struct of tactic and technique, null when nothing matches.

    ``text`` should be a materialised column (see ``with_mitre``): every rule reads it.
    Rule order decides. By default a pattern may hit inside a word, so that ``rce`` also hits
    "force" and "source"; ``word_boundaries`` asks for whole words.
    """
    cases = [
        (_matches(text, patterns, word_boundaries), _names(tactic, technique))
        for tactic, technique, patterns in fixed.TEXT_RULES
    ]
    cases.append((looks_generated(domain), _names(*fixed.DGA_RULE)))
    bad_words = contains_any(F.lower(F.coalesce(domain, F.lit(""))), fixed.DOMAIN_RULE_WORDS)
    cases.append((bad_words, _names(*fixed.DOMAIN_RULE)))
    return choose(cases)


def with_mitre(df: DataFrame, reason: str = "ai_reason", word_boundaries: bool = False) -> DataFrame:
    """Add the four ATT&CK columns to incidents."""
    staged = df.withColumn(
        "_text", rule_text(F.col("alert_type"), F.col("domain"), F.col(reason), F.col("summary"))
    )
    staged = computed_once(staged, "_m", mitre_struct(F.col("_text"), F.col("domain"), word_boundaries))
    return staged.select(*df.columns, "_m.*")


def with_technique_names(df: DataFrame) -> DataFrame:
    """Taxonomy lookup for frames that hold ids only; unknown techniques keep their id as name.

    The taxonomy is a fixed table of 30 rows, so broadcasting it is always safe.
    """
    table = taxonomy(df.sparkSession).select(
        F.col("tactic_id").alias("mitre_tactic_id"),
        F.col("technique_id").alias("mitre_technique_id"),
        F.col("technique").alias("_technique"),
    )
    joined = df.join(F.broadcast(table), ["mitre_tactic_id", "mitre_technique_id"], "left")
    name = F.coalesce("_technique", "mitre_technique_id")
    return joined.withColumn("mitre_technique", name).select(
        *[c for c in df.columns if c != "mitre_technique"], "mitre_technique"
    )
