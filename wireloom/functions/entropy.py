"""Shannon entropy of short strings, in bits per character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed


def char_entropy(text: Column, length: Column | None = None) -> Column:
    """Entropy of the characters of ``text``; 0 for null and the empty string.

    The characters are sorted and the runs of two or more equal ones cut out, so only
    repeated characters reach the interpreted ``aggregate``: with c the run lengths and n the
    length, H = log2(n) - sum(c * log2(c)) / n, where runs of one add nothing.
    """
    n = F.length(text) if length is None else length
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))
    weighted = F.aggregate(runs, F.lit(0.0), lambda total, run: total + F.length(run) * F.log2(F.length(run)))
    # sum of c/n over all characters; 1 unless lower-casing changed the length
    share = F.length(text) / n
    return F.when(F.length(text) > 0, share * F.log2(n) - weighted / n).otherwise(F.lit(0.0))


def domain_entropy(domain: Column) -> Column:
    """Entropy of the first label, lower-cased; 0 for domains shorter than three characters."""
    label = F.substring_index(domain, ".", 1)
    return F.when(F.length(domain) >= 3, char_entropy(F.lower(label), F.length(label))).otherwise(F.lit(0.0))


def full_domain_entropy(domain: Column) -> Column:
    """The feature form: whole domain, case kept, a fixed value when there is none."""
    present = F.coalesce(domain, F.lit("")) != ""
    return F.when(present, char_entropy(domain)).otherwise(F.lit(fixed.DEFAULT_DOMAIN_ENTROPY))


def payload_entropy(source_ip: Column, destination_ip: Column, alert: Column, domain: Column) -> Column:
    """Entropy of the leading characters of the four fields joined together."""
    parts = [F.coalesce(c, F.lit("")) for c in (source_ip, destination_ip, alert, domain)]
    return char_entropy(F.substring(F.concat(*parts), 1, fixed.PAYLOAD_CHARS))


def looks_generated(domain: Column) -> Column:
    """True for domains whose first label is long and random enough to be machine-made."""
    return F.coalesce(
        (F.length(domain) > fixed.DGA_MIN_LENGTH) & (domain_entropy(domain) > fixed.DGA_MIN_ENTROPY),
        F.lit(False),
    )
