"""Address, port and protocol helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.text import contains_any, starts_with_any

# a port-like word: optional punctuation around an optional sign and a number 1 to 65535
_PORT_WORD = (
    r"(?:^|\s)[:,/()]*\+?0*"
    r"(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3})"
    r"[:,/()]*(?=\s|$)"
)


def is_private(ip: Column) -> Column:
    """Private, loopback or link-local address, judged by its text prefix."""
    return starts_with_any(F.coalesce(ip, F.lit("")), fixed.PRIVATE_PREFIXES)


def valid_endpoints(source_ip: Column, destination_ip: Column) -> Column:
    """Both ends are known."""
    return (F.coalesce(source_ip, F.lit("")) != "") & (F.coalesce(destination_ip, F.lit("")) != "")


def extract_port(text: Column) -> Column:
    """First word of ``text`` that reads as a port number, else the default port.

    One regular expression finds the first word in range, so no array of words is built.
    Digit groups joined by an underscore count as one number.
    """
    joined = F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(text)
    found = F.regexp_extract(F.coalesce(joined, F.lit("")), _PORT_WORD, 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(fixed.DEFAULT_DST_PORT))


def protocol_number(alert: Column, port: Column) -> Column:
    """1 for ICMP, 17 for UDP (by word or well-known port), else 6."""
    text = F.lower(F.coalesce(alert, F.lit("")))
    udp = F.contains(text, F.lit("udp")) | port.isin(fixed.UDP_PORTS)
    return F.when(F.contains(text, F.lit("icmp")), 1).when(udp, 17).otherwise(6)


def has_any(alert: Column, words: list[str]) -> Column:
    """Behaviour flag: the lower-cased alert holds one of the words."""
    return contains_any(alert, words)
