"""JSON lines: EVE, Zeek JSON and generic JSON to the normalised event.

A line is decoded once into a VARIANT; fields are read from its binary form. The dialects are
sets of column expressions, so the dispatcher is one projection, not three scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.network import is_private, valid_endpoints
from wireloom.functions.text import choose, computed_once, first_truthy, lookup, strip
from wireloom.schemas import PARSED_COLUMNS
from wireloom.sources.lines import FILE_KEYS, ORDER, keep_order

_TOP = [
    "event_type", "src_ip", "source_ip", "dest_ip", "dst_ip", "destination_ip", "domain", "timestamp",
    "time", "src_port", "dest_port", "proto", "_path", "log_type", "id.orig_h", "orig_h", "id.resp_h",
    "resp_h", "query", "host", "server_name", "ts", "service", "note", "src", "dst", "hostname",
    "@timestamp", "alert_type", "alert", "signature", "type", "protocol",
]
_TOP_TYPE = "struct<" + ", ".join(f"`{name}`: string" for name in _TOP) + ">"
_NESTED_TYPE = """struct<
    alert: struct<signature: string, category: string, severity: variant, signature_id: string, action: string>,
    http: struct<hostname: string>,
    dns: struct<rrname: string, queries: array<struct<rrname: string>>, answers: array<struct<rrname: string>>>,
    tls: struct<sni: string>>"""
# kept as VARIANT, a field that is present but null differs from one that is absent
_PRESENCE_TYPE = "struct<" + ", ".join(
    f"`{name}`: variant" for name in ["src_ip", "dest_ip", "id.orig_h", "orig_h", "_path"]
) + ">"
# a value that a truth test skips: the number 0, false, an empty list or object, as a member's value
_FALSE = r"(?:false|-?0[.0]*(?:[eE][+-]?[0-9]+)?|\[\s*\]|\{\s*\})(?=\s*[,}])"
_MAYBE_FALSE = r":\s*" + _FALSE
# from where the last match ended: text without such a member, strings taken whole, up to the next one
_TO_NEXT_FALSE = r'\G((?:[^":]++|"(?:[^"\\]++|\\.)*+"|:(?!\s*' + _FALSE + r"))*+:\s*)" + _FALSE


def without_false() -> Column:
    """The line with null in place of values that a truth test skips. The texts "0" and "false" are
    values and stay; only lines that may hold such a number or word are rewritten."""
    value = F.col("value")
    return F.when(F.rlike(value, F.lit(_MAYBE_FALSE)), F.regexp_replace(value, _TO_NEXT_FALSE, "$1null")).otherwise(value)


def severity_number() -> Column:
    """Severity if it is a number (or a truth value, which counts as 1 or 0); texts are none."""
    given = F.col("_j.nested.alert.severity")
    kind = F.schema_of_variant(given)
    flag = F.try_variant_get(given, "$", "boolean").cast("double")
    return F.when(kind == "BOOLEAN", flag).when(kind != "STRING", F.try_variant_get(given, "$", "double"))


def _f(name: str) -> Column:
    """Top-level field as text."""
    return F.col(f"_j.top.`{name}`")


def _n(path: str) -> Column:
    """Field of a nested object."""
    return F.col(f"_j.nested.{path}")


def _has(name: str) -> Column:
    return F.col(f"_j.present.`{name}`").isNotNull()


def _alert_text() -> Column:
    """The ``alert`` field as text; an empty object or list counts as missing."""
    return F.when(~_f("alert").isin("{}", "[]"), _f("alert"))


def with_json(lines: DataFrame) -> DataFrame:
    """Decode objects; anything else (scalars, arrays, broken text) is left null."""
    is_object = F.startswith(strip(F.col("value")), F.lit("{"))
    return lines.withColumn("_json", F.when(is_object, F.try_parse_json(without_false())))


def with_fields(lines: DataFrame) -> DataFrame:
    """Decode every line once and read the fields the dialects use into the struct ``_j``."""
    decoded = with_json(lines)
    fields = F.struct(
        F.col("_json").isNotNull().alias("is_object"),
        F.try_variant_get("_json", "$", _TOP_TYPE).alias("top"),
        F.try_variant_get("_json", "$", _NESTED_TYPE).alias("nested"),
        F.try_variant_get("_json", "$", _PRESENCE_TYPE).alias("present"),
    )
    read = computed_once(decoded, "_j", fields).select(*lines.columns, "_j")
    return read.withColumn("_dns", dns_domain()).withColumn("_name", event_domain())


def dns_domain() -> Column:
    """Name asked for: ``rrname``, else that of the first query, else of the first answer."""
    return first_truthy(
        _n("dns.rrname"), F.get(_n("dns.queries"), F.lit(0))["rrname"], F.get(_n("dns.answers"), F.lit(0))["rrname"]
    )


def event_domain() -> Column:
    """HTTP host, DNS name, TLS server name or the plain field, in that order."""
    return first_truthy(_n("http.hostname"), F.col("_dns"), _n("tls.sni"), _f("domain"))


def has_domain() -> Column:
    """The live filter's own test: answers do not count and blanks are no name."""
    name = first_truthy(
        _n("http.hostname"), _n("dns.rrname"), F.get(_n("dns.queries"), F.lit(0))["rrname"], _n("tls.sni"), _f("domain")
    )
    return strip(name) != ""


def display_alert(event_type: Column, domain: Column, proto: Column, signature: Column) -> Column:
    """Readable alert: the name looked up, the flow protocol or the signature."""
    named = domain != ""
    flow = F.when(proto != "", F.concat(event_type, F.lit(":"), F.lower(proto))).otherwise(event_type)
    return choose(
        [
            ((event_type == "dns") & named, F.concat(F.lit("dns-query: "), domain)),
            ((event_type == "tls") & named, F.concat(F.lit("tls: "), domain)),
            ((event_type == "http") & named, F.concat(F.lit("http: "), domain)),
            (event_type.isin("flow", "netflow"), flow),
        ],
        signature,
    )


def _missing() -> Column:
    return F.lit(None).cast("string")


def eve_columns() -> dict[str, Column]:
    event_type = F.coalesce(_f("event_type"), F.lit(""))
    domain = F.col("_name")
    proto = F.coalesce(_f("proto"), F.lit(""))
    signature = first_truthy(
        _n("alert.signature"), _n("alert.category"), _f("event_type"), default="suricata-event"
    )
    return {
        "source": F.lit("suricata"),
        "timestamp": first_truthy(_f("timestamp"), _f("time")),
        "source_ip": first_truthy(_f("src_ip"), _f("source_ip")),
        "destination_ip": first_truthy(_f("dest_ip"), _f("dst_ip"), _f("destination_ip")),
        "source_port": _f("src_port"),
        "destination_port": _f("dest_port"),
        "domain": domain,
        "alert_type": display_alert(event_type, domain, proto, signature),
        "protocol": proto,
        "event_type": event_type,
        "risk_level": lookup(severity_number(), fixed.SEVERITY_RISK, F.lit("Low")),
        "signature_id": _n("alert.signature_id"),
        "category": F.coalesce(_n("alert.category"), F.lit("")),
        "action": F.coalesce(_n("alert.action"), F.lit("")),
        "raw": F.col("value"),
    }


def zeek_json_columns() -> dict[str, Column]:
    log_type = first_truthy(_f("_path"), _f("log_type"), default="conn")
    proto = F.coalesce(_f("proto"), F.lit(""))
    detail = first_truthy(_f("service"), _f("note"))
    return {
        "source": F.concat(F.lit("zeek-"), log_type),
        "timestamp": first_truthy(_f("ts")),
        "source_ip": first_truthy(_f("id.orig_h"), _f("orig_h"), _f("src_ip")),
        "destination_ip": first_truthy(_f("id.resp_h"), _f("resp_h"), _f("dst_ip")),
        "source_port": _missing(),
        "destination_port": _missing(),
        "domain": first_truthy(_f("query"), _f("host"), _f("server_name"), _f("domain")),
        "alert_type": F.concat(F.lit("zeek-"), log_type, F.lit(":"), proto, F.lit(":"), detail),
        "protocol": proto,
        "event_type": _missing(),
        "risk_level": F.lit("Low"),
        "signature_id": _missing(),
        "category": _missing(),
        "action": _missing(),
        "raw": F.col("value"),
    }


def generic_json_columns() -> dict[str, Column]:
    field = lambda a: _alert_text() if a == "alert" else _f(a)
    alias = {name: first_truthy(*[field(a) for a in names]) for name, names in fixed.GENERIC_JSON_ALIASES.items()}
    # the alert may itself be an object, which then names itself
    is_object = (alias["alert_type"] == _f("alert")) & F.startswith(_f("alert"), F.lit("{"))
    inner = first_truthy(_n("alert.signature"), _n("alert.category"))
    return {
        "source": F.lit("generic-json"),
        **alias,
        "alert_type": F.when(is_object, inner).otherwise(alias["alert_type"]),
        "source_port": _missing(),
        "destination_port": _missing(),
        "event_type": _missing(),
        "risk_level": _missing(),
        "signature_id": _missing(),
        "category": _missing(),
        "action": _missing(),
        "raw": F.col("value"),
    }


def json_dialect() -> Column:
    """``eve``, ``zeek`` or ``generic``; null for a line that holds no object."""
    typed = F.coalesce(_f("event_type"), F.lit("")) != ""
    return choose(
        [
            (~F.col("_j.is_object"), F.lit(None)),
            (typed & (_has("src_ip") | _has("dest_ip")), F.lit("eve")),
            (_has("id.orig_h") | _has("orig_h") | _has("_path"), F.lit("zeek")),
        ],
        F.lit("generic"),
    )


def _normalized(lines: DataFrame, columns: dict[str, Column]) -> DataFrame:
    events = with_fields(lines).filter("_j.is_object").select(*keep_order(columns))
    return events.filter(valid_endpoints(F.col("source_ip"), F.col("destination_ip")))


def normalize_eve(lines: DataFrame) -> DataFrame:
    return _normalized(lines, eve_columns())


def normalize_zeek_json(lines: DataFrame) -> DataFrame:
    return _normalized(lines, zeek_json_columns())


def normalize_generic_json(lines: DataFrame) -> DataFrame:
    return _normalized(lines, generic_json_columns())


def with_dialect(lines: DataFrame) -> DataFrame:
    """Lines with their ``dialect``."""
    return with_fields(lines).withColumn("dialect", json_dialect())


def _merged_columns() -> dict[str, Column]:
    by_dialect = {"eve": eve_columns(), "zeek": zeek_json_columns(), "generic": generic_json_columns()}
    return {
        c: choose((F.col("dialect") == F.lit(d), columns[c]) for d, columns in by_dialect.items())
        for c in PARSED_COLUMNS
    }


def _parsed(lines: DataFrame) -> DataFrame:
    """Events of lines that have their dialect. The fields are computed once per line: rules applied
    to them later would otherwise each hold the whole expression of the field."""
    event = F.struct(*[c.alias(name) for name, c in _merged_columns().items()])
    found = computed_once(lines, "_e", event).select(*FILE_KEYS, *ORDER, *[F.col(f"_e.{c}").alias(c) for c in PARSED_COLUMNS])
    return found.filter(valid_endpoints(F.col("source_ip"), F.col("destination_ip")))


def parse_json(lines: DataFrame) -> DataFrame:
    """All dialects in one projection; lines that give no event are dropped."""
    return _parsed(with_dialect(lines).filter(F.col("dialect").isNotNull()))


def with_json_outcome(lines: DataFrame) -> DataFrame:
    """Lines with ``json_ok`` (gives an event) and ``json_corrupt`` (content, but no object)."""
    by_dialect = {"eve": eve_columns(), "zeek": zeek_json_columns(), "generic": generic_json_columns()}
    ends = [
        choose((F.col("dialect") == F.lit(d), columns[end]) for d, columns in by_dialect.items())
        for end in ("source_ip", "destination_ip")
    ]
    blank = strip(F.col("value")) == ""
    return with_dialect(lines).select(
        *FILE_KEYS, *ORDER, "value",
        (F.col("_j.is_object") & valid_endpoints(*ends)).alias("json_ok"),
        (~blank & ~F.col("_j.is_object")).alias("json_corrupt"),
    )


def is_relevant() -> Column:
    """Live filter: alerts and anomalies always; other kept types need both ends, and look-ups
    and requests also a name or an end outside the private ranges."""
    kind = F.coalesce(_f("event_type"), F.lit(""))
    src, dst = F.coalesce(_f("src_ip"), F.lit("")), F.coalesce(_f("dest_ip"), F.lit(""))
    outside = ~is_private(src) | ~is_private(dst)
    worth = ~kind.isin(fixed.DOMAIN_BOUND_TYPES) | has_domain() | outside
    return kind.isin(fixed.ALWAYS_KEPT_TYPES) | (
        kind.isin(fixed.KEPT_TYPES) & valid_endpoints(src, dst) & worth
    )


def relevant_lines(lines: DataFrame) -> DataFrame:
    """Object lines that pass the live filter; malformed ones are skipped."""
    return with_fields(lines).filter("_j.is_object").filter(is_relevant()).select(*lines.columns)


def parse_relevant(lines: DataFrame) -> DataFrame:
    """Events of the object lines that pass the live filter, each line decoded once."""
    return _parsed(with_dialect(lines).filter("_j.is_object").filter(is_relevant()))
