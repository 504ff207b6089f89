"""Header-driven and plain delimited text: Zeek TSV, CSV, comma-separated lines.

A file's header decides which cell holds which field. That is worked out once per file (see
``router.file_profile``) as lists of cell positions; a line is then split and indexed, with no
map per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.network import valid_endpoints
from wireloom.functions.text import any_of, choose, computed_once, first_truthy, strip
from wireloom.sources.lines import is_blank, keep_order

ZEEK_FIELDS = {
    "source_ip": ["id.orig_h", "src"],
    "destination_ip": ["id.resp_h", "dst"],
    "domain": ["host", "query", "server_name", "filename"],
    "timestamp": ["ts"],
    "source_port": ["id.orig_p"],
    "destination_port": ["id.resp_p"],
    "proto": ["proto"], "service": ["service"], "conn_state": ["conn_state"],
    "qtype_name": ["qtype_name"], "query": ["query"], "method": ["method"],
    "status_code": ["status_code"], "note": ["note"], "version": ["version"],
    "validation_status": ["validation_status"],
}


def positions(header: Column, aliases: dict[str, list[str]]) -> Column:
    """Struct: field -> 1-based cells that may hold it, in order of preference (0 = absent).

    A name that occurs twice in a header means its last cell.
    """
    backwards = F.reverse(header)

    def last(name: str) -> Column:
        found = F.array_position(backwards, name)
        return F.when(found > 0, F.size(header) - found + 1).otherwise(F.lit(0)).cast("int")

    return F.struct(*[F.array(*[last(n) for n in names]).alias(field) for field, names in aliases.items()])


def cell(cells: Column, where: Column, choices: int) -> Column:
    """First non-empty cell among the listed positions."""
    return first_truthy(*[F.get(cells, F.get(where, F.lit(i)) - 1) for i in range(choices)], default=None)


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; a cell may be quoted, with doubled quotes inside."""
    quoted = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), F.lit(1)
    )
    # what follows the closing quote within a cell is taken as it is
    part = lambda c, i: F.regexp_extract(c, r'^"((?:[^"]++|"")*+)"([^,]*+)', i)
    unquoted = F.transform(
        quoted,
        lambda c: F.when(
            F.startswith(c, F.lit('"')), F.concat(F.replace(part(c, 1), F.lit('""'), F.lit('"')), part(c, 2))
        ).otherwise(c),
    )
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, ","))


def _absent() -> Column:
    return F.lit(None).cast("string")


def zeek_alert(log_type: Column, f: dict[str, Column]) -> Column:
    """Alert text of a Zeek row, by log type."""
    named = {k: F.coalesce(v, F.lit("")) for k, v in f.items()}
    colon = F.lit(":")
    return choose(
        [
            (log_type == "conn", F.concat(
                F.lit("zeek-conn:"), named["proto"], colon, F.coalesce(f["service"], F.lit("unknown")),
                colon, named["conn_state"])),
            (log_type == "dns", F.concat(
                F.lit("zeek-dns:"), F.coalesce(f["qtype_name"], F.lit("A")), colon, named["query"])),
            (log_type == "http", F.concat(
                F.lit("zeek-http:"), F.coalesce(f["method"], F.lit("GET")), colon, named["status_code"])),
            (log_type == "notice", F.concat(F.lit("zeek-notice:"), F.coalesce(f["note"], F.lit("notice")))),
            (log_type == "ssl", F.concat(
                F.lit("zeek-ssl:"), named["version"], colon, F.coalesce(f["validation_status"], F.lit("ok")))),
        ],
        F.concat(F.lit("zeek-"), log_type),
    )


def zeek_risk(log_type: Column, conn_state: Column, note: Column, validation: Column) -> Column:
    """Risk hint of a Zeek row: connection state, notice kind or certificate failure."""
    state_bad = F.coalesce(conn_state, F.lit("")).isin(fixed.ZEEK_BAD_CONN_STATES)
    note_text = F.coalesce(note, F.lit("notice"))
    note_bad = any_of(F.contains(note_text, F.lit(n)) for n in fixed.ZEEK_BAD_NOTES)
    failed = F.contains(F.lower(F.coalesce(validation, F.lit("ok"))), F.lit("fail"))
    return choose(
        [
            ((log_type == "conn") & state_bad, F.lit("Medium")),
            ((log_type == "notice") & note_bad, F.lit("High")),
            (log_type == "notice", F.lit("Medium")),
            ((log_type == "ssl") & failed, F.lit("Medium")),
        ],
        F.lit("Low"),
    )


def parse_zeek_tsv(lines: DataFrame) -> DataFrame:
    """Rows of Zeek files. ``lines`` carries ``zeek_type`` and ``zeek_cells`` of its file.

    The whole line is stripped before it is split, so empty cells at either end vanish; rows
    with fewer than four cells are dropped, short rows leave their last fields empty.
    """
    cells = F.transform(F.split("_line", "\t"), lambda c: F.when(~c.isin("-", "(empty)"), c))
    body = lines.filter(~F.startswith(F.col("value"), F.lit("#")) & ~is_blank(F.col("value")))
    split = computed_once(body.withColumn("_line", strip(F.col("value"))), "_cells", cells)
    split = split.filter(F.size("_cells") >= 4)
    fields = {
        name: cell(F.col("_cells"), F.col(f"zeek_cells.{name}"), len(names)) for name, names in ZEEK_FIELDS.items()
    }
    staged = split.select("*", *[c.alias(f"_z_{n}") for n, c in fields.items()])
    f = {n: F.col(f"_z_{n}") for n in fields}
    kind = F.col("zeek_type")
    columns = {
        "source": F.concat(F.lit("zeek-"), kind),
        "timestamp": F.coalesce(f["timestamp"], F.lit("")),
        "source_ip": f["source_ip"],
        "destination_ip": f["destination_ip"],
        "source_port": f["source_port"],
        "destination_port": f["destination_port"],
        "domain": F.coalesce(f["domain"], F.lit("")),
        "alert_type": zeek_alert(kind, f),
        "protocol": F.coalesce(f["proto"], F.lit("")),
        "event_type": _absent(),
        "risk_level": zeek_risk(kind, f["conn_state"], f["note"], f["validation_status"]),
        "signature_id": _absent(), "category": _absent(), "action": _absent(),
        "raw": F.col("_line"),
    }
    return staged.filter(valid_endpoints(f["source_ip"], f["destination_ip"])).select(*keep_order(columns))


def parse_csv(lines: DataFrame) -> DataFrame:
    """Rows of CSV files. ``lines`` carries ``csv_cells`` and the header line's place."""
    is_header = (F.col("block") == F.col("head_block")) & (F.col("line_id") == F.col("head_id"))
    split = computed_once(lines.filter(~is_header & (F.col("value") != "")), "_cells", csv_cells(F.col("value")))
    value = {
        name: F.coalesce(cell(F.col("_cells"), F.col(f"csv_cells.{name}"), len(names)), F.lit(""))
        for name, names in fixed.CSV_ALIASES.items()
    }
    staged = split.select("*", *[c.alias(f"_v_{n}") for n, c in value.items()])
    v = {n: F.col(f"_v_{n}") for n in value}
    columns = {
        "source": F.lit("csv"), **v,
        "source_port": _absent(), "destination_port": _absent(), "event_type": _absent(),
        "risk_level": _absent(), "signature_id": _absent(), "category": _absent(), "action": _absent(),
        "raw": F.col("value"),
    }
    return staged.filter(valid_endpoints(v["source_ip"], v["destination_ip"])).select(*keep_order(columns))


def parse_plain(lines: DataFrame) -> DataFrame:
    """Comma-separated lines of at least five parts; the sixth is the protocol.

    Endpoints are not checked here; detection drops rows without them.
    """
    parts = F.transform(F.split(strip(F.col("value")), ","), lambda p: strip(p))
    split = computed_once(lines, "_p", parts).filter(F.size("_p") >= 5)
    part = [F.get("_p", F.lit(i)) for i in range(6)]
    columns = {
        "source": F.lit("plain-text"), "timestamp": part[0], "source_ip": part[1],
        "destination_ip": part[2], "domain": part[3], "alert_type": part[4],
        "protocol": F.coalesce(part[5], F.lit("")),
        "source_port": _absent(), "destination_port": _absent(), "event_type": _absent(),
        "risk_level": _absent(), "signature_id": _absent(), "category": _absent(), "action": _absent(),
        "raw": strip(F.col("value")),
    }
    return split.select(*keep_order(columns))
