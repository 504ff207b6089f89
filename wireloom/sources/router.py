"""Per-file format choice: Zeek TSV, else JSON lines, else CSV, else plain text.

Each step falls through when it yields no event, so the choice depends on what the parsers
find. Everything the parsers need to know about a file is one row of ``file_profile``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.functions.text import choose, starts_with_any, strip
from wireloom.operators.lookups import small_lookup
from wireloom.schemas import EVENT_SCHEMA
from wireloom.session import materialize, scratch_path
from wireloom.sources import delimited
from wireloom.sources.csv_records import csv_records
from wireloom.sources.json_lines import parse_json, with_json_outcome
from wireloom.sources.lines import FILE_KEYS, LINE_COLUMNS, ORDER, is_blank, number_events

HEADER_MARKS = ["#separator", "#path", "#fields"]


def field_names(line: Column) -> Column:
    return F.split(strip(F.replace(line, F.lit("#fields"), F.lit(""))), "\t")


def type_from_path(line: Column) -> Column:
    """Log type named by a ``#path`` line, exact or as the last dotted part."""
    path = strip(F.element_at(F.split(line, "\t"), -1))
    return choose((((path == t) | F.endswith(path, F.lit("." + t))), F.lit(t)) for t in fixed.ZEEK_LOG_TYPES)


def type_from_fields(names: Column) -> Column:
    """Log type told by the columns of a ``#fields`` line."""
    has = lambda n: F.array_contains(names, n)
    return choose(
        [
            (has("conn_state"), F.lit("conn")),
            (has("query") & has("qtype_name"), F.lit("dns")),
            (has("method") & has("host"), F.lit("http")),
            (has("note"), F.lit("notice")),
        ]
    )


def line_counts(lines: DataFrame, count_json: bool = True) -> DataFrame:
    """Per file: lines, JSON events, corrupt JSON lines and the place of the first line with content.

    Lines are reduced per (file, block) to plain numbers, which are hash-aggregated before the
    shuffle, so one huge file is counted by many tasks and no text moves. The line count runs
    from the first line with content to the last one; blank lines between them count.
    """
    checked = with_json_outcome(lines) if count_json else lines.withColumns(
        {"json_ok": F.lit(False), "json_corrupt": F.lit(False)}
    )
    content = F.when(~is_blank(F.col("value")), F.col("line_id"))
    blocks = checked.groupBy(*FILE_KEYS, "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("json_ok").alias("json_ok"),
        F.count_if("json_corrupt").alias("json_corrupt"),
        F.min("line_id").alias("low"), F.max("line_id").alias("high"),
        F.min(content).alias("first"), F.max(content).alias("last"),
    )
    per_file = W.partitionBy(*FILE_KEYS)
    with_content = F.when(F.col("first").isNotNull(), F.col("block"))
    framed = blocks.withColumns({"b0": F.min(with_content).over(per_file), "b1": F.max(with_content).over(per_file)})
    lead = F.when(F.col("block") == F.col("b0"), F.col("first") - F.col("low")).otherwise(0)
    tail = F.when(F.col("block") == F.col("b1"), F.col("high") - F.col("last")).otherwise(0)
    counted = F.when(F.col("block").between(F.col("b0"), F.col("b1")), F.col("n") - lead - tail).otherwise(0)
    return framed.filter(F.col("b0").isNotNull()).groupBy(*FILE_KEYS).agg(
        F.sum(counted).alias("n_lines"),
        F.sum("json_ok").alias("n_json"),
        F.sum("json_corrupt").alias("n_corrupt"),
        F.min("b0").alias("head_block"),
        F.min(F.when(F.col("block") == F.col("b0"), F.col("first"))).alias("head_id"),
    )


def file_profile(lines: DataFrame, count_json: bool = True) -> DataFrame:
    """One row per file: line counts, JSON yield, Zeek type and cells, CSV cells.

    A first pass counts; a second one keeps just the first line and the ``#`` lines of each file
    and reads the headers out of them. Both results are one row per file and stored, so that they
    go to the lines and not the lines to them.
    """
    counts = materialize(line_counts(lines, count_json))
    value = F.col("value")
    placed = small_lookup(lines, counts, FILE_KEYS)
    is_head = (F.col("block") == F.col("head_block")) & (F.col("line_id") == F.col("head_id"))
    top = placed.filter(is_head | F.startswith(value, F.lit("#")))
    nth = F.when(F.col("block") == F.col("head_block"), F.col("line_id") - F.col("head_id"))
    near = lambda n: F.coalesce(nth < n, F.lit(False))
    is_fields = F.startswith(value, F.lit("#fields"))
    named = F.when(F.startswith(value, F.lit("#path")) & near(10), type_from_path(value))
    told = F.when(is_fields & near(10), type_from_fields(field_names(value)))
    place = F.struct("block", "line_id")

    def earliest(what: Column) -> Column:
        return F.min_by(what, F.when(what.isNotNull(), place))

    found = top.groupBy(*FILE_KEYS, "n_lines", "n_json", "n_corrupt", "head_block", "head_id").agg(
        F.max(F.when(is_head, value)).alias("head"),
        F.bool_or(starts_with_any(value, HEADER_MARKS) & near(5)).alias("has_zeek_header"),
        F.coalesce(earliest(named), earliest(told)).alias("zeek_type"),
        earliest(F.when(is_fields, value)).alias("fields_line"),
    )
    staged = found.withColumns(
        {"_names": field_names(F.col("fields_line")), "_header": delimited.csv_cells(F.ltrim(F.col("head")))}
    )
    return materialize(staged.select(
        *FILE_KEYS, "n_lines", "n_json", "n_corrupt", "head_block", "head_id", "has_zeek_header", "zeek_type",
        F.when(F.col("_names").isNotNull(), delimited.positions(F.col("_names"), delimited.ZEEK_FIELDS)).alias(
            "zeek_cells"
        ),
        delimited.positions(F.col("_header"), fixed.CSV_ALIASES).alias("csv_cells"),
    ))


def json_accepted() -> Column:
    """More than a fifth of the lines must give an event."""
    return F.col("n_json") > F.lit(fixed.JSON_ACCEPT_SHARE) * F.col("n_lines")


def zeek_candidate() -> Column:
    return F.col("has_zeek_header") & F.col("zeek_type").isNotNull() & F.col("zeek_cells").isNotNull()


def _with_profile(lines: DataFrame, profile: DataFrame) -> DataFrame:
    return small_lookup(lines, profile, FILE_KEYS)


def normalize_zeek_tsv(lines: DataFrame) -> DataFrame:
    """Events of files known to be Zeek TSV."""
    profile = file_profile(lines, count_json=False)
    return delimited.parse_zeek_tsv(_with_profile(lines, profile).filter(zeek_candidate()))


def normalize_csv(lines: DataFrame) -> DataFrame:
    """Events of files known to be CSV with a header line; records may span lines."""
    records = csv_records(lines)
    return delimited.parse_csv(_with_profile(records, file_profile(records, count_json=False)))


def _csv_events(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """Events of the CSV files that ``profile`` lists."""
    own = _with_profile(lines, profile)
    plain = own.select(*LINE_COLUMNS)
    records = csv_records(plain)
    if records is plain:
        return delimited.parse_csv(own)
    return delimited.parse_csv(_with_profile(records, file_profile(records, count_json=False)))


def normalize_plain(lines: DataFrame) -> DataFrame:
    return delimited.parse_plain(lines)


def choose_routes(lines: DataFrame) -> DataFrame:
    """The profile with the ``route`` of every file.

    A file's first two answers need no second look at its lines: JSON files without a Zeek header
    are settled by the profile. Only the others are parsed once more to see whether their
    candidate yields at least one event.
    """
    profile = file_profile(lines)
    settled = ~zeek_candidate() & json_accepted()
    open_files = profile.filter(~settled)
    if open_files.isEmpty():
        return profile.withColumn("route", F.lit("json"))
    open_files = materialize(open_files)
    looked_up = _with_profile(lines, open_files)
    one = lambda df, name: df.groupBy(*FILE_KEYS).agg(F.lit(True).alias(name))
    zeek_hits = one(delimited.parse_zeek_tsv(looked_up.filter(zeek_candidate())), "zeek_hit")
    csv_hits = one(_csv_events(lines, open_files.filter(~json_accepted())), "csv_hit")
    judged = profile.join(zeek_hits, FILE_KEYS, "left").join(csv_hits, FILE_KEYS, "left")
    route = choose(
        [
            (zeek_candidate() & F.coalesce("zeek_hit", F.lit(False)), F.lit("zeek_tsv")),
            (json_accepted(), F.lit("json")),
            (F.coalesce("csv_hit", F.lit(False)), F.lit("csv")),
        ],
        F.lit("plain"),
    )
    return judged.withColumn("route", route).drop("zeek_hit", "csv_hit")


def parse_logs(lines: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Events of any mix of files, each read in the format its content shows."""
    routes = materialize(choose_routes(lines) if routes is None else routes)
    present = {r.route for r in routes.select("route").distinct().collect()}  # four at most

    def part(route: str) -> DataFrame:
        return _with_profile(lines, routes.filter(F.col("route") == route))

    parsers = {
        "zeek_tsv": delimited.parse_zeek_tsv,
        "json": lambda of_file: parse_json(of_file.select(*LINE_COLUMNS)),
        "plain": delimited.parse_plain,
    }
    # a pass over the lines only for formats that occur
    parsed = [parse(part(route)) for route, parse in parsers.items() if route in present]
    if "csv" in present:
        parsed.append(_csv_events(lines, routes.filter(F.col("route") == "csv")))
    if not parsed:
        parsed = [parse_json(lines)]
    return reduce(lambda a, b: a.unionByName(b), parsed)


def store_events(events: DataFrame) -> DataFrame:
    """Write events to a scratch table in the shared folder and read them back.

    Detection reads its events several times, each time a few columns; without this every read
    would parse the text and number the events again. The table may be deleted after the job.
    """
    path = scratch_path(events.sparkSession, "events")
    events.write.parquet(path)
    return events.sparkSession.read.schema(EVENT_SCHEMA).parquet(path)


def read_events(lines: DataFrame, log_format: str = "auto", store: bool = True) -> DataFrame:
    """Numbered events. Naming the format saves the passes that find it out."""
    parsers = {
        "auto": parse_logs,
        "json": parse_json,
        "zeek_tsv": normalize_zeek_tsv,
        "csv": normalize_csv,
        "plain": normalize_plain,
    }
    events = number_events(parsers[log_format](lines))
    return store_events(events) if store else events
