"""Raw text lines: the frame every parser starts from, and the file scan that makes it.

Columns: ``organization_id``, ``batch_id`` (the file), ``block`` and ``line_id`` (together the
order within the file), ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.text import strip
from wireloom.operators.ordering import distributed_row_number
from wireloom.schemas import EVENT_SCHEMA, PARSED_COLUMNS
from wireloom.sources.growing import SPLIT_BYTES, growing_reader

FILE_KEYS = ["organization_id", "batch_id"]
ORDER = ["block", "line_id"]
LINE_COLUMNS = [*FILE_KEYS, *ORDER, "value"]


def scan_log_lines(
    spark: SparkSession, paths: str | list[str], organization_id: int = 0, recursive: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Read UTF-8 log files as lines.

    Large files are split: ``block`` is the first byte of the range that a task reads and
    ``line_id`` counts the lines that begin in it, so (block, line_id) orders a file without a
    shuffle. Ranges are cut at multiples of ``split_bytes``, not by the session's settings or the
    cores at hand, so a line has the same place in every pass over it.
    """
    reader = growing_reader(spark, paths, recursive, False, splitBytes=str(split_bytes))
    return label_ranges(reader.load(), organization_id)


def label_ranges(ranges: DataFrame, organization_id: int = 0) -> DataFrame:
    """Attach the tenant to lines read by byte ranges."""
    tenant = F.lit(organization_id).cast("long").alias("organization_id")
    return ranges.select(tenant, F.col("path").alias("batch_id"), "block", "line_id", "value")


def scan_text(spark: SparkSession, paths: str | list[str], organization_id: int = 0, recursive: bool = False) -> DataFrame:
    """Lines by the engine's own text scan, for stores that only it can open.

    Here ``block`` is the byte offset of the engine's split, which follows the session's settings:
    name the format, so that one pass suffices.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return label_lines(reader.text(paths), organization_id)


def label_lines(text: DataFrame, organization_id: int = 0) -> DataFrame:
    """Attach tenant, file and order to a text scan.

    A stream knows no row ids; there the order within a split is added per micro-batch.
    """
    placed = text.select(
        F.lit(organization_id).cast("long").alias("organization_id"),
        F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    return placed if text.isStreaming else with_line_ids(placed)


def with_line_ids(lines: DataFrame) -> DataFrame:
    """Add ``line_id``, which grows along the rows of a split."""
    return lines.withColumn("line_id", F.monotonically_increasing_id()).select(*LINE_COLUMNS)


def is_blank(value: Column) -> Column:
    return strip(value) == ""


def drop_blank(lines: DataFrame) -> DataFrame:
    """Lines with content; a file without any contributes nothing."""
    return lines.filter(~is_blank(F.col("value")))


def number_events(events: DataFrame) -> DataFrame:
    """Replace the file order by ``seq``, the dense position of an event in its batch."""
    numbered = distributed_row_number(events, FILE_KEYS, ["block"], ["line_id"], "seq")
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA])


def keep_order(columns: dict[str, Column]) -> list[Column | str]:
    """Selection of the order columns plus the parsed ones."""
    return [*FILE_KEYS, *ORDER, *[columns[c].alias(c) for c in PARSED_COLUMNS]]
