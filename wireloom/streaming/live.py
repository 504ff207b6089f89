"""Live detection: tail a folder of log files, detect per micro-batch, store and announce.

The checkpoint holds the reading position. A micro-batch plays the part of one upload: windows
start afresh with it. Delivery is at least once, and the sinks make a repeated batch harmless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wireloom.operators.ordering import distributed_row_number
from wireloom.plans.detect import Scorer, as_incidents, score_incidents
from wireloom.schemas import EVENT_SCHEMA, PARSED_COLUMNS
from wireloom.session import materialize
from wireloom.sources import json_lines
from wireloom.sources.growing import SETTLE_SECONDS, growing_reader
from wireloom.sources.lines import FILE_KEYS, label_lines, label_ranges
from wireloom.sources.sinks import IncidentTable, alert_feed

POLL = "5 seconds"
# incident ids of one micro-batch; later batches get higher ids, and 2^31 batches fit a long
IDS_PER_BATCH = 1 << 32


def tail(
    spark: SparkSession,
    folder: str,
    organization_id: int = 0,
    max_files: int | None = None,
    growing: bool = False,
    settle: float = SETTLE_SECONDS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Stream of raw lines.

    Files that are moved in complete are picked up once each. With ``growing`` files are followed
    as they grow, roll and are truncated; a last line without an end is then held back until its
    file has not changed for ``settle`` seconds, and a trigger reads at most ``max_bytes``.
    """
    if growing:
        options = {"settleSeconds": str(settle), **({"maxBytesPerTrigger": str(max_bytes)} if max_bytes else {})}
        return label_ranges(growing_reader(spark, folder, True, True, **options).load(), organization_id)
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return label_lines(reader.text(folder), organization_id).withColumn("line_id", F.lit(None).cast("long"))


def tail_events(lines: DataFrame) -> DataFrame:
    """Relevant events of a stream of lines; each line is decoded once."""
    return json_lines.parse_relevant(lines)


def as_batch(events: DataFrame, batch_id: str) -> DataFrame:
    """Events of one micro-batch, numbered over all of its files.

    Where the source knows no places of lines, the order of a split's rows is theirs.
    """
    placed = events.withColumn("line_id", F.coalesce("line_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_file": F.col("batch_id"), "batch_id": F.lit(batch_id)})
    numbered = distributed_row_number(placed, FILE_KEYS, ["_file", "block"], ["line_id"], "seq")
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA])


def stream_name(checkpoint: str) -> str:
    """Short name of the stream that keeps its position in ``checkpoint``, for its epochs."""
    return "stream-" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def process_batch(
    table: IncidentTable, feed_path: str | None = None, scorer: Scorer | None = None, stream: str = "stream"
) -> Callable[[DataFrame, int], None]:
    """The function run for every micro-batch of parsed events: detect, announce, store.

    Messages and incidents go to folders of their epoch, which a repeated batch replaces as a
    whole, whatever an attempt that broke off has left there.
    """

    def run(parsed: DataFrame, epoch: int) -> None:
        name = f"{stream}-{epoch}"
        # stored copies keep the plans short; the session setting cleans them up once they are unused
        events = materialize(as_batch(parsed, f"epoch-{epoch}"))
        scored = score_incidents(events, scorer)
        incidents = as_incidents(scored.withColumn("id", F.lit(epoch).cast("long") * F.lit(IDS_PER_BATCH) + F.col("seq")), "id")
        fresh = materialize(table.new_incidents(incidents, epoch=name))
        if fresh.isEmpty() and not table.has_epoch(name):
            return
        if feed_path:
            alert_feed(fresh).write.mode("overwrite").partitionBy("organization_id").json(f"{feed_path}/epoch={name}")
        table.write_epoch(fresh, name)

    return run


def run_live(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    feed_path: str | None = None,
    organization_id: int = 0,
    scorer: Scorer | None = None,
    max_files: int | None = None,
    once: bool = False,
    growing: bool = False,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Start live detection. ``once`` works off what is there, then stops (also the final flush,
    which takes last lines without an end as well)."""
    lines = tail(spark, folder, organization_id, max_files, growing, 0 if once else SETTLE_SECONDS, max_bytes)
    run_batch = process_batch(IncidentTable(spark, table_path), feed_path, scorer, stream_name(checkpoint))
    writer = tail_events(lines).writeStream.foreachBatch(run_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.start()


def tail_to_table(
    spark: SparkSession, folder: str, path: str, checkpoint: str, max_files: int | None = None, growing: bool = False
) -> StreamingQuery:
    """Work off the folder and append the relevant events, parsed, to a parquet table."""
    parsed = tail_events(tail(spark, folder, max_files=max_files, growing=growing, settle=0)).select(*PARSED_COLUMNS)
    return (
        parsed.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
