"""Incident table, alert feed and their writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions.times import partition_day
from wireloom.operators.incidents import allowed_changes, dedup_incidents, latest_status, with_latest_status
from wireloom.schemas import INCIDENT_COLUMNS, INCIDENT_SCHEMA
from wireloom.session import materialize

# tenant first: every read names one; the day is that of the instant, whatever form its stamp has
PARTITIONS = ["organization_id", "event_day"]
STATUS_SCHEMA = "incident_id long, status string, role string, changed_at timestamp, organization_id long"


def alert_feed(incidents: DataFrame) -> DataFrame:
    """Per-tenant message for every new incident: an eleven-field JSON payload."""
    payload = F.to_json(
        F.struct(
            F.col("id").alias("incident_id"), "source_ip", "destination_ip", "alert_type", "risk_level", "timestamp",
            "mitre_tactic", "mitre_technique", "attack_category", "threat_score", "risk_tier",
        ),
        {"ignoreNullFields": "false"},
    )
    return incidents.select("organization_id", F.col("id").alias("incident_id"),
                            F.lit("incident_created").alias("event"), payload.alias("payload"))


def write_feed(feed: DataFrame, path: str) -> None:
    """Append messages as JSON lines, one folder per tenant."""
    feed.write.mode("append").partitionBy("organization_id").json(path)


class IncidentTable:
    """Parquet table of incidents: a folder per epoch, in it a partition per tenant and day.

    An epoch is one write as a whole - a micro-batch of a stream or one batch job - and writing it
    again replaces it. Approvals and rejections are rows of their own below ``_status``; the
    latest one of each incident is merged in on read, so no incident is rewritten under a stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        folder, system = self._folder(path)
        return system.exists(folder)

    def _delete(self, pattern: str) -> None:
        folder, system = self._folder(pattern)
        for found in system.globStatus(folder) or []:
            system.delete(found.getPath(), True)

    def exists(self) -> bool:
        return self._there(self.path)

    def has_epoch(self, epoch: str) -> bool:
        return self._there(f"{self.path}/epoch={epoch}")

    def rows(self) -> DataFrame:
        """Incidents as they were written, with the epoch that wrote them."""
        columns = [*INCIDENT_COLUMNS, "event_day", "epoch"]
        if not self.exists():
            empty = self.spark.createDataFrame([], INCIDENT_SCHEMA)
            return empty.withColumns({"event_day": F.lit("").cast("string"), "epoch": F.lit("").cast("string")})
        schema = "event_day string, epoch string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INCIDENT_SCHEMA)
        return self.spark.read.schema(schema).parquet(self.path).select(*columns)

    def status_changes(self) -> DataFrame | None:
        """All accepted changes; none before the first one."""
        path = f"{self.path}/_status"
        return self.spark.read.schema(STATUS_SCHEMA).parquet(path) if self._there(path) else None

    def read(self) -> DataFrame:
        """All incidents in their present state; an empty frame before the first write."""
        stored, changes = self.rows().drop("epoch"), self.status_changes()
        return stored if changes is None else with_latest_status(stored, changes)

    def stored_for(self, incoming: DataFrame, epoch: str | None = None) -> DataFrame:
        """Stored incidents of other epochs that could equal one of ``incoming``.

        Equal incidents share tenant and day. Only partitions between the first and the last day of
        the batch are read, and of these the rows whose tenant and day occur in it, null included.
        """
        stored = self.rows().filter(F.col("epoch") != F.lit(epoch)) if epoch else self.rows()
        cells = incoming.select(
            F.col("organization_id").alias("_tenant"), partition_day(F.col("timestamp")).alias("_day")
        ).distinct()
        first, last = cells.agg(F.min("_day"), F.max("_day")).first()
        if first is None:
            return stored.limit(0)
        same = stored["organization_id"].eqNullSafe(cells["_tenant"]) & (stored["event_day"] == cells["_day"])
        return stored.filter(F.col("event_day").between(first, last)).join(cells, same, "left_semi")

    def new_incidents(self, incoming: DataFrame, within_batch: bool = False, epoch: str | None = None) -> DataFrame:
        """The incoming incidents that no other epoch has stored yet, as of now.

        What ``epoch`` itself left behind does not count: a repeated epoch has the same new ones.
        The incoming ones are settled first, as they are read three times.
        """
        incoming = materialize(incoming)
        return dedup_incidents(incoming, self.stored_for(incoming, epoch), within_batch=within_batch, order="id")

    def append_new(self, incoming: DataFrame, within_batch: bool = False) -> DataFrame:
        """Append the incidents not stored yet and return them.

        Running the same batch again appends nothing, so a retried micro-batch is harmless. The
        new ones are settled before the write; read afterwards they would all count as stored.
        """
        fresh = materialize(self.new_incidents(incoming, within_batch))
        self.append(fresh)
        return fresh

    def append(self, incidents: DataFrame) -> None:
        """Append rows as an epoch of their own."""
        self.write_epoch(incidents, f"batch-{uuid.uuid4().hex}")

    def write_epoch(self, incidents: DataFrame, epoch: str) -> None:
        """Store an epoch's rows in place of all that an earlier attempt at it has left.

        Rebalancing gathers each partition's rows into few files and splits a partition that holds
        too many for one task.
        """
        dated = incidents.select(*INCIDENT_COLUMNS, partition_day(F.col("timestamp")).alias("event_day"))
        target = f"{self.path}/epoch={epoch}"
        dated.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(target)

    def change_status(self, changes: DataFrame, feed_path: str | None = None) -> DataFrame:
        """Record approvals and rejections and return the messages to the tenants.

        ``changes``: (organization_id, incident_id, action, role, changed_at). Viewers change
        nothing, and a request reaches its own tenant's incidents only; one that names no such
        incident changes nothing. The message of an incident tells its latest state among them.
        """
        asked = allowed_changes(changes)
        stored = self.rows().select(F.col("organization_id").alias("_tenant"), F.col("id").alias("_id"))
        same = (F.col("organization_id") == F.col("_tenant")) & (F.col("incident_id") == F.col("_id"))
        accepted = materialize(asked.join(stored, same, "left_semi"))
        recorded = accepted.select("incident_id", "status", "role", F.col("changed_at").cast("timestamp"), "organization_id")
        recorded.hint("rebalance", "organization_id").write.mode("append").partitionBy("organization_id").parquet(f"{self.path}/_status")
        feed = latest_status(accepted).select(
            "organization_id", "incident_id", F.lit("incident_status").alias("event"),
            F.to_json(F.struct("incident_id", "status")).alias("payload"),
        )
        if feed_path:
            write_feed(feed, feed_path)
        return feed

    def compact(self) -> None:
        """Merge all epochs into one and the recorded states into the incidents.

        A job of its own, for times when no stream writes. Old epochs go only after the new one is
        complete; if that is interrupted, equal rows stand twice until it is run again.
        """
        merged = materialize(self.read().select(*INCIDENT_COLUMNS).distinct())
        old = [r.epoch for r in self.rows().select("epoch").distinct().collect()]
        self.write_epoch(merged, f"base-{uuid.uuid4().hex}")
        for epoch in old:
            self._delete(f"{self.path}/epoch={epoch}")
        self._delete(f"{self.path}/_status")

    def purge(self, organization_id: int, role: str) -> int:
        """Delete a tenant's partitions (administrators only) and return how many incidents they held."""
        if role != "ADMIN":
            raise PermissionError("only an ADMIN may delete incidents")
        count = self.rows().filter(F.col("organization_id") == organization_id).count()
        tenant = f"organization_id={int(organization_id)}"
        self._delete(f"{self.path}/epoch=*/{tenant}")
        self._delete(f"{self.path}/_status/{tenant}")
        return count
