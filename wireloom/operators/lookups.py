"""Joins against one-row-per-key frames that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators.ordering import null_safe

# rows of a table of a few hundred bytes each that may be handed to every task
BROADCAST_ROWS = 10_000


def key_lookup(left: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` with ``table``, which has one row per key (``how``: left or inner). Null equals null.

    A plain equi join: the engine broadcasts a table that its shuffle statistics show to be small,
    and else splits every partition of ``left`` that is too large for a task and hands each piece
    the few table rows it needs. Any number of hot keys is covered, whatever their weight, and
    ``left`` is read once.
    """
    payload = [c for c in table.columns if c not in keys]
    named = table.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], *payload)
    condition = null_safe(left, named, [(k, f"_t{i}") for i, k in enumerate(keys)])
    return left.join(named, condition, how).select(*left.columns, *payload)


def small_lookup(left: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``key_lookup`` with a stored table that is mostly small, such as one row per file.

    Its rows are counted: up to BROADCAST_ROWS of them are handed to every task, so the rows of
    ``left`` stay where they are. Beyond that ``left`` is the kept side of an outer join, which
    the engine may split but never broadcasts.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return key_lookup(left, F.broadcast(table), keys, how)
    if how == "left":
        return key_lookup(left, table, keys, "left")
    return key_lookup(left, table.withColumn("_matched", F.lit(True)), keys, "left").filter("_matched").drop("_matched")
