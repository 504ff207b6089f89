"""CSV records that span lines: quote state carried across lines, blocks and splits.

A quoted cell may hold line ends. Whether a line begins inside such a cell depends on all lines
before it, but a line acts on that state in one of four ways only - it keeps it, flips it, opens or
closes - and such ways combine in any grouping. So every block of a file is worked on by itself,
a table of one row per block carries the state from block to block, and lines of one record are put
together wherever they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.operators.lookups import key_lookup, small_lookup
from wireloom.session import materialize
from wireloom.sources.delimited import csv_cells
from wireloom.sources.lines import FILE_KEYS, LINE_COLUMNS

# a whole cell, and one that is opened and not closed; quotes count only where a cell begins with one
_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|)'
_OPENED = r'"(?:[^"]++|"")*+'
_OPENS = rf"^(?:{_CELL},)*+{_OPENED}\z"
_STAYS_OPEN = r'^(?:[^"]++|"")*+\z'
_REOPENS = rf'^(?:[^"]++|"")*+"[^,]*+,(?:{_CELL},)*+{_OPENED}\z'


def opens(line: Column) -> Column:
    """A line that begins outside quotes ends inside them."""
    return F.contains(line, F.lit('"')) & F.rlike(line, F.lit(_OPENS))


def stays_open(line: Column) -> Column:
    """A line that begins inside quotes is all of it inside."""
    return ~F.contains(line, F.lit('"')) | F.rlike(line, F.lit(_STAYS_OPEN))


def ends_open(line: Column) -> Column:
    """A line that begins inside quotes ends inside them."""
    return stays_open(line) | F.rlike(line, F.lit(_REOPENS))


def _xor(state: Column, flips: Column) -> Column:
    return state != (F.pmod(flips, F.lit(2)) == 1)


def _with_states(lines: DataFrame) -> DataFrame:
    """Lines with ``inside`` (the quote state they begin in) and ``after`` (the one they leave)."""
    value = F.col("value")
    acted = lines.withColumns({"_o": opens(value), "_i": ends_open(value)})
    settles = F.col("_o") == F.col("_i")  # the state after it is the same whatever it was before
    flip = (F.col("_o") & ~F.col("_i")).cast("long")
    in_block = W.partitionBy(*FILE_KEYS, "block").orderBy("line_id")
    so_far, before = in_block.rowsBetween(W.unboundedPreceding, 0), in_block.rowsBetween(W.unboundedPreceding, -1)
    counted = acted.withColumn("_flips", F.sum(flip).over(so_far))
    settled = F.when(settles, F.struct(F.col("_o").alias("state"), F.col("_flips").alias("flips")))
    marked = counted.withColumns({
        "_last": F.last(settled, ignorenulls=True).over(before),
        "_prior": F.col("_flips") - flip,
    })
    blocks = marked.groupBy(*FILE_KEYS, "block").agg(
        F.max("_flips").alias("flips"), F.max_by(settled, F.when(settles, F.col("line_id"))).alias("last")
    )
    # the same once more over the blocks of a file
    earlier = W.partitionBy(*FILE_KEYS).orderBy("block")
    total = F.sum("flips").over(earlier.rowsBetween(W.unboundedPreceding, 0))
    leaves = F.when(F.col("last").isNotNull(), F.struct(
        _xor(F.col("last.state"), F.col("flips") - F.col("last.flips")).alias("state"), F.col("_total").alias("flips")
    ))
    entered = blocks.withColumn("_total", total).withColumn("_leaves", leaves).withColumn(
        "_known", F.last("_leaves", ignorenulls=True).over(earlier.rowsBetween(W.unboundedPreceding, -1))
    )
    entry = F.coalesce(
        _xor(F.col("_known.state"), F.col("_total") - F.col("flips") - F.col("_known.flips")),
        _xor(F.lit(False), F.col("_total") - F.col("flips")),
    )
    placed = key_lookup(marked, entered.select(*FILE_KEYS, "block", entry.alias("_entry")), [*FILE_KEYS, "block"])
    inside = F.coalesce(
        _xor(F.col("_last.state"), F.col("_prior") - F.col("_last.flips")), _xor(F.col("_entry"), F.col("_prior"))
    )
    return placed.withColumn("inside", inside).select(
        *LINE_COLUMNS, "inside", F.when(F.col("inside"), F.col("_i")).otherwise(F.col("_o")).alias("after")
    )


def _with_record(states: DataFrame) -> DataFrame:
    """Lines with the place at which their record begins."""
    begins = F.when(~F.col("inside"), F.col("line_id"))
    so_far = W.partitionBy(*FILE_KEYS, "block").orderBy("line_id").rowsBetween(W.unboundedPreceding, 0)
    own = states.withColumn("_own", F.last(begins, ignorenulls=True).over(so_far))
    blocks = own.groupBy(*FILE_KEYS, "block").agg(F.max(begins).alias("_line"))
    place = F.when(F.col("_line").isNotNull(), F.struct(F.col("block").alias("block"), F.col("_line").alias("line_id")))
    earlier = W.partitionBy(*FILE_KEYS).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*FILE_KEYS, "block", F.last(place, ignorenulls=True).over(earlier).alias("_carried"))
    here = F.when(F.col("_own").isNotNull(), F.struct("block", F.col("_own").alias("line_id"))).otherwise(F.col("_carried"))
    return key_lookup(own, carried, [*FILE_KEYS, "block"]).withColumn("_record", here).select(*states.columns, "_record")


def _joined(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of files that have some of several lines, and the files with a cell beyond the limit.

    Sizes are summed before any text is gathered: of ``n`` cells that share the lines swallowed
    whole, one is longer than the limit if the lines exceed ``n`` times that. What is gathered is
    thus bounded by the limit and the number of a record's cells.
    """
    placed = materialize(_with_record(_with_states(lines)))
    single = ~F.col("inside") & ~F.col("after")
    parts = placed.filter(~single)
    swallowed = F.col("inside") & stays_open(F.col("value"))
    sizes = parts.groupBy(*FILE_KEYS, "_record").agg(
        F.sum(F.when(swallowed, F.length("value") + 1).otherwise(0)).alias("_size"),
        (F.count_if(F.col("inside") & ~swallowed) + 1).alias("_cells"),
    )
    broken = materialize(sizes.filter(F.col("_size") > F.lit(fixed.CSV_CELL_LIMIT) * F.col("_cells")).select(*FILE_KEYS).distinct())
    sound = _without(parts, broken)
    gathered = sound.groupBy(*FILE_KEYS, "_record").agg(
        F.array_sort(F.collect_list(F.struct("block", "line_id", "value", "after"))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    # at the end of a file an open cell ends as if it were closed
    closed = F.when(F.element_at("_lines", -1)["after"], F.concat(text, F.lit('"'))).otherwise(text)
    whole = gathered.select(*FILE_KEYS, F.col("_record.block").alias("block"), F.col("_record.line_id").alias("line_id"), closed.alias("value"))
    return _without(placed.filter(single), broken).select(*LINE_COLUMNS).unionByName(whole.select(*LINE_COLUMNS)), broken


def _without(rows: DataFrame, files: DataFrame) -> DataFrame:
    return small_lookup(rows, files.withColumn("_hit", F.lit(True)), FILE_KEYS, how="left").filter("_hit is null").drop("_hit")


def csv_records(lines: DataFrame) -> DataFrame:
    """One row per CSV record, at the place of its first line; lines inside quotes are part of it.

    A file with a cell longer than a reader accepts gives no record at all. One pass over the lines
    finds the files that have open quotes or very long lines; without any, ``lines`` itself is
    returned, and the lines of all other files stay as they are.
    """
    value = F.col("value")
    odd = lines.groupBy(*FILE_KEYS).agg(
        F.bool_or(opens(value)).alias("_open"), F.bool_or(F.length(value) > fixed.CSV_CELL_LIMIT).alias("_long")
    )
    odd = materialize(odd.filter("_open or _long"))
    if odd.isEmpty():
        return lines
    marked = small_lookup(lines, odd, FILE_KEYS, how="left")
    spanning, broken = _joined(marked.filter("_open").select(*LINE_COLUMNS))
    records = marked.filter("_open is null or not _open").select(*LINE_COLUMNS).unionByName(spanning)
    wide = F.exists(csv_cells(value), lambda c: F.length(c) > fixed.CSV_CELL_LIMIT)
    beyond = records.filter((F.length(value) > fixed.CSV_CELL_LIMIT) & wide).select(*FILE_KEYS)
    return _without(records, materialize(beyond.union(broken).distinct()))
