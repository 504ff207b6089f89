"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SYMBOLS, WORD_PATTERN, Guarded, pick, stored

# rows of one source that are sorted together
BUCKET_ROWS = 20_000
# quality weights lie between the first and twice the last of these
WEIGHT_STEPS = (0.1, 0.2, 0.4, 0.8)
ADDED = ("size", "source_size", "target", "taken", "epochs")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the fewer symbol characters a text has, the likelier it is drawn."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * share), F.lit(0.1)).cast("double")


def draw_key(doc_id: Column, size: Column, weight: Column, seed: str) -> Column:
    """Exponential variate with rate ``weight``; a pure function of the row, so reruns agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def key_bucket(key: Column, buckets: Column) -> Column:
    """Bucket of a key; buckets follow the keys' order.

    Keys of weight w spread evenly over 1 - exp(-w key). The mean of these over WEIGHT_STEPS spreads
    the keys of any weight so that no bucket gets over ``2 * len(WEIGHT_STEPS)`` times its share.
    """
    spread = sum((1 - F.exp(-w * key) for w in WEIGHT_STEPS), F.lit(0.0)) / len(WEIGHT_STEPS)
    return F.floor(spread * buckets).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target): the budget poured over the sources by weight, at most
    ``cap`` times a source's size each, the excess poured on over the others.

    The sources that end at their cap are those with the least cap per weight. Sorted by that
    ratio, running sums tell for each whether the level reaches it. One row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.col("budget") - F.col("capped")) / F.col("weight_left")
    at_cap = F.col("full_at") <= F.col("level")
    weighed = (
        sizes.withColumn("_at", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_at") + 1))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(ratio))
    )
    # the level of the first source that the budget does not fill holds for all that follow it
    final = F.min(F.when(~at_cap, F.struct("place", "level"))).over(everything)["level"]
    return weighed.select(
        "source", "source_size",
        F.coalesce(F.least("limit", F.col("weight") * final), F.col("limit")).alias("target"),
    )


def source_plan(rows: DataFrame, share: float, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source its target, the complete epochs and the last key of the fractional one.

    ``rows``: (doc_id, source, size, key). The keys of a source are sorted by range: sizes are
    summed per (source, key bucket), their running sum finds the one bucket in which the budget
    ends, and only that bucket is sorted row by row.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, share, weights, cap), "targets")
    buckets = max(64, 2 * len(WEIGHT_STEPS) * rows.count() // BUCKET_ROWS)
    cut = rows.withColumn("bucket", key_bucket(F.col("key"), F.lit(buckets)))
    cells = cut.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    named = plan.select(F.col("source").alias("_s"), "rest")
    last = (
        cells.withColumn("filled", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
        .join(named, F.col("source").eqNullSafe(F.col("_s")))
        .filter("filled <= rest")
        .groupBy("source")
        .agg(F.max(F.struct("bucket", "filled", "rest")).alias("end"))
        .select(F.col("source").alias("_s"), F.col("end.bucket").alias("_b"), "end.filled", "end.rest")
    )
    inside = W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = (
        cut.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("upto", F.col("filled") + F.sum("size").over(inside))
        # the row on the edge is taken when that comes nearer to the target
        .filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("key", "doc_id")).alias("reach"))
    )
    ends = last.join(edge, F.col("_s").eqNullSafe(F.col("source")), "left").select(
        F.col("_s"), F.col("_b").alias("last_bucket"), "reach.key", "reach.doc_id"
    )
    return plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("epochs").alias("full_epochs"),
        F.lit(buckets).alias("buckets"), "last_bucket", F.col("key").alias("last_key"), F.col("doc_id").alias("last_id"),
    )


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken, the words that the mix takes of a row.

    Each source is first taken whole as often as its target allows; the rest of its target is
    drawn without replacement, likelier for texts of higher quality weight. A null source is a
    source of its own, the last one. A null text has size 0. Rows with equal id and size have
    equal keys and are taken or left together. Columns of the added names are replaced. An empty
    table gives an empty one.
    """
    plan, guard = mix_plan(docs, share, weights, cap, seed)[1], Guarded(docs, ("doc_id", "source", "text"), ADDED)
    return guard.restore(_taken(_keyed(guard.work, seed), plan), *ADDED)


def mix_sizes(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """As ``mix_sources``, for (doc_id, source) alone; texts are read once."""
    return _taken(*mix_plan(docs, share, weights, cap, seed)).select("doc_id", "source", *ADDED)


def mix_plan(docs: DataFrame, share: float, weights: Sequence[float], cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """The stored (doc_id, source, size, key) of all rows, and the plan of each source."""
    rows = stored(_keyed(pick(docs, "doc_id", "source", "text"), seed).drop("text"), "sizes")
    return rows, stored(source_plan(rows, share, weights, cap), "mix")


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    sized = docs.withColumn("size", word_count(F.col("text")))
    return sized.withColumn("key", draw_key(F.col("doc_id"), F.col("size"), quality_weight(F.col("text")), seed))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    bucket = key_bucket(F.col("key"), F.col("buckets"))
    none = F.lit(-(1 << 63))
    reached = (F.col("key") < F.col("last_key")) | (
        (F.col("key") == F.col("last_key")) & (F.coalesce("doc_id", none) <= F.coalesce("last_id", none))
    )
    drawn = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & reached)
    times = F.col("full_epochs") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("epochs", times).withColumn("taken", F.col("size") * times)
