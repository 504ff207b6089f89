"""How filters interact: what every order of them removes, step by step."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, pick, stored

FILTERS = "ABCDE"
# the filter that asks for an earlier row with the same text; all others look at one row alone
COPY = "E"


def row_failures(text: Column) -> Column:
    """Bits of the filters that a whole text fails by itself: bit 0 for A up to bit 3 for D.

    A: under 200 words; B: under half of the words distinct; C: over 2% of the code points in
    A-Z; D: one of #$%&*|. A null text counts as an empty one.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals > 2 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    bits = F.lit(0)
    for at, fail in enumerate(fails):
        bits = bits + F.when(fail, F.lit(1 << at)).otherwise(F.lit(0))
    return bits


def copied_rows(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (doc_id, text and others), those whose exact text a smaller doc_id has as well.

    An existential self-join: left-semi on hash, text and a smaller id. Its right side is folded to
    the least id of each text before the shuffle, so a text that a third of all rows share is one
    row there, and its left side holds only rows whose hash occurs under several ids. Rows without
    an id are neither smaller nor larger than others.
    """
    hashed = rows.withColumn("_h", F.xxhash64("text"))
    ids = hashed.groupBy("_h").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z"))
    # stored, so that the engine knows its size when it decides how to join
    again = stored(ids.filter("_a < _z").select("_h"), "repeated-hashes")
    met = stored(hashed.join(again, "_h", "left_semi"), "repeated-texts")
    # stored as well: an aggregate right below the join would keep the engine from splitting a hot text's rows
    first = stored(
        met.groupBy(F.col("_h").alias("_fh"), F.col("text").alias("_ft")).agg(F.min("doc_id").alias("_first")), "first-ids"
    )
    same = (F.col("_h") == F.col("_fh")) & (F.col("text") == F.col("_ft")) & (F.col("_first") < F.col("doc_id"))
    return met.join(first, same, "left_semi").drop("_h")


def combination_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, docs, good, toxic): rows of each source that fail exactly these filters.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; a null source
    counts as an empty one. A document with several label rows is good or toxic if one of them
    says so. Repeated rows count each, rows without an id have no label.
    """
    docs = pick(docs, "doc_id", "text", "source")
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    # what tells rows apart: equal ones fail the same filters
    key = ["doc_id", "part", "hash", "chars"]
    named = [F.xxhash64(F.lit("row"), F.col("text")).alias("hash"), F.length("text").alias("chars")]
    alone = rows.select("doc_id", "part", *named, row_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    copies = copied_rows(rows).select("doc_id", "part", *named, F.lit(1 << FILTERS.index(COPY)).alias("bits"), F.lit(0).alias("n"))
    failing = alone.union(copies).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0)).cast("long")
    return failing.join(marks, F.col("doc_id") == F.col("_doc"), "left").groupBy("part", "bits").agg(
        F.sum("n").cast("long").alias("docs"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic")
    )


def order_steps(combinations: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from counts of bit combinations.

    A row goes at the first filter of the order that it fails. ``shapley`` sums what a filter
    removes over all orders.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    letters = F.filter(F.split(F.lit(filters), ""), lambda x: x != "")
    failed = F.filter(letters, lambda x, i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    each = (
        combinations.withColumn("failed", failed)
        .withColumn("filter_order", F.explode(orders))
        .withColumn("gone", F.coalesce(F.array_min(F.transform("failed", lambda x: F.instr(F.col("filter_order"), x))), F.lit(len(filters) + 1)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    )
    fails = F.array_contains("failed", F.col("filter"))
    here = F.col("gone") == F.col("step")
    total = lambda name, when: F.sum(F.when(when, F.col(name)).otherwise(0)).cast("long")
    steps = each.groupBy("part", "filter_order", "step", "filter").agg(
        total("docs", F.col("gone") > F.col("step")).alias("kept"),
        total("docs", here).alias("removed"),
        total("docs", fails & (F.col("gone") < F.col("step"))).alias("redundant"),
        total("docs", fails & (F.size("failed") == 1)).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    600 rows for every source that occurs; none for an empty table.
    """
    return order_steps(combination_counts(docs, labels)).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "filter", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    )
