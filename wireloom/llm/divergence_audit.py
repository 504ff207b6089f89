"""Divergence of word use between the sources of a language, by products of one-hot levels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP_TERMS = 50
# terms and groups of one block of the product
BLOCK_TERMS = 256
BLOCK_GROUPS = 32
# distinct terms that a task counts before it sends them on
COUNTED_AT_ONCE = 300_000

# A-Z lower-cased, other ASCII characters that are no letters become blanks, bytes above stay
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in, and documents of, each group.

    Tasks count their rows first, so a group with most of the rows sends each term a few times only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in uses.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                        pa.array([t.decode("utf-8", "replace") for t in n], pa.string()),
                        pa.array(list(n.values()), pa.int64()), pa.array([held[t] for t in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            uses.clear()

        size = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "text")]
            for i in range(batch.num_rows):
                lang, source, text = (c[i].as_py() for c in columns)
                n, held = uses.setdefault((lang, source), (Counter(), Counter()))
                found = Counter(terms_of(text))
                size -= len(n)
                n.update(found)
                held.update(found.keys())
                size += len(n)
                if size > COUNTED_AT_ONCE:
                    yield from sent()
                    size = 0
        yield from sent()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact; 0 without terms."""
    n = F.col(n) if isinstance(n, str) else n
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    under = (F.col(total) + PRIOR * F.col(terms)).cast("decimal(20,0)")
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", over, under)).otherwise(0).cast("long")


def kept_cells(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (lang, source, term, n, p, q, terms) with n > 0, and groups (lang, source, p0, terms, groups).

    p and q are a term's smoothed share in its group and its language, p0 that of a term the
    group does not use, terms the number of terms its language keeps.
    """
    counts = stored(count_terms(docs), "terms")
    kept = counts.groupBy(F.col("lang").alias("_l"), F.col("term").alias("_t")).agg(F.sum("docs").alias("_d"), F.sum("n").alias("in_lang"))
    kept = stored(kept.filter(F.col("_d") >= LEAST_DOCS).select("_l", "_t", "in_lang"), "kept-terms")
    cells = stored(
        counts.join(kept, (F.col("lang") == F.col("_l")) & (F.col("term") == F.col("_t"))).select("lang", "source", "term", "n", "in_lang"),
        "cells",
    )
    langs = kept.groupBy("_l").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    sums = cells.groupBy(F.col("lang").alias("_cl"), F.col("source").alias("_cs")).agg(F.sum("n").alias("total"))
    seen = docs.select("lang", "source").distinct()
    sizes = seen.groupBy(F.col("lang").alias("_gl")).agg(F.count(F.lit(1)).alias("groups"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    groups = stored(
        seen.join(langs, F.col("lang") == F.col("_l"), "left")
        .join(sums, (F.col("lang") == F.col("_cl")) & (F.col("source") == F.col("_cs")), "left")
        .join(sizes, F.col("lang") == F.col("_gl"))
        .select("lang", "source", "groups", zero("terms"), zero("lang_total"), zero("total"))
        .withColumn("p0", smoothed(F.lit(0).cast("long"), "total", "terms")),
        "groups",
    )
    known = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "terms", "total", "lang_total")
    priced = cells.join(known, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).select(
        "lang", "source", "term", "n", "terms", smoothed("n", "total", "terms").alias("p"), smoothed("in_lang", "lang_total", "terms").alias("q")
    )
    return stored(priced, "priced"), groups


def _one_hot(row: np.ndarray, level: np.ndarray, rows: int, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicator columns of one group's levels over a block's terms, and each column's price.

    The first column is that of terms the group does not use.
    """
    prices, at = np.unique(level, return_inverse=True)
    hot = np.zeros((rows, len(prices) + 1), np.float32)
    hot[:, 0] = 1
    hot[row, 0] = 0
    hot[row, at + 1] = 1
    return hot, np.concatenate([[zero], prices])


def block_distances(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block of terms for all pairs of a block of groups with another.

    For every pair of groups the product of one's transposed indicator columns with the other's is
    their joint table: how many terms have this level here and that level there. Each entry is
    priced by the difference of the two levels. Counts stay far below 2^24, so single-precision
    products are exact; prices are summed as 64-bit integers.
    """
    if groups.num_rows == 0:
        return pa.table({n: pa.array([], t) for n, t in (("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
    names, p0, side, size = (groups.column(c).to_numpy(zero_copy_only=False) for c in ("source", "p0", "side", "size"))
    place = {s: i for i, s in enumerate(names)}
    terms = pa.concat_arrays(cells.column("term").chunks or [pa.array([], pa.string())]).dictionary_encode()
    row = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
    level = cells.column("p").to_numpy().astype(np.int64)
    order = np.argsort(group, kind="stable")
    row, group, level = row[order], group[order], level[order]
    ends = np.searchsorted(group, np.arange(len(names) + 1))
    used = len(terms.dictionary)
    unused = int(size[0]) - used  # terms of the block that no group here uses
    hot = [_one_hot(row[a:b], level[a:b], used, int(z)) for a, b, z in zip(ends, ends[1:], p0)]
    first, second = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    columns = np.concatenate([hot[j][0] for j in second], axis=1) if len(second) else np.zeros((used, 0), np.float32)
    prices = np.concatenate([hot[j][1] for j in second]) if len(second) else np.zeros(0, np.int64)
    starts = np.cumsum([0] + [len(hot[j][1]) for j in second])[:-1]
    out: tuple[list, list, list] = ([], [], [])
    for i in first:
        joint = (hot[i][0].T @ columns).astype(np.int64)
        if len(starts):
            joint[0, starts] += unused
            paid = np.add.reduceat((joint * np.abs(hot[i][1][:, None] - prices[None, :])).sum(axis=0), starts)
            for j, value in zip(second, paid):
                if i != j:
                    out[0].append(names[i]), out[1].append(names[j]), out[2].append(int(value))
                    if side[i] != side[j]:
                        out[0].append(names[j]), out[1].append(names[i]), out[2].append(int(value))
    lang = groups.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
        "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()),
    })


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every ordered pair of a language's groups the sum of |p - q|.

    Terms are dealt to blocks by hash, groups as well; a task gets one block of terms and two
    blocks of groups, whatever the size of a group.
    """
    across = F.ceil(F.col("groups") / BLOCK_GROUPS).cast("int")
    sized = groups.select(
        "lang", "source", "p0", "terms", across.alias("across"), F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int").alias("blocks"),
    ).withColumn("own", F.expr("pmod(xxhash64(source), across)").cast("int"))
    met = [
        F.col("lang"), F.col("source"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("other"),
    ]
    shape = sized.groupBy(F.col("lang").alias("_l")).agg(F.max("across").alias("across"), F.max("blocks").alias("blocks"))
    placed = (
        cells.join(shape, F.col("lang") == F.col("_l"))
        .withColumn("own", F.expr("pmod(xxhash64(source), across)").cast("int"))
        .withColumn("block", F.expr("pmod(xxhash64(term), blocks)").cast("int"))
    )
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    left = placed.select(*met, "own", "block", "term", "p").select("lang", "source", "block", low, high, "term", "p")
    filled = placed.select(F.col("lang").alias("_bl"), F.col("block").alias("_bb"), "term").distinct().groupBy("_bl", "_bb").agg(
        F.count(F.lit(1)).alias("_size")
    )
    spread = sized.select("lang", "source", "p0", "own", "across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # side: 0 where both blocks of groups are the same one, else 1 for the first and 2 for the second
    right = (
        spread.join(filled, (F.col("lang") == F.col("_bl")) & (F.col("block") == F.col("_bb")), "left")
        .select(*met, "own", "block", "p0", F.coalesce("_size", F.lit(0)).alias("size"))
        .select("lang", "source", "block", low, high, "p0", "size",
                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    )
    key = ("lang", "block", "low", "high")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block_distances, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source; null: empty).

    Part `pair` ranks the other sources of a group's language by divergence, part `term` the terms
    that a group uses more than its language does, down to rank 50. Groups without a kept term
    have pairs, but no terms; an empty table gives no row. Ties go by the item's UTF-8 bytes.
    """
    plain = pick(docs, "lang", "source", "text")
    rows = plain.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells, groups = kept_cells(rows)
    pairs = pair_distances(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = cells.filter("n > 0 and p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).union(ranked(terms).filter(F.col("rank") <= TOP_TERMS))
