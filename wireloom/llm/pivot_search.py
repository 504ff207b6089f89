"""Exact top-k by inner product with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, stored

# pivots per vector length, chosen among about so many rows; those rows also give each query a
# first k-th score
PIVOTS = 60
PIVOT_SAMPLE = 2_000
# queries and candidate rows that meet in one task
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
QUERIES_AT_ONCE = 256
# candidates that are scored between two looks at the bound
STEP = 64
LONG = (1 << 63) - 1


def whole_vector(embedding: Column) -> Column:
    """Components as floor(256 * x); null where the vector or a component is null or not finite."""
    # floor of a large double does not fit a long; such numbers are whole already
    wide = F.transform(embedding, lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & good, wide)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products as whole numbers; doubles are exact as long as every sum stays below 2^53."""
    largest = float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, len(query))
    if largest < 2.0**52:
        return (rows @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [max(-LONG, min(LONG, sum(a * int(b) for a, b in zip(whole, row)))) for row in rows]


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots that lie far from each other: each is the sampled row farthest from those before it."""
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Pivots:
    """Pivots of one vector length, in the space where inner products become distances.

    A row x gets one more component, the root of M - |x|^2 with M the largest squared norm, and a
    query q gets 0. Then |q - x|^2 = |q|^2 + M - 2 qx: the nearest rows have the highest product.

    A row's distances to all pivots fix its place in the space the pivots span and its height above
    it. Two points are at least as far apart as these are, which is never less than the difference
    of their distances to any single pivot: the highest lower bound that the table holds.
    """

    def __init__(self, sample: np.ndarray, largest: float, count: int = PIVOTS):
        self.largest = largest
        self.points = farthest_first(self.lift(sample), count)
        self.steps = self.points[1:] - self.points[0]
        left, size, _ = np.linalg.svd(self.steps, full_matrices=False)
        firm = size > 1e-3 * size.max(initial=0)  # directions told apart too badly are left out
        self.turn = left[:, firm] / size[firm]

    def lift(self, rows: np.ndarray) -> np.ndarray:
        spare = np.sqrt(np.maximum(self.largest - (rows**2).sum(axis=1), 0))
        return np.concatenate([rows, spare[:, None]], axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots: the pivot table."""
        square = (lifted**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * lifted @ self.points.T
        return np.maximum(square, 0)

    def places(self, far: np.ndarray) -> np.ndarray:
        """Coordinates within the span of the pivots and the height above it, from the distances."""
        along = (far[:, :1] + (self.steps**2).sum(axis=1)[None, :] - far[:, 1:]) / 2
        inside = along @ self.turn
        height = np.sqrt(np.maximum(far[:, 0] - (inside**2).sum(axis=1), 0))
        return np.concatenate([inside, height[:, None]], axis=1)


def upper_bounds(queries: np.ndarray, query_places: np.ndarray, places: np.ndarray, largest: float) -> np.ndarray:
    """For each query and row, what their inner product cannot exceed."""
    square = (queries**2).sum(axis=1)
    least = (query_places**2).sum(axis=1)[:, None] + (places**2).sum(axis=1)[None, :] - 2 * query_places @ places.T
    slack = 1e-6 * (1.0 + square + largest)
    return (square[:, None] + largest - np.maximum(least, 0)) / 2 + slack[:, None]


def kth_score(query: np.ndarray, row: int, sample: np.ndarray, sample_rows: np.ndarray, k: int) -> int | None:
    """The k-th best score among sampled rows other than the query's own; None if there are fewer."""
    scores = sorted((s for s, r in zip(exact_scores(query, sample), sample_rows.tolist()) if r != row), reverse=True)
    return scores[k - 1] if len(scores) >= k else None


def _table(vectors: DataFrame, pivots: dict[int, tuple[Pivots, np.ndarray, np.ndarray]], every: int, k: int) -> DataFrame:
    """The pivot table: each row's place by its distances to the pivots, and each query's first k-th score."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS and PIVOT_SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            rows, ids = batch.column("row").to_pylist(), batch.column("vec_id").to_pylist()
            places: list[list[float]] = [[]] * len(lists)
            start: list[int | None] = [None] * len(lists)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                p, sample, sample_rows = held.value[size]
                own = np.array([lists[i] for i in at]).reshape(len(at), size)
                lifted = p.lift(own)
                asks = np.array([ids[i] % every == 0 for i in at])
                found = p.places(p.distances(lifted))
                lifted[:, -1] = 0.0  # as a query
                as_query = p.places(p.distances(lifted[asks]))
                for i, d in zip(at, found.tolist()):
                    places[i] = d
                for j, d in zip(np.flatnonzero(asks).tolist(), as_query.tolist()):
                    places[at[j]] = places[at[j]] + d
                    start[at[j]] = kth_score(own[j], rows[at[j]], sample, sample_rows, k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.list_(pa.float64())), pa.array(start, pa.int64())], [*batch.schema.names, "place", "start"]
            )

    return vectors.mapInArrow(run, "row bigint, vec_id bigint, vector array<double>, place array<double>, start bigint")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def search_block(rows: pa.Table, queries: pa.Table, largest: dict[int, float], k: int) -> list[tuple[int, int, int, int, int]]:
    """(asked, query_id, vec_id, row, score): the best ``k`` of a block's rows for each query.

    Bounds of many queries and all rows come from one matrix product. A query's rows are scored in
    the order of their bounds until the next one is below its k-th score; an equal one is still
    scored, for it may have the smaller id.
    """
    if not rows.num_rows or not queries.num_rows:
        return []
    vectors, asked = _matrix(rows.column("vector"), rows.num_rows), _matrix(queries.column("vector"), queries.num_rows)
    places, twice = _matrix(rows.column("place"), rows.num_rows), _matrix(queries.column("place"), queries.num_rows)
    limit = largest[vectors.shape[1]]
    ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
    names, own = queries.column("vec_id").to_pylist(), queries.column("row").to_pylist()
    start = queries.column("start").to_pylist()
    found = []
    for first in range(0, len(asked), QUERIES_AT_ONCE):
        part = slice(first, first + QUERIES_AT_ONCE)
        bounds = upper_bounds(asked[part], twice[part, twice.shape[1] // 2 :], places, limit)
        for q, bound in zip(range(first, len(asked)), bounds):
            least = start[q]
            open_ = np.flatnonzero(bound >= least) if least is not None else np.arange(len(ids))
            order = open_[np.argsort(-bound[open_], kind="stable")]
            top: list[tuple[int, int, int]] = []
            at = 0
            while at < len(order) and (least is None or bound[order[at]] >= least):
                near = order[at : at + STEP]
                at += STEP
                scored = zip(exact_scores(asked[q], vectors[near]), ids[near].tolist(), numbers[near].tolist())
                top = sorted([*top, *((-s, i, r) for s, i, r in scored if r != own[q])])[:k]
                if len(top) == k:
                    least = -top[-1][0] if least is None else max(least, -top[-1][0])
            found += [(own[q], names[q], i, r, -s) for s, i, r in top]
    return found


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for each query.

    ``vectors``: (vec_id, embedding). Queries are the rows whose id is divisible by ``every``;
    candidates are all rows but the query's own, ties go to the smaller id. Rows whose id or vector
    is null, or that hold null or non-finite components, take no part. Vectors of another length
    are no candidates. Rows with equal ids are rows of their own. Scores beyond a long end at its
    limits. Blocks of queries meet blocks of rows in one task each.
    """
    spark = vectors.sparkSession
    rows = stored(
        pick(vectors, "vec_id", "embedding")
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding")).alias("vector"))
        .filter("vec_id is not null and vector is not null")
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "vec_id", "vector"),
        "vectors",
    )
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.max(norm).alias("largest"), F.count(F.lit(1)).alias("rows")).collect()
    total = sum(s["rows"] for s in sizes)
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    part = max(1, total // PIVOT_SAMPLE)
    drawn = rows.filter(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).select("row", "vector").toArrow()
    sample = list(zip(drawn.column("row").to_pylist(), drawn.column("vector").to_pylist()))
    pivots = {}
    for s in sizes:
        size, own = s["size"], [x for x in sample if len(x[1]) == s["size"]]
        points = np.array([v for _, v in own], dtype=float).reshape(-1, size)
        if not own:  # no row of this length was drawn: any point will do as a pivot
            points = np.zeros((1, size))
        pivots[size] = (Pivots(points, float(s["largest"])), points[: len(own)], np.array([r for r, _ in own], dtype=np.int64))
    largest = {s["size"]: float(s["largest"]) for s in sizes}
    table = stored(_table(rows, pivots, every, k), "pivots").withColumn("size", F.size("vector"))
    asks = F.col("vec_id") % every == 0
    row_blocks, query_blocks = -(-total // ROW_BLOCK), max(1, -(-table.filter(asks).count() // QUERY_BLOCK))
    block = lambda n, seed: F.expr(f"pmod(xxhash64(row, {seed}), {n})").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.when(asks, F.floor(F.size("place") / 2)).otherwise(F.size("place")).cast("int")
    left = table.withColumn("place", F.slice("place", F.lit(1), width)).withColumn("c", block(row_blocks, 1)).withColumn("b", each(query_blocks))
    right = table.filter(asks).withColumn("b", block(query_blocks, 2)).withColumn("c", each(row_blocks))

    def run(near: pa.Table, queries: pa.Table) -> pa.Table:
        columns = list(zip(*search_block(near, queries, largest, k))) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["asked", "query_id", "vec_id", "row", "score"])

    key = ("size", "c", "b")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "asked bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
