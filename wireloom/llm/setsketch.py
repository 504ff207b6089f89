"""Near-duplicate documents by banded SetSketch registers, a joint likelihood and a check on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, pick, spans_of, stored
from .components import connected_components

SHINGLE_WORDS = 3
# link at PERCENT * union <= 100 * intersection
PERCENT = 85
# registers: truncated minima on a scale of powers of BASE, for exponentials of rate RATE
REGISTERS = 96
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
# registers of a band; at similarity 0.85 all 24 bands of 4 differ in 2 of 10^8 pairs
BAND_ROWS = 4
# a pair is estimated this many standard errors below the limit before it is passed over
ERRORS = 5.0
# rows that are compared with each other in one task
BLOCK_ROWS = 200
# members of a large cluster that go along with each of its blocks
HUBS = 8
WORDS_CACHED = 1_000_000
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 16

_ODD = np.random.default_rng(12).integers(1 << 62, size=(2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """Hash of each word, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if len(words) < SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE_WORDS)]))


def shingle_hashes(words: list[bytes], known: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    each = np.fromiter((known[w] for w in words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    if not width:
        return each
    mixed = np.full(len(each) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ each[k : len(each) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def registers_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of registers for each run of ``values`` that begins at ``starts``.

    A register is floor(1 - log_BASE of the least exponential) within 0 and LIMIT + 1. The least
    exponential of a set belongs to its least uniform hash, so only that one is transformed; the
    register of a union is the larger of two registers.
    """
    least = np.empty((len(starts), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(values * _ODD[0, i] + _ODD[1, i], starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def sketch_sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, digest, registers, text): the size, a 128-bit digest and the registers of each set.

    Digest and registers are null for an empty set.
    """
    fields = [("row", "bigint"), ("doc_id", "bigint"), ("n", "bigint"), ("digest", "binary"), ("registers", "binary"), ("text", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            row, doc_id, text = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "text"))
            sets = [shingle_hashes(words_of(text[i].as_py()), known) for i in range(batch.num_rows)]
            full = [i for i, s in enumerate(sets) if len(s)]
            registers: list[bytes | None] = [None] * len(sets)
            for a, b in spans_of([len(sets[i]) for i in full], SHINGLES_AT_ONCE):
                part = [sets[i] for i in full[a:b]]
                starts = np.cumsum([0] + [len(s) for s in part])[:-1]
                for i, found in zip(full[a:b], registers_of(np.concatenate(part), starts)):
                    registers[i] = found.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    row, doc_id, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(registers, pa.binary()), text,
                ],
                [n for n, _ in fields],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, arrow_schema(fields))


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set exceeds the other's, of the share of elements that make it so."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimated_similarity(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity at which counts of larger and smaller registers, jointly, are likeliest."""
    u = n_a / (n_a + n_b)
    v, same = 1 - u, REGISTERS - more - less
    tiny = 1e-12

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _share(u - v * j), _share(v - u * j)
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    for _ in range(20):  # the likelihood has one maximum
        third = (high - low) / 3
        right = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(right, low + third, low), np.where(right, high, high - third)
    return (low + high) / 2


def likely_pairs(registers: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions within ``left`` and ``right`` of pairs that may reach the limit, and their estimates."""
    limit = PERCENT / 100
    least = limit - ERRORS * np.sqrt(limit * (1 - limit) / REGISTERS)
    at, found = [], []
    for start in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[start : start + PAIRS_AT_ONCE], right[start : start + PAIRS_AT_ONCE]
        here = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
        x, y = registers[a[here]], registers[b[here]]
        more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
        estimate = estimated_similarity(more, less, n[a[here]].astype(float), n[b[here]].astype(float))
        near = estimate >= least
        at.append(start + here[near])
        found.append(estimate[near])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(at, np.int64), join(found, float)


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j within consecutive runs of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        left.append((at[:, None] + i[None, :]).ravel())
        right.append((at[:, None] + j[None, :]).ravel())
    return np.concatenate(left), np.concatenate(right)


class _Forest:
    """Union-find over positions; ``join`` says whether it connected something new."""

    def __init__(self, label: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(label)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def apart(self, i: int, j: int) -> bool:
        return self.root(i) != self.root(j)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def band_clusters(nodes: DataFrame) -> DataFrame:
    """(node, root) of all sets that may be linked: clusters of sets that meet in a band.

    ``nodes``: (node, n, registers), one row per distinct set. In buckets of at most BLOCK_ROWS sets
    the registers estimate all pairs, and a spanning forest of the likely ones is kept; a larger
    bucket hangs together as it is. No likely pair is in two clusters.
    """
    bands = REGISTERS // BAND_ROWS
    width = 2 * BAND_ROWS
    keyed = nodes.select("node", "registers", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select(
        "node", F.xxhash64("band", F.substring(F.col("registers"), F.col("band") * width + 1, F.lit(width))).alias("key")
    )
    sizes = keyed.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"))
    met = stored(keyed.join(sizes.filter("size > 1"), F.col("key") == F.col("_key")).select("key", "node", "size", "hub"), "band-members")
    small = met.filter(F.col("size") <= BLOCK_ROWS).join(nodes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    buckets = small.groupBy("key").agg(F.collect_list(F.struct("node", "n", "registers")).alias("sets")).select("sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sets")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            node, n = flat.field("node").to_numpy(), flat.field("n").to_numpy()
            registers = np.frombuffer(b"".join(flat.field("registers").to_pylist()), np.uint16).reshape(len(node), REGISTERS)
            ends = np.concatenate([[0], np.cumsum(size)])
            for a, b in spans_of((size * size).tolist(), 4 * PAIRS_AT_ONCE):
                at = slice(ends[a], ends[b])
                left, right = _pairs_within(size[a:b])
                near, estimate = likely_pairs(registers[at], n[at], left, right)
                forest = _Forest(list(range(ends[b] - ends[a])))
                best = near[np.argsort(-estimate, kind="stable")]
                kept = [(i, j) for i, j in zip(left[best].tolist(), right[best].tolist()) if forest.join(i, j)]
                if kept:
                    i, j = np.array(kept).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[at][i]), pa.array(node[at][j])], ["a", "b"])

    likely = buckets.mapInArrow(run, "a bigint, b bigint")
    wide = met.filter((F.col("size") > BLOCK_ROWS) & (F.col("node") > F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return stored(connected_components(likely.union(wide), "a", "b"), "clusters")


def confirmed_links(blocks: DataFrame) -> DataFrame:
    """(a, b): links that connect what is linked within each ``unit`` of ``blocks``.

    ``blocks``: (unit, cluster, label, node, n, registers, text). Rows of one cluster are compared if
    their labels differ; equal labels are connected already. Pairs are taken from the likeliest
    down and confirmed on the full sets of shingles; pairs that earlier links connect are left out.
    """

    def run(rows: pa.Table) -> pa.Table:
        cluster, label, node, n = (rows.column(c).to_numpy() for c in ("cluster", "label", "node", "n"))
        order = np.argsort(cluster, kind="stable")
        registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(len(node), REGISTERS)[order]
        text = rows.column("text").take(pa.array(order))
        cluster, label, node, n = cluster[order], label[order], node[order], n[order]
        firsts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])) if len(cluster) else np.zeros(0, np.int64)
        left, right = _pairs_within(np.diff(np.append(firsts, len(cluster))))
        other = label[left] != label[right]
        left, right = left[other], right[other]
        near, estimate = likely_pairs(registers, n, left, right)
        forest = _Forest(label.tolist())
        sets: dict[int, set] = {}
        found = []

        def full(i: int) -> set:
            if i not in sets:
                sets[i] = shingle_set(text[i].as_py())
            return sets[i]

        for at in near[np.argsort(-estimate, kind="stable")].tolist():
            i, j = int(left[at]), int(right[at])
            if forest.apart(i, j):
                x, y = full(i), full(j)
                both = len(x & y)
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    forest.join(i, j)
                    found.append((node[i], node[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return blocks.groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def _unit(*parts: str) -> F.Column:
    return F.xxhash64(*[F.col(p) for p in parts]).alias("unit")


def set_links(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of all distinct sets that have a link; ``sets`` holds their texts by ``row``.

    A cluster of up to BLOCK_ROWS sets is compared within one task, several small ones together. A
    larger one is dealt to blocks, and HUBS of its members go along with each, which connects most
    of it; then what is not yet in its largest part meets all other blocks. So no pair is left
    out, no task gets more than two blocks, and texts travel only where something is open.
    """
    clusters = band_clusters(nodes.select("node", "n", "registers"))
    texts = sets.select(F.col("row").alias("_row"), "text")
    size = clusters.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("members"))
    members = stored(
        clusters.join(size, F.col("root") == F.col("_root")).select("node", F.col("root").alias("cluster"), "members")
        .join(nodes.select(F.col("node").alias("_node"), "n", "registers"), F.col("node") == F.col("_node"))
        .join(texts, F.col("node") == F.col("_row"))
        .select("node", "cluster", "members", "n", "registers", "text"),
        "members", "zstd",
    )
    packs = max(1, members.count() // BLOCK_ROWS)
    body = ["cluster", "node", "n", "registers", "text"]
    alone = F.col("node").alias("label")
    small = members.filter(F.col("members") <= BLOCK_ROWS).withColumn("pack", F.expr(f"pmod(xxhash64(cluster), {packs})"))
    wide = members.filter(F.col("members") > BLOCK_ROWS).withColumn("parts", F.ceil(F.col("members") / BLOCK_ROWS).cast("int"))
    hubs = wide.groupBy(F.col("cluster").alias("_c"), F.expr(f"pmod(xxhash64(node, 1), {HUBS})").alias("_k")).agg(F.min("node").alias("_hub"))
    own = F.expr("pmod(xxhash64(node), parts)").cast("int")
    dealt = wide.withColumn("part", own)
    along = (
        wide.join(hubs, (F.col("cluster") == F.col("_c")) & (F.col("node") == F.col("_hub")), "left_semi")
        .withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> own").drop("own")
    )
    first = small.select(_unit("pack"), alone, *body).union(
        dealt.unionByName(along).select(_unit("cluster", "part"), alone, *body)
    )
    links = stored(confirmed_links(first), "links")
    if not wide.isEmpty():
        links = links.union(stored(confirmed_links(_open_blocks(wide, links, body)), "links"))
    return connected_components(links, "a", "b")


def _open_blocks(wide: DataFrame, links: DataFrame, body: list[str]) -> DataFrame:
    """Blocks of the large clusters' members that are still apart from their cluster's largest part."""
    rooted = connected_components(links, "a", "b").withColumnRenamed("node", "_node")
    labelled = wide.select(*body).join(rooted, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("root", "node")).drop("_node", "root")
    parts = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size"))
    most = parts.groupBy(F.col("cluster").alias("_c")).agg(
        F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("mains"), (F.sum("size") - F.max("size")).alias("rest")
    ).filter("rest > 0")
    blocks = lambda rows: F.ceil(F.col(rows) / BLOCK_ROWS).cast("int")
    open_ = labelled.join(most, F.col("cluster") == F.col("_c")).withColumn("mains", blocks("mains")).withColumn("rest", blocks("rest"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_main = F.col("label") == F.col("main")
    block = lambda n: F.expr(f"pmod(xxhash64(node, 2), {n})").cast("int")
    main = open_.filter(in_main).withColumn("side", F.lit("main")).withColumn("i", block("mains")).withColumn("j", numbers("rest"))
    rest = open_.filter(~in_main)
    across = rest.withColumn("side", F.lit("main")).withColumn("j", block("rest")).withColumn("i", numbers("mains"))
    own, other = block("rest"), F.col("other")
    among = rest.withColumn("other", numbers("rest")).withColumn("side", F.lit("rest")).withColumn("i", F.least(own, other)).withColumn(
        "j", F.greatest(own, other)).drop("other")
    return main.unionByName(across).unionByName(among).select(_unit("cluster", "side", "i", "j"), "label", *body)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Sets of distinct lower-cased 3-word shingles link at PERCENT; rows without words have an empty
    set and stay alone. Copies and repeated rows meet in one set first. The component id is the
    least doc_id reached; it is null where no row of the component has an id, and such rows, like
    all of the least id, are kept.
    """
    sets = stored(sketch_sets(pick(docs, "doc_id", "text")), "sketches", "zstd")
    nodes = stored(
        sets.filter("n > 0").groupBy("digest", "n", "registers").agg(F.min("row").alias("node"), F.min("doc_id").alias("item")), "nodes"
    )
    linked = set_links(sets, nodes).withColumnRenamed("node", "_node")
    rooted = nodes.join(linked, F.col("node") == F.col("_node"), "left").select("digest", F.coalesce("root", "node").alias("root"), "item")
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("item").alias("least"))
    classes = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), "least")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return sets.select("doc_id", "n", "digest").join(classes, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
