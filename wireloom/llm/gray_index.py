"""SimHash near-duplicates found with a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Guarded, extended, pick, stored
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# larger buckets are cut by further bits, so that one task never gets more fingerprints of a bucket
BUCKET_ROWS = 1024
# bits of a fingerprint that one level of the index adds
LEVEL_BITS = 16
# node pairs and fingerprints that are expanded together
PAIRS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 200_000


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes. No words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long; without its text unless asked for."""
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = extended(docs.select(*names), [("fp", "bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            found = np.array([fingerprint(text[i].as_py(), words_each) for i in range(batch.num_rows)], dtype=np.uint64)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, schema)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the binary-reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _children(starts: np.ndarray, nodes: np.ndarray, level: int, pairs: tuple[np.ndarray, ...]):
    """Child pairs of node pairs; a node paired with itself gives each unordered pair once."""
    a, b, bits = pairs
    first_a, count_a = starts[level][a], starts[level][a + 1] - starts[level][a]
    first_b, count_b = starts[level][b], starts[level][b + 1] - starts[level][b]
    each = count_a * count_b
    at = np.repeat(np.arange(len(a)), each)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    i, j = first_a[at] + k // count_b[at], first_b[at] + k % count_b[at]
    return i, j, bits[at], (a[at] != b[at]) | (i <= j)


def linked_pairs(bucket: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within a bucket that differ in at most ``max_bits`` bits.

    ``bucket`` and ``values`` are sorted by (bucket, Gray rank), so fingerprints with equal leading
    bits lie together. A node of level k stands for one pattern of the first 16 * k bits; pairs
    of nodes are followed down from the bucket itself, adding up differences, and a pair of
    groups is dropped whole as soon as its sum exceeds the limit.
    """
    n, levels = len(values), 64 // LEVEL_BITS
    firsts = []  # of each level, the rows at which a node begins
    for level in range(levels + 1):
        prefix = values >> np.uint64(64 - LEVEL_BITS * level) if level else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (prefix[1:] != prefix[:-1])
        firsts.append(np.flatnonzero(new))
    # of each level, the first child of each node in the next one
    starts = [np.append(np.searchsorted(firsts[k + 1], firsts[k]), len(firsts[k + 1])) for k in range(levels)]
    segment = [
        (values[firsts[k + 1]] >> np.uint64(64 - LEVEL_BITS * (k + 1))) & np.uint64((1 << LEVEL_BITS) - 1)
        for k in range(levels)
    ]
    roots = np.arange(len(firsts[0]))
    stack = [(0, (roots, roots, np.zeros(len(roots), np.int64)))]
    left, right = [], []
    while stack:
        level, pairs = stack.pop()
        if level == levels:
            other = pairs[0] != pairs[1]
            left.append(firsts[level][pairs[0][other]])
            right.append(firsts[level][pairs[1][other]])
            continue
        size = (starts[level][pairs[0] + 1] - starts[level][pairs[0]]) * (starts[level][pairs[1] + 1] - starts[level][pairs[1]])
        if len(size) > 1 and int(size.sum()) > PAIRS_AT_ONCE:
            half = len(size) // 2
            stack += [(level, tuple(x[:half] for x in pairs)), (level, tuple(x[half:] for x in pairs))]
            continue
        i, j, bits, once = _children(starts, None, level, pairs)
        bits = bits + np.bitwise_count(segment[level][i] ^ segment[level][j])
        near = once & (bits <= max_bits)
        stack.append((level + 1, (i[near], j[near], bits[near])))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(left), join(right)


def _folded(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each position, the least one that the pairs reach from it."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]
        if (label == before).all() and (label[left] == label[right]).all():
            break
    return label


def bucket_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) star links that connect what is linked in each row's array ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            cuts = np.searchsorted(np.cumsum(size), np.arange(ROWS_AT_ONCE, len(flat) + ROWS_AT_ONCE, ROWS_AT_ONCE))
            ends = np.concatenate([[0], np.cumsum(size)])
            for a, b in zip([0, *(cuts + 1)[:-1]], np.minimum(cuts + 1, len(size))):
                at = slice(ends[a], ends[max(a, b)])
                values, bucket = flat[at], row[at]
                order = np.lexsort((gray_rank(values), bucket))
                values, bucket = values[order], bucket[order]
                label = _folded(len(values), *linked_pairs(bucket, values, max_bits))
                off = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[off].view(np.int64)), pa.array(values[label[off]].view(np.int64))], ["a", "b"]
                )

    return buckets.mapInArrow(run, "a bigint, b bigint")


def _parts(mask: int, count: int) -> list[int]:
    """``mask`` joined with each of ``count`` equal shares of the bits outside it."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(k * len(free) / count) for k in range(count + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links that connect all distinct fingerprints (``fp``) at ``max_bits`` or fewer bits.

    Cut into ``max_bits`` + 1 shares, two near fingerprints agree on one share at least, so they
    meet in the bucket of that share's bits. A bucket that is too large for a task is cut again in
    the same way by the bits that are still free, as often as needed; no pair is lost.
    """
    links, level = None, 0
    masks = [0]
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        finer = {m: _parts(m, max_bits + 1) for m in masks}
        shares = F.create_map(*[x for m, parts in finer.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(p)).cast("long") for p in parts]))])
        keyed = stored(
            rows.select("fp", F.explode(F.element_at(shares, F.col("mask"))).alias("mask"))
            .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "buckets")
        masks = [p for parts in finer.values() for p in parts]
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        last = 64 - min(bin(m).count("1") for m in masks) <= 10
        wide = sizes.select(F.col("mask").alias("_m"), F.col("value").alias("_v"), "rows")
        sized = keyed.join(wide, (F.col("mask") == F.col("_m")) & (F.col("value") == F.col("_v"))).select("fp", "mask", "value", "rows")
        small = sized if last else sized.filter(F.col("rows") <= BUCKET_ROWS)
        found = bucket_links(small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps"), max_bits)
        links = found if links is None else links.union(found)
        if last or sizes.filter(F.col("rows") > BUCKET_ROWS).isEmpty():
            return links
        rows = stored(sized.filter(F.col("rows") > BUCKET_ROWS).select("fp", "mask"), "wide")


def fingerprint_components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, least) for every distinct fingerprint: the least ``item`` in its component.

    ``rows``: (fp, item). Copies meet in one fingerprint by a combined minimum first.
    """
    distinct = stored(rows.groupBy("fp").agg(F.min("item").alias("item")), "fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_bits), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "item"
    )
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("item").alias("least"))
    return rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("node"), "least")


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Texts are lower-cased in A-Z; a text with fewer words than a shingle is one shingle, one
    without words (or null) has fingerprint 0 and is linked like any other. The component id is the
    least doc_id reached over links; it is null only if no row of the component has an id.
    """
    rows = stored(with_fingerprints(pick(docs, "doc_id", "text"), words_each), "simhash")
    found = fingerprint_components(rows.select("fp", F.col("doc_id").alias("item")), max_bits)
    return rows.join(found, F.col("fp") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: that of the least doc_id, the first stored of repeated rows."""
    guard = Guarded(docs, ("doc_id", "text"), ())
    rows = stored(
        with_fingerprints(guard.work.withColumn("_row", F.monotonically_increasing_id()), words_each, True), "simhash"
    )
    item = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    found = fingerprint_components(rows.select("fp", item.alias("item")), max_bits)
    chosen = found.select(F.col("least.row").alias("_kept")).distinct()
    return guard.restore(rows.join(chosen, F.col("_row") == F.col("_kept"), "left_semi"))
