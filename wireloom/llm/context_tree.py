"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with the up to DEPTH bytes before it as context. The counts of
all training texts fill the tree; at every node a Krichevsky-Trofimov estimate is mixed half and
half with the mixture of the node's longer contexts. The tables are joined as rows: distinct
contexts grow with the corpus, so nothing of them is broadcast or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Temporary, id_bucket, pick, spans_of, stored

DEPTH = 5
# levels from here on are worked out in one pass per partition, the few above them level by level
SPLIT_LEVEL = 3
# bytes of text that share one table of words and contexts
BLOCK_BYTES = 28 << 20
BYTES_AT_ONCE = 1 << 20
# distinct contexts of one partition
PART_GRAMS = 400_000
END = 0xFF  # in no UTF-8 text: fills the context before a text and ends it
WORD, GRAM, LAST = 0, 1, 2
HALF = np.log(0.5)


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every position as one number, number of positions of each text).

    The latest byte of a context is the highest, so that contexts with a common ending are
    neighbours in sorted order; the predicted byte is the lowest.
    """
    pad = bytes([END]) * depth
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    key = flat.copy()
    for back in range(1, depth + 1):
        key[back:] |= flat[:-back] << np.uint64(8 * (depth + 1 - back))
    # the padding before a text is no position of its own
    own = np.ones(len(flat), bool)
    begin = np.cumsum(size + depth) - size
    for k in range(1, depth + 1):
        own[begin - k] = False
    return key[own], size


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_DRAW = np.random.default_rng(2).integers(1 << 63, size=258, dtype=np.uint64)
_BASE, _MIX = int(_DRAW[256]) | 1, _DRAW[257] | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(size: int) -> list[np.ndarray]:
    """Powers of the base of the word hash and of its inverse, modulo 2^64."""
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text), by running sums instead of word by word.

    A word's hash is the sum of a random number for each byte times a power for its place.
    """
    flat = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[flat]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers_to(len(flat))
    total = np.cumsum(_DRAW[flat] * power[: len(flat)])
    found = (total[end - 1] - total[begin - 1]) * inverse[begin]
    found = (found ^ (found >> np.uint64(32)) ^ (end - begin).astype(np.uint64)) * _MIX
    after = np.cumsum([len(t) + 1 for t in texts])  # the blank behind each text
    return found ^ (found >> np.uint64(29)), np.diff(np.searchsorted(begin, after), prepend=0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: eight steps up, then Stirling's series."""
    up = x + 8
    step = np.ones_like(x)
    for k in range(8):
        step = step * (x + k)
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - np.log(step)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a sequence with so many zeros and ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def mixed(block: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate) from its estimate and its children."""
    log = np.logaddexp(block, below) + HALF
    return log, np.exp(block + HALF - log)


class Subtrees:
    """Levels from ``depth`` up to ``top`` of all contexts whose grams are given."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int):
        symbol = grams & np.uint64(0xFF)
        context = grams >> np.uint64(8)
        nodes, bits = [], []
        for j in range(8):
            nodes.append((context << np.uint64(8)) | np.uint64(1 << j) | (symbol >> np.uint64(8 - j)))
            bits.append((symbol >> np.uint64(7 - j)) & np.uint64(1))
        key, at = np.unique(np.concatenate(nodes), return_inverse=True)
        self.bits = np.concatenate(bits).astype(np.int64)
        self.at = at
        weight = np.tile(counts.astype(float), 8)
        n1 = np.bincount(at, weights=weight * self.bits, minlength=len(key))
        n0 = np.bincount(at, weights=weight, minlength=len(key)) - n1
        block = kt_block(n0, n1)
        # per level: node keys, counts, own weight, and the place of each node's parent one level up
        self.levels = [(key, n0, n1, np.ones(len(key)))]
        self.parents: list[np.ndarray] = []
        log = block
        for _ in range(depth - top):
            shorter = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))
            key, up = np.unique(shorter, return_inverse=True)
            n0, n1, below = (np.bincount(up, weights=x, minlength=len(key)) for x in (n0, n1, log))
            log, own = mixed(kt_block(n0, n1), below)
            self.parents.append(up)
            self.levels.append((key, n0, n1, own))
        self.log = log

    def gram_log10(self, above: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte, given what the levels above add to each top node.

        ``above``: probability of a one from the levels above; ``rest``: weight left for this one and below.
        """
        for level in range(len(self.levels) - 1, -1, -1):
            _, n0, n1, own = self.levels[level]
            above = above + rest * own * (n1 + 0.5) / (n0 + n1 + 1)
            rest = rest * (1 - own)
            if level:
                above, rest = above[self.parents[level - 1]], rest[self.parents[level - 1]]
        one = above[self.at]
        part = np.log10(np.where(self.bits == 1, one, 1 - one))
        return part.reshape(8, -1).sum(axis=0)


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, bucket, text), stored: rows of a block lie together and have bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            block = np.zeros(batch.num_rows, np.int64)
            for i, size in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
                if held and held + (size or 0) > block_bytes:
                    number, held = number + 1, 0
                held += size or 0
                block[i] = number
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    schema = "block bigint, doc_id {}, bucket bigint, text string".format(docs.schema["doc_id"].dataType.simpleString())
    return stored(docs.select("doc_id", "bucket", "text").mapInArrow(run, schema), "blocks", compression="zstd")


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "replace").lower() for t in column.to_pylist()]


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    code, distinct = pd.factorize(keys)
    return distinct, np.bincount(code, weights=counts, minlength=len(distinct)).astype(np.int64)


def block_counts(blocks: DataFrame, depth: int, held: int) -> DataFrame:
    """(block, kind, key, n): words and grams that occur in each block, and how often in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, ends, grams = -1, [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            if block < 0:
                return
            found = [(LAST, np.zeros(1, np.int64), np.array([ends]))]
            for kind, parts in ((WORD, words), (GRAM, grams)):
                if parts:
                    keys, n = _folded(parts)
                    found.append((kind, keys.view(np.int64), n))
            for kind, keys, n in found:
                order = np.argsort(keys)  # neighbours share their high bytes, which packs well
                keys, n = keys[order], n[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)],
                    ["block", "kind", "key", "n"],
                )

        for batch in batches:
            number = batch.column("block").to_numpy()
            learned = batch.column("bucket").to_numpy() != held
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
            cuts = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if number[a] != block:
                    yield from flush()
                    block, words, ends, grams = int(number[a]), [], 0, []
                for c, d in spans_of(sizes[a:b], BYTES_AT_ONCE):
                    own, use = _texts(batch.column("text").slice(a + c, d - c)), learned[a + c : a + d]
                    ends += int(use.sum())
                    for parts, (keys, size) in ((words, word_hashes(own)), (grams, grams_of(own, depth))):
                        parts.append(_folded([(keys, np.repeat(use, size).astype(float))]))
                if len(grams) > 16:
                    words, grams = [_folded(words)], [_folded(grams)]
        yield from flush()

    return blocks.select("block", "bucket", "text").mapInArrow(run, "block bigint, kind int, key bigint, n bigint")


def _top_context(depth: int, top: int) -> str:
    return f"shiftrightunsigned(gram, {8 * (depth + 1 - top)})"


def _upper_levels(nodes: DataFrame, top: int) -> DataFrame:
    """(context, node, above, rest) of the nodes of level ``top``: what levels 0 to ``top`` - 1 add.

    ``nodes``: (context, node, n0, n1, log) of level ``top``.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n0, n1, below = (batch.column(c).to_numpy() for c in ("n0", "n1", "log"))
            log, own = mixed(kt_block(n0, n1), below)
            yield pa.RecordBatch.from_arrays(
                [batch.column("context"), batch.column("node"), batch.column("n0"), batch.column("n1"), pa.array(log), pa.array(own)],
                ["context", "node", "n0", "n1", "log", "own"],
            )

    levels, at = [], nodes
    for _ in range(top):
        shorter = at.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log")
        )
        at = stored(shorter.mapInArrow(weigh, "context bigint, node int, n0 double, n1 double, log double, own double"), "levels")
        levels.append(at)
    state = None
    for level in [*reversed(levels), nodes.withColumn("own", F.lit(0.0))]:
        own = level.withColumn("p", (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1))
        if state is None:
            own = own.withColumns({"above": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            parent = state.select(F.col("context").alias("_c"), F.col("node").alias("_n"), "above", "rest")
            own = own.join(parent, (F.shiftright("context", 8) == F.col("_c")) & (F.col("node") == F.col("_n")))
        state = stored(own.select(
            "context", "node", (F.col("above") + F.col("rest") * F.col("own") * F.col("p")).alias("above"),
            (F.col("rest") * (1 - F.col("own"))).alias("rest")), "states")
    return state


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10_p) of every gram (gram, n): the tree's probability of its byte in its context.

    Grams that no training text has are nodes with counts 0, as the tree defines them. Subtrees
    of one short context meet in one partition; the partitions grow in number with the grams.
    """
    spark = grams.sparkSession
    top = min(SPLIT_LEVEL, depth)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams.count() // PART_GRAMS + 1)
    context = F.expr(_top_context(depth, top))

    def subtrees(table: pa.Table) -> tuple[Subtrees, np.ndarray]:
        keys = table.column("gram").to_numpy().view(np.uint64)
        return Subtrees(keys, table.column("n").to_numpy(), depth, top), keys

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(r.num_rows for r in rows):
            return
        tree, _ = subtrees(pa.Table.from_batches(rows))
        key, n0, n1, _ = tree.levels[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array((key >> np.uint64(8)).astype(np.int64)), pa.array((key & np.uint64(0xFF)).astype(np.int32)), pa.array(n0), pa.array(n1), pa.array(tree.log)],
            ["context", "node", "n0", "n1", "log"],
        )

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(r.num_rows for r in rows):
            return
        whole = pa.Table.from_batches(rows)
        own = whole.filter(pa.compute.is_valid(whole.column("gram")))
        tree, keys = subtrees(own)
        states = whole.filter(pa.compute.is_null(whole.column("gram")))
        node = (states.column("context").to_numpy().astype(np.uint64) << np.uint64(8)) | states.column("node").to_numpy().astype(np.uint64)
        order = np.argsort(node)  # the same nodes as the top level has, which is sorted
        found = tree.gram_log10(states.column("above").to_numpy()[order], states.column("rest").to_numpy()[order])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(found)], ["gram", "log10_p"])

    spread = grams.withColumn("context", context).repartition(parts, "context")
    nodes = stored(spread.select("gram", "n").mapInArrow(up, "context bigint, node int, n0 double, n1 double, log double"), "nodes")
    state = _upper_levels(nodes, top)
    null = lambda t, name: F.lit(None).cast(t).alias(name)
    both = grams.select("gram", "n", context.alias("context"), null("int", "node"), null("double", "above"), null("double", "rest")).union(
        state.select(null("bigint", "gram"), null("bigint", "n"), "context", "node", "above", "rest")
    )
    return both.repartition(parts, "context").mapInArrow(down, "gram bigint, log10_p double")


class Lookup:
    """Values by 64-bit key: a table of hashed places, and a sorted search where two keys share one.

    Keys that are not there take the value given for them.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(np.ceil(np.log2(4 * len(keys) + 1)))))
        self.place = np.zeros(1 << int(64 - self.shift), np.int32)  # keys of one block, so few enough
        self.place[self._hash(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys)) if other is None else other
        at = self.place[self._hash(keys)]
        off = np.flatnonzero(self.keys[at] != keys)
        at[off] = np.minimum(np.searchsorted(self.keys, keys[off]), len(self.keys) - 1)
        found = self.values[at]
        if other is not None:
            lost = off[self.keys[at[off]] != keys[off]]
            found[lost] = other[lost]
        return found


def score_texts(docs: DataFrame, parts: int = 10, held: int = 0, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every text.

    Learned from the rows whose crc32(doc_id) mod ``parts`` is not ``held``. ``score`` is the
    log10 probability of the text's bytes, A-Z in lower case, and of its end. ``base_score`` is that
    of its words and end by their smoothed counts. A null text is empty: one token, its end. Without
    training rows every bit has probability one half. Equal rows are scored alike.
    """
    rows = pick(docs, "doc_id", "text").withColumn("bucket", id_bucket(F.col("doc_id"), parts).cast("long"))
    blocks = in_blocks(rows)
    counts = stored(block_counts(blocks, depth, held), "block-counts", compression="zstd")
    # a word has one row per block, so its window is no larger than the number of blocks
    same = W.partitionBy("kind", "key")
    totals = stored(
        counts.filter(f"kind <> {GRAM}").withColumns({
            "total": F.sum("n").over(same), "first": F.row_number().over(same.orderBy("block")) == 1
        }), "words", compression="zstd")
    train, words = totals.agg(F.sum("n"), F.count_if(F.col("first") & (F.col("total") > 0))).first()
    train, words = train or 0, words or 0
    with Temporary(rows.sparkSession) as made:  # the tree's levels are not read again once every gram has its value
        grams = stored(
            counts.filter(f"kind = {GRAM}").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "grams"
        )
        values = made.keep(gram_scores(grams, depth), "values")
    scored = counts.filter(f"kind = {GRAM}").select("block", "kind", "key").join(values, F.col("key") == F.col("gram"))
    # a block knows by itself what occurs nowhere else; of words it gets only totals that differ from its own
    needed = scored.select("block", "kind", "key", F.col("log10_p").alias("value")).union(
        totals.filter(f"total <> n or kind = {LAST}").select("block", "kind", "key", F.col("total").cast("double"))
    )

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        kind, value = table.column("kind").to_numpy(), table.column("value").to_numpy()
        key = table.column("key").to_numpy().view(np.uint64)
        count = Lookup(key[kind == WORD], value[kind == WORD])
        gram = Lookup(key[kind == GRAM], value[kind == GRAM])
        end = float(value[kind == LAST][0])
        room = train + 0.1 * (words + 1)
        raw = _texts(texts.column("text"))
        learned = texts.column("bucket").to_numpy() != held
        spans = spans_of([len(t) for t in raw], BYTES_AT_ONCE)
        words_in, parts = [], []
        for a, b in spans:
            words_in.append(word_hashes(raw[a:b]))
            parts.append(_folded([(words_in[-1][0], np.repeat(learned[a:b], words_in[-1][1]).astype(float))]))
        distinct, own = _folded(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0))
        occurs = Lookup(distinct, count(distinct, own.astype(float)))
        del parts, distinct, own, count
        out: list[np.ndarray] = []
        for (a, b), (hashes, size) in zip(spans, words_in):
            c = occurs(hashes)
            owner = np.repeat(np.arange(b - a), size)
            base = np.bincount(owner, weights=np.log10((c + 0.1) / room), minlength=b - a) + np.log10((end + 0.1) / room)
            known = np.bincount(owner, weights=(c > 0).astype(float), minlength=b - a) + (end > 0)
            keys, length = grams_of(raw[a:b], depth)
            log10 = np.bincount(np.repeat(np.arange(b - a), length), weights=gram(keys), minlength=b - a)
            out.append(np.stack([size + 1, known, base, log10, -log10 * np.log2(10) / length]))
        found = np.concatenate(out, axis=1) if out else np.zeros((5, 0))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.compute.equal(texts.column("bucket"), held),
            "n_tokens": pa.array(found[0].astype(np.int64)), "n_known": pa.array(found[1].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(raw), train, np.int64)), "base_score": pa.array(found[2]),
            "score": pa.array(found[3]), "bits_per_byte": pa.array(found[4]),
        })

    schema = "doc_id {}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        score, schema.format(rows.schema["doc_id"].dataType.simpleString())
    )
