"""Encoding and decoding with a piece vocabulary; giant texts by a max-plus scan over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Guarded, extended, spans_of, stored

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# texts above this many characters are cut into chunks of it
CHUNK_CHARS = 32_768
# transfer matrices that are combined in one step
FAN = 64
# units (words with their spaces) whose best cut a Python worker remembers, and the longest of them
REMEMBERED = 150_000
LONGEST_UNIT = 64
CHARS_AT_ONCE = 1 << 20
TOKENS_AT_ONCE = 1 << 17
# characters of the next chunk that go along with a chunk; a piece may not be longer
CONTEXT_CHARS = 64
LOWEST = -(1 << 60)
UNIT = re.compile(" *[^ \n]+| +|\n")
ADDED = [("tokens", "array<int>"), ("score", "bigint")]


class PieceTable:
    """Pieces by a 64-bit hash of their characters that running sums give for any part of a string."""

    def __init__(self, pieces: list[str], weights: list[int], ids: list[int]):
        self.base = int(np.random.default_rng(9).integers(1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        own = []
        for p in pieces:
            codes = np.array([list(map(ord, p))], np.uint32)
            own.append(self._part(self.prefixes(codes), 0, len(p))[0])
        keys = np.array(own, np.uint64)
        if len(set(own)) != len(own):
            raise ValueError("two pieces of the vocabulary have one hash")
        order = np.argsort(keys)
        self.keys, self.weights, self.ids = keys[order], np.array(weights, np.int64)[order], np.array(ids, np.int32)[order]
        self.shift = np.uint64(64 - int(np.ceil(np.log2(8 * len(keys) + 1))))
        self.place = np.zeros(1 << int(np.uint64(64) - self.shift), np.int32)
        self.place[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
        # of pieces that share a place, all but the last are found by a sorted search
        shared = np.flatnonzero(self.place[(self.keys >> self.shift).astype(np.int64)] != np.arange(len(keys)))
        self.crowded = np.zeros(len(self.place), bool)
        self.crowded[(self.keys[shared] >> self.shift).astype(np.int64)] = True

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Running sums of a number for each character times a power for its place, one row per string."""
        drawn = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        drawn = (drawn ^ (drawn >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        drawn ^= drawn >> np.uint64(27)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, codes.shape[1] - 1), self.base, np.uint64)]))
        return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(drawn * powers[: codes.shape[1]], axis=1)], axis=1)

    def _part(self, prefixes: np.ndarray, i: int, j: int) -> np.ndarray:
        found = (prefixes[:, j] - prefixes[:, i]) * np.uint64(pow(self.inverse, i, 1 << 64))
        found = (found ^ (found >> np.uint64(32)) ^ np.uint64(j - i)) * np.uint64(0x94D049BB133111EB)
        return found ^ (found >> np.uint64(29))

    def find(self, prefixes: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight, id, whether it is a piece) of the part from ``i`` to ``j`` of every string."""
        key = self._part(prefixes, i, j)
        spot = (key >> self.shift).astype(np.int64)
        at = self.place[spot]
        there = self.keys[at] == key
        other = np.flatnonzero(~there & self.crowded[spot])
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
            there[other] = self.keys[at[other]] == key[other]
        return self.weights[at], self.ids[at], there


def grown(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` behind the first ``used``, in an array twice as large when it is full."""
    if used + len(more) > len(values):
        values = np.concatenate([values, np.zeros(max(len(values), len(more)), values.dtype)])
    values[used : used + len(more)] = more
    return values


class KnownCuts:
    """Cuts of units seen before, in arrays from which those of many units are read at once."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 14, np.int32), 0
        self.ends, self.weights = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, units: list[str], ids: np.ndarray, size: np.ndarray, weight: np.ndarray) -> None:
        """Units with their ids one after the other, the number of ids and the weight of each."""
        known = len(self.place)
        self.place.update(zip(units, range(known, known + len(units))))
        self.weights = grown(self.weights, known, weight)
        # the end of unit k is at place k + 1
        self.ends = grown(self.ends, known + 1, self.used + np.cumsum(size))
        self.ids = grown(self.ids, self.used, ids)
        self.used += len(ids)

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids, weight) of the units at the given places."""
        first = self.ends[place]
        size = self.ends[place + 1] - first
        return self.ids[runs(first, size)], size, self.weights[place]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers from each ``first`` on, ``size`` of them, one run after the other."""
    at = np.arange(int(size.sum()))
    at += np.repeat(first - (np.cumsum(size) - size), size)
    return at


class PieceBytes:
    """What each id stands for, which is all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                found.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                found.append(b"")
            else:
                found.append(model.id_to_piece(i).replace("▁", " ").encode())
        self.all_bytes = np.frombuffer(b"".join(found), np.uint8)
        self.byte_ends = np.concatenate([[0], np.cumsum([len(b) for b in found])])

    def decode_all(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts that the ids stand for, ``size`` of them for each text."""
        length = self.byte_ends[ids + 1] - self.byte_ends[ids]
        raw = self.all_bytes[runs(self.byte_ends[ids], length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(size)])].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


class Vocabulary(PieceBytes):
    """Pieces with whole-number weights, and the best cut of any string into pieces and bytes.

    The file's scores are merge ranks, not probabilities. A piece weighs a thousand times the
    logarithm of its share under Zipf's law by rank, a byte less than any piece. Whole numbers add
    up alike in any order, so a scan over chunks finds the same sums as one pass over the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        norm = np.log(np.log(len(plain)) + 0.5772)
        text = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
        self.weight = {text[i]: (round(-1000 * (np.log(rank + 1.0) + norm)), i) for rank, i in enumerate(plain)}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(count):
            if model.is_byte(i):
                self.byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
        self.byte_weight = round(-1000 * (np.log(len(plain)) + norm + 2))
        self.longest = max(map(len, text.values()))
        self.tree: dict = {}  # from character to subtree; at 0 the weight and id of the piece that ends there
        for piece, found in self.weight.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[0] = found
        if self.longest > CONTEXT_CHARS:
            raise ValueError("the vocabulary has pieces that reach beyond the context of a chunk")
        # units are cut where no piece reaches across
        self.by_units = all(re.fullmatch(" ?[^ \n]*| +", t) for t in text.values())
        self.pieces = PieceTable(list(self.weight), [w for w, _ in self.weight.values()], [i for _, i in self.weight.values()])
        self.known = KnownCuts()

    def steps(self, s: str, at: int) -> Iterator[tuple[int, int]]:
        """(length, weight) of what may begin at ``at``; a character that is no piece counts as its bytes."""
        node, n = self.tree, 0
        for c in s[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            n += 1
            if 0 in node:
                yield n, node[0][0]
        if s[at] not in self.weight:
            yield 1, self.byte_weight * len(s[at].encode())

    def best_cut(self, s: str, start: int = 0) -> tuple[list[int], int]:
        """Ids and weight of the best path from character ``start`` to the end of ``s``."""
        tree, weight, longest, stop = self.tree, self.weight, self.longest, len(s)
        score = [LOWEST] * (stop + 1)
        back = [0] * (stop + 1)
        last = [-1] * (stop + 1)  # id of the piece that ends here; -1: a character by its bytes
        score[start] = 0
        for i in range(start, stop):
            here = score[i]
            if here == LOWEST:
                continue
            node, j = tree, i
            for c in s[i : i + longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                found = node.get(0)
                if found is not None:
                    total = here + found[0]
                    if total > score[j]:
                        score[j], back[j], last[j] = total, i, found[1]
            if s[i] not in weight:
                total = here + self.byte_weight * len(s[i].encode())
                if total > score[i + 1]:
                    score[i + 1], back[i + 1], last[i + 1] = total, i, -1
        ids: list[int] = []
        i = stop
        while i > start:
            if last[i] < 0:
                ids.extend(int(self.byte_id[b]) for b in reversed(s[back[i] : i].encode()))
            else:
                ids.append(last[i])
            i = back[i]
        return ids[::-1], score[stop]

    def learn(self, units: list[str]) -> None:
        """Best cuts of units into memory: those of one length together, position by position."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u) if len(u) <= LONGEST_UNIT else 0, []).append(u)
        for length, same in sorted(by_length.items()):
            # a few strings are cut sooner one by one
            together = length and len(same) > 20 * min(length, self.longest)
            whole = self.cut_alike(same, length) if together else np.zeros(len(same), bool)
            for at in np.flatnonzero(~whole):
                ids, total = self.best_cut(same[at])
                self.known.add([same[at]], np.array(ids, np.int32), np.array([len(ids)]), np.array([total]))

    def cut_alike(self, units: list[str], length: int) -> np.ndarray:
        """Learn the best cuts of strings of one length; false for those with a character that is no piece."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), length)
        hashes = self.pieces.prefixes(codes)
        n = len(units)
        score = np.full((n, length + 1), LOWEST, np.int64)
        back, last = np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int32)
        whole = np.ones(n, bool)
        score[:, 0] = 0
        for i in range(length):
            for j in range(i + 1, min(length, i + self.longest) + 1):
                weight, ids, there = self.pieces.find(hashes, i, j)
                if j == i + 1:
                    whole &= there
                total = score[:, i] + weight
                better = there & (total > score[:, j])
                score[better, j], back[better, j], last[better, j] = total[better], i, ids[better]
        rows, at = np.flatnonzero(whole), np.full(int(whole.sum()), length)
        steps = np.zeros((len(rows), length), np.int32)  # ids, the last one in the last column
        count = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            end = at[open_]
            steps[open_, length - 1 - count[open_]] = last[rows[open_], end]
            count[open_] += 1
            at[open_] = back[rows[open_], end]
            open_ = open_[at[open_] > 0]
        ids = steps[np.arange(length)[None, :] >= (length - count)[:, None]]
        self.known.add([units[r] for r in rows.tolist()], ids, count, score[rows, length])
        return whole

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each, weight of each).

        Units are independent of each other; each distinct one is cut once.
        """
        units = [UNIT.findall(s) if self.by_units else [s] for s in texts]
        flat = [u for part in units for u in part]
        distinct = dict.fromkeys(flat)
        if len(self.known.place) + len(distinct) > REMEMBERED:
            self.known = KnownCuts()
        self.learn([u for u in distinct if u not in self.known.place])
        place = np.fromiter(map(self.known.place.__getitem__, flat), np.int64, len(flat))
        ids, size, weight = self.known.gather(place)
        ends = np.cumsum([0] + [len(part) for part in units])
        per_text = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends])
        return ids, per_text(size), per_text(weight)

    def encode(self, s: str) -> tuple[list[int], int]:
        """Best cut of ``s`` (with its leading space)."""
        ids, _, weight = self.encode_all([s])
        return ids.tolist(), int(weight[0])

    def transfer(self, s: str, size: int) -> np.ndarray:
        """Best weight from each entry state to each exit state of a chunk.

        A state is the number of characters that a piece begun before a boundary takes behind it.
        ``s`` is the chunk's ``size`` characters and, behind them, as many of the next chunk as a
        piece can reach into.
        """
        k = self.longest
        best = np.full((len(s) + k + 1, k), LOWEST, np.int64)
        for a in range(k):
            if a <= size:
                best[a, a] = 0
        for i in range(size):
            here = best[i]
            if here.max() == LOWEST:
                continue
            open_ = here > LOWEST
            for n, w in self.steps(s, i):
                np.maximum(best[i + n], np.where(open_, here + w, LOWEST), out=best[i + n])
        return np.stack([best[size + b] if size + b <= len(s) else np.full(k, LOWEST) for b in range(k)], axis=1)

    def chunk_transfers(self, chunks: list[str], sizes: list[int]) -> list[np.ndarray]:
        """As ``transfer`` of each chunk; what lies between its first and last unit boundary is one sum."""
        ends: list[tuple[int, int] | None] = []
        for s, size in zip(chunks, sizes):
            bounds = [m.start() for m in UNIT.finditer(s[:size])] if self.by_units else []
            # a boundary is sure only if the character before it is known, which the first one's is not
            bounds = [b for b in bounds if b > 0]
            ends.append((bounds[0], bounds[-1]) if len(bounds) > 1 else None)
        middles = self.encode_all([s[e[0] : e[1]] if e else "" for s, e in zip(chunks, ends)])[2]
        return [
            self._joined(s, size, e, int(m)) if e else self.transfer(s, size) for s, size, e, m in zip(chunks, sizes, ends, middles)
        ]

    def _joined(self, s: str, size: int, ends: tuple[int, int], middle: int) -> np.ndarray:
        into = self.transfer(s[: ends[0]], ends[0])[:, 0]
        out = self.transfer(s[ends[1] :], size - ends[1])[0]
        whole = into[:, None] + middle + out[None, :]
        return np.where((into[:, None] <= LOWEST) | (out[None, :] <= LOWEST), LOWEST, whole)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    out = np.full((a.shape[0], b.shape[1]), LOWEST, np.int64)
    for k in range(a.shape[1]):
        open_ = (a[:, k][:, None] > LOWEST) & (b[k][None, :] > LOWEST)
        np.maximum(out, np.where(open_, a[:, k][:, None] + b[k][None, :], LOWEST), out=out)
    return out


def chained(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at all boundaries of a chain, ends included, on the best way through it."""
    reach = [np.where(np.arange(matrices[0].shape[0]) == enter, 0, LOWEST)[None, :]]
    for m in matrices:
        reach.append(combined(reach[-1], m))
    states = [leave]
    for m, before in zip(reversed(matrices), reversed(reach[:-1])):
        through = np.where((before[0] > LOWEST) & (m[:, states[-1]] > LOWEST), before[0] + m[:, states[-1]], LOWEST)
        states.append(int(through.argmax()))
    return states[::-1]


def _matrix(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.int64)
    side = int(round(len(flat) ** 0.5))
    return flat.reshape(side, side)


def _encode_short(rows: DataFrame, path: str) -> DataFrame:
    names = [c for c in rows.columns]
    schema = extended(rows, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path)
            for a, b in spans_of(pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_pylist(), CHARS_AT_ONCE):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                flat, size, weight = vocabulary.encode_all([" " + t if t else "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                added = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + added, [*names, "tokens", "score"])

    return rows.mapInArrow(run, schema)


def _cut(rows: DataFrame, chunk: int, reach: int) -> DataFrame:
    """(row, part, piece, size): chunks of ``chunk`` characters with ``reach`` more for context.

    Each text is walked through once, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                whole = " " + text.as_py()
                for first in range(0, len(whole), FAN * chunk):
                    starts = range(first, min(first + FAN * chunk, len(whole)), chunk)
                    pieces = [whole[at : at + chunk + reach] for at in starts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(starts), pa.int64()), pa.array([at // chunk for at in starts], pa.int64()),
                            pa.array(pieces, pa.string()), pa.array([min(len(p), chunk) for p in pieces], pa.int32()),
                        ],
                        ["row", "part", "piece", "size"],
                    )

    return rows.select("row", "text").mapInArrow(run, "row bigint, part bigint, piece string, size int")


def _transfers(chunks: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path)
            for a, b in spans_of(batch.column("size").to_pylist(), CHARS_AT_ONCE):
                part = batch.slice(a, b - a)
                found = vocabulary.chunk_transfers(part.column("piece").to_pylist(), part.column("size").to_pylist())
                raw = pa.array([m.tobytes() for m in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("part"), raw], ["row", "part", "matrix"])

    return chunks.mapInArrow(run, "row bigint, part bigint, matrix binary")


def _products(level: DataFrame) -> DataFrame:
    """One level up: of each ``FAN`` neighbouring parts the product of their matrices, in order."""

    def multiply(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy())
        raw = group.column("matrix").to_pylist()
        out = _matrix(raw[order[0]])
        for i in order[1:]:
            out = combined(out, _matrix(raw[i]))
        return pa.table({"row": group.column("row")[:1], "part": pa.array([group.column("up")[0].as_py()], pa.int64()), "matrix": pa.array([out.tobytes()], pa.binary())})

    up = level.withColumn("up", F.floor(F.col("part") / FAN).cast("long"))
    return up.groupBy("row", "up").applyInArrow(multiply, "row bigint, part bigint, matrix binary")


def _states(level: DataFrame, above: DataFrame) -> DataFrame:
    """One level down: entry and exit state of each part from those of the product it went into."""

    def spread(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy())
        raw = group.column("matrix").to_pylist()
        found = chained([_matrix(raw[i]) for i in order], group.column("enter")[0].as_py(), group.column("leave")[0].as_py())
        parts = group.column("part").to_numpy()[order]
        return pa.table({
            "row": pa.array([group.column("row")[0].as_py()] * len(parts), pa.int64()), "part": pa.array(parts, pa.int64()),
            "enter": pa.array(found[:-1], pa.int64()), "leave": pa.array(found[1:], pa.int64()),
        })

    up = level.withColumn("up", F.floor(F.col("part") / FAN).cast("long"))
    over = above.select(F.col("row").alias("_r"), F.col("part").alias("_p"), "enter", "leave")
    joined = up.join(over, (F.col("row") == F.col("_r")) & (F.col("up") == F.col("_p")))
    return joined.groupBy("row", "up").applyInArrow(spread, "row bigint, part bigint, enter bigint, leave bigint")


def _backtraced(chunks: DataFrame, path: str) -> DataFrame:
    """Tokens of each chunk between its two known states; chunks need nothing of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path)
            for a, b in spans_of(batch.column("size").to_pylist(), CHARS_AT_ONCE):
                part = batch.slice(a, b - a)
                cells = [part.column(n).to_pylist() for n in ("piece", "size", "enter", "leave")]
                found = chunk_tokens(vocabulary, [p[: n + leave] for p, n, _, leave in zip(*cells)], cells[2])
                tokens = pa.array([f[0] for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("part"), tokens, pa.array([f[1] for f in found], pa.int64())], ["row", "part", "tokens", "score"]
                )

    return chunks.mapInArrow(run, "row bigint, part bigint, tokens array<int>, score bigint")


def chunk_tokens(vocabulary: Vocabulary, chunks: list[str], enter: list[int]) -> list[tuple[np.ndarray, int]]:
    """Best cut of each chunk behind its first ``enter`` characters, unit by unit where units begin."""
    heads, rests = [], []
    for s, at in zip(chunks, enter):
        bounds = (m.start() for m in UNIT.finditer(s) if 0 < m.start() >= at) if vocabulary.by_units else iter(())
        first = next(bounds, len(s))
        heads.append(vocabulary.best_cut(s[:first], at))
        rests.append(s[first:])
    ids, size, weight = vocabulary.encode_all(rests)
    ends = np.cumsum(size)
    return [
        (np.concatenate([np.array(head, np.int32), ids[e - n : e]]), total + int(w))
        for (head, total), e, n, w in zip(heads, ends, size, weight)
    ]


def encode_pieces(docs: DataFrame, path: str = PIECES, chunk: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with ``tokens``, the ids of the best cut of the whole text, and ``score``, its weight.

    A space is put before a text that is not empty. Null and empty texts have no tokens. Texts of
    up to ``chunk`` characters are cut as they are. Longer ones become chunks: each yields a matrix
    of best weights between boundary states, the matrices are multiplied up a tree of ``FAN``
    branches, states come down the same tree, and each chunk is backtraced by itself. Any text
    length gives the best weight of one pass; of equally good cuts either may be returned. Rows
    are independent, equal rows get equal tokens; columns of the added names are replaced.
    """
    guard = Guarded(docs, ("text",), [n for n, _ in ADDED])
    short = guard.restore(_encode_short(guard.work.filter(f"text is null or length(text) < {chunk}"), path), "tokens", "score")
    long_ = stored(guard.work.filter(f"length(text) >= {chunk}").withColumn("row", F.monotonically_increasing_id()), "giants")
    chunks = stored(_cut(long_, chunk, CONTEXT_CHARS).repartition("row", "part"), "chunks")
    levels = [stored(_transfers(chunks, path), "transfers")]
    most = chunks.agg(F.max("part")).first()[0] or 0
    while most > 0:
        levels.append(stored(_products(levels[-1]), "transfers"))
        most //= FAN
    states = levels[-1].select("row", "part", F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("leave"))
    for level in reversed(levels[:-1]):
        states = stored(_states(level, states), "states")
    known = states.select(F.col("row").alias("_r"), F.col("part").alias("_p"), "enter", "leave")
    traced = _backtraced(chunks.join(known, (F.col("row") == F.col("_r")) & (F.col("part") == F.col("_p"))).select(
        "row", "part", "piece", "size", "enter", "leave"), path)
    ordered = F.array_sort(F.collect_list(F.struct("part", "tokens")))
    joined = traced.groupBy(F.col("row").alias("_r")).agg(
        F.flatten(F.transform(ordered, lambda x: x["tokens"])).alias("tokens"), F.sum("score").alias("score")
    )
    giants = guard.restore(long_.join(joined, F.col("row") == F.col("_r")), "tokens", "score")
    return short.unionByName(giants) if len(set(short.columns)) == len(short.columns) else short.union(giants)


def decode_pieces(rows: DataFrame, path: str = PIECES) -> DataFrame:
    """``rows`` with ``decoded``, the text that the ids in ``tokens`` stand for; null stays null."""
    schema = extended(rows, [("decoded", "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or PieceBytes(path)
            lists = batch.column("tokens")
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts: list[str | None] = []
            for a, b in spans_of(size.tolist(), TOKENS_AT_ONCE):
                part = lists.slice(a, b - a)
                found = vocabulary.decode_all(part.flatten().to_numpy(zero_copy_only=False), size[a:b])
                texts += [t if there else None for t, there in zip(found, part.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
