"""Quality rules from tokeniser fertility: how public vocabularies cut a text."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SYMBOLS, Guarded, extended, pick, stored

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SPACE = " \t\n\x0b\x0c\r"
# words whose tokens a Python worker remembers; beyond it the memory starts anew
REMEMBERED = 400_000
# at so many usable documents a language or script counts its own band widths and those of all groups alike
STEADY_DOCS = 50
# how many half-widths (median to a quartile) a measure may lie off its median
REACH = 8.0
# a band is at least this share of the median wide on each side
LEAST_WIDTH = 0.07
# measures of texts with fewer tokens than this scatter more; their bands widen by the root of the ratio
STEADY_TOKENS = 400

METRICS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("n_tokens", "bigint"),
    ("chars_per_token", "double"), ("byte_chars_per_token", "double"), ("fallback_share", "double"),
    ("token_entropy", "double"), ("script", "string"),
]
VERDICT = ("band_group", "kept")

# first and last code point of scripts that have no language column to go by
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]


class WordTokens:
    """Token ids of words by the piece model, and token counts by the byte vocabulary, remembered per word."""

    def __init__(self, pieces: str, ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        pieces_text = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.opens = np.array([p.startswith("\u2581") for p in pieces_text])
        self.widths = np.zeros(max(table.values()) + 1, np.int64)
        self.widths[list(table.values())] = [len(t) for t in table]
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.start, self.size, self.byte_size = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, words: list[bytes]) -> None:
        """Encode new words joined by spaces: no piece of either vocabulary reaches over a space into a word."""
        texts = [w.decode("utf-8", "replace").replace("\u2581", "\u2582") for w in words]
        ids = np.array(self.pieces.encode(" ".join(texts)), dtype=np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(words):  # a word with a space of its own in the model's sense
            parts = [self.pieces.encode(t) for t in texts]
            ids = np.array([i for p in parts for i in p], dtype=np.int32)
            first = np.cumsum([0, *map(len, parts)])[:-1]
        width = self.widths[np.array(self.bytes.encode_ordinary(" " + " ".join(texts)), dtype=np.int64)]
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        byte_tokens = np.diff(np.searchsorted(np.cumsum(width), ends, side="left") + 1, prepend=0)
        n, room = len(self.at), len(self.at) + len(words)
        if room > len(self.start):
            self.start, self.size, self.byte_size = (
                np.concatenate([a, np.zeros(room, np.int64)]) for a in (self.start, self.size, self.byte_size)
            )
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[n:room] = self.used + first
        self.size[n:room] = np.diff(first, append=len(ids))
        self.byte_size[n:room] = byte_tokens
        self.used += len(ids)
        self.at.update(zip(words, range(n, room)))

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.at.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            if len(self.at) > REMEMBERED:
                self.clear()
                get, found = self.at.get, [-1] * len(words)
            self.learn(list(dict.fromkeys(w for w, i in zip(words, found) if i < 0)))
            found = [get(w) for w in words]
        return np.array(found, dtype=np.int64)


def repeated_words(index: np.ndarray) -> int:
    """Words in some window of five that occurs twice or more.

    Equal windows have equal hashes, so texts without equal hashes are done at once; for the
    others the windows are compared by rank, which is exact.
    """
    n = len(index)
    if n < 6:
        return 0
    mixed = index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    window = mixed[: n - 4].copy()
    for k in range(1, 5):
        window = window * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - 4 + k]
    window.sort()
    if not (window[1:] == window[:-1]).any():
        return 0
    rank = np.unique(index, return_inverse=True)[1].astype(np.int64)
    two = np.unique(rank[:-1] * n + rank[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:-1] * n + rank[4:], return_inverse=True, return_counts=True)
    marks = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(count[five] > 1)
    marks[hit] += 1
    marks[hit + 5] -= 1
    return int((np.cumsum(marks[:n]) > 0).sum())


def main_script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    best = max(((int(((points >= a) & (points <= b)).sum()), name) for name, a, b in SCRIPTS), key=lambda x: x[0])
    return best[1] if best[0] else "none"


def measure(text: str | None, lang: str | None, tokens: WordTokens) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    script = main_script(text) if lang is None else None
    if not n:
        return (0, word_chars, symbols, dup_lines, 0, True, 0, None, None, None, None, script)
    index = tokens.of(words)
    repeats = repeated_words(index)
    size = tokens.size[index]
    total = int(size.sum())
    offset = np.repeat(tokens.start[index] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    ids = tokens.ids[offset + np.arange(total)]
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total) if total else 0.0
    failed = n < 10 or 100 * repeats > 20 * n
    return (
        n, word_chars, symbols, dup_lines, repeats, failed, total,
        word_chars / max(1, total), word_chars / max(1, int(tokens.byte_size[index].sum())),
        float(tokens.fallback[ids].mean()) if total else 0.0, entropy, script,
    )


def fertility_metrics(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """``docs`` with METRICS behind its columns; needs text and lang."""
    schema = extended(docs, METRICS)
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or WordTokens(pieces, ranks)
            text, lang = batch.column("text"), batch.column("lang")
            rows = [measure(text[i].as_py(), lang[i].as_py(), tokens) for i in range(batch.num_rows)]
            found = [pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(METRICS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *[n for n, _ in METRICS]])

    return docs.mapInArrow(run, schema)


MEASURES = ("chars_per_token", "byte_chars_per_token", "entropy_ratio", "fallback_share")


def fertility_bands(measured: DataFrame) -> DataFrame:
    """Per language or script the accepted range of each measure, around its own median. One row per group.

    Taken from all documents that pass the base rules: the distance of the median to its
    quartiles, shrunk by the root of the group's size towards what such distances are in all
    groups on average (as shares of their medians), stretched by REACH, at least LEAST_WIDTH of the median.
    """
    usable = measured.filter("not base_failed")
    quartiles = "percentile_approx({0}, array(0.25, 0.5, 0.75), 1000)"
    per = usable.groupBy("band_group").agg(
        F.count(F.lit(1)).alias("docs"), *[F.expr(quartiles.format(m)).alias(m) for m in MEASURES]
    )
    spread = {}
    for m in MEASURES:
        low, mid, high = (F.element_at(m, i) for i in (1, 2, 3))
        scale = F.lit(1.0) if m == "fallback_share" else mid
        spread |= {f"{m}_scale": scale, f"{m}_below": (mid - low) / scale, f"{m}_above": (high - mid) / scale}
    per = per.withColumns(spread)
    sides = [f"{m}_{side}" for m in MEASURES for side in ("below", "above")]
    usual = per.agg(*[(F.sum(F.col(s) * F.col("docs")) / F.sum("docs")).alias(f"usual_{s}") for s in sides])
    own = F.sqrt("docs") / (F.sqrt("docs") + STEADY_DOCS**0.5)
    out = [F.col("band_group").alias("_group")]
    for m in MEASURES:
        mid, scale = F.element_at(m, 2), F.col(f"{m}_scale")
        least = F.lit(0.02) if m == "fallback_share" else mid * LEAST_WIDTH
        width = lambda s: F.greatest(REACH * scale * (own * F.col(s) + (1 - own) * F.col(f"usual_{s}")), least)
        out.append(F.struct(mid.alias("mid"), width(f"{m}_below").alias("below"), width(f"{m}_above").alias("above")).alias(f"{m}_band"))
    return per.join(F.broadcast(usual)).select(*out)  # the broadcast is one row


def _judged(docs: DataFrame, pieces: str, ranks: str) -> DataFrame:
    measured = stored(fertility_metrics(docs, pieces, ranks), "fertility").withColumns({
        "band_group": F.coalesce(F.col("lang"), F.concat(F.lit("script:"), F.col("script"))),
        # token entropy against the most that so many tokens can have
        "entropy_ratio": F.col("token_entropy") / F.greatest(F.log2(F.col("n_tokens").cast("double")), F.lit(1.0)),
    })
    bands = stored(fertility_bands(measured), "bands")
    scatter = F.sqrt(F.greatest(F.lit(1.0), STEADY_TOKENS / F.greatest(F.col("n_tokens"), F.lit(1))))
    inside = F.lit(True)
    for m in MEASURES:
        off, band = F.col(m) - F.col(f"{m}_band.mid"), f"{m}_band"
        fits = (off >= -F.col(f"{band}.below") * scatter) & (off <= F.col(f"{band}.above") * scatter)
        inside = inside & F.coalesce(fits, F.lit(True))
    joined = measured.join(bands, F.col("band_group") == F.col("_group"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def quality_metrics(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """(doc_id, METRICS, band_group, kept) of every document.

    ``base_failed``: under 10 words, or over 20% of the words in repeated five-word windows.
    ``kept``: not so, and characters per token of two vocabularies, byte-fallback share and token
    entropy lie in the bands of the document's language, or script where the language is null.
    A null or blank text has no words and fails. Rows are judged one by one, repeated ones alike.
    """
    judged = _judged(pick(docs, "doc_id", "lang", "text"), pieces, ranks)
    return judged.select("doc_id", *[n for n, _ in METRICS], *VERDICT)


def quality_filter(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The rows of ``docs`` that ``quality_metrics`` keeps, with their columns as they were."""
    guard = Guarded(docs, ("lang", "text"), ())
    return guard.restore(_judged(guard.work, pieces, ranks).filter("kept"))
