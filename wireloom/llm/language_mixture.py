"""Language proportions of each document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, id_bucket, pick, spans_of

# letter trigrams are hashed to so many columns; the model has this many numbers per language
COLUMNS = 1 << 16
SMOOTHING = 0.5
# log-likelihood that another language must add, per log of the number of words
PENALTY = 3.0
ROUNDS = 12
CHARS_AT_ONCE = 1 << 20
ADDED = [("lang_pred", "string"), ("score", "double"), ("languages", "array<struct<lang:string,share:double>>"), ("n_words", "bigint")]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> list[str]:
    """A long text in parts of bounded size, cut behind a space where there is one."""
    out, at = [], 0
    while len(text) - at > CHARS_AT_ONCE:
        end = text.rfind(" ", at, at + CHARS_AT_ONCE) + 1 or at + CHARS_AT_ONCE
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigram of every letter, first trigram of every word, text of every word).

    A word is a run of letters; a letter's trigram has its neighbours, or nothing at a word's end.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    point = np.where(_letters()[point], point, 0).astype(np.uint64)
    at = np.flatnonzero(point)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    mixed = point[at - 1] * np.uint64(0x9E3779B97F4A7C15) + point[at] * np.uint64(0xC2B2AE3D27D4EB4F) + point[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(31)
    column = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64) % COLUMNS
    first = np.flatnonzero(point[at - 1] == 0)
    begins = np.cumsum([1, *[len(t) + 1 for t in lowered[:-1]]])
    owner = np.searchsorted(begins, at[first], side="right") - 1
    return column, first, owner


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, col, n): how often each hashed trigram occurs in the texts of each language; every text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs = batch.column("lang").to_pylist()
            for a, b in spans_of([len(t) for t in texts], CHARS_AT_ONCE):
                by_lang: dict[str, list[str]] = {}
                for text, lang in zip(texts[a:b], langs[a:b]):
                    by_lang.setdefault(lang, []).extend(_pieces(text))
                for lang, parts in by_lang.items():
                    held = counts.setdefault(lang, np.zeros(COLUMNS, np.int64))
                    for c, d in spans_of([len(t) for t in parts], CHARS_AT_ONCE):
                        held += np.bincount(trigrams(parts[c:d])[0], minlength=COLUMNS)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "col", "n"]
            )

    parts = docs.mapInArrow(run, "lang string, col int, n bigint")
    return parts.groupBy("lang", "col").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each trigram column in each); languages by name.

    The driver gets the counts only: COLUMNS numbers per language at most, whatever the corpus.
    """
    counts = trigram_counts(pick(docs, "lang", "text").filter("lang is not null")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((COLUMNS, len(langs)), SMOOTHING)
    row = {lang: i for i, lang in enumerate(langs)}
    at = np.array([row[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    table[counts.column("col").to_numpy(), at] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text over its allowed languages, all texts at once."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    owner = np.repeat(np.arange(len(size)), size)
    for _ in range(ROUNDS):
        part = like * share[owner]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, first, axis=0) / size[:, None]
    total = np.log(np.maximum((like * share[owner]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, first)


def proportions(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Language shares of texts with ``size`` words each; ``words`` has a log-likelihood per language.

    The set starts with the best single language. The next by share in the full mixture joins as
    long as it adds more log-likelihood than the penalty; texts whose full mixture adds less than
    that to one language need no further trial.
    """
    n, k = len(size), words.shape[1]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    top = words.max(axis=1, keepdims=True)
    like = np.exp((words - top).astype(np.float64))
    offset = np.add.reduceat(top[:, 0].astype(np.float64), first)
    single = np.add.reduceat(words.astype(np.float64), first, axis=0)
    best = single.argmax(axis=1)
    share = np.zeros((n, k))
    share[np.arange(n), best] = 1
    if k == 1:
        return share
    allowed = share.copy()
    value = single[np.arange(n), best] - offset
    price = PENALTY * np.log(size + 1.0)
    full, most = _em(like, first, size, np.ones((n, k)))
    open_ = most - value > price
    for _ in range(k - 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        new = np.where(allowed[rows] > 0, -1.0, full[rows]).argmax(axis=1)
        trial = allowed[rows].copy()
        trial[np.arange(len(rows)), new] = 1
        pick_ = np.concatenate([np.arange(first[r], first[r] + size[r]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(size[rows])[:-1]])
        found, gained = _em(like[pick_], begin, size[rows], trial)
        better = gained - value[rows] > price[rows]
        won = rows[better]
        allowed[won], share[won], value[won] = trial[better], found[better], gained[better]
        open_[rows[~better]] = False
        open_ &= (allowed.sum(axis=1) < k) & (most - value > price)
    return share


def infer_languages(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred, score, languages and n_words, from its column text alone.

    ``languages`` has the selected languages and their shares, largest first; ``lang_pred`` and
    ``score`` are the first. A null text or one without letters gives ``und``, 0 and no languages,
    as does every text if the model has learned no language.
    """
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)  # COLUMNS numbers per language
    names = [c for c in docs.columns if c != "text"]
    schema = extended(docs.select(*names), ADDED)

    def guess(texts: list[str | None]) -> list[tuple]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in _pieces(text or ""):
                parts.append(part)
                owner.append(i)
        scores, owners = [], []
        for a, b in spans_of([len(p) for p in parts], CHARS_AT_ONCE) if langs else []:
            column, first, at = trigrams(parts[a:b])
            if len(first):
                scores.append(np.add.reduceat(held.value[column], first, axis=0))
                owners.append(np.array(owner)[a:b][at])
        out: list[tuple] = [("und", 0.0, [], 0)] * len(texts)
        if not scores:
            return out
        words, at = np.concatenate(scores), np.concatenate(owners)
        rows, size = np.unique(at, return_counts=True)
        for row, n, share in zip(rows, size, proportions(words, size)):
            order = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
            mix = [{"lang": langs[k], "share": min(1.0, float(share[k]))} for k in order]
            out[row] = (mix[0]["lang"], mix[0]["share"], mix, int(n))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])), pa.int64()]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in spans_of([len(t or "") for t in texts], CHARS_AT_ONCE):
                found = guess(texts[a:b])
                own = [batch.column(batch.schema.get_field_index(n)).slice(a, b - a) for n in names]
                added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*own, *added], [*names, *[n for n, _ in ADDED]])

    return docs.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ...): learned where crc32(doc_id) mod ``parts`` is not ``held``."""
    rows = pick(docs, "doc_id", "lang", "text").withColumn("held_out", id_bucket(F.col("doc_id"), parts) == held)
    model = fit_languages(rows.filter("not held_out"))
    return infer_languages(rows.select("doc_id", "held_out", "text"), model)
