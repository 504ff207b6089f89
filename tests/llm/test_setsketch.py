"""SetSketch near-duplicates against brute force on small frames."""

import random

import numpy as np
import pytest

from wireloom.llm import setsketch


def brute(rows):
    """doc_id -> (n, least reachable doc_id) for rows with ids, by all pairs."""
    sets = [setsketch.shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)], rows[i][0] == least[root(i)]) for i in range(len(rows))), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def found(df):
    return sorted((tuple(r) for r in setsketch.near_duplicates(df).collect()), key=str)


def family(rng, base, copies, most):
    words = [f"{base}w{rng.randrange(4000)}" for _ in range(150)]
    return [edited(rng, words, rng.randrange(most)) for _ in range(copies)]


@pytest.mark.parametrize("block", [200, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """Groups of near copies below and above a block's size, many of their pairs close to the limit."""
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", block)
    rng = random.Random(5)
    texts = [t for k in range(12) for t in family(rng, k, 3 + 8 * (k == 0) + 90 * (k == 1), 9)]
    texts += [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [None, "", " \t", "one", "ONE", "one two", "One  Two", "one two three", "é é é", "é é é é", "x " * 30_000] + texts[:10]
    ids = rng.sample(range(10_000), len(texts))
    rows = [*zip(ids, texts), (None, texts[0]), (None, "nobody else has this"), (ids[0], texts[0])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, kept int, TEXT_ string").repartition(6)
    assert found(df) == brute(rows)
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(1 << 63, size=3000, dtype=np.uint64))
    a, b = values[:2000], values[500:2600]
    one = lambda x: setsketch.registers_of(x, np.array([0]))[0]
    assert (one(values[:2600]) == np.maximum(one(a), one(b))).all()
    both, n = np.stack([one(a), one(b)]), np.array([len(a), len(b)])
    more, less = np.array([(both[0] > both[1]).sum()]), np.array([(both[0] < both[1]).sum()])
    true = 1500 / 2600
    assert abs(setsketch.estimated_similarity(more, less, n[:1].astype(float), n[1:].astype(float))[0] - true) < 5 * (true * (1 - true) / setsketch.REGISTERS) ** 0.5


def test_bands_lose_no_link_on_documents(spark):
    """All documents of the small table against plain Python by way of an inverted index."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(df) == brute(rows)
