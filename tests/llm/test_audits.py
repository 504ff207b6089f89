"""Filter and source audits against plain Python on small frames."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from wireloom.llm import divergence_audit, filter_audit
from wireloom.llm.queries import QUERIES
from wireloom.llm.sql import ORACLE_SQL

from compare import compare, duck

LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [
    (5, LONG, "a"), (3, LONG, "a"), (9, LONG, "b"), (9, LONG, "b"), (None, LONG, "a"), (1, None, None), (2, "", ""), (4, " \t\n", "b"),
    (6, "A B C", "b"), (7, LONG + " 5$ | &", "a"), (8, "go " * 300, "a"), (10, LONG.upper(), "b"), (10, "other", "b"), (11, "é" * 5000, None),
    (12, LONG + " " + LONG + " x" * 200_000, "a"),
]


def failing(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
    checks = (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        bool(re.search(r"[#$%&*|]", text)), smaller,
    )
    return "".join(f for f, c in zip("ABCDE", checks) if c)


def test_filter_orders_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in TEXTS], "doc_id long, text string, source string, TEXT_ string, bits long").repartition(4)
    labels = spark.createDataFrame(
        [(5, 1, 0), (9, 0, 1), (9, None, None), (9, 1, None), (None, 1, 1), (4, None, None), (77, 1, 1)], "doc_id long, quality long, toxic long"
    )
    good, toxic = {5, 9}, {9}
    want = {}
    for part in {s or "" for _, _, s in TEXTS}:
        rows = [(i, failing(i, t, TEXTS)) for i, t, s in TEXTS if (s or "") == part]
        sums = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = [(i, x) for i, x in rows if not set(x) & set(order[: step - 1])]
                here = [i for i, x in before if f in x]
                sums[f] += len(here)
                want[part, order, step] = [
                    f, len(before) - len(here), len(here), sum(f in x for _, x in rows) - len(here), sum(x == f for _, x in rows),
                    sum(i in good for i in here), sum(i in toxic for i in here),
                ]
        for key in [k for k in want if k[0] == part]:
            want[key].append(sums[want[key][0]])
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == want
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit_filters(docs, labels.limit(0)).collect()
    assert len(bare) == len(want) and not any(r.good_lost or r.toxic_lost for r in bare)


def test_hash_is_not_trusted(spark):
    """Texts of equal hash are told apart: the join compares the texts themselves."""
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (2, "b"), (None, "b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in filter_audit.copied_rows(rows).collect()) == [(2, "a"), (3, "b")]


def divergence(rows):
    """Plain Python over (lang, source, text) rows."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, source, text in rows:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for (lang, source) in groups:
        kept = [t for t, d in held[lang].items() if d >= 30]
        v = len(kept)
        count = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        count[None] = {t: sum(c[t] for (l, _), c in groups.items() if l == lang) for t in kept}
        price = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * v) for t, n in c.items()} for s, c in count.items()}
        pairs = [(o, sum(abs(price[source][t] - price[o][t]) for t in kept)) for o in count if o is not None and o != source]
        terms = [(t, price[source][t] - price[None][t]) for t in kept if count[source][t] and price[source][t] > price[None][t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, f, r) for r, (i, f) in enumerate(found, 1) if part == "pair" or r <= 50]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    names = [f"t{chr(97 + i % 26)}{'é' * (i // 26)}" for i in range(90)]
    rows = []
    for i in range(500):
        lang, source = ("x", "y", None)[i % 3], (f"s{i % 7}", None, "")[(i // 11) % 3]
        words = rng.choice(names, size=rng.integers(0, 30), p=np.arange(90, 0, -1) / sum(range(91)))
        rows.append((lang, source, " ".join(words) + (" ÄB-Cd_1\x00Ab" if i % 5 else "")))
    rows += [("x", "bare", None), ("x", "bare", ""), ("z", "lone", "alone here"), ("w", "one", "a"), ("w", "two", None), ("x", "s1", "tA " * 50_000)] + [rows[0]] * 40
    docs = spark.createDataFrame([(*r, 0) for r in rows], "lang string, source string, text string, LANG_ int").repartition(5)
    found = divergence_audit.audit_sources(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == divergence(rows)
    assert ("w", "one", "pair", "two", 0, 1) in divergence(rows)
    assert divergence_audit.audit_sources(docs.limit(0)).count() == 0


def test_blocks_of_groups_and_terms(spark, monkeypatch):
    """More groups and terms than one block holds."""
    monkeypatch.setattr(divergence_audit, "BLOCK_GROUPS", 3)
    monkeypatch.setattr(divergence_audit, "BLOCK_TERMS", 8)
    rows = [("x", f"s{i % 11}", " ".join(f"w{chr(97 + j)}" for j in range(26) if (i * j + i) % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence_audit.audit_sources(docs).collect()) == divergence(rows)


def test_joint_table_is_exact():
    rng = np.random.default_rng(1)
    level = rng.integers(1, 5, (200, 4)) * 1000
    used = rng.random((200, 4)) < 0.6
    cells = [(f"t{t}", f"s{g}", int(level[t, g])) for t in range(200) for g in range(4) if used[t, g]]
    groups = pa.table({"lang": ["x"] * 4, "source": [f"s{g}" for g in range(4)], "p0": [7, 8, 9, 10], "size": [250] * 4, "side": [0] * 4})
    out = divergence_audit.block_distances(
        pa.table({"term": [c[0] for c in cells], "source": [c[1] for c in cells], "p": [c[2] for c in cells]}), groups
    ).to_pylist()
    full = np.where(used, level, np.array([7, 8, 9, 10]))
    for r in out:
        a, b = int(r["source"][1]), int(r["item"][1])
        assert r["value"] == int(np.abs(full[:, a] - full[:, b]).sum()) + 50 * abs(a - b)
    assert len(out) == 12


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_source_divergence"])
def test_audits_equal_twins(spark, sf, name):
    assert compare(spark, duck(sf), sf, QUERIES[name], ORACLE_SQL[name]) == ""
