"""Operators on texts against brute force on small frames."""

import collections
import math
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wireloom.llm import context_tree, dom_marginals, fertility, gray_index, language_mixture, line_edit_join, piece_scan, queries
from wireloom.llm.common import Guarded, pick

EN = "the river runs past the old mill and the people there rowed to church when the water was high"
DE = "der fluss zieht an der alten mühle vorbei und die leute ruderten zur kirche wenn das wasser hoch stand"
DOCS = [
    (0, EN, "en", "a", 1), (1, DE, "de", "b", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
    (4, EN + "\n" + EN + "\n" + EN, "en", "a", 2), (5, " \t\n", "de", "b", 3), (6, "12 34 !!", None, "c", 4),
    (7, EN + " " + DE, "en", None, 5), (None, DE + "x", "de", "b", 6), (8, EN, "en", "a", 1), (8, EN, "en", "a", 1),
    (9, "x" * 3000, "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_clashing_columns_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], ["doc_id", "text", "TEXT", "score"])
    assert pick(df, "text").first()["text"] == "a"
    guard = Guarded(df, ("text",), ("score",))
    out = guard.restore(guard.work.withColumn("score", F.lit(9)), "score")
    assert out.columns == ["doc_id", "text", "TEXT", "score"] and tuple(out.first()) == (1, "a", "b", 9)


def test_languages(docs, empty):
    found = language_mixture.infer_languages(docs.select("doc_id", "text"), language_mixture.fit_languages(docs.filter("doc_id <> 7")))
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[0].lang_pred == "en" and by_id[1].lang_pred == "de"
    assert {x.lang for x in by_id[7].languages} == {"en", "de"} and abs(by_id[7].score - 0.5) < 0.2
    for i in (2, 3, 5, 6):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in by_id.values())
    assert language_mixture.held_out_languages(empty).count() == 0


def test_mixture_set_is_penalised():
    rng = np.random.default_rng(0)
    pure = np.stack([rng.normal(5, 1, 200), np.zeros(200), np.zeros(200)], axis=1)
    half = np.concatenate([pure[:100], pure[:100][:, [1, 0, 2]]])
    share = language_mixture.proportions(np.concatenate([pure, half]).astype(np.float32), np.array([200, 200]))
    assert (share[0] > 0).tolist() == [True, False, False]
    assert (share[1] > 0).tolist() == [True, True, False] and abs(share[1][0] - 0.5) < 0.05


def _tree_probability(text: bytes, train: list[bytes], depth: int) -> float:
    """Context-tree weighting spelled out: log10 probability of a text after training, counts frozen."""
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(t):
        full = bytes([255]) * depth + t + bytes([255])
        for i in range(depth, len(full)):
            node = 1
            for j in range(8):
                bit = full[i] >> (7 - j) & 1
                yield [(full[i - d:i], node) for d in range(depth + 1)], bit
                node = 2 * node + bit

    children = collections.defaultdict(set)
    for t in train:
        for path, bit in decisions(t):
            for d, node in enumerate(path):
                counts[node][bit] += 1
                if d < depth:
                    children[node].add(path[d + 1])

    def block(n):
        a, b = counts[n] if n in counts else (0, 0)
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(n):
        if len(n[0]) == depth:
            return block(n)
        below = sum(weighted(c) for c in children.get(n, ()))
        return math.log(0.5 * math.exp(block(n)) + 0.5 * math.exp(below))

    total = 0.0
    for path, bit in decisions(text):
        p, rest = 0.0, 1.0
        for d, n in enumerate(path):
            a, b = counts[n] if n in counts else (0, 0)
            own = 1.0 if d == depth else 0.5 * math.exp(block(n) - weighted(n))
            p += rest * own * ((a, b)[bit] + 0.5) / (a + b + 1)
            rest *= 1 - own
        total += math.log10(p)
    return total


def test_context_tree_equals_definition(spark, docs):
    rows = [(i, t) for i, t in enumerate(["abab", "ab b", "", "Abba zz", "ba", None, "abab", "a", "bb", "b a", "ab", "zq"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 0 for i, _ in rows}
    texts = {i: (t or "").lower().encode() for i, t in rows}
    train = [texts[i] for i in texts if not held[i]]
    words = collections.Counter(w for t in train for w in t.split())
    total, distinct = sum(words.values()) + len(train), len(words) + 1
    for r in context_tree.score_texts(df, parts=3, held=0, depth=2).collect():
        own = texts[r.doc_id].split()
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        base += math.log10((len(train) + 0.1) / (total + 0.1 * (distinct + 1)))
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(own) + 1 and r.train_tokens == total
        assert r.n_known == sum(w in words for w in own) + 1
        assert abs(r.base_score - base) < 1e-9
        assert abs(r.score - _tree_probability(texts[r.doc_id], train, 2)) < 1e-9
    assert context_tree.score_texts(docs).count() == len(DOCS)


def test_lines(spark, docs, empty):
    base = "it was a bright cold day in april and the clocks were striking thirteen"
    rows = [(1, base + "\nshort\n" + base), (2, base.replace("bright", "brigt")), (3, base.replace("cold", "warm and wet")),
            (4, base[:-1] + "N!"), (None, base), (5, None), (6, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line_no): r for r in line_edit_join.deduplicated_lines(df, least_chars=16).collect()}
    assert set(found) == {(1, 0), (1, 2), (2, 0), (3, 0), (4, 0), (None, 0)}
    assert [k for k, r in found.items() if r.kept] == [(1, 0), (3, 0)] or {k for k, r in found.items() if r.kept} == {(1, 0), (3, 0)}
    assert found[1, 0].n_links == 2 and found[3, 0].n_links == 0 and found[None, 0].class_doc_id == 1
    left = {r.doc_id: r.text for r in line_edit_join.drop_copied_lines(df).collect()}
    assert left == {1: base + "\nshort", 3: rows[2][1], 5: None, 6: "\n\n"}
    assert line_edit_join.deduplicated_lines(empty).count() == 0
    assert line_edit_join.drop_copied_lines(docs).columns == docs.columns


def test_repeated_rows_are_one_line(spark):
    base = "it was a bright cold day in april and the clocks were striking thirteen"
    rows = [(1, base)] * 3 + [(2, base.replace("bright", "brigt")), (3, base + "é")]
    found = line_edit_join.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and {r.class_doc_id for r in found} == {1}
    assert sorted((r.doc_id, r.n_links, r.n_copies, r.kept) for r in found) == [(1, 2, 3, True)] * 3 + [(2, 2, 1, False), (3, 2, 1, False)]


def _within(a, b, most):
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            steps = [row.get(j, most) + 1, now.get(j - 1, most) + 1]
            now[j] = min(steps + [row.get(j - 1, most + 1) + (x != b[j - 1])] if j else steps)
        row = now
    return row.get(len(b), most + 1) <= most


def test_edits_grow_with_line_length(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    éß漢"))
    lines = []
    for size in [*range(18, 70), 90, 116, 126, 128, 140, 250, 258, 300, 505, 520, 1030]:
        line = "x" + "".join(rng.choice(letters, size - 2)) + "y"
        most = max(2, size // 10)
        at = int(rng.integers(2, size - most - 3))
        lines += [line, line[:at] + "Q" * most + line[at + most:], line[:at] + line[at + most:], line[:at] + "Q" * (most + 4) + line[at + most + 4:]]
        few = list(line)
        for i in rng.choice(size - 2, 2, replace=False):
            few[i + 1] = "Z"
        lines.append("".join(few))
        if size < 64:  # every pair of short lines is found, however the edits are spread
            spread = list(line)
            for i in rng.choice(size - 2, most, replace=False):
                spread[i + 1] = "#"
            lines.append("".join(spread))
    found = line_edit_join.deduplicated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    links = {r.doc_id: r.n_links for r in found}
    apart = {i: 0 for i in links}
    for i, a in enumerate(lines):
        for j in range(i):
            n = max(len(a), len(lines[j]))
            if i - j < 6 and _within(a, lines[j], max(2, n // 10)):
                apart[i] += 1
                apart[j] += 1
    assert links == apart and sum(links.values()) > 400



def test_no_pair_of_long_lines_is_left_out(spark):
    """Lines of all lengths with as many single edits as are allowed, spread evenly or drawn anywhere, meet their originals."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz ABCÄ漢"
    lines = []
    for n in [*range(60, 112), 127, 128, 140, 255, 256, 300, 511, 513, 640, 1030]:
        for spread in (True, False):
            line = "".join(rng.choice(letters) for _ in range(n))
            edited, at = list(line), n // 10
            for k in range(at):
                place = (2 * k + 1) * n // (2 * at) if spread else rng.randrange(n)
                kind = rng.choice("sid")
                edited[place] = {"s": "#", "i": edited[place] + "#", "d": ""}[kind]
            edited = "".join(edited)
            if _within(line, edited, max(n, len(edited)) // 10):
                lines.append((line, edited))
    assert len(lines) > 100
    rows = [(i, x) for i, x in enumerate(x for pair in lines for x in pair)]
    found = {r.doc_id: r for r in line_edit_join.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [len(lines[i // 2][0]) for i in range(0, len(rows), 2) if found[i + 1].class_doc_id != i]
    assert not lost
    assert all(r.n_links == 1 for r in found.values())


def test_few_keys_of_unlike_lines_are_joined(spark):
    """Keys that no other line makes are left out before the join; those of a pair with all its edits are not."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(64, 700))) for _ in range(200)]
    near = ["".join("#" if i % 11 == 5 else c for i, c in enumerate(x)) for x in lines[:3]]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "id long, counts long, line string")

    chars = sum(map(len, lines))
    keys = lambda batch: (k for *_, k, _ in line_edit_join._segment_keys(batch.column("line").to_pylist()))
    known = line_edit_join.sketched(df.select("line"), keys, 1 << 22)
    none = spark.sparkContext.broadcast((np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.uint8)))
    assert line_edit_join.met_keys(df, line_edit_join._place_keys, none).count() == 0
    assert line_edit_join.met_keys(df, line_edit_join._place_keys, known).count() < chars / 100
    assert all(line_edit_join.share_grams(a, b) for a, b in zip(lines, near))
    assert not any(line_edit_join.share_grams(a, b) for a, b in zip(lines[:50], lines[50:100]) if len(a) > 200)


def test_lines_that_repeat_themselves_meet_once(spark):
    """A key that a line has at many places is one row, and no row at all where no other line has it."""
    lines = ["of " * 300, "of " * 290 + "no", "Thor " * 200]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "id long, counts long, line string").coalesce(1)
    keys = lambda batch: (line_edit_join._per_line(*k)[4] for k in line_edit_join._segment_keys(batch.column("line").to_pylist()))
    known = line_edit_join.sketched(df.select("line"), keys, 1 << 20)
    met = line_edit_join.met_keys(df, line_edit_join._place_keys, known).collect()
    assert len(met) == len({(r.id, r.key) for r in met}) and {r.id for r in met} == {0, 1}
    assert max(r.greatest - r.least for r in met) > 800


def test_many_lines_are_compared_at_once():
    """Distances of pairs of all lengths are those of the plain edit matrix."""
    rng = random.Random(9)
    a, b = [], []
    for n in [*range(0, 140, 3), 192, 193, 640, 641, 1024, 1025, 1100] * 3:
        line = "".join(rng.choice(rng.choice(["ab", "abcdefgh ", "é漢😀"])) for _ in range(n))
        near = [rng.choice(["", "#", c + "é"]) if rng.random() < rng.choice([0.02, 0.08, 0.3]) else c for c in line]
        a.append(line)
        b.append("".join(near))
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(a, b)])
    apart = [_within(x, y, m) for x, y, m in zip(a, b, most)]
    assert line_edit_join.within(a, b, most).tolist() == apart and 20 < sum(apart) < len(a) - 20
    exact = line_edit_join.edit_distances(a, b)
    assert exact.tolist() == [line_edit_join.edit_distance(x, y) for x, y in zip(a, b)]
    assert all(_within(x, y, d) and not (d and _within(x, y, d - 1)) for x, y, d in zip(a, b, exact.tolist()) if len(x) < 200)


def test_short_lines_have_classes(spark, tmp_path):
    texts = ["Yes.\n\r\nfirst of all, a text", "Yes.\n\r\n今天天气很好。", "今天天气很好。\nanother text goes here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.line_no): r for r in queries.op3_line_edit_join(spark, str(tmp_path)).collect()}
    assert {k for k, r in found.items() if r.kept} == {(0, 0), (0, 2), (1, 2), (2, 1)} and set(found) == {(0, 0), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}
    assert found[1, 0].class_doc_id == 0 and found[2, 0].class_doc_id == 1 and found[2, 0].n_copies == 2
    left = {r.doc_id: r.text for r in line_edit_join.drop_copied_lines(df).collect()}
    assert left == {0: texts[0], 1: "\r\n今天天气很好。", 2: "another text goes here"}


def test_own_lines_outlast_shared_ones(spark):
    shared = [f"passage {i} that many pages of this hot source have in common, word for word {i * i}" for i in range(8)]
    rows = [(i, "\n".join([*shared, f"own {'abcdef'[i] * 9}", ""])) for i in range(5)] + [(5, "\n".join(shared) + "\n")]
    left = {r.doc_id: r.text for r in line_edit_join.drop_copied_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(left) == [0, 1, 2, 3, 4] and all(f"own {'abcdef'[i] * 9}" in left[i] for i in left)
    assert [sum(s in t for t in left.values()) for s in shared[:1]] == [1]


def test_fingerprints_and_components(spark, docs, empty):
    def plain(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0

    for _, text, *_ in DOCS:
        assert gray_index.fingerprint(text) == plain(text)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = points[:200].copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    values = np.unique(np.concatenate([points, near, np.arange(40, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp long, item long")
    got = {r.node: r.least for r in gray_index.fingerprint_components(df).collect()}
    label = list(range(len(values)))
    apart = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    while True:
        new = [min(label[j] for j in np.flatnonzero(apart[i])) for i in range(len(values))]
        if new == label:
            break
        label = new
    assert [got[int(v)] for v in values.view(np.int64)] == label
    rows = gray_index.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS) and {r.component_id for r in rows if r.doc_id in (0, 8)} == {0}
    kept = gray_index.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in rows})
    assert gray_index.near_duplicates(empty).count() == 0


def test_hot_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(gray_index, "BUCKET_ROWS", 16)
    df = spark.range(1 << 9).select(F.col("id").alias("fp"), F.col("id").alias("item"))
    assert {r.least for r in gray_index.fingerprint_components(df).collect()} == {0}


def test_pages(spark):
    model = dom_marginals.train(dom_marginals.training_pages([]))
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><article><h1>On &amp;  rivers</h1><p>The river\n runs past the old mill, and it floods the fields.<p>It rains.</article><footer>&copy; all</footer>"
    assert dom_marginals.extract([page, "", "<"], model)[:2] == ["On & rivers\nThe river runs past the old mill, and it floods the fields.\nIt rains.", ""]
    forest = dom_marginals.Forest([dom_marginals.parse("<div><p>a</p><p>b</p></div>")])
    rng = np.random.default_rng(1)
    unary, edge = rng.normal(size=len(forest.parent)), rng.normal(size=(2, 2, 2))
    weight = {}
    n = len(unary)
    for state in range(1 << n):
        s = [state >> i & 1 for i in range(n)]
        w = sum(unary[i] * s[i] for i in range(n)) + sum(edge[forest.kind[i], s[forest.parent[i]], s[i]] for i in range(1, n))
        weight[state] = math.exp(w)
    total = sum(weight.values())
    want = [sum(w for st, w in weight.items() if st >> i & 1) / total for i in range(n)]
    belief, _, log = forest.marginals(unary, edge)
    assert np.allclose(belief, want) and abs(log - math.log(total)) < 1e-9
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5)], "page_id long, url string, html string, text long")
    assert [(r.page_id, r.n_chars > 0) for r in dom_marginals.extract_text(df, model).orderBy("page_id").collect()] == [(1, True), (2, False)]


def test_unclosed_silent_elements():
    read = lambda page: " ".join(dom_marginals.parse(page).runs.values())
    assert read("<head><title>t</title><meta charset=x><article><p>one</p></article><p>two") == "one two"
    assert read("<head><title>t</title> text <p>more") == "text more"
    assert read("<head><noscript><p>no</p></noscript><title>t</title></head><p>one") == "one"
    for tag in ("button", "select", "svg", "object", "noscript"):
        page = f"<body><div><nav><{tag}><p>menu</p></nav><p>one</p></div><p>two</p>"
        assert read(page).endswith("one two")
        assert read(page + f"<{tag}>off</{tag}>") == "one two"
        assert read(f"<div>a<{tag}><div><p>b</div></{tag}>c</div>") == "a c"


def test_quality(docs, empty):
    tokens = fertility.WordTokens(fertility.PIECES, fertility.RANKS)
    for text in [EN, EN * 3, (EN + " ") * 3, "a b a b a b a b a b a b", "", "* # x"]:
        w = text.split()
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        row = fertility.measure(text, "en", tokens)
        assert row[0] == len(w) and row[4] == len(hit) and row[6] == sum(len(tokens.pieces.encode(x)) for x in w)
    rows = fertility.quality_metrics(docs).collect()
    assert len(rows) == len(DOCS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert fertility.quality_filter(docs).columns == docs.columns and fertility.quality_metrics(empty).count() == 0


def test_small_groups_keep_their_own_bands(spark):
    rng = np.random.default_rng(4)
    rows = [("en", False, *map(float, rng.normal((4.3, 4.1, 0.8, 0.0), (0.1, 0.1, 0.01, 0)))) for _ in range(10_000)]
    few = [("zh", False, *map(float, rng.normal((1.5, 1.2, 0.9, 0.3), (0.04, 0.03, 0.01, 0.002)))) for _ in range(20)]
    names = ["chars_per_token", "byte_chars_per_token", "entropy_ratio", "fallback_share"]
    measured = spark.createDataFrame(rows + few + [("zh", True, 9.0, 9.0, 9.0, 1.0)], ["band_group", "base_failed", *names])
    bands = {r["_group"]: r for r in fertility.fertility_bands(measured).collect()}
    fits = lambda row: all(-b["below"] <= v - b["mid"] <= b["above"] for v, b in zip(row[2:], [bands[row[0]][f"{n}_band"] for n in names]))
    assert set(bands) == {"en", "zh"} and all(map(fits, rows + few))
    assert not fits(("zh", False, 2.3, 1.2, 0.9, 0.3)) and not fits(("zh", False, 1.5, 2.0, 0.9, 0.3))


def test_pieces_chunked_equal_whole(spark, docs, empty):
    whole = piece_scan.Vocabulary(piece_scan.PIECES)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(20, "a▁b  c\n\n é漢😀 " * 30), (21, "theandof" * 90), (22, " " * 200)], "doc_id long, text string"))
    odd = odd.withColumn("tokens", F.lit("clash"))
    for chunk in (40, 100_000):
        back = piece_scan.decode_pieces(piece_scan.encode_pieces(odd, chunk=chunk)).collect()
        assert len(back) == len(DOCS) + 3
        for r in back:
            assert r.decoded == (r.text or "") and r.score == (whole.best_cut(" " + r.text)[1] if r.text else 0)
    assert piece_scan.encode_pieces(empty).count() == 0


def test_best_cut_equals_plain_dynamic_programme():
    """Against a forward pass over all substrings, written without the vocabulary's tree, units or memory."""
    v = piece_scan.Vocabulary(piece_scan.PIECES)

    def best(s):
        score = [0] + [None] * len(s)
        for j in range(1, len(s) + 1):
            ways = [score[i] + v.weight[s[i:j]][0] for i in range(max(0, j - v.longest), j) if score[i] is not None and s[i:j] in v.weight]
            if s[j - 1] not in v.weight and score[j - 1] is not None:
                ways.append(score[j - 1] + v.byte_weight * len(s[j - 1].encode()))
            score[j] = max(ways, default=None)
        return score[-1]

    rng = np.random.default_rng(7)
    letters = list("abcdeinorst  \n.é漢🙂")
    for n in (1, 2, 5, 40, 300):
        for _ in range(8):
            s = " " + "".join(rng.choice(letters, n))
            ids, weight = v.encode(s)
            assert weight == best(s) and v.decode(ids) == s[1:]


def test_giant_text_at_the_production_chunk_size(spark):
    """Several levels of chunks: the weight of one pass, and the text back."""
    rng = np.random.default_rng(3)
    words = ["the", "river", "mühle", "x" * 70, "\n", "  ", "漢字", "unbelievably"]
    giant = " ".join(rng.choice(words, 60_000))
    assert len(giant) > 5 * piece_scan.CHUNK_CHARS
    docs = spark.createDataFrame([(1, giant, 5), (2, giant, 5), (3, None, 5), (4, "", 5)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in piece_scan.decode_pieces(piece_scan.encode_pieces(docs)).collect()}
    ids, weight = piece_scan.Vocabulary(piece_scan.PIECES).encode(" " + giant)
    for i in (1, 2):
        assert rows[i].score == weight and rows[i].decoded == giant
    assert rows[3].decoded is None or rows[3].tokens == [] and rows[4].tokens == []


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<div>", "<script>", "</", "<!--", "<svg></x>", '<a ">"', "<a '\"", "<li><div>", "<table><td>", "<a b=c >"])
def test_broken_markup_takes_linear_time(piece):
    """A megabyte of markup that never closes; the text before it is still found."""
    start = time.perf_counter()
    tree = dom_marginals.parse("<p>before</p>" + piece * (1_000_000 // len(piece)))
    assert "before" in tree.runs.values() and time.perf_counter() - start < 30


def test_tokens_of_tags_and_quotes():
    found = lambda page: [(t[2], t[3], t[4]) for t in dom_marginals.tokens(page)]
    assert found('<a title="x>y">z</a>') == [("a", False, ' title="x>y"'), ("a", True, "")]
    assert found("<a t=\"x <b>") == [("a", False, ' t="x <b')]
    assert found("a < b <i>c") == [("i", False, "")] and found("<!-- <p> --><script>'<p>'</SCRIPT ><br/>")[2:] == [("br", False, "/")]
    assert found("<p") == [] and found("</p") == [("", False, "")] and found("<!-- open <p>") == [("", False, "")]


def test_temporary_tables_go(spark):
    """Tables stored within the block go with it, the kept one stays readable."""
    from wireloom.llm.common import Temporary, stored

    with Temporary(spark) as outer:
        with Temporary(spark) as inner:
            first = stored(spark.range(5).toDF("x"), "t")
            kept = inner.keep(first.selectExpr("x + 1 AS x"), "t")
        assert len(inner.paths) == 1 and len(outer.paths) == 1
        assert kept.count() == 5
        last = outer.keep(kept.selectExpr("x + 1 AS x"), "t")
    assert sorted(r.x for r in last.collect()) == [2, 3, 4, 5, 6]
    with pytest.raises(Exception):
        spark.read.parquet(outer.paths[0]).count()


def test_documents_without_id_are_told_apart(spark):
    """A line at one place of several documents without id stays in one of them only."""
    line = "one and the same line of more than a few words"
    docs = spark.createDataFrame([(None, f"{line}\nown line number {'abcdefg'[i] * 12}") for i in range(3)] + [(5, f"{line}\nlast")], "doc_id long, text string")
    cut = [r.text for r in line_edit_join.drop_copied_lines(docs).collect()]
    assert sum(line in t for t in cut) == 1 and len(cut) == 4
    kept = line_edit_join.deduplicated_lines(docs).filter(f"class_doc_id = 5 and kept").collect()
    assert [(r.doc_id, r.line_no) for r in kept] == [(5, 0), (5, 1)]


def test_units_cut_together_equal_units_cut_one_by_one():
    v = piece_scan.Vocabulary(piece_scan.PIECES)
    rng = np.random.default_rng(8)
    letters = list(" abcdeeeinorsttt") + ["é", "漢", "🙂", "\t"]
    for length in (1, 2, 3, 7, 20, 64):
        units = list(dict.fromkeys("".join(rng.choice(letters, length)) for _ in range(400)))
        v.known = piece_scan.KnownCuts()
        whole = v.cut_alike(units, length)
        assert whole.any() and [u for u, w in zip(units, whole) if w] == list(v.known.place)
        for u, w in zip(units, whole):
            ids, weight = v.best_cut(u)
            if w:
                found, size, total = v.known.gather(np.array([v.known.place[u]]))
                assert found.tolist() == ids and size[0] == len(ids) and total[0] == weight
    v.known = piece_scan.KnownCuts()
    words = list(dict.fromkeys("".join(rng.choice(letters[1:], n)) for n in rng.integers(1, 9, 6000)))
    ids, size, weight = v.encode_all([" ".join(words), "", " " + words[0]])
    assert v.decode_all(ids, size) == [" ".join(words), "", words[0]] and weight[1] == 0
