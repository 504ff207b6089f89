"""Operators on sources, lists and vectors against plain Python."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from wireloom.llm import list_intervals, pivot_search, weighted_mix


def test_mix_reaches_targets(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, "w " * (1 + i % 13), i) for i in range(600)] + [(None, "s0", None, 0), (700, "s9", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target long")
    out = weighted_mix.mix_sources(docs)
    found = out.collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    per = out.groupBy("source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert abs(sum(r.target for r in per) - 1.5 * sum(r.size for r in per)) < 1e-6
    for r in per:
        assert r.target <= 2 * r.size + 1e-9 and abs(r.taken - r.target) <= 13
    again = weighted_mix.mix_sources(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in found)
    assert weighted_mix.mix_sources(docs.limit(0)).count() == 0


def test_no_bucket_of_keys_is_large(spark):
    """Sources whose texts all have one weight, light ones too, spread over the buckets alike."""
    buckets = 400
    rows = spark.range(200_000).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in (0.1, 0.15, 0.5, 0.79, 1.0)]), (F.col("id") % 5 + 1).cast("int")))
    key = weighted_mix.draw_key(F.col("id"), F.lit(7).cast("long"), F.col("weight"), "x")
    found = rows.withColumn("key", key).withColumn("bucket", weighted_mix.key_bucket(F.col("key"), F.lit(buckets)))
    sizes = found.groupBy("weight", "bucket").count().groupBy("weight").agg(F.max("count").alias("most")).collect()
    share = 40_000 / buckets
    assert len(sizes) == 5 and all(r.most <= 1.3 * 2 * len(weighted_mix.WEIGHT_STEPS) * share for r in sizes)
    order = found.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bucket").collect()
    assert all(a.high <= b.low for a, b in zip(order, order[1:]))


def test_lists_as_of(spark):
    day = 86_400
    entries = spark.createDataFrame([
        ("bad.org", "block", 10 * day), ("bad.org", "remove", 100 * day), ("bad.org", "block", 300 * day),
        ("ok.bad.org", "allow", 20 * day), ("x.com/ads", "block", 0), ("tie.com", "allow", 5), ("tie.com", "block", 5), (None, "block", 1),
    ], "entry string, action string, listed_at long")
    captures = spark.createDataFrame([
        (1, "http://bad.org/", 9 * day), (2, "http://bad.org/", 10 * day), (3, "https://a.BAD.org:8/x", 99 * day), (4, "http://bad.org", 100 * day),
        (5, "http://bad.org", 400 * day), (6, "http://ok.bad.org/", 30 * day), (7, "http://x.com/ads/1", 1), (8, "http://x.com/news", 1),
        (9, None, 1), (10, "no url", 1), (11, "http://bad.org/", None), (12, "http://tie.com", 6), (13, "http://notbad.org", 50 * day),
    ], "page_id long, url string, fetched_at long")
    got = {r.page_id for r in list_intervals.filter_urls(captures, entries).collect() if r.blocked}
    assert got == {2, 3, 5, 7, 12}
    assert list_intervals.filter_urls(captures.limit(0), entries).count() == 0
    assert list_intervals.filter_urls(captures, entries.limit(0)).count() == 13


def test_forms_of_entries(spark):
    """Case, a last dot, a scheme and a port make no difference; paths of any depth and parents with paths count."""
    entries = spark.createDataFrame([
        ("Bad.ORG.", "block", 1), ("http://user@Deep.com:80/Ads/x/?q#f", "block", 1), ("deep.com/Ads", "allow", 1), (" ", "block", 1), ("/only", "block", 1),
        ("bad.org", "remove", 100),
    ], "entry string, action string, listed_at long")
    urls = {
        1: "http://a.bad.org/x/y", 2: "http://a.deep.com/Ads/x/y.html", 3: "http://deep.com/Ads/z", 4: "http://deep.com//Ads//x", 5: "http://deep.com/ads/x",
        6: "http://deep.com/Ads/xy", 7: "http://xdeep.com/Ads/x", 8: "http://deep.com./Ads/x?Ads", 9: "http://b.org/" + "Ads/" * 5000,
    }
    captures = spark.createDataFrame([(i, u, 50, "theirs") for i, u in urls.items()] * 2, "page_id long, url string, fetched_at long, ENTRY string")
    found = list_intervals.filter_urls(captures, entries)
    got = {(r.page_id, r.blocked, r.entry) for r in found.select("page_id", "blocked", "entry").collect()}
    assert found.count() == 18 and got == {
        (1, True, "bad.org"), (2, True, "deep.com/Ads/x"), (3, False, "deep.com/Ads"), (4, True, "deep.com/Ads/x"), (5, False, None), (6, False, "deep.com/Ads"),
        (7, False, None), (8, True, "deep.com/Ads/x"), (9, False, None),
    }
    assert not any(r.blocked for r in list_intervals.filter_urls(captures.withColumn("fetched_at", F.lit(100)).filter("page_id = 1"), entries).collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(400, rows[3][1]), (401, None), (402, [1.0, None]), (403, [float("nan")] * 8), (None, [0.0] * 8), (450, [1e30] * 8), (500, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-max(-pivot_search.LONG, min(pivot_search.LONG, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v))
            want[q] = [(i, -s) for s, i in scored[:5]]
    got = {}
    for r in pivot_search.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: w for q, w in want.items() if w}
    assert pivot_search.top_k(df.limit(0)).count() == 0


def test_pipeline_runs_on_the_smallest_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "tokens", "score"]
    rows = out.collect()
    assert rows and all(len(r.tokens) > 0 and r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
