"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    context_tree, divergence_audit, dom_marginals, fertility, filter_audit, gray_index, language_mixture, line_edit_join, list_intervals, piece_scan,
    pivot_search, setsketch, weighted_mix,
)
from .common import table


def op9_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_scan.encode_pieces(table(spark, sf_dir, "documents", "doc_id", "text"))
    back = piece_scan.decode_pieces(coded)
    return back.select(
        "doc_id", F.length("text").alias("n_chars"), F.size("tokens").cast("long").alias("n_tokens"), "score",
        F.hex(F.xxhash64("tokens")).alias("tokens_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return weighted_mix.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_mixture.held_out_languages(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    mixture = F.expr("array_join(transform(languages, x -> concat(x.lang, ':', format_number(x.share, 3))), ' ')")
    return found.select("doc_id", "held_out", "lang_pred", "score", mixture.alias("mixture"), "n_words")


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.deduplicated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), least_chars=1)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_index.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return dom_marginals.extract_text(pages, dom_marginals.fit_pages(pages))


def list_changes(captures: DataFrame) -> DataFrame:
    """Dated list entries derived from the hosts and sections seen: listed, some removed and listed again."""
    hosts = captures.select(list_intervals.host_of(F.col("url")).alias("entry"), F.lit("block").alias("action"))
    parents = hosts.select(F.regexp_replace("entry", r"^[^.]*\.", "").alias("entry"), "action")
    sections = captures.select(list_intervals.section_of(F.col("url")).alias("entry"), F.lit("allow").alias("action"))
    names = hosts.union(parents).union(sections).filter("entry is not null").distinct()
    draw = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("long")
    day = LIST_START + (draw % 300) * 86_400
    changes = F.array(
        F.struct("action", day.alias("listed_at")),
        F.struct(F.lit("remove").alias("action"), (day + 40 * 86_400).alias("listed_at")),
        F.struct("action", (day + 90 * 86_400).alias("listed_at")),
    )
    count = F.when(draw % 7 < 3, 1).otherwise(3)
    return names.filter(draw % 5 < 3).select("entry", F.explode(F.slice(changes, 1, count)).alias("c")).select(
        "entry", "c.action", "c.listed_at"
    )


# 2024-01-01, the first day of the derived captures and list entries
LIST_START = 1_704_067_200


def op6_list_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    captures = pages.withColumn("fetched_at", LIST_START + F.col("page_id") * 7919 % 31_536_000)
    return list_intervals.filter_urls(captures, list_changes(pages))


def op7_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return fertility.quality_metrics(docs)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return filter_audit.audit_filters(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit_sources(table(spark, sf_dir, "documents", "lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_mixture, op2_context_tree, op3_line_edit_join, op4_simhash_components, op5_dom_marginals, op6_list_intervals, op7_pivot_search,
        op8_tokeniser_fertility, op9_piece_scan, op10_mix_sources, op11_filter_audit,
        op12_setsketch_near_dedup, op13_source_divergence,
    )
}
