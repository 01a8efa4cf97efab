"""The registered queries opN_<name>, thin over the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, license_scan, line_quality, mixing, packing, sharding, simhash, suffix_dedup, suffix_tree_lm, token_counts, url_filter, whitening
from .common import table


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def _redirected(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """op1's operator with a table of redirects from some pages to the next."""
    pages = table(spark, sf_dir, "pages")
    target = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    edges = pages.where(which).join(target, "page_id").select(F.col("url").alias("src"), "dst")
    return url_filter.judge_urls(pages, edges)


def redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page redirects to the next."""
    return _redirected(spark, sf_dir, "page_id % 3 = 0")


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but every tenth page redirect to the next: chains of ten."""
    return _redirected(spark, sf_dir, "page_id % 10 <> 9")


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_slots(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_viterbi_token_counts(spark: SparkSession, sf_dir: str, model_file: str = token_counts.MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", token_counts.count_tokens(docs, token_counts.read_pieces(model_file)).alias("t"))
    return counted.select("doc_id", "t.n_tokens", "t.score")


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), least=1)
    best = F.coalesce(F.array_max(F.col("leaks.overlap")), F.lit(0))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_distinct("leaks.item_id").alias("item_ids"), best.alias("longest_overlap"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", license_scan.scan_licenses(docs["text"]).alias("l")).select("doc_id", "l.license", "l.dice", "l.units")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree_lm.suffix_tree_scores(docs, ~suffix_tree_lm.held_out())
    return scored.select("doc_id", suffix_tree_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_shifted_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.every(conversations.reports(conversations.repair(conversations.damage(rows))), rows)


QUERIES = {f.__name__: f for f in (op1_redirect_url_filter, op2_jump_sharding, op3_viterbi_token_counts, op4_spaced_seed_decontamination, op5_suffix_array_dedup, op6_line_frequency_quality, op7_license_dice, op8_simhash_trie, op9_suffix_tree_lm, op10_subset_sum_mix, op11_shifted_cholesky_whitening, op12_shortest_pack_first, op13_conversation_repair, redirect_classes, redirect_chains)}
