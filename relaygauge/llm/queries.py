"""The operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygauge.llm.centroids import cluster_vectors
from relaygauge.llm.decontamination import contamination
from relaygauge.llm.frames import crc_remainder
from relaygauge.llm.html_extraction import main_text
from relaygauge.llm.jaccard_join import near_duplicates
from relaygauge.llm.language_id import identify_languages, language_samples
from relaygauge.llm.licenses import license_scan
from relaygauge.llm.mixing import mix_sources
from relaygauge.llm.oracles import ORACLES
from relaygauge.llm.passages import repeated_passages
from relaygauge.llm.quality import quality
from relaygauge.llm.source_audit import source_divergence
from relaygauge.llm.suffix_dedup import suffix_dedup
from relaygauge.llm.token_counts import token_counts
from relaygauge.llm.toxicity import fit_on_labels, toxicity

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rest = suffix_dedup(_read(spark, folder, "documents"))
    return rest.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_passages(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_passages, n_repeated, first_ids, passages."""
    found = repeated_passages(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_passages", "n_repeated", "first_ids", "passages")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate."""
    docs = _read(spark, folder, "documents")
    held_out = crc_remainder("doc_id", 4) == 2
    samples = language_samples(docs.where(~held_out))
    return identify_languages(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rate")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scan = license_scan(_read(spark, folder, "documents"))
    base = F.filter("places", lambda p: p["base"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"])
    return scan.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        "score",
    )


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies."""
    mixed = mix_sources(_read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id, text_class, n_links, n_link_texts."""
    return near_duplicates(_read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    judged = quality(_read(spark, folder, "documents"))
    return judged.select(*[c for c in judged.columns if c != "failed"], F.array_join("failed", ",").alias("failed_rules"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    held_out = crc_remainder("doc_id", 5) == 0
    model = fit_on_labels(docs, labels.where(~held_out))
    scored = toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    return token_counts(_read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = main_text(_read(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return cluster_vectors(_read(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return source_divergence(_read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_passages": op2_passages,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_source_mix": op5_source_mix,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_html_extraction": op11_html_extraction,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_source_divergence": op13_source_divergence,
}

__all__ = ["ORACLES", "QUERIES"]
