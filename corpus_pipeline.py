"""A corpus pipeline: five of the text operators in a row, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.llm.decontamination import contamination
from relaygauge.llm.frames import crc_remainder, stage
from relaygauge.llm.jaccard_join import near_duplicates
from relaygauge.llm.language_id import UNKNOWN, identify_languages, language_samples
from relaygauge.llm.mixing import mix_sources
from relaygauge.llm.suffix_dedup import suffix_dedup

MOST_BITS = 7.0  # bits per byte above which a text is in no language that was learned
LEAST_BYTES = 64  # a shorter text tells too little for that, and stays if it has a letter


def _own(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator gives, with a key that only rows alike in doc_id and text share.

    The key is a digest of 128 bits, of the id (no digits if null), a mark and the text (no mark if null).
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in docs.columns])
    number = F.coalesce(F.col("_in_doc_id").cast("string"), F.lit(""))
    content = F.coalesce(F.concat(F.lit(":"), "_in_text"), F.lit(""))
    return own.withColumn("_row", F.unhex(F.md5(F.concat(number, content))))


def _back(own: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    return own.select(*[F.col(f"`_in_{c}`").alias(c) for c in docs.columns], *more)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with all their columns.

    Rejected: a text that is null or has no letter, and one that even its best language cannot parse
    into fewer than MOST_BITS bits per byte.
    """
    own = _own(docs).drop("_row")
    labelled = own.where(crc_remainder("_in_doc_id", 4) != 2)
    samples = language_samples(labelled, text="_in_text", lang="_in_lang", key="_in_doc_id")
    others = tuple(c for c in own.columns if c != "_in_doc_id")
    judged = identify_languages(own, samples, text="_in_text", key="_in_doc_id", keep=others)
    readable = (F.col("rate") < MOST_BITS) | (F.octet_length("_in_text") < LEAST_BYTES)
    return _back(judged.where((F.col("lang_pred") != UNKNOWN) & readable), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, a null id last.

    A text without words is in no group, but of rows alike in doc_id and text one stays.
    """
    own = _own(docs)
    rank = F.struct(F.col("_in_doc_id").isNull().alias("none"), F.col("_in_doc_id").alias("id"), "_row")
    classes = near_duplicates(own.withColumn("_rank", rank), text="_in_text", key="_rank")
    first = classes.where(F.col("class_id") == F.col("_rank")).select("_rank._row").distinct()
    rest = [F.col(f"`_in_{c}`").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")]
    turn = F.row_number().over(W.partitionBy("_row").orderBy(*rest, F.col("_row")))
    kept = own.join(first, "_row", "left_semi")
    return _back(kept.withColumn("_turn", turn).where("_turn = 1"), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the strings of 50 bytes or more that an earlier one has, by whole characters.

    ``n_chars`` follows the text; a null text stays null.
    """
    own = _own(docs).withColumn("_row", F.col("_in_text").isNull())
    others = tuple(c for c in own.columns if c not in ("_in_doc_id", "_in_text"))
    rest = suffix_dedup(own, text="_in_text", key="_in_doc_id", keep=others, whole_characters=True)
    rest = rest.withColumn("_in_text", F.when(~F.col("_row"), F.decode("kept", "UTF-8")))
    if "n_chars" in docs.columns:
        length = F.char_length("_in_text").cast(docs.schema["n_chars"].dataType)
        rest = rest.withColumn("_in_n_chars", F.when(F.col("_in_n_chars").isNotNull(), length))
    return _back(rest, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    own = _own(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(own, items, text="_in_text", key="_row").where("n_hit > 0").select("_row").distinct()
    return _back(own.join(hit, "_row", "left_anti"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, with ``copies`` and ``taken`` words; those it leaves out go.

    Columns of the documents that bear these two names give way to them.
    """
    own = _own(docs)
    taken = mix_sources(own, text="_in_text", key="_row", source="_in_source").where("copies > 0")
    # Rows that share a key are alike: each is taken as often as the most taken of them.
    often = taken.groupBy("_row").agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    return _back(own.join(often, "_row"), docs.drop("copies", "taken"), "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
]

# Cross-parsing and the subset sum cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``; each result is written and read again as the next's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
