"""Every text operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaygauge.llm import queries
from relaygauge.llm.decontamination import contamination
from relaygauge.llm.jaccard_join import near_duplicates
from relaygauge.llm.language_id import identify_languages, language_samples
from relaygauge.llm.licenses import license_scan
from relaygauge.llm.mixing import mix_sources
from relaygauge.llm.passages import repeated_passages
from relaygauge.llm.quality import quality
from relaygauge.llm.suffix_dedup import suffix_dedup
from relaygauge.llm.token_counts import token_counts
from relaygauge.llm.toxicity import fit_on_labels, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators give to columns of their own.
CLASHING = ["size", "copies", "row", "kept", "n_words", "label", "lang_pred", "score", "spans", "_text", "_key", "_row", "bucket", "taken"]
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals here"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ROWS = [
    (None, None, None, None, None),
    (None, SENTENCE + " for null keys", "en", "a", 1),
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "!!! ... ###", "en", None, 11),
    (5, "É", "fr", "b", 1),
    (6, SENTENCE, "en", "b", 1),
    (6, SENTENCE, "en", "b", 1),
    (7, SENTENCE, "en", "b", 1),
    (8, SENTENCE.replace("quick", "slow"), None, "b", 1),
    (9, LONG, "en", "c", len(LONG)),
    (10, "A\x00b\x1cc|||d e f\U0001f600 g", "de", "c", 1),
    (11, "la maison est sur la colline et le chat dort dans le jardin", "fr", "c", 1),
    (12, "x" * 5_000, "en", "c", 5_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return frame.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SENTENCE), (1, SENTENCE), (2, None), (3, ""), (None, "quick brown"), (4, "é")], "item_id long, text string")


def operators(items):
    spark = items.sparkSession
    labels = spark.createDataFrame([(6, 1), (6, 1), (9, 0), (None, 1), (11, None), (99, 0)], "doc_id long, toxic int")
    return {
        "suffix_dedup": lambda d: suffix_dedup(d, block_bytes=2_000, bucket_bytes=5_000),
        "passages": repeated_passages,
        "language_id": lambda d: identify_languages(d, language_samples(d)),
        "license_scan": license_scan,
        "source_mix": mix_sources,
        "jaccard_join": near_duplicates,
        "quality": quality,
        "decontamination": lambda d: contamination(d, items),
        "toxicity": lambda d: toxicity(d, fit_on_labels(d, labels)),
        "token_counts": lambda d: token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    }


NAMES = ["suffix_dedup", "passages", "language_id", "license_scan", "source_mix", "jaccard_join", "quality", "decontamination", "toxicity", "token_counts"]


@pytest.mark.parametrize("name", NAMES)
def test_each_row_gives_a_row(docs, items, name):
    result = operators(items)[name](docs).collect()
    keys = sorted((r[0] for r in ROWS), key=str)
    assert sorted((r["doc_id"] for r in result), key=str) == keys


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, items, name):
    assert operators(items.limit(0))[name](docs.limit(0)).collect() == []


def test_no_benchmark_items(docs, items):
    assert contamination(docs, items.limit(0)).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, items, tmp_path, name, step):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    result = step(spark, docs, str(tmp_path))
    expected = docs.columns if name != "source_mix" else [*[c for c in docs.columns if c not in ("copies", "taken")], "copies", "taken"]
    assert result.columns == expected
    result.write.parquet(str(tmp_path / "out"))
    kept = {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect()}
    given = {r[:2] for r in ROWS}
    if name == "language_id":
        assert kept == {r for r in given if r[1] and any(c.isalpha() for c in r[1])}
    if name == "jaccard_join":
        assert (6, SENTENCE) in kept and (7, SENTENCE) not in kept and {r for r in given if not r[1]} <= kept
    if name == "suffix_dedup":
        assert {k for k, _ in kept} == {k for k, _ in given} and (7, "") in kept and (1, None) in kept
    if name == "decontamination":
        assert given - kept == {r for r in given if r[1] and "brown" in r[1]}
    empty = step(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == expected and empty.collect() == []


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
