"""The validation job: archived messages to the verdict report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.archive import drop_markers, lookup_tests
from relaygauge.operators.digests import (
    compare_slices,
    digests_of_slices,
    message_prints,
    slice_digests,
    slice_digests_ordered,
    slice_fingerprints,
)
from relaygauge.operators.positions import SLICE_SIZE, has_dense_offsets, partition_bounds
from relaygauge.operators.verdicts import validation_report
from relaygauge.session import shared_folder


def validate(
    messages: DataFrame,
    tests: DataFrame,
    marker: str | None = None,
    slice_size: int = SLICE_SIZE,
    strict: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The report on all registered tests, or on the ``wanted`` ids, in one pass over messages."""
    if marker is not None:
        messages = drop_markers(messages, marker)
    registered = lookup_tests(tests, tests if wanted is None else wanted)
    compared = compare_slices(slice_digests(messages, slice_size, strict), registered.where("status = 'FOUND'"))
    return validation_report(compared, registered)


def validate_ordered(
    located: DataFrame,
    tests: DataFrame,
    marker: str | None = None,
    slice_size: int = SLICE_SIZE,
    strict: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The report of ``validate`` on an archive that ``write_ordered`` stored."""
    if marker is not None:
        located = drop_markers(located, marker)
    registered = lookup_tests(tests, tests if wanted is None else wanted)
    digests = slice_digests_ordered(located, slice_size, strict)
    return validation_report(compare_slices(digests, registered.where("status = 'FOUND'")), registered)


def validate_by_fingerprint(
    messages: DataFrame,
    tests: DataFrame,
    marker: str | None = None,
    slice_size: int = SLICE_SIZE,
    wanted: DataFrame | None = None,
    folder: str | None = None,
    version: str | None = None,
) -> DataFrame:
    """The report of ``validate``, with payloads shuffled only where topics seem to differ.

    A first pass compares slices by prints of their messages, which are made where the
    messages lie; slices with equal ones are taken to have equal text.  Others need not differ, as
    message boundaries may have moved.  So the first of them in each test is compared by text, which
    settles the test if the texts differ; else all others of that test are compared as well.
    With ``version``, messages are the archive's versions, and prints tell which is the newest.
    Prints, bounds and what each pass finds are written below ``folder``, so each is made once.
    """
    spark = messages.sparkSession
    folder = folder or shared_folder(spark, "validation")
    if marker is not None:
        messages = drop_markers(messages, marker)
    registered = lookup_tests(tests, tests if wanted is None else wanted)
    found = registered.where("status = 'FOUND'")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    prints = stored(message_prints(messages, version), "prints")
    bounds = stored(partition_bounds(prints), "bounds")

    def compare_texts(slices: DataFrame, name: str) -> DataFrame:
        texts = compare_slices(digests_of_slices(messages, slices, slice_size, prints, version), found)
        return stored(texts.select("test_id", "slice", F.col("same").alias("same_text")), name)

    # Offsets without gaps need no sort.
    dense = has_dense_offsets(prints, bounds)
    compared = stored(compare_slices(slice_fingerprints(prints, slice_size, dense, bounds), found), "slices")
    doubtful = compared.where(~F.col("same")).select("test_id", "slice")
    if not doubtful.isEmpty():
        texts = compare_texts(doubtful.groupBy("test_id").agg(F.min("slice").alias("slice")), "first_texts")
        unsettled = doubtful.join(texts.where("same_text").select("test_id"), "test_id", "left_semi")
        rest = unsettled.join(texts, ["test_id", "slice"], "left_anti")
        if not rest.isEmpty():
            texts = texts.unionByName(compare_texts(rest, "other_texts"))
        compared = compared.join(texts, ["test_id", "slice"], "left").withColumn(
            "same", F.col("same") | F.coalesce("same_text", F.lit(False))
        )
    return validation_report(compared, registered)
