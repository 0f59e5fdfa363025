"""What the plans must keep to at scale: shuffles, pruning, no cross joins, no Python workers."""

import re

import pytest
from pyspark.sql import functions as F

from relaygauge.checks import fixtures as fx
from relaygauge.checks.queries import QUERIES
from relaygauge.operators import digests, latencies, positions, rolling, synthetic
from relaygauge.operators.archive import project_messages
from relaygauge.schemas import MESSAGE
from relaygauge.sources.topics import from_latest

FOLDER = "/root/testdata/sf0.001"
EAGER = ("stream_", "validation_report_fingerprint", "validation_report_gapless")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffled(text):
    """Exchanges of the plan with the operator tree below the root only."""
    return re.findall(r"Exchange (\w+)", text)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "archive")
    fx.archive(spark, FOLDER).write.parquet(path)
    return spark.read.schema(MESSAGE).parquet(path)


def test_digests_move_payloads_once(messages):
    text = plan(digests.slice_digests(messages))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert sum("payload" in s for s in scans) == 1
    # From the window down to the scan of payloads there is one shuffle; slices are digested
    # on it without another, and only their edges go through the last one.
    spine = text.split("Union")[0]
    assert len(shuffled(spine)) == 2
    assert spine.count("ObjectHashAggregate") == 4


def test_strict_digests_move_no_payload(messages):
    text = plan(digests.slice_digests(messages, strict=True))
    union = text.split("Union")[1]
    first = union.splitlines()[1]
    assert "md5" in first and "_text" in first


def test_dense_digests_shuffle_once(spark, messages):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dense = messages.where("test_id = 'faithful'").withColumn("partition", F.lit(0))
        text = plan(digests.slice_digests_dense(dense))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Bounds are small here, so no message is shuffled to meet them, only to the slices.
    assert "BroadcastHashJoin" in text and "Sort [" not in text.split("+- Window")[0]


def test_prints_combine_before_the_shuffle(messages):
    dense = messages.where("test_id = 'faithful'").withColumn("partition", F.lit(0))
    text = plan(digests.slice_fingerprints(digests.message_prints(dense), dense=True))
    assert "partial_bit_xor" in text
    assert "payload" not in text.split("partial_bit_xor")[0]


def test_versions_move_no_payload(messages):
    text = plan(digests.slice_fingerprints(digests.message_prints(messages.withColumn("v", F.lit(1)), "v")))
    for part in text.split("Exchange")[1:]:
        assert "payload" not in part.splitlines()[0]
    # The only use of a payload is its print, where it is read.
    assert all("xxhash64" in line or "FileScan" in line or "coalesce" in line for line in text.splitlines() if "payload" in line)


def test_windows_unfold_after_the_shuffle(spark):
    text = plan(rolling.rolling_averages(fx.buckets(spark, FOLDER)))
    below = text.split("REPARTITION_BY_COL")[1]
    assert "Generate inline" in text.split("REPARTITION_BY_COL")[0] and "Generate inline" not in below.split("Aggregate")[0]


def test_counting_reads_no_payload(messages):
    text = plan(messages.groupBy("test_id", "topic").count())
    assert "payload" not in text
    general = plan(positions.message_positions(messages).select("partition", "offset", "position"))
    assert "payload" not in general


def test_filters_reach_the_scan(messages):
    text = plan(messages.where("test_id = 'faithful' AND topic = 'src'").select("test_id", "topic", "payload"))
    assert "EqualTo(test_id,faithful)" in text and "EqualTo(topic,src)" in text
    assert "ReadSchema: struct<test_id:string,topic:string,payload:string>" in text


def test_one_topic_is_filtered_below_the_window(messages):
    text = plan(positions.message_positions(messages).where("topic = 'src'"))
    assert text.count("EqualTo(topic,src)") >= 2


def test_latest_start_reaches_the_scan(spark, tmp_path):
    fx.records(spark, FOLDER).write.parquet(str(tmp_path / "r"))
    text = plan(from_latest(spark.read.parquet(str(tmp_path / "r")), 1_705_000_000_000_000, "arrived_at"))
    assert "GreaterThanOrEqual(arrived_at" in text


def test_buckets_aggregate_before_the_shuffle(spark):
    text = plan(latencies.latency_buckets(fx.records(spark, FOLDER)))
    assert shuffled(text) == ["hashpartitioning"] and "partial_sum" in text


def test_six_windows_take_one_shuffle(spark):
    names = ["topic", "partition", "consumerid", "eventname"]
    series = [F.col("id").cast("string").alias(c) for c in names]
    buckets = spark.range(10).select(*series, *[F.col("id").alias(c) for c in ("second", "total", "cnt")])
    text = plan(rolling.rolling_averages(buckets))
    assert shuffled(text) == ["hashpartitioning"] and text.count("Window [") == 1


def test_budget_cut_shuffles_no_rows(spark):
    shape = synthetic.Shape("s", 10, 50)
    text = plan(synthetic.line_dataset(spark, 10_000, shape))
    main = text.split("Subquery")[0] if "Subquery" in text else text
    assert "Exchange" not in main.split("+- Filter")[0]
    assert "ScalarSubquery" in text or "Subquery" in text


def test_decoding_needs_no_shuffle(spark):
    rows = spark.createDataFrame([("t", 0, 0, bytearray(b"x"))], "topic STRING, partition INT, offset BIGINT, value BINARY")
    assert "Exchange" not in plan(project_messages(rows, "t"))
    assert "Exchange" not in plan(QUERIES["fallback_decode"](spark, FOLDER))
    assert "Exchange" not in plan(QUERIES["wire_frame_split"](spark, FOLDER))
