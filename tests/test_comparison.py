"""Where topics differ: descent of digest trees, slices by content."""

import pytest
from pyspark.sql import functions as F

from relaygauge.checks import fixtures as fx
from relaygauge.operators import trees
from relaygauge.operators.archive import register_tests
from relaygauge.plans.comparison import compare_by_content, first_differences
from relaygauge.schemas import MESSAGE, TOPIC
from relaygauge.sources.topics import stream_topic
from relaygauge.streaming import DRAIN
from relaygauge.streaming.archive import archive_stream, nodes_table, read_messages

FOLDER = "/root/testdata/sf0.001"
COUNT = 300


def topic(name, payloads, test="t", partitions=2):
    per = -(-len(payloads) // partitions)
    return [(test, name, i // per, i % per, p) for i, p in enumerate(payloads)]


def archive_of(spark, source, destination, test="t"):
    rows = topic("src", source, test) + topic("dst", destination, test)
    return spark.createDataFrame(rows, MESSAGE).repartition(3)


def payloads(n=COUNT):
    return [f"message {i}" for i in range(n)]


@pytest.fixture(scope="module")
def tests(spark):
    return register_tests(spark, [("t", "src", "dst")])


def nodes_of(messages, tmp_path, leaf_bits=4):
    trees.tree_nodes(messages, leaf_bits).write.parquet(str(tmp_path / "nodes"))
    return messages.sparkSession.read.parquet(str(tmp_path / "nodes"))


@pytest.mark.parametrize(
    "place,change,expected",
    [
        (None, None, (None, None, None, None, None)),
        (210, "other", (1, 60, "changed", "message 210", "other")),
        (0, "other", (0, 0, "changed", "message 0", "other")),
        (299, "", (1, 149, "changed", "message 299", "")),
    ],
)
def test_the_first_difference_is_found(spark, tests, tmp_path, place, change, expected):
    copy = payloads()
    if place is not None:
        copy[place] = change
        copy[-1] = copy[-1] + "!" if place != 299 else copy[-1]
    messages = archive_of(spark, payloads(), copy)
    row = first_differences(nodes_of(messages, tmp_path), messages, tests, leaf_bits=4).first()
    assert tuple(row)[1:] == expected


def test_lost_and_added_messages(spark, tests, tmp_path):
    messages = archive_of(spark, payloads(), payloads())
    lost = messages.where("NOT (topic = 'dst' AND partition = 1 AND offset = 7)")
    row = first_differences(nodes_of(lost, tmp_path / "a"), lost, tests, leaf_bits=4).first()
    assert (row.partition, row.offset, row.difference, row.source_payload) == (1, 7, "missing", "message 157")
    added = messages.where("NOT (topic = 'src' AND partition = 0 AND offset < 3)")
    row = first_differences(nodes_of(added, tmp_path / "b"), added, tests, leaf_bits=4).first()
    assert (row.partition, row.offset, row.difference, row.destination_payload) == (0, 0, "extra", "message 0")


def test_a_null_payload_counts_as_empty(spark, tests, tmp_path):
    rows = [("t", t, 0, 0, p) for t, p in (("src", None), ("dst", ""))]
    messages = spark.createDataFrame(rows, MESSAGE)
    assert first_differences(nodes_of(messages, tmp_path), messages, tests, leaf_bits=4).first().difference is None


def test_nodes_of_batches_add_up(spark, tests):
    messages = archive_of(spark, payloads(), payloads())
    whole = trees.tree_nodes(messages, 4)
    parts = [trees.tree_nodes(messages.where(F.pmod("offset", F.lit(3)) == i), 4) for i in range(3)]
    added = trees.added_nodes(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, whole.collect()))


def test_one_leaf_is_read(spark, tests, tmp_path):
    copy = payloads()
    copy[210] = "other"
    archive_of(spark, payloads(), copy).write.parquet(str(tmp_path / "archive"))
    messages = spark.read.schema(MESSAGE).parquet(str(tmp_path / "archive"))
    leaves = spark.createDataFrame([("t", 1, 60 >> 4)], "test_id STRING, partition INT, node BIGINT")
    some = trees.leaves_messages(messages, leaves, 4)
    assert {(r.partition, r.offset >> 4) for r in some.collect()} == {(1, 3)} and some.count() == 32
    # The bounds stand at the scan, below the join.
    scan = [line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert any(">= 48" in line and "<= 63" in line for line in scan)


def test_trees_are_kept_by_the_archive_stream(spark, tests, tmp_path):
    rows = [(t, i % 2, i // 2, None, None, bytearray(f"m{i}{'!' * (t == 'dst' and i == 31)}".encode())) for i in range(60) for t in ("src", "dst")]
    for i in range(6):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], TOPIC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    stream = stream_topic(spark, "parquet", str(tmp_path / "in"), maxFilesPerTrigger="1")
    archive_stream(stream, "t", "END", root, str(tmp_path / "check"), DRAIN, trees=True).awaitTermination()
    nodes = nodes_table(spark, root).current()
    row = first_differences(nodes, read_messages(spark, root), tests).first()
    assert (row.partition, row.offset, row.difference) == (1, 15, "changed")


def content(spark, source, destination, tests, size=10):
    row = compare_by_content(archive_of(spark, source, destination), tests, size).first()
    return row.asDict()


def test_equal_topics_align(spark, tests):
    found = content(spark, payloads(), payloads(), tests)
    assert found["aligned"] and found["source_slices"] == found["destination_slices"] > 10
    # Also where partitions are cut elsewhere: the order of all messages is what counts.
    messages = spark.createDataFrame(topic("src", payloads(), partitions=2) + topic("dst", payloads(), partitions=3), MESSAGE)
    assert compare_by_content(messages, tests, 10).first().aligned


@pytest.mark.parametrize("place", [3, 155])
def test_a_lost_message_touches_two_slices_at_most(spark, tests, place):
    copy = payloads()
    del copy[place]
    found = content(spark, payloads(), copy, tests)
    assert not found["aligned"]
    assert 1 <= found["only_source"] <= 2 and found["only_destination"] <= 2 and found["seams"] == 0
    assert found["first_lacking"] <= place + 1


def test_a_moved_block_shows_seams(spark, tests):
    source = payloads()
    found = content(spark, source, source[100:] + source[:100], tests)
    assert not found["aligned"] and found["only_source"] + found["seams"] >= 1 and found["only_source"] <= 3


def test_equal_messages_without_end(spark, tests):
    found = content(spark, ["x"] * COUNT, ["x"] * COUNT, tests)
    assert found["aligned"]
    assert not content(spark, ["x"] * COUNT, ["x"] * (COUNT - 1), tests)["aligned"]


def test_a_test_without_messages_is_aligned(spark, tests):
    messages = archive_of(spark, payloads(4), payloads(4)).where("false")
    row = compare_by_content(messages, tests).first()
    assert row.aligned and row.source_slices == 0
