"""Archives stored in order: same reports, and plans that move no payload."""

import re

import pytest
from pyspark.sql import functions as F

from relaygauge.checks import fixtures as fx
from relaygauge.operators import digests, positions
from relaygauge.operators.archive import end_markers, register_tests
from relaygauge.plans.validation import validate, validate_ordered
from relaygauge.schemas import MESSAGE, TOPIC
from relaygauge.sinks.ordered import _name, read_ordered, write_ordered
from relaygauge.sources.topics import stream_topic
from relaygauge.streaming import DRAIN
from relaygauge.streaming.archive import archive_stream, messages_table, order_archive, read_messages

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered") / "a")
    write_ordered(fx.marked_archive(spark, FOLDER), path, 5)
    return path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reports_are_the_same(spark, path):
    tests = fx.tests(spark)
    for strict in (False, True):
        plain = validate(fx.marked_archive(spark, FOLDER), tests, fx.MARKER, strict=strict).collect()
        ordered = validate_ordered(read_ordered(spark, path), tests, fx.MARKER, strict=strict).collect()
        assert sorted(ordered) == sorted(plain) and len(plain) == 3


@pytest.mark.parametrize("strict", [False, True])
def test_digests_are_made_where_messages_lie(spark, path, strict):
    text = plan(digests.slice_digests_ordered(read_ordered(spark, path), strict=strict))
    # From the scan of payloads up to the digests of whole slices: no Exchange.  The lines of a plan lead from the
    # result down to its first scan, and the scan with payloads is the first.
    spine = text[: text.index("FileScan")].splitlines()
    first = next(i for i, line in enumerate(spine) if "Exchange" in line)
    below = [line for line in spine[first + 1 :] if "Exchange" in line]
    assert below == [] and "Window" in "".join(spine) and "md5" in "".join(spine[first:])
    assert "payload" in re.search(r"ReadSchema: (struct<[^>]*>)", text)[1]
    assert sum("payload" in s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == 1
    # Only texts at the edges of buckets leave: whole slices go as digests.
    assert "CASE WHEN NOT" in "".join(spine)


def test_validation_reads_payloads_in_place(spark, path):
    text = plan(validate_ordered(read_ordered(spark, path), fx.tests(spark), fx.MARKER))
    for part in text.split("Exchange")[1:]:
        assert "payload" not in part.splitlines()[0]
    assert "Bucketed: true" in text


def test_positions_with_gaps_and_large_offsets(spark, tmp_path):
    rows = [("t", topic, p, o * 7919 + p, f"{topic}{p}{o}") for topic in ("src", "dst") for p in range(3) for o in range(100)]
    rows += [("t", "src", 2, 2**40 + i, "far") for i in range(5)]
    messages = spark.createDataFrame(rows, MESSAGE).repartition(4)
    stored = write_ordered(messages, str(tmp_path / "a"), 3)
    plain = positions.message_positions(messages).select("topic", "partition", "offset", "position")
    counted, _ = positions.stored_positions(stored)
    assert sorted(map(tuple, counted.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_an_archive_opens_in_another_session(spark, path):
    spark.sql(f"DROP TABLE {_name(path)}")
    again = read_ordered(spark, path)
    assert again.count() == fx.marked_archive(spark, FOLDER).count()
    assert "Bucketed: true" in plan(digests.slice_digests_ordered(again))
    assert again.schema["offset"].dataType == MESSAGE["offset"].dataType


def test_an_archive_is_not_overwritten(spark, path):
    with pytest.raises(Exception, match="already"):
        write_ordered(fx.archive(spark, FOLDER), path, 2)


def test_empty_archive(spark, tmp_path):
    stored = write_ordered(spark.createDataFrame([], MESSAGE), str(tmp_path / "a"))
    assert digests.slice_digests_ordered(stored).collect() == []


def test_a_streamed_archive_is_ordered_and_merged(spark, tmp_path):
    rows = [("src", i % 2, i // 2, None, None, bytearray(f"m{i}".encode())) for i in range(60)]
    for i in range(20):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], TOPIC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    stream = stream_topic(spark, "parquet", str(tmp_path / "in"), maxFilesPerTrigger="1")
    archive_stream(stream, "run", "END", root, str(tmp_path / "check"), DRAIN).awaitTermination()
    assert [(p.level, p.first, p.last) for p in messages_table(spark, root).manifest().parts][0] == (1, 0, 15)
    # No message came twice, so payloads are read where they lie.
    assert "Exchange" not in plan(read_messages(spark, root))
    stored = order_archive(spark, root, str(tmp_path / "ordered"), 2)
    assert sorted((r.partition, r.offset, r.payload) for r in stored.collect()) == sorted((p, o, v.decode()) for _, p, o, _, _, v in rows)


def test_copies_in_later_batches_replace_earlier_ones(spark, tmp_path):
    table = messages_table(spark, str(tmp_path))
    for batch in range(3):
        rows = [("t", "src", 0, o, f"{batch}-{o}") for o in range(batch, 5)]
        table.append(spark.createDataFrame(rows, MESSAGE), batch)
    assert sorted((r.offset, r.payload) for r in read_messages(spark, str(tmp_path)).collect()) == [
        (o, f"{min(o, 2)}-{o}") for o in range(5)
    ]


def test_a_topic_without_a_number_of_partitions_is_an_error(spark):
    tests = register_tests(spark, [("run", "src", "dst")])
    assert end_markers(tests, {"src": 2, "dst": 1}, "END").count() == 3
    with pytest.raises(Exception, match="no number of partitions is given for topic dst"):
        end_markers(tests, {"src": 2}, "END").collect()
    assert end_markers(tests.select("test_id", F.lit("src").alias("source_topic"), F.lit("src").alias("destination_topic")), {"src": 2}, "END").count() == 4
