"""Verdicts on relays that went wrong in known ways, against a plain model of the slice rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

from relaygauge.operators import archive, digests, positions
from relaygauge.plans.validation import validate, validate_by_fingerprint
from relaygauge.schemas import MESSAGE, TEST

PARTITIONS, PER_PARTITION, SLICE = 4, 70, 100
SCHEMA = MESSAGE


def source():
    return {(p, o): f"{p}|{o}|click" for p in range(PARTITIONS) for o in range(PER_PARTITION)}


def dropped():
    copy = source()
    del copy[(1, 17)]
    return copy


def duplicated():
    return source() | {(2, PER_PARTITION): source()[(2, 5)]}


def swapped():
    copy = source()
    copy[(0, 3)], copy[(0, 4)] = copy[(0, 4)], copy[(0, 3)]
    return copy


def edited():
    return source() | {(3, 60): "other"}


def empty_tail():
    return source() | {(PARTITIONS - 1, PER_PARTITION): ""}


def regrouped():
    copy = source()
    first, second = copy[(0, 3)], copy[(0, 4)]
    copy[(0, 3)], copy[(0, 4)] = first + second[:2], second[2:]
    return copy


RELAYS = {
    "none": (source, True, True, True),
    "drop": (dropped, False, False, False),
    "duplicate": (duplicated, False, False, False),
    "swap": (swapped, True, False, False),
    "edit": (edited, True, False, False),
    "empty tail": (empty_tail, False, True, False),
    "regroup": (regrouped, True, True, False),
}


def model(copy):
    def slices(topic):
        texts = [topic[k] for k in sorted(topic)]
        return [hashlib.md5("".join(texts[i : i + SLICE]).encode()).hexdigest() for i in range(0, len(texts), SLICE)]

    mine, theirs = slices(source()), slices(copy)
    empty = hashlib.md5(b"").hexdigest()
    length = max(len(mine), len(theirs))
    return mine + [empty] * (length - len(mine)) == theirs + [empty] * (length - len(theirs))


@pytest.fixture(scope="module")
def relays(spark):
    rows = []
    for name, (copy, *_) in RELAYS.items():
        for topic, content in (("src", source()), ("dst", copy())):
            rows += [(name, topic, p, o, text) for (p, o), text in content.items()]
            rows += [(name, topic, p, 10_000, "END") for p in range(PARTITIONS)]
    messages = spark.createDataFrame(rows, SCHEMA)
    tests = spark.createDataFrame([(name, "src", "dst") for name in RELAYS], TEST)
    return messages.repartition(5).cache(), tests


@pytest.mark.parametrize("strict", [False, True])
def test_verdicts(relays, strict):
    messages, tests = relays
    report = {r.test_id: r for r in validate(messages, tests, "END", SLICE, strict).collect()}
    for name, (copy, same_amount, ordered, ordered_strict) in RELAYS.items():
        assert report[name].same_amount == same_amount, name
        assert report[name].order_preserved == (ordered_strict if strict else ordered), name
        if not strict:
            assert report[name].order_preserved == model(copy()), name


def test_fingerprints_give_the_same_report(relays, tmp_path):
    messages, tests = relays
    one = validate(messages, tests, "END", SLICE)
    two = validate_by_fingerprint(messages, tests, "END", SLICE, folder=str(tmp_path))
    assert sorted(one.collect()) == sorted(two.collect())


def test_a_moved_boundary_before_a_change(spark, tmp_path):
    """The first doubtful slice has the same text, a later one has not."""
    copy = regrouped()
    copy[(3, 60)] = "other"
    rows = [("t", topic, p, o, text) for topic, c in (("src", source()), ("dst", copy)) for (p, o), text in c.items()]
    messages = spark.createDataFrame(rows, SCHEMA)
    tests = spark.createDataFrame([("t", "src", "dst")], TEST)
    row = validate_by_fingerprint(messages, tests, slice_size=SLICE, folder=str(tmp_path)).first()
    assert (row.order_preserved, row.first_difference) == (False, 2)
    assert validate(messages, tests, slice_size=SLICE).first() == row


@pytest.mark.parametrize("relay", list(RELAYS))
def test_prints_differ_where_messages_do(relays, relay):
    messages, tests = relays
    messages = messages.where((F.col("test_id") == relay) & (F.col("payload") != "END"))
    dense = positions.has_dense_offsets(messages)
    assert dense == (relay != "drop")
    tests = tests.where(F.col("test_id") == relay)
    strict = digests.compare_slices(digests.slice_digests(messages, SLICE, strict=True), tests)
    prints = digests.compare_slices(digests.slice_fingerprints(digests.message_prints(messages), SLICE, dense), tests)
    assert sorted(strict.select("slice", "same").collect()) == sorted(prints.select("slice", "same").collect())


def test_texts_of_chosen_slices(relays):
    messages, tests = relays
    chosen = tests.sparkSession.createDataFrame([("none", 1), ("drop", 2), ("drop", 0)], "test_id STRING, slice BIGINT")
    every = digests.slice_digests(messages, SLICE).join(chosen, ["test_id", "slice"], "left_semi")
    some = digests.digests_of_slices(messages, chosen, SLICE).select(every.columns)
    assert every.count() == 6 and every.exceptAll(some).isEmpty() and some.exceptAll(every).isEmpty()


def test_markers_count_unless_dropped(relays):
    messages, _ = relays
    raw = {(r.test_id, r.topic): r.total for r in archive.topic_counts(messages).collect()}
    clean = {(r.test_id, r.topic): r.total for r in archive.archive_counts(messages, "END").collect()}
    assert all(raw[key] == clean[key] + PARTITIONS for key in clean)


def test_report_lines_and_missing_test(spark, relays):
    messages, tests = relays
    wanted = spark.createDataFrame([("drop",), ("gone",)], "test_id STRING")
    report = {r.test_id: r for r in validate(messages, tests, "END", SLICE, wanted=wanted).collect()}
    assert report["drop"].count_line == (
        " - Destination topic contains the same amount of messages as Source topic(280 out of 279): FALSE"
    )
    assert report["drop"].order_line == " - Destination topic preserves ordering of Source topic: FALSE"
    assert report["drop"].first_difference == 0
    assert report["gone"].status == "NO_SUCH_TEST" and report["gone"].same_amount is None


def test_test_without_messages_is_in_order(spark, relays):
    messages, _ = relays
    tests = spark.createDataFrame([("idle", "src", "dst")], TEST)
    row = validate(messages, tests).first()
    assert (row.source_total, row.destination_total, row.same_amount, row.order_preserved) == (0, 0, True, True)


def test_dense_and_general_paths_agree(relays):
    messages, _ = relays
    messages = messages.where("test_id IN ('none', 'swap') AND payload <> 'END'")
    general = positions.message_positions(messages)
    dense = positions.dense_positions(messages)
    assert general.exceptAll(dense.select(general.columns)).isEmpty()
    one, two = digests.slice_digests(messages, SLICE), digests.slice_digests_dense(messages, SLICE)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_dense_offsets_are_recognised(relays):
    messages, _ = relays
    clean = messages.where("payload <> 'END'")
    assert positions.has_dense_offsets(clean.where("test_id <> 'drop'"))
    assert not positions.has_dense_offsets(clean)


def test_dense_path_refuses_gaps(relays):
    messages, _ = relays
    with pytest.raises(Exception, match="offsets have gaps"):
        positions.dense_positions(messages.where("test_id = 'drop'")).collect()


def test_null_payload_counts_as_empty(spark):
    rows = [("t", "src", 0, 0, None), ("t", "src", 0, 1, "a")]
    digest = digests.slice_digests(spark.createDataFrame(rows, SCHEMA)).first()
    assert digest.messages == 2 and digest.digest == hashlib.md5(b"a").hexdigest()


def test_row_key_order_is_textual(spark):
    rows = [("t", "src", 0, offset, f"<{offset}>") for offset in (1, 2, 10, 11, 100)]
    digest = digests.slice_digests_by_row_key(spark.createDataFrame(rows, SCHEMA)).first()
    assert digest.digest == hashlib.md5(b"<1><10><100><11><2>").hexdigest()


def test_colliding_row_keys_have_one_digest(spark):
    rows = [("t", topic, p, o, f"{p}/{o}") for topic in ("src", "dst") for p in range(12) for o in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = set()
    for seed in range(3):
        mixed = frame.orderBy(F.rand(seed)).repartition(3 + seed)
        compared = digests.compare_slices(digests.slice_digests_by_row_key(mixed, 50), spark.createDataFrame([("t", "src", "dst")], TEST))
        assert compared.where("NOT same").isEmpty()
        found.add(tuple(r.source_digest for r in compared.orderBy("slice").collect()))
    assert len(found) == 1


def test_versions_are_settled_by_prints(spark, tmp_path):
    old = [("t", topic, p, o, f"old{p}") for topic in ("src", "dst") for p in range(2) for o in range(20)]
    new = [(*row[:4], f"{row[2]}|{row[3]}") for row in old]
    changed = [(*row[:4], row[4] + ("!" if row[1:4] == ("dst", 1, 7) else "")) for row in new]
    frames = [spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(i)) for i, rows in enumerate((old, new, changed))]
    tests = spark.createDataFrame([("t", "src", "dst")], TEST)
    for upto, ordered, first in ((2, True, None), (3, False, 2)):
        versions = frames[0]
        for frame in frames[1:upto]:
            versions = versions.unionByName(frame)
        row = validate_by_fingerprint(versions, tests, slice_size=10, folder=str(tmp_path / str(upto)), version="v").first()
        assert (row.same_amount, row.source_total, row.order_preserved, row.first_difference) == (True, 40, ordered, first)


def test_row_keys_collide(spark):
    rows = [("t", "src", 1, 12, "first", 0), ("t", "src", 11, 2, "second", 1)]
    messages = spark.createDataFrame(rows, "test_id STRING, topic STRING, partition INT, offset BIGINT, payload STRING, v BIGINT")
    assert [r.payload for r in archive.archive_messages_by_row_key(messages, "v").collect()] == ["second"]
    assert archive.archive_messages(messages, "v").count() == 2


def test_progress_ignores_extra_markers(spark):
    tests = spark.createDataFrame([("t", "src", "dst")], TEST)
    rows = [("t", "src", 0, 1, "END"), ("t", "src", 0, 2, "END"), ("t", "dst", 0, 1, "x"), ("t", "dst", 1, 1, "END")]
    progress = archive.stream_progress(spark.createDataFrame(rows, SCHEMA), tests, 2, "END")
    seen = {(r.topic, r.partition): (r.markers, r.done) for r in progress.collect()}
    assert seen == {("src", 0): (2, True), ("src", 1): (0, False), ("dst", 0): (0, False), ("dst", 1): (1, True)}


def test_topics_may_differ_in_partitions(spark):
    tests = spark.createDataFrame([("t", "src", "dst")], TEST)
    markers = archive.marker_values(tests, {"src": 3, "dst": 1}, "END").collect()
    assert sorted((r.topic, r.partition, bytes(r.value)) for r in markers) == [("dst", 0, b"END"), *[("src", p, b"END") for p in range(3)]]


def test_undecodable_bytes_do_not_fail(spark):
    rows = spark.createDataFrame([("src", 0, 0, bytearray(b"a\xff"))], "topic STRING, partition INT, offset BIGINT, value BINARY")
    assert archive.project_messages(rows, "t").first().payload == "�61FF"


def test_payloads_differ_where_bytes_do(spark):
    values = [b"a\xff", b"a\xfe", "�61FF".encode(), b"", b"a"]
    rows = spark.createDataFrame([("src", 0, i, bytearray(v)) for i, v in enumerate(values)], "topic STRING, partition INT, offset BIGINT, value BINARY")
    assert archive.project_messages(rows, "t").select("payload").distinct().count() == len(values)


def test_invalid_arguments(spark):
    with pytest.raises(ValueError):
        archive.register_tests(spark, [("t", "", "dst")])
    ids = [r.test_id for r in archive.register_tests(spark, [("a", "b"), ("a", "b")]).collect()]
    assert len(set(ids)) == 2 and all(ids)
    with pytest.raises(ValueError):
        archive.end_markers(spark.createDataFrame([("t", "a", "b")], TEST), 0, "END")
    with pytest.raises(ValueError):
        positions.slice_number(F.col("position"), 0)
