"""Tables of levels: bounded parts, nothing lost or doubled, whatever dies in between."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from relaygauge.sinks.files import Files
from relaygauge.sinks.levels import LevelledTable, Manifest, Part, newest_of, summed_by

SCHEMA = StructType([StructField("k", LongType()), StructField("v", StringType())])


def table(spark, tmp_path, **options):
    settings = {"combine": newest_of(["k"]), "order": ("k",), "bound": "k", "width": 4, "grace_seconds": 0}
    return LevelledTable(spark, str(tmp_path / "t"), SCHEMA, **{**settings, **options})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_a_day_of_batches_leaves_few_parts():
    """The plan of merges alone: 86,400 batches of one second."""
    manifest, most = Manifest(), 0
    rewritten = 0
    for batch in range(86_400):
        manifest = manifest.with_part(Part(f"0-{batch}", 0, batch, batch, 1, 1))
        while sources := manifest.due(16):
            size = sum(p.size for p in sources)
            rewritten += size
            merged = Part(f"{batch}-{sources[0].level + 1}", sources[0].level + 1, sources[0].first, sources[-1].last, size, size)
            manifest = manifest.merged(sources, merged, 0.0)
        most = max(most, len(manifest.parts))
        manifest = Manifest(manifest.version, manifest.parts)
    covered = [b for p in manifest.parts for b in (p.first, p.last)]
    assert most <= 16 * 5 and rewritten <= 5 * 86_400
    assert covered == sorted(covered) and covered[0] == 0 and covered[-1] == 86_399
    assert all(a.last + 1 == b.first for a, b in zip(manifest.parts, manifest.parts[1:]))


def test_batches_merge_and_read_as_one_table(spark, tmp_path):
    own = table(spark, tmp_path)
    expected = {}
    for batch in range(22):
        part = [(k, f"{batch}-{k}") for k in range(batch % 5, 12, 5)]
        expected.update(part)
        assert own.append(rows(spark, *part), batch)
        assert dict(map(tuple, own.current().collect())) == expected
    manifest = own.manifest()
    assert [(p.level, p.first, p.last) for p in manifest.parts] == [(2, 0, 15), (1, 16, 19), (0, 20, 20), (0, 21, 21)]
    # Replaced folders and old manifests are gone, and a merged part is one sorted file.
    files = Files(spark, own.root)
    assert sorted(files.names(f"{own.root}/parts")) == sorted(p.folder.split("/")[1] for p in manifest.parts)
    assert len(files.names(f"{own.root}/manifest")) <= 2 * 8
    merged = [n for n in files.names(f"{own.root}/{manifest.parts[0].folder}") if n.startswith("part-")]
    assert len(merged) == 1
    assert own.sweep() == []


def test_a_batch_is_added_once(spark, tmp_path):
    own = table(spark, tmp_path, combine=lambda r: r)
    for batch in range(6):
        assert own.append(rows(spark, (batch, "x")), batch)
        assert not own.append(rows(spark, (batch, "again")), batch)
    # Also one that has been merged since.
    assert not own.append(rows(spark, (1, "again")), 1)
    assert sorted(map(tuple, own.current().collect())) == [(b, "x") for b in range(6)]
    # An empty batch leaves no part.
    assert own.append(rows(spark).where("false"), 6)
    assert not own.manifest().holds(6)


def test_a_writer_that_dies_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    own = table(spark, tmp_path)
    for batch in range(4):
        own.append(rows(spark, (batch, "x")), batch, merge_below=None)
    before = own.manifest()

    def die(*_):
        raise RuntimeError("killed")

    # Between the merged rows and the manifest.
    monkeypatch.setattr(LevelledTable, "_commit", die)
    with pytest.raises(RuntimeError):
        own.merge()
    with pytest.raises(RuntimeError):
        own.append(rows(spark, (9, "y")), 4)
    monkeypatch.undo()
    assert own.manifest() == before and own.current().count() == 4
    assert len(own.sweep()) == 2
    # What was not committed is done again.
    assert own.append(rows(spark, (9, "y")), 4)
    assert own.merge() == 0 and own.current().count() == 5 and len(own.manifest().parts) == 2


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    own, other = table(spark, tmp_path, grace_seconds=600), table(spark, tmp_path, grace_seconds=600)
    for batch in range(4):
        own.append(rows(spark, (batch, "x")), batch, merge_below=None)
    write = LevelledTable._write

    def slow(self, frame, folder):
        # While this merge writes, the stream adds a batch and another job merges the same parts.
        monkeypatch.setattr(LevelledTable, "_write", write)
        other.append(rows(spark, (7, "late")), 4, merge_below=None)
        other.merge()
        return write(self, frame, folder)

    monkeypatch.setattr(LevelledTable, "_write", slow)
    own.merge()
    assert sorted(map(tuple, own.current().collect())) == [(0, "x"), (1, "x"), (2, "x"), (3, "x"), (7, "late")]
    assert [(p.level, p.first, p.last) for p in own.manifest().parts] == [(1, 0, 3), (0, 4, 4)]
    assert own.sweep() == []


def test_readers_keep_folders_within_the_grace(spark, tmp_path):
    own = table(spark, tmp_path, grace_seconds=600)
    for batch in range(3):
        own.append(rows(spark, (batch, "x")), batch)
    reading = own.current()
    own.append(rows(spark, (3, "x")), 3)
    assert len(own.manifest().parts) == 1 and len(own.manifest().retired) == 4
    assert reading.count() == 3


def test_parts_beyond_a_range_are_not_read(spark, tmp_path):
    own = table(spark, tmp_path, width=100)
    for batch in range(5):
        own.append(rows(spark, *[(10 * batch + i, str(batch)) for i in range(10)]), batch)
    some = own.versions(low=12, high=25)
    assert sorted(r.k for r in some.collect()) == list(range(12, 26))
    assert len(some.inputFiles()) == 2
    assert sorted(r.k for r in own.versions(until=0).collect()) == list(range(10))


def test_sums_add_up_over_merges(spark, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("n", LongType())])
    own = LevelledTable(spark, str(tmp_path / "s"), schema, summed_by(["k"], ["n"]), width=3, grace_seconds=0)
    for batch in range(11):
        own.append(spark.range(4).select(F.col("id").alias("k"), F.lit(batch).cast("bigint").alias("n")), batch)
    assert {tuple(r) for r in own.current().collect()} == {(k, sum(range(11))) for k in range(4)}
    assert sum(p.rows for p in own.manifest().parts) < 4 * 11


def test_large_merges_are_left_to_their_job(spark, tmp_path):
    own = table(spark, tmp_path)
    for batch in range(5):
        own.append(rows(spark, (batch, "x")), batch, merge_below=1)
    assert len(own.manifest().parts) == 5
    assert own.merge() == 1 and len(own.manifest().parts) == 2


def test_files_are_made_whole_or_not_at_all(spark, tmp_path):
    files, path = Files(spark, str(tmp_path)), str(tmp_path / "new" / "a")
    assert files.names(str(tmp_path / "new")) == []
    assert files.write_new(path, "é one") and not files.write_new(path, "two")
    assert files.read(path) == "é one" and files.names(str(tmp_path / "new")) == ["a"]
    files.remove(str(tmp_path / "new"))
    assert files.names(str(tmp_path / "new")) == []
