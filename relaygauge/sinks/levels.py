"""Tables that grow by batches and merge by levels, under a manifest.

Each batch adds a part of level 0.  As soon as a level has ``width`` parts, the oldest of them are
merged into one part of the next level, so a table of n batches has some ``width * log(n)`` parts, and a row is
rewritten once per level.  The manifest lists the parts that make up the table.  Every change of it is a
new version, made by one rename that fails if another writer was first: readers see either the parts
before a merge or the one after it, and a merge that dies leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relaygauge.sinks.files import Files
from relaygauge.sinks.tables import BATCH

WIDTH = 16
FILE_BYTES = 128 << 20
# Versions of the manifest that stay for readers and writers that are behind.
MANIFESTS = 8


@dataclass(frozen=True)
class Part:
    """A folder with the rows of the batches ``first`` to ``last``; ``low`` and ``high`` bound one of its columns."""

    folder: str
    level: int
    first: int
    last: int
    size: int
    rows: int
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Manifest:
    """The parts of a table in the order of their batches, and folders that merges have replaced, with the time."""

    version: int = -1
    parts: tuple[Part, ...] = ()
    retired: tuple[tuple[str, float], ...] = ()

    def holds(self, batch: int) -> bool:
        return any(p.first <= batch <= p.last for p in self.parts)

    def with_part(self, part: Part) -> Manifest:
        parts = sorted([*self.parts, part], key=lambda p: p.first)
        return replace(self, parts=tuple(parts))

    def merged(self, sources: Sequence[Part], result: Part, now: float) -> Manifest | None:
        """With one part in place of its sources, None if they are not all there any more."""
        if not set(sources) <= set(self.parts):
            return None
        rest = tuple(p for p in self.parts if p not in sources)
        retired = self.retired + tuple((p.folder, now) for p in sources)
        return replace(self, parts=rest, retired=retired).with_part(result)

    def due(self, width: int, most_bytes: int | None = None) -> list[Part]:
        """The oldest ``width`` parts of the lowest level that has as many, if any."""
        for level in sorted({p.level for p in self.parts}):
            same = [p for p in self.parts if p.level == level][:width]
            if len(same) == width and (most_bytes is None or sum(p.size for p in same) <= most_bytes):
                return same
        return []


@dataclass(frozen=True)
class LevelledTable:
    """A table below ``root`` whose rows carry their batch.

    ``combine`` makes the rows of several batches into those that stay: it gets and gives the
    columns of ``schema`` and the batch.  ``order`` is how merged parts are sorted, and ``bound`` a whole-number
    column by whose range parts are left out when reading.
    """

    spark: SparkSession
    root: str
    schema: StructType
    combine: Callable[[DataFrame], DataFrame] = lambda rows: rows
    order: tuple[str, ...] = ()
    bound: str | None = None
    width: int = WIDTH
    file_bytes: int = FILE_BYTES
    grace_seconds: float = 3600

    def _files(self) -> Files:
        return Files(self.spark, self.root)

    @property
    def stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField(BATCH, LongType())])

    def manifest(self) -> Manifest:
        """The newest version; an older one may vanish while it is read, then the next is there."""
        files = self._files()
        while True:
            names = sorted(n for n in files.names(f"{self.root}/manifest") if n.startswith("v"))
            if not names:
                return Manifest()
            try:
                text = files.read(f"{self.root}/manifest/{names[-1]}")
            except Exception:
                if names[-1] in files.names(f"{self.root}/manifest"):
                    raise
                continue
            known = json.loads(text)
            parts = tuple(Part(**p) for p in known["parts"])
            return Manifest(known["version"], parts, tuple((f, t) for f, t in known["retired"]))

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Put a change through, on top of whatever others have committed; False if it no longer applies."""
        files = self._files()
        while True:
            before = self.manifest()
            after = change(before)
            if after is None or after == before:
                return after is not None
            now = time.time()
            over = [f for f, t in after.retired if t + self.grace_seconds <= now]
            version = before.version + 1
            text = {
                "version": version,
                "parts": [asdict(p) for p in after.parts],
                "retired": [r for r in after.retired if r[0] not in over],
            }
            if files.write_new(f"{self.root}/manifest/v{version:012d}", json.dumps(text)):
                break
        # Nobody is led to these any more.
        for folder in over:
            files.remove(f"{self.root}/{folder}")
        if version >= MANIFESTS:
            files.remove(f"{self.root}/manifest/v{version - MANIFESTS:012d}")
        return True

    def _write(self, rows: DataFrame, folder: str) -> tuple[int, int | None, int | None]:
        seen = Observation()
        low, high = (F.min(self.bound), F.max(self.bound)) if self.bound else (F.lit(None), F.lit(None))
        bounds = [low.cast("bigint").alias("low"), high.cast("bigint").alias("high")] if self.bound else []
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *bounds)
        watched.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        found = seen.get
        return found["rows"], found.get("low"), found.get("high")

    def append(self, rows: DataFrame, batch: int, files: int | None = 1, merge_below: int | None = 256 << 20) -> bool:
        """Add a batch; one that the table has already is not added again, whatever has become of its part.

        Merges that are due follow if they rewrite at most ``merge_below`` bytes; ``merge`` does the others.
        """
        if self.manifest().holds(batch):
            return False
        folder = f"parts/0-{batch}"
        own = rows.select(*self.schema.names, F.lit(batch).cast("bigint").alias(BATCH))
        if files is not None:
            own = own.repartition(files)
        count, low, high = self._write(own, folder)
        if not count:
            self._files().remove(f"{self.root}/{folder}")
            return True
        part = Part(folder, 0, batch, batch, self._files().size(f"{self.root}/{folder}"), count, low, high)
        self._commit(lambda m: m if m.holds(batch) else m.with_part(part))
        if merge_below:
            self.merge(merge_below)
        return True

    def merge(self, most_bytes: int | None = None) -> int:
        """Merge what is due, beside readers and the writer of batches; returns how many merges were made."""
        made = 0
        while sources := self.manifest().due(self.width, most_bytes):
            level, first, last = sources[0].level + 1, sources[0].first, sources[-1].last
            folder = f"parts/{level}-{first}-{last}-{uuid.uuid4().hex[:8]}"
            rows = self.combine(self._scan(sources)).select(*self.stored.names)
            size = max(1, -(-sum(p.size for p in sources) // self.file_bytes))
            if self.order:
                rows = (rows.coalesce(1) if size == 1 else rows.repartitionByRange(size, *self.order)).sortWithinPartitions(*self.order)
            else:
                rows = rows.coalesce(size)
            count, low, high = self._write(rows, folder)
            result = Part(folder, level, first, last, self._files().size(f"{self.root}/{folder}"), count, low, high)
            if self._commit(lambda m: m.merged(sources, result, time.time())):
                made += 1
            else:
                self._files().remove(f"{self.root}/{folder}")
        return made

    def sweep(self) -> list[str]:
        """Remove folders that writers left when they died; no writer may be at work."""
        files, manifest = self._files(), self.manifest()
        known = {p.folder for p in manifest.parts} | {f for f, _ in manifest.retired}
        lost = [f"parts/{n}" for n in files.names(f"{self.root}/parts") if f"parts/{n}" not in known]
        for folder in lost:
            files.remove(f"{self.root}/{folder}")
        return lost

    def _scan(self, parts: Sequence[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.root}/{p.folder}" for p in parts])

    def versions(self, low: int | None = None, high: int | None = None, until: int | None = None) -> DataFrame:
        """All rows as batches or merges left them, with their batch: of a range of ``bound``, of batches up to one.

        Each batch is in one part, so nothing is read twice.
        """
        parts = [
            p
            for p in self.manifest().parts
            if (until is None or p.first <= until)
            and (low is None or p.high is None or p.high >= low)
            and (high is None or p.low is None or p.low <= high)
        ]
        rows = self._scan(parts)
        if until is not None:
            rows = rows.where(F.col(BATCH) <= until)
        if low is not None:
            rows = rows.where(F.col(self.bound) >= low)
        if high is not None:
            rows = rows.where(F.col(self.bound) <= high)
        return rows

    def current(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows of the table."""
        return self.combine(self.versions(low, high)).select(*self.schema.names)


def newest_of(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows with the same key the one of the latest batch."""

    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c != BATCH]
        newest = F.max(F.struct(BATCH, *rest)).alias("_newest")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")

    return combine


def summed_by(keys: Sequence[str], sums: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Rows with the same key added up."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max(BATCH).alias(BATCH))

    return combine
