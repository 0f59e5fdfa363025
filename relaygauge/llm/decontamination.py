"""Benchmark decontamination: a prefix-filtered join of word shingles, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import (
    ALNUM,
    LOWER,
    MIX_A,
    byte_arrays,
    chunks,
    mix,
    rows_of,
    stage,
    utf8,
    word_hashes,
    word_spans,
)

WINDOW = 10  # fixed value: consecutive item words that count as an occurrence
SHINGLE = 5  # words of the tokens that windows are joined on
MAP_ROOM = 1024  # bits of the map of benchmark shingles that tasks carry, for each of them
MAP_BITS = (25, 29)  # the map has 2^25 to 2^29 bits: 4 to 64 MB; a fuller one only lets more places pass to the join


class _Words:
    """The words of some texts as spans and hashes, and the shingles that start at each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends = word_spans(self.data, offsets, ALNUM)
        self.row = rows_of(self.starts, offsets)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # of each row, and the end
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word places at which ``size`` words of one text begin, and the shingles' hashes."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        joined = np.full(n, size, np.uint64)
        for k in range(size):
            joined *= MIX_A
            joined += self.hashes[k : n + k]
        same = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return same, mix(joined[same])

    def text(self, i: int, j: int) -> str:
        """Words i to j of the joined texts, lower-cased, one blank between them."""
        return " ".join(self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.starts[i:j], self.ends[i:j]))


def _map_of(index: DataFrame, column: str) -> np.ndarray:
    """A bit for each shingle of ``index``, at a place given by its hash: the OR of the tasks' maps.

    The map grows with the number of distinct shingles.
    """
    distinct = index.select(column).distinct()
    width = min(max((MAP_ROOM * distinct.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (width - 3), np.uint8)
        for batch in batches:
            _mark(table, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()])], ["_bits"])

    table = np.zeros(1 << (width - 3), np.uint8)
    for row in distinct.coalesce(8).mapInArrow(bits, "_bits binary").toLocalIterator():
        table |= np.frombuffer(row["_bits"], np.uint8)
    return table


def _at(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits of a map that hashes fall on: by as many high bits as the map's length has."""
    return (hashes >> np.uint64(64 - (8 * len(table) - 1).bit_length())).astype(np.int64)


def _mark(table: np.ndarray, hashes: np.ndarray) -> None:
    at = _at(table, hashes)
    np.bitwise_or.at(table, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))


def _on_map(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _at(table, hashes)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def item_windows(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: (window, words, n_words, items).

    A window is ``window`` consecutive words; an item of fewer words, but not none, is one window.
    """
    words = F.filter(F.split(F.translate(F.col(text), _UPPER, _UPPER.lower()), _SPLIT), lambda w: w != "")
    last = F.greatest(F.size("_words") - window, F.lit(0))
    return (
        items.select(F.col(key).cast("string").alias("_item"), words.alias("_words"))
        .where(F.size("_words") > 0)
        .select("_item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("_words", i + 1, window))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("_item").alias("items"))
        .select(F.concat_ws(" ", "words").alias("window"), "words", F.size("words").alias("n_words"), "items")
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Each window's shingles with their places: (window, n_words, shingle, place, hash)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_arrays(batch.column("_text"))
            words = _Words(data, offsets)
            sizes = np.minimum(words.counts(), shingle)
            for size in np.unique(sizes):
                at, hashes = words.shingles(int(size))
                row = words.row[at]
                own = sizes[row] == size
                at, hashes, row = at[own], hashes[own], row[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("window").take(pa.array(row)),
                        pa.array((at - words.first[row]).astype(np.int32)),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(hashes.view(np.int64)),
                    ],
                    ["window", "place", "size", "shingle"],
                )

    rows = windows.select("window", utf8("window").alias("_text"))
    return rows.mapInArrow(hashed, "window string, place int, size int, shingle long")


def _frequencies(docs: DataFrame, text: str, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """In how many places of all texts each shingle on the map stands, counted per task first."""
    carried = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_arrays(batch.column("_text"))
            for i, j in chunks(offsets):
                words = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for size in sizes:
                    _, hashes = words.shingles(size)
                    found, n = np.unique(hashes[_on_map(carried.value, hashes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"]
                    )

    rows = docs.select(utf8(text).alias("_text")).mapInArrow(count, "shingle long, n long")
    return rows.groupBy("shingle").agg(F.sum("n").alias("frequency"))


def _places(docs: DataFrame, text: str, key: str, table: np.ndarray, sizes: list[int], reach: int) -> DataFrame:
    """Two kinds of rows: one per document (its key, row, n_words), and one per place whose shingle
    is on the map, with the words around it that a window through it can cover."""
    carried = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column("_key")
            data, offsets = byte_arrays(batch.column("_text"))
            for i, j in chunks(offsets):
                words = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words = words.counts()
                rows = np.arange(serial, serial + (j - i), dtype=np.int64)
                serial += j - i
                none = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(rows), pa.array(n_words), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string())],
                    ["_key", "_row", "n_words", "shingle", "at", "left", "around"],
                )
                for size in sizes:
                    at, hashes = words.shingles(size)
                    hit = np.flatnonzero(_on_map(carried.value, hashes))
                    if not len(hit):
                        continue
                    at, hashes = at[hit], hashes[hit]
                    row = words.row[at]
                    low = np.maximum(at - (reach - size), words.first[row])
                    high = np.minimum(at + reach, words.first[row + 1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(i, j - i).take(pa.array(row)),
                            pa.array(rows[row]),
                            pa.array(n_words[row]),
                            pa.array(hashes.view(np.int64)),
                            pa.array(at - words.first[row]),
                            pa.array(at - low),
                            pa.array([words.text(a, b) for a, b in zip(low, high)], pa.string()),
                        ],
                        ["_key", "_row", "n_words", "shingle", "at", "left", "around"],
                    )

    rows = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text"))
    return rows.mapInArrow(
        find, f"_key {kind}, _row long, n_words long, shingle long, at long, left long, around string"
    )


def _covered(spans: Column) -> Column:
    """Words covered by the (start, end) pairs, which are sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(done: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], done["upto"]), F.lit(0))
        return F.struct((done["n"] + fresh).alias("n"), F.greatest(done["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, start, step)["n"]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """(``key``, n_words, n_hit, spans, items) for each row of ``docs``.

    ``spans`` are the (start, end) word ranges of item windows found in the text, sorted; ``items``
    the ids of the items they come from, sorted as text; ``n_hit`` the words inside any span.

    Shingles of the items are ordered by how often they stand in all documents.  As a window must be
    contained whole, its rarest shingle is all the prefix it needs: only that one is joined, a place
    must leave room for the window on both sides, and the words are then compared one by one.  Tasks
    carry a bit map of fixed size to leave out places early; the join itself moves the few places
    left, and Spark splits a shingle that stands in many documents.

    A null text has no words; rows with null or equal keys are rows of their own; empty tables
    give no hits; other columns are not read.
    """
    windows = stage(item_windows(items, item_text, item_key, window), "windows")
    shingles = stage(_window_shingles(windows, shingle), "window-shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # 1 to ``shingle``
    frequency = _frequencies(docs, text, _map_of(shingles, "shingle"), sizes)
    rarest = F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "shingle", "place"))
    prefixes = stage(
        shingles.join(frequency, "shingle", "left")
        .groupBy("window")
        .agg(rarest.alias("_rarest"))
        .select("window", "_rarest.shingle", "_rarest.place"),
        "prefixes",
    )
    found = stage(_places(docs, text, key, _map_of(prefixes, "shingle"), sizes, window), "places")

    index = prefixes.join(windows.select("window", "words", F.col("n_words").alias("m")), "window")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("m") <= F.col("n_words")) & (F.col("place") <= F.col("left"))
    same = F.slice(F.split("around", " "), (F.col("left") - F.col("place") + 1).cast("int"), F.col("m")) == F.col("words")
    matches = (
        found.where("shingle IS NOT NULL")
        .join(index, "shingle")
        .where(inside & same)
        .select("_row", F.struct(start.alias("start"), (start + F.col("m")).alias("end")).alias("span"), "window")
    )
    spans = matches.groupBy("_row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    names = (
        matches.select("_row", "window")
        .distinct()
        .join(windows.select("window", F.explode("items").alias("item")), "window")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hits = spans.join(names, "_row").withColumn("n_hit", _covered(F.col("spans")))
    return (
        found.where("shingle IS NULL")
        .select("_key", "_row", "n_words")
        .join(hits, "_row", "left")
        .select(
            F.col("_key").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
