"""Near-duplicate texts: a chosen-path join over word shingles, verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.components import components
from relaygauge.llm.decontamination import _Words
from relaygauge.llm.frames import MIX_A, byte_arrays, chunks, finished, mix, stage, utf8

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999  # of a pair that is just similar enough, over all runs
DEPTH = 3  # levels of splitting
BUCKET = 64  # larger buckets are split again, as long as there is a level left
SKETCH = 64  # bytes of a set's sketch, one per minimum
SLACK = 0.25  # how far below the similarity a sketch may lie: a pair of 0.8 fails this once in 200,000
BLOCK = 1024  # sets that are compared with each other in one go
BITMAP_BYTES = 4096  # fixed value: of a bitmap of Spark's bitmap functions
BITMAPS = 1 << 13  # bitmaps of wanted sets that tasks may carry: 32 MB; beyond, all sets are shuffled
TOKEN_BYTES = 5  # of a shingle's hash


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Runs after which a pair of this similarity has met in a bucket of the last level with
    probability ``recall``.

    A set follows 1 / similarity tokens per node on average.  Two sets share at least
    ``similarity`` times the larger one, so they follow one token together, or more.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _sets(words: _Words, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, joined, and their offsets.  A text of fewer words than a
    shingle, but not none, is one shingle."""
    at, hashes = words.shingles(shingle)
    owner = words.row[at]
    counts = words.counts()
    for size in range(1, shingle):
        short = np.flatnonzero(counts == size)
        if len(short):
            at, more = words.shingles(size)
            mine = np.isin(words.row[at], short)
            owner, hashes = np.concatenate([owner, words.row[at][mine]]), np.concatenate([hashes, more[mine]])
    tokens = hashes >> np.uint64(64 - 8 * TOKEN_BYTES)
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
    owner, tokens = owner[fresh], tokens[fresh]
    return tokens, np.searchsorted(owner, np.arange(rows + 1))


def _paths(tokens: np.ndarray, bounds: np.ndarray, runs: int, similarity: float, depth: int) -> np.ndarray:
    """Chosen paths: rows of (set, key of level 1, ..., key of the last level).

    At each node a set follows the tokens whose hash under that node lies below
    1 / (similarity * its size), so sets follow shared tokens together.
    """
    sizes = np.diff(bounds)
    bar = np.minimum(2.0**63 / np.maximum(similarity * sizes, 1), 2.0**63 - 1025).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    base = mix(tokens)
    rows = [np.zeros((depth + 1, 0), np.uint64)]

    def note(sets: np.ndarray, keys: list[np.ndarray]) -> None:
        gone = [np.zeros(len(sets), np.uint64)] * (depth - len(keys))
        rows.append(np.stack([sets.astype(np.uint64), *keys, *gone]))

    for run in range(runs):
        root = mix(np.array([run + 1], np.uint64))[0]
        chosen = np.flatnonzero(mix(base ^ root) >> np.uint64(1) < bar[owner])
        sets, keys = owner[chosen], [mix(base[chosen] + root)]
        for _ in range(depth - 1):
            # All tokens of the set, again, under each node that it has reached.
            n = sizes[sets]
            of = np.repeat(np.arange(len(n)), n)
            first = bounds[sets] - np.cumsum(n) + n
            token = base[first[of] + np.arange(len(of))]
            node = keys[-1][of]
            good = np.flatnonzero(mix(token ^ node) >> np.uint64(1) < bar[sets[of]])
            last = np.ones(len(sets), bool)
            last[of[good]] = False
            note(sets[last], [k[last] for k in keys])
            sets, keys = sets[of[good]], [k[of[good]] for k in keys] + [mix(token[good] + node[good])]
        note(sets, keys)
    return np.concatenate(rows, axis=1)


def _sketches(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A byte of each of SKETCH minimal hashes per set that is not empty."""
    out = np.zeros((len(bounds) - 1, SKETCH), np.uint8)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        base = mix(tokens + np.uint64(1))
        for k in range(SKETCH):
            least = np.minimum.reduceat((base ^ (base >> np.uint64(31))) * np.uint64(2 * k * 0x9E3779B97F4A7 + 1) + base, bounds[full])
            out[full, k] = (mix(least) >> np.uint64(56)).astype(np.uint8)
    return out


def shingle_sets(docs: DataFrame, text: str, key: str, shingle: int, similarity: float, recall: float, depth: int) -> DataFrame:
    """(_key, row, size, hi, lo, sketch, paths, tokens) of each document: ``hi`` and ``lo`` are a digest of
    its set, paths and tokens are packed."""
    runs = runs_for(recall, similarity, depth)
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = byte_arrays(batch.column("_text"))
            for i, j in chunks(offsets):
                n = j - i
                words = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                tokens, bounds = _sets(words, n, shingle)
                packed = np.ascontiguousarray(tokens[:, None].view(np.uint8)[:, :TOKEN_BYTES])
                sets = [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                paths = _paths(tokens, bounds, runs, similarity, depth)
                paths = paths[:, np.argsort(paths[0], kind="stable")]
                cut = np.searchsorted(paths[0], np.arange(n + 1, dtype=np.uint64))
                keys = paths[1:].T.astype(np.uint64)
                rows = np.arange(serial, serial + n, dtype=np.int64)
                digests = np.frombuffer(b"".join(hashlib.md5(s).digest() for s in sets), np.int64).reshape(n, 2)
                serial += n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key").slice(i, n),
                        pa.array(rows),
                        pa.array(np.diff(bounds)),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array([s.tobytes() for s in _sketches(tokens, bounds)], pa.binary()),
                        pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                        pa.array(sets, pa.binary()),
                    ],
                    ["_key", "row", "size", "hi", "lo", "sketch", "paths", "tokens"],
                )

    rows = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text"))
    return rows.mapInArrow(
        build, f"_key {kind}, row long, size long, hi long, lo long, sketch binary, paths binary, tokens binary"
    )


def _unfold(depth: int, level: int, bucket: int):
    """A row for each node of a level that a set reaches: its key, that of the node above and the set.

    Equal sets of a batch are one row.  A node that more than ``bucket`` sets of a batch reach is one
    row for all of them, marked as crowded, where a further level will split it.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_arrays(batch.column("paths"))
            keys = data.view(np.int64).reshape(-1, depth)
            place = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // (8 * depth))
            key, above = keys[:, level], keys[:, max(level - 1, 0)]
            hi, lo = (batch.column(c).to_numpy()[place] for c in ("hi", "lo"))
            # Paths of one set that part further down share the node; a key of 0 is no node.
            order = np.lexsort((lo, hi, key))
            key, above, hi, lo = key[order], above[order], hi[order], lo[order]
            fresh = key != 0
            fresh[1:] &= (key[1:] != key[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            key, above, hi, lo = key[fresh], above[fresh], hi[fresh], lo[fresh]
            crowded = np.zeros(len(key), bool)
            if level < depth - 1 and len(key):
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(first, len(key)))
                crowded = np.repeat(size > bucket, size)
                keep = ~crowded
                keep[first] = True
                key, above, hi, lo, crowded = key[keep], above[keep], hi[keep], lo[keep], crowded[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(above), pa.array(key), pa.array(hi), pa.array(lo), pa.array(crowded)],
                ["above", "bucket", "hi", "lo", "crowded"],
            )

    return unfold


_COMPARE, _SPLIT, _JOIN = 0, 1, 2  # what becomes of a bucket's sets, or of the bucket


def _meetings(bucket: int, last: bool):
    """What becomes of each bucket; rows come sorted by bucket and set.

    Buckets of one set are left out.  Up to ``bucket`` sets are to be compared.  A larger bucket is
    named, to be split; at the ``last`` level its sets are joined to the least of them instead.  No
    more than ``bucket`` sets are held back from one batch to the next.
    """

    def rows_of(kind: int, key: np.ndarray, hi: np.ndarray, lo: np.ndarray, to_hi: np.ndarray, to_lo: np.ndarray) -> pa.RecordBatch:
        kinds = np.full(len(key), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (kinds, key, hi, lo, to_hi, to_lo)], ["kind", "bucket", "hi", "lo", "to_hi", "to_lo"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in _then_none(batches):
            if batch is not None:
                fresh = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "hi", "lo", "crowded")]
                held = [np.concatenate(pair) for pair in zip(held, fresh)]
            key, hi, lo, crowded = held
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            marked = np.logical_or.reduceat(crowded, first)
            new = np.append(True, (key[1:] != key[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
            key, hi, lo = key[new], hi[new], lo[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            large = marked | (size > bucket)
            open_ = np.zeros(len(first), bool)
            open_[-1] = batch is not None
            compare = np.flatnonzero(np.repeat(~large & ~open_ & (size > 1), size))
            yield rows_of(_COMPARE, key[compare], hi[compare], lo[compare], hi[compare], lo[compare])
            if last:
                # Also of a bucket that goes on: its least set is held back, the others are done with.
                of = np.repeat(first, size)
                join = np.flatnonzero(np.repeat(large, size) & (np.arange(len(key)) != of))
                yield rows_of(_JOIN, key[join], hi[join], lo[join], hi[of[join]], lo[of[join]])
            else:
                split = first[large & ~open_]
                yield rows_of(_SPLIT, key[split], hi[split], lo[split], hi[split], lo[split])
            start = len(key) if batch is None else first[-1]
            end = start + 1 if large[-1] else len(key)
            held = [key[start:end], hi[start:end], lo[start:end], np.full(len(key[start:end]), bool(large[-1]))]

    return settle


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near(sizes: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets may reach the similarity by their sizes: those of other sizes cannot."""
    return np.minimum.outer(sizes, others) >= similarity * np.maximum.outer(sizes, others) - 1e-9


def _alike(sketch: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets are likely to reach the similarity, by their sizes and sketches."""
    enough = math.ceil((similarity - SLACK) * SKETCH)
    equal = np.zeros((len(sketch), len(others)), np.uint8)
    for k in range(SKETCH):
        equal += sketch[:, k, None] == others[None, :, k]
    return (equal >= enough) & _near(sizes, other_sizes, similarity)


def _spanning(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b (as places in ``rows``) reduced to one per row: to the least of its component."""
    root = np.argsort(np.argsort(rows, kind="stable"), kind="stable")
    back = np.argsort(rows, kind="stable")
    label = root.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[back[label]])
        if (label == before).all():
            break
    moved = np.flatnonzero(label != root)
    return rows[moved], rows[back[label[moved]]]


def _bucket_links(similarity: float):
    """Compares the sets of each bucket by sketch; rows come sorted by bucket."""

    def links_of(rows: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(np.triu(_alike(sketch, sizes, sketch, sizes, similarity), 1))
        return _spanning(rows, a, b)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket = table.column("bucket").to_numpy()
            rows, sizes = table.column("row").to_numpy(), table.column("size").to_numpy()
            data, _ = byte_arrays(table.column("sketch").combine_chunks())
            sketch = data.reshape(-1, SKETCH)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            a, b = [], []
            for i, j in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])):
                if j - i == 2:  # most buckets
                    if (sketch[i] == sketch[i + 1]).sum() < (similarity - SLACK) * SKETCH or min(sizes[i], sizes[i + 1]) < similarity * max(sizes[i], sizes[i + 1]):
                        continue
                    a.append([max(rows[i], rows[i + 1])])
                    b.append([min(rows[i], rows[i + 1])])
                elif j - i > 2:
                    x, y = links_of(rows[i:j], sizes[i:j], sketch[i:j])
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            bucket = table.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if last:
                yield from settle(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from settle(held)

    return compare


def candidate_links(sets: DataFrame, classes: DataFrame, similarity: float, depth: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): rows of ``classes`` that met in a bucket and look alike, as spanning links.

    ``sets`` may hold equal sets many times, ``classes`` has a row for each.  A bucket of ``bucket`` sets
    or fewer is compared there and then.  A larger one is split by the next level.  What is still larger
    at the last level goes through as one component: its sets have shared three sampled tokens, and
    the exact check that follows compares them in blocks.  A node crosses the shuffle once, with the digest of
    its set; sketches follow only to buckets where sets have met.
    """
    packed = sets.where("size > 0").select("hi", "lo", "paths")
    parts, split = [], None
    for level in range(depth):
        nodes = packed.mapInArrow(_unfold(depth, level, bucket), "above long, bucket long, hi long, lo long, crowded boolean")
        if split is not None:
            nodes = nodes.join(split.withColumnRenamed("bucket", "above"), "above", "left_semi")
        met = stage(
            nodes.select("bucket", "hi", "lo", "crowded")
            .repartition("bucket")
            .sortWithinPartitions("bucket", "hi", "lo")
            .mapInArrow(_meetings(bucket, level == depth - 1), "kind int, bucket long, hi long, lo long, to_hi long, to_lo long"),
            "met",
        )
        # Written, so that Spark knows their size: few, they go to the rows instead of these to them.
        split = stage(met.where(F.col("kind") == _SPLIT).select("bucket"), "split")
        parts.append(met)
    placed = reduce(DataFrame.unionByName, [p.where(F.col("kind") == _COMPARE).select("bucket", "hi", "lo") for p in parts])
    compared = (
        placed.join(classes.where("size > 0").select("hi", "lo", "row", "size", "sketch"), ["hi", "lo"])
        .select("bucket", "row", "size", "sketch")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_bucket_links(similarity), "a long, b long")
    )
    numbers = classes.where("size > 0").select("hi", "lo", F.col("row").alias("a"))
    joined = (
        parts[-1].where(F.col("kind") == _JOIN)
        .join(numbers, ["hi", "lo"])
        .select("a", F.col("to_hi").alias("hi"), F.col("to_lo").alias("lo"))
        .join(numbers.withColumnRenamed("a", "b"), ["hi", "lo"])
        .select("a", "b")
    )
    return compared.unionByName(joined).distinct()


def _of_rows(sets: DataFrame, wanted: DataFrame, most: int = BITMAPS) -> DataFrame:
    """``sets`` without most of those whose row is not ``wanted`` (node), where the rows fit ``most`` bitmaps.

    Rows of a task follow each other, so a bitmap of 4 KB stands for up to 32,768 of them; tasks carry
    them and drop what nobody asked for before it is shuffled.  Beyond that bound all go on.
    """
    maps = stage(
        wanted.groupBy(F.bitmap_bucket_number("node").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node")).alias("_bits")),
        "wanted",
    )
    if maps.count() > most:
        return sets
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        sets.withColumn("_map", F.bitmap_bucket_number("row"))
        .join(F.broadcast(maps), "_map")
        .where(F.getbit(byte, (place % 8).cast("int")) == 1)
        .drop("_map", "_bits")
    )


def _tokens(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :TOKEN_BYTES] = raw
    return wide.view(np.uint64).ravel()


def _verified(left: pd.DataFrame, right: pd.DataFrame | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a in left, b in right or left) of the pairs that reach the similarity exactly."""
    other = left if right is None else right

    alike = _near(left["size"].to_numpy(), other["size"].to_numpy(), similarity)
    if right is None:
        alike = np.triu(alike, 1)
    a, b = np.nonzero(alike)
    if not len(a):
        return a, b
    mine, theirs = np.unique(a), np.unique(b)
    sets = {("l", k): _tokens(left["tokens"].iat[k]) for k in mine}
    sets |= {("r", k): _tokens(other["tokens"].iat[k]) for k in theirs}
    if len(a) <= 4 * (len(mine) + len(theirs)):
        shared = np.array([len(np.intersect1d(sets["l", i], sets["r", j], assume_unique=True)) for i, j in zip(a, b)])
    else:
        # Many pairs: a product of two incidence tables, over the tokens that both sides have.
        if right is None:
            tokens, times = np.unique(np.concatenate([_tokens(t) for t in left["tokens"]]), return_counts=True)
            common = tokens[times > 1]
        else:
            common = np.intersect1d(np.unique(np.concatenate([sets["l", k] for k in mine])), np.unique(np.concatenate([sets["r", k] for k in theirs])))
        product = np.zeros((len(mine), len(theirs)), np.float32)
        for start in range(0, len(common), 4096):
            part = common[start : start + 4096]
            tables = []
            for side, places in (("l", mine), ("r", theirs)):
                table = np.zeros((len(places), len(part)), np.float32)
                for n, k in enumerate(places):
                    at = np.searchsorted(part, sets[side, k])
                    at[at == len(part)] = 0
                    table[n, at[part[at] == sets[side, k]]] = 1
                tables.append(table)
            product += tables[0] @ tables[1].T
        shared = product[np.searchsorted(mine, a), np.searchsorted(theirs, b)]
    union = left["size"].to_numpy()[a] + other["size"].to_numpy()[b] - shared
    real = shared >= similarity * union - 1e-9
    return a[real], b[real]


def _verify(similarity: float):
    def verify(pack: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pack.groupby(["part", "i", "j"], sort=False):
            group = group.reset_index(drop=True)
            if (group["i"] == group["j"]).all():
                left, right = group, None
                other = left
            else:
                left = group[group["block"] == group["i"]].reset_index(drop=True)
                right = other = group[group["block"] == group["j"]].reset_index(drop=True)
            if not len(left) or not len(other):
                continue
            a, b = _verified(left, right, similarity)
            if not len(a):
                continue
            rows, others = left["row"].to_numpy(), other["row"].to_numpy()
            links = np.concatenate([rows[a], others[b]])
            copies = np.concatenate([other["copies"].to_numpy()[b], left["copies"].to_numpy()[a]])
            both, place = np.unique(links, return_inverse=True)
            edge, root = _spanning(both, place[: len(a)], place[len(a) :])
            nearest = dict(zip(edge, root))
            out.append(
                pd.DataFrame(
                    {
                        "row": both,
                        "texts": np.bincount(place).astype(np.int64),
                        "links": np.bincount(place, copies).astype(np.int64),
                        "root": [nearest.get(r, r) for r in both],
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "texts", "links", "root")})

    return verify


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    depth: int = DEPTH,
    block: int = BLOCK,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(``key``, class_id, text_class, n_links, n_link_texts) for each row of ``docs``.

    Two texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``similarity`` or more.  ``text_class`` is the least key of the documents with the very same set,
    ``class_id`` that of all documents reached over links, ``n_links`` the number of documents linked to
    this one, ``n_link_texts`` that of different sets.

    Sets meet in buckets of chosen paths: a set follows sampled tokens level by level, in as many
    independent runs as the target ``recall`` needs.  Buckets are compared by sketch and give
    spanning links only; the components of these are then verified exactly, in blocks, with each set
    moved once per block of its component.  Equal sets are one set from the start, so a group of
    copies costs one.  A null text or one without words has no shingles and is linked to nothing; keys
    are expected to tell rows apart (rows with equal keys share their class); other columns are not read.
    The result, a row of keys and counts per document, is written; sets and buckets are removed then.
    """
    return finished(
        docs.sparkSession,
        "near-duplicates",
        lambda: _near_duplicates(docs, similarity, shingle, recall, depth, block, text, key),
    )


def _near_duplicates(
    docs: DataFrame, similarity: float, shingle: int, recall: float, depth: int, block: int, text: str, key: str
) -> DataFrame:
    sets = stage(shingle_sets(docs, text, key, shingle, similarity, recall, depth), "sets")
    # An empty set is like no other: it stays alone.
    alone = [F.when(F.col("size") == 0, F.col("row")).otherwise(F.col(c)).alias(c) for c in ("hi", "lo")]
    members = sets.select("_key", "row", "size", *alone)
    first = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("_key"), F.col("row").alias("row"))
    classes = stage(
        sets.select("_key", "row", "size", "sketch", *alone)
        .groupBy("hi", "lo", "size")
        .agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch"))
        .select("hi", "lo", "size", "sketch", F.col("_first._key").alias("_least"), F.col("_first.row").alias("row"), "copies"),
        "classes",
    )
    groups = components(candidate_links(sets, classes, similarity, depth))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_m"))
    blocks = F.ceil(F.col("_m") / block)
    placed = (
        groups.join(sizes, "component")
        .select(F.col("node").alias("row"), F.col("component").alias("part"), blocks.alias("_blocks"))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")))
        .join(classes.select("row", "copies"), "row")
        .join(_of_rows(sets.select("row", "size", "tokens"), groups.select("node")), "row")
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    )
    # Small components share a group of rows, so that a worker is called once for many of them.
    packs = F.when(F.col("_blocks") > 1, F.xxhash64("part", "i", "j")).otherwise(
        F.pmod(F.xxhash64("part"), F.lit(_packs(docs)))
    )
    checked = stage(
        placed.select("part", "i", "j", "block", "row", "size", "copies", "tokens", packs.alias("pack"))
        .groupBy("pack")
        .applyInPandas(_verify(similarity), "row long, texts long, links long, root long"),
        "links",
    )
    counts = checked.groupBy("row").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    linked = components(checked.where("row != root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = (
        linked.join(classes.select(F.col("row").alias("node"), "_least"), "node")
        .groupBy("component")
        .agg(F.min("_least").alias("_class"))
    )
    about = (
        classes.join(counts, "row", "left")
        .join(linked.withColumnRenamed("node", "row"), "row", "left")
        .join(named, "component", "left")
        .select("hi", "lo", "size", "_least", F.coalesce("_class", "_least").alias("_class"), "copies", "texts", "links")
    )
    zero = F.lit(0).cast("long")
    return members.join(about, ["hi", "lo", "size"]).select(
        F.col("_key").alias(key),
        F.col("_class").alias("class_id"),
        F.col("_least").alias("text_class"),
        (F.col("copies") - 1 + F.coalesce("links", zero)).alias("n_links"),
        F.coalesce("texts", zero).alias("n_link_texts"),
    )


def _packs(docs: DataFrame) -> int:
    """Groups of small components: a few per task of a shuffle."""
    return 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
