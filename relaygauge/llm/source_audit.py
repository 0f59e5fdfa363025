"""How far the sources of a language differ in their words, with transducers as the vocabulary.

Terms that enough documents of a language have are sorted and cut into blocks, and each block becomes a
minimal acyclic transducer that maps its terms to their lexicographic ordinals.  The texts are then
streamed through the transducers and counted by ordinal: terms travel to their block with the number of times
a piece of text has them, so no worker needs more of the vocabulary than a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.llm.frames import finished, stage
from relaygauge.llm.transducer import Transducer

# Terms and bytes of terms that a block holds at most (a longer term comes alone).
BLOCK_TERMS = 1 << 15
BLOCK_BYTES = 4 << 20
# Terms on average that blocks are planned for.
PLANNED_TERMS = 1 << 13
# Distinct terms, and bytes of text, that a worker counts before it hands them on.
HELD_TERMS = 300_000
HELD_BYTES = 64 << 20
# Terms whose counts a worker compares between all sources at once.
COMPARED = 1 << 12
# Bytes of terms that run through a transducer side by side.
STREAMED = 1 << 19
UNIT = 1_000_000_000

# Fixed value: the letters of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ byte by byte, A-Z lower-cased, blanks for all else.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(rows: Iterator[tuple[tuple, list[bytes] | set[bytes], int]]) -> Iterator[dict[tuple, Counter]]:
    """Counts of terms per group of (group, terms, bytes of text), handed on before they grow beyond their bounds."""
    counts: dict[tuple, Counter] = {}
    held = size = 0
    for group, terms, length in rows:
        into = counts.setdefault(group, Counter())
        before = len(into)
        into.update(terms)
        held += len(into) - before
        size += length
        if held >= HELD_TERMS or size >= HELD_BYTES:
            yield counts
            counts, held, size = {}, 0, 0
    if counts:
        yield counts


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, bytes]]:
    for batch in batches:
        groups = zip(*(batch.column(n).to_pylist() for n in names))
        for group, text in zip(groups, batch.column("_text")):
            yield group, text.as_py()


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs) of each piece of the documents."""
    for counts in _counted((g, set(terms_of(t)), len(t)) for g, t in _groups(batches, "lang")):
        for (lang,), found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["lang", "term", "docs"],
            )


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A transducer for each run of sorted terms of a language."""

    def block(lang: str, terms: list[bytes]) -> pa.RecordBatch:
        packed = Transducer.build(terms).to_bytes()
        return pa.RecordBatch.from_pylist(
            [{"lang": lang, "first": terms[0], "terms": len(terms), "transducer": packed}], schema=_BLOCK
        )

    lang, terms, size = None, [], 0
    for batch in batches:
        for its, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
            if terms and (its != lang or len(terms) >= BLOCK_TERMS or size + len(term) > BLOCK_BYTES):
                yield block(lang, terms)
                terms, size = [], 0
            lang = its
            terms.append(term)
            size += len(term)
    if terms:
        yield block(lang, terms)


_BLOCK = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("terms", pa.int64()), ("transducer", pa.binary())])


def _routed(blocks: dict[str, tuple[list[bytes], list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms of each piece of the documents with their counts, a row per block they may be in.

    Terms hold no ASCII beyond letters, so they are joined by blanks.
    """
    schema = pa.schema(
        [("block", pa.int64()), ("kind", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("packed", pa.binary()), ("counts", pa.binary())]
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ((g, t) for g, t in _groups(batches, "lang", "source") if g[0] in blocks)
        for counts in _counted((g, terms_of(t), len(t)) for g, t in known):
            for (lang, source), found in counts.items():
                firsts, numbers = blocks[lang]
                terms = sorted(found)
                each = np.array([found[t] for t in terms], np.int64)
                ends = [*(bisect_left(terms, first) for first in firsts), len(terms)]
                met = [(n, low, high) for n, low, high in zip(numbers, ends, ends[1:]) if low < high]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _, _ in met], pa.int64()),
                        pa.array([1] * len(met), pa.int32()),
                        pa.array([lang] * len(met), pa.string()),
                        pa.array([source] * len(met), pa.string()),
                        pa.array([b" ".join(terms[low:high]) for _, low, high in met], pa.binary()),
                        pa.array([each[low:high].tobytes() for _, low, high in met], pa.binary()),
                    ],
                    schema=schema,
                )

    return route


def _spans(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of terms, where each starts and where it ends."""
    data = np.frombuffer(packed, np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    return data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])


def _recounted(offsets: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, lang, source, ordinal, count) of rows sorted by block, its transducer first, and source."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, lang), rows in groupby(rows_of(batches), key=lambda r: (r[0], r[2])):
            transducer = Transducer.from_bytes(next(rows)[4])
            source, totals = None, np.zeros(transducer.terms, np.int64)
            for streams in _together(rows):
                ordinals = transducer.ordinals(*_spans(b" ".join(r[4] for r in streams)))
                at = 0
                for row in streams:
                    if row[3] != source:
                        yield from counted(block, lang, source, totals)
                        source, totals = row[3], np.zeros(transducer.terms, np.int64)
                    counts = np.frombuffer(row[5], np.int64)
                    its = ordinals[at : at + len(counts)]
                    at += len(counts)
                    # The terms of a row are distinct.
                    totals[its[its >= 0]] += counts[its >= 0]
            yield from counted(block, lang, source, totals)

    def counted(block: int, lang: str, source: str | None, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(totals)
        n = len(found)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block), pa.int64()),
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(found + offsets[block], pa.int64()),
                    pa.array(totals[found], pa.int64()),
                ],
                ["block", "lang", "source", "ordinal", "count"],
            )

    return recount


def _together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in runs of about STREAMED bytes of terms."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row[4])
        if size >= STREAMED:
            yield run
            run, size = [], 0
    if run:
        yield run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block with the terms of their ordinals."""
    for batch in batches:
        for row in batch.to_pylist():
            transducer = Transducer.from_bytes(row["transducer"])
            yield pa.RecordBatch.from_pylist(
                [
                    {**{c: r[c] for c in ("lang", "source", "value", "rank")}, "item": transducer.term(r["place"]).decode("utf-8", "replace")}
                    for r in row["rows"]
                ],
                schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("value", pa.int64()), ("rank", pa.int32()), ("item", pa.string())]),
            )


def _distances(floors: dict[str, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, a, b, value) summed over the terms of a task; ``floors`` are the shares of a term a source lacks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros((len(f), len(f)), np.int64) for lang, f in floors.items()}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            lists = batch.column("shares")
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            numbers, shares = flat.field("g").to_numpy(), flat.field("p").to_numpy()
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                for i in range(0, len(at), COMPARED):
                    rows = at[i : i + COMPARED]
                    table = np.tile(np.array(floors[lang], np.int64), (len(rows), 1))
                    mine = np.isin(row, rows)
                    table[np.searchsorted(rows, row[mine]), numbers[mine]] = shares[mine]
                    for b in range(table.shape[1]):
                        q = table[:, b, None]
                        apart = table - q
                        sums[lang][:, b] += (apart * apart // q).sum(axis=0)
        for lang, table in sums.items():
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(table[a, b], pa.int64())],
                ["lang", "a", "b", "value"],
            )

    return compare


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact at any size."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + terms).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def vocabulary(spark: SparkSession, texts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, first, terms, transducer): the terms that at least ``least_docs`` documents of a language
    have, in sorted blocks.  ``texts`` has lang and _text."""
    found = texts.select("lang", "_text").mapInArrow(_documents_with, "lang string, term binary, docs long")
    kept = stage(
        found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"),
        "audit-terms",
    )
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(wide, -(-kept.count() // PLANNED_TERMS))
    ordered = kept.repartitionByRange(blocks, "lang", "term").sortWithinPartitions("lang", "term")
    return stage(ordered.mapInArrow(_built, "lang string, first binary, terms long, transducer binary"), "audit-blocks")


def source_divergence(
    docs: DataFrame, least_docs: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each (lang, source) group differs from other groups.

    Terms are runs of letters (A-Z lower-cased) and of all beyond ASCII; a language keeps those that
    ``least_docs`` of its documents have.  Each group gives a kept term the share
    1 + floor(10^9 * (count + 1) / (N + V)).  Part ``pair`` sums (p - q)^2 div q over all kept terms
    for each other source of the language, 0 if there are none; part ``term`` lists the first ``ranks`` terms that the
    group has and uses more than its language.  Ties go by the item's bytes, for terms by their ordinals.

    Null text, lang and source are read as empty text and are groups of that name; repeated rows count each; an empty
    table gives no rows; a language without kept terms gives pairs of value 0; columns other than these
    three are not read.

    The driver keeps a row per group (the result has a row per pair of those) and one per block of the
    vocabulary, some 2^13 terms, as a range partitioner does.
    """
    spark = docs.sparkSession

    def work() -> DataFrame:
        plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        texts = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("_text"))
        blocks = vocabulary(spark, texts, least_docs)

        # Where each block starts, and how many terms of its language come before it.
        firsts: dict[str, tuple[list[bytes], list[int]]] = {}
        offsets: dict[int, int] = {}
        size: dict[str, int] = {}
        starts = []
        for number, r in enumerate(blocks.select("lang", "first", "terms").orderBy("lang", "first").collect()):
            first = bytes(r["first"])
            firsts.setdefault(r["lang"], ([], []))
            firsts[r["lang"]][0].append(first)
            firsts[r["lang"]][1].append(number)
            offsets[number] = size.get(r["lang"], 0)
            size[r["lang"]] = offsets[number] + r["terms"]
            starts.append((number, r["lang"], r["first"]))
        numbered = blocks.join(spark.createDataFrame(starts, "block long, lang string, first binary"), ["lang", "first"])
        numbered = numbered.select("block", "lang", "transducer")

        form = "block long, kind int, lang string, source string, packed binary, counts binary"
        streams = texts.mapInArrow(_routed(firsts), form)
        heads = numbered.select(
            "block", F.lit(0).alias("kind"), "lang", F.lit("").alias("source"), F.col("transducer").alias("packed"), F.lit(None).cast("binary").alias("counts")
        )
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = heads.unionByName(streams).repartition(max(wide, len(starts)), "block").sortWithinPartitions("block", "kind", "source")
        counts = stage(met.mapInArrow(_recounted(offsets), "block long, lang string, source string, ordinal long, count long"), "audit-counts")

        found = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = texts.select("lang", "source").distinct().join(found, ["lang", "source"], "left").na.fill(0, ["n"])
        listed: dict[str, list[tuple[str, int]]] = {}
        for r in groups.orderBy("lang", "source").collect():
            listed.setdefault(r["lang"], []).append((r["source"], r["n"]))
        rows = [
            (its, name, g, n, sum(m for _, m in members), size.get(its, 0))
            for its, members in listed.items()
            for g, (name, n) in enumerate(members)
        ]
        table = spark.createDataFrame(rows, "lang string, source string, g int, n long, n_all long, v long")
        floors = {its: [1 + UNIT // max(n + size.get(its, 0), 1) for _, n in members] for its, members in listed.items()}

        # A row per term, with the sources that have it: as many as a language has sources.
        shares = counts.join(table, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
        terms = stage(
            shares.groupBy("lang", "block", "ordinal").agg(
                F.sum("count").alias("count"),
                F.first("n_all").alias("n_all"),
                F.first("v").alias("v"),
                F.collect_list(F.struct("g", "p")).alias("shares"),
            ),
            "audit-shares",
        )
        return _pairs(terms, table, floors).unionByName(_top_terms(terms, table, numbered, offsets, ranks))

    return finished(spark, "audit", work)


def _pairs(terms: DataFrame, table: DataFrame, floors: dict[str, list[int]]) -> DataFrame:
    parts = terms.select("lang", "shares").mapInArrow(_distances(floors), "lang string, a int, b int, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = table.select("lang", "source", F.col("g").alias("a"))
    other = table.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(summed, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _top_terms(terms: DataFrame, table: DataFrame, blocks: DataFrame, offsets: dict[int, int], ranks: int) -> DataFrame:
    spark = terms.sparkSession
    q = _share(F.col("count"), F.col("n_all"), F.col("v"))
    used = terms.select("lang", "block", "ordinal", q.alias("q"), F.inline("shares")).where("p > q")
    valued = used.select("lang", "g", "block", "ordinal", _apart(F.col("p"), F.col("q")).alias("value"))
    # The first of each task are cut before a group meets.
    salted = valued.withColumn("salt", F.pmod("ordinal", F.lit(64)))
    for by in (["lang", "g", "salt"], ["lang", "g"]):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "ordinal"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= ranks)
    first = spark.createDataFrame(list(offsets.items()), "block long, first long")
    named = salted.join(table.select("lang", "g", "source"), ["lang", "g"]).join(first, "block")
    row = F.struct("lang", "source", "value", "rank", (F.col("ordinal") - F.col("first")).alias("place"))
    per_block = named.groupBy("block").agg(F.collect_list(row).alias("rows")).join(blocks.select("block", "transducer"), "block")
    out = per_block.select("rows", "transducer").mapInArrow(_named, "lang string, source string, value long, rank int, item string")
    return out.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
