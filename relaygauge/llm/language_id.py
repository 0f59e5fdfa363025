"""Language identification by cross-parsing: the fewest phrases of a language's own text win."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import LOWER, byte_arrays, chunks, first_of_each, stage, utf8

SAMPLE_ROWS = 400  # labelled texts per language that the automata are made of, at most
SAMPLE_TEXT_BYTES = 1 << 13  # of a longer text, so much is learned from, where shorter ones are few
SAMPLE_BYTES = 1 << 18  # bytes of all languages' samples together, at most
SEGMENT = 512  # bytes that are parsed side by side; a phrase ends at the edge of a segment
LEAST_SEEN = 4  # a byte that all samples together have less often is like one they never have
UNKNOWN = "und"

_BLANK = 0x20


def folded(text: bytes) -> bytes:
    """Lower case, with digits, punctuation and white space of ASCII as one blank per run."""
    letters = LOWER[np.frombuffer(text.decode("utf-8", "replace").lower().encode(), np.uint8)]
    blank = (letters < 0x61) | ((letters > 0x7A) & (letters < 0x80))
    keep = ~blank
    if len(blank):
        keep[1:] |= ~blank[:-1]
        keep[0] = not blank[0]
    return np.where(blank, np.uint8(_BLANK), letters)[keep].tobytes()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that reads every substring of ``text`` from state 0."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(goto)
        goto.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return goto


class CrossParser:
    """Phrase counts of texts under one automaton per language.

    A phrase is the longest match in the language's text from where the last one ended; a byte
    that the language never shows is a phrase of its own.  Counts are normalised by the length
    of the text and by log2 of the language's own, which gives bits per byte.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        counts = np.bincount(np.frombuffer(b"".join(samples.values()), np.uint8), minlength=256)
        seen = np.flatnonzero(counts >= LEAST_SEEN)
        self.symbol = np.zeros(256, np.int64)  # 0: in no sample, or too seldom to tell

        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.tables = []
        for language in self.languages:
            states = suffix_automaton(samples[language])
            table = np.full((len(states), self.width), -1, np.int32)
            moves = np.fromiter(map(len, states), np.int64, len(states))
            rows = np.repeat(np.arange(len(states)), moves)
            symbols = self.symbol[np.fromiter((c for s in states for c in s), np.int64, len(rows))]
            table[rows, symbols] = np.fromiter((v for s in states for v in s.values()), np.int64, len(rows))
            table[:, 0] = -1
            self.tables.append((table * self.width).ravel())  # holds offsets of rows; below 0: no match
        self.bits = [math.log2(len(samples[x]) + 2) for x in self.languages]

    def _phrases(self, columns: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Phrases of segments, longest first: ``columns`` has a row of symbols per step."""
        at = np.zeros(len(lengths), np.int64)
        phrases = np.ones(len(lengths), np.int64)
        width = len(lengths)
        for step in range(len(columns)):
            while width and lengths[width - 1] <= step:
                width -= 1
            symbols = columns[step, :width]
            then = table[at[:width] + symbols]
            ended = np.flatnonzero(then < 0)
            if len(ended):
                # A byte unknown to the language is a phrase alone: the next begins behind it.
                again = table[symbols[ended]]
                phrases[ended] += at[ended] > 0
                alone = again < 0
                phrases[ended[alone]] += step + 1 < lengths[ended[alone]]
                then[ended] = np.maximum(again, 0)
            at[:width] = then
        return phrases

    def rates(self, texts: list[bytes]) -> np.ndarray:
        """Bits per byte of each folded text (rows) under each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        parts = [(i, k) for i, t in enumerate(texts) for k in range(0, len(t), SEGMENT)]
        if not parts:
            return out
        lengths = np.array([min(SEGMENT, len(texts[i]) - k) for i, k in parts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        block = np.zeros((len(parts), SEGMENT), np.uint8)
        for row, n in enumerate(order):
            i, k = parts[n]
            block[row, : lengths[row]] = np.frombuffer(texts[i], np.uint8, lengths[row], k)
        columns = self.symbol[np.ascontiguousarray(block.T)]
        owner = np.array([i for i, _ in parts])[order]
        size = np.array([max(len(t), 1) for t in texts])
        for n, table in enumerate(self.tables):
            phrases = np.bincount(owner, self._phrases(columns, lengths, table), len(texts))
            out[:, n] = phrases * self.bits[n] / size
        return out


_PARSERS: dict[str, CrossParser] = {}


def _parser(samples: dict[str, bytes]) -> CrossParser:
    """The automata of these samples, made once per worker."""
    name = hashlib.sha256(b"\0".join(k.encode() + b"\1" + v for k, v in sorted(samples.items()))).hexdigest()
    if name not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[name] = CrossParser(samples)
    return _PARSERS[name]


def language_samples(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows: int = SAMPLE_ROWS,
    text_bytes: int = SAMPLE_TEXT_BYTES,
    total_bytes: int = SAMPLE_BYTES,
) -> dict[str, bytes]:
    """Folded sample text per language, the bounded sample that automata are learned from.

    Of each language, ``rows`` labelled texts of up to ``text_bytes`` at most, whole, in an order
    given by a hash of the key, as many as fit in its equal share of ``total_bytes``.  Behind them come
    longer ones, cut to ``text_bytes`` from their first letter on, so that a language of long texts only
    is learned too: at least one text of each.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    long = F.octet_length(text) > text_bytes
    start = F.regexp_substr(F.col(text), F.lit(r"(?s)\p{L}.{0,%d}" % (text_bytes - 1)))
    named = usable.select(
        F.col(lang).cast("string").alias("_lang"),
        F.xxhash64(F.lit(7), F.col(key), F.col(text)).alias("_order"),
        long.alias("_long"),
        F.when(long, start).otherwise(F.col(text)).cast("binary").alias("_text"),
    )
    # Texts are fetched for the chosen ones only, a few per language.
    chosen = stage(first_of_each(named.select("_lang", "_long", "_order"), "_lang", ["_long", "_order"], rows).distinct(), "samples")
    found: dict[str, list[bytes]] = {}
    for row in named.join(chosen, ["_lang", "_long", "_order"], "left_semi").orderBy("_lang", "_long", "_order").toLocalIterator():
        part = bytes(row["_text"])
        part = part[:text_bytes].decode("utf-8", "ignore").encode() if row["_long"] else part
        found.setdefault(row["_lang"], []).append(folded(part))
    share = total_bytes // max(1, len(found))
    samples = {}
    for name, texts in found.items():
        ends = np.cumsum([len(t) + 1 for t in texts])
        samples[name] = b" ".join(texts[: max(1, int((ends <= share).sum()))])
    return samples


def identify_languages(
    docs: DataFrame, samples: dict[str, bytes], text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(``key``, *``keep``, lang_pred, score, rate) for each row of ``docs``.

    ``lang_pred`` is the language whose automaton parses the whole text into the fewest normalised
    phrases, the first by name of equals; ``und`` for a text that is null or has no letter, or
    where nothing was learned.  ``rate`` is its bits per byte (null for ``und``); ``score`` (0 to 1)
    says how far the second best is from it: 0 if equal.  A worker parses all texts of a batch
    side by side, in segments, so a long text takes no longer than as many short ones.
    """
    columns = [key, *keep]
    fields = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    names = [f"_{i}" for i in range(len(columns))]
    # A text that is kept travels once; null values have no bytes in it.
    whole = names[columns.index(text)] if text in columns else "_text"

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            data, offsets = byte_arrays(batch.column(whole))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                letter = np.array(part.column("_letter").to_pylist(), bool) & bool(parser.languages)
                texts = [folded(data[offsets[n] : offsets[n + 1]].tobytes()) if ok else b"" for n, ok in zip(range(i, j), letter)]
                rates = parser.rates(texts)
                if parser.languages:
                    best = rates.argmin(axis=1)
                    rate = rates[np.arange(len(texts)), best]
                    rest = rates.copy()
                    rest[np.arange(len(texts)), best] = np.inf
                    second = rest.min(axis=1)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = np.where(np.isfinite(second), 1 - rate / second, 1.0)
                else:
                    best, rate, score = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                score = np.where(letter, np.clip(np.nan_to_num(score), 0, 1), 0.0)
                predicted = [parser.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array(predicted, pa.string()), pa.array(score), pa.array(rate, mask=~letter)],
                    [*names, "lang_pred", "score", "rate"],
                )

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = [] if whole != "_text" else [utf8(text).alias("_text")]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], *own, letter.alias("_letter"))
    parsed = rows.mapInArrow(identify, f"{fields}, lang_pred string, score double, rate double")
    return parsed.withColumnsRenamed(dict(zip(names, columns)))
