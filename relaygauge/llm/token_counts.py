"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import byte_arrays, chunks, utf8

BATCH_BYTES = 1 << 18  # text that goes to the encoder at once
KNOWN_BYTES = 64 << 20  # of pieces whose lengths a worker remembers
KNOWN_LETTERS = 32  # of a piece that is remembered: longer ones seldom come again
PIECE_BYTES = 160  # that an entry takes besides its letters

# What an encoder that ignores white space may still take for a letter, though Python splits there.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Lengths of texts under one vocabulary file.

    Where the tokenizer drops white space, no token spans it: texts are then split there, each
    short piece is encoded once, and its length is remembered.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            self._encode = lambda texts: [len(e.ids) for e in encode(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library is known for {path}")
        self.splits = self._drops_white_space()
        self._known: dict[str, int] = {}
        self._held = 0

    def _drops_white_space(self) -> bool:
        probes = ["Ab", "ab,", "12", "it's", "(x"]
        alone = sum(self._encode(probes))
        joined = self._encode([space.join(probes) for space in (" ", "\n", "\t \r\n", "   ", " ")])
        return self._encode([" \n "]) == [0] and all(n == alone for n in joined)

    def encode(self, texts: list[str]) -> list[int]:
        """Lengths, encoded in batches of about BATCH_BYTES."""
        lengths: list[int] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text)
            size += len(text) + 16
            if size >= BATCH_BYTES:
                lengths += self._encode(batch)
                batch, size = [], 0
        return lengths + (self._encode(batch) if batch else [])

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.encode(texts)
        pieces = [[t] if any(c in t for c in _NOT_SPACE) else t.split() for t in texts]
        if self._held > KNOWN_BYTES:
            self._known.clear()
            self._held = 0
        distinct = {p for words in pieces for p in words}
        short = [p for p in distinct if len(p) <= KNOWN_LETTERS and p not in self._known]
        self._known.update(zip(short, self.encode(short)))
        self._held += sum(PIECE_BYTES + 4 * len(p) for p in short)
        long = [p for p in distinct if len(p) > KNOWN_LETTERS]
        here = dict(zip(long, self.encode(long)))
        known = self._known.get
        return [sum(n if (n := known(p)) is not None else here[p] for p in words) if here else sum(map(known, words)) for words in pieces]


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``tokenizer`` names a vocabulary file that every executor can open: .json or .model.  A null
    or empty text has no bytes and no tokens.  Repeated rows and null keys each give their row;
    columns other than ``key`` and ``text`` are not read.  Texts never leave the task that read
    them, and a long one is encoded piece by piece.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            _, offsets = byte_arrays(batch.column("_text"))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                tokens = encoder.lengths([b.as_py().decode() for b in part.column("_text")])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key"),
                        pa.array(offsets[i + 1 : j + 1] - offsets[i:j], pa.int64()),
                        pa.array(tokens, pa.int64()),
                    ],
                    ["_key", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
