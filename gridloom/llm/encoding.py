"""Encoding of a corpus with a public byte-level BPE vocabulary, and back.

A sentencepiece BPE model is serialised directly from the vocabulary's ranks: each
token becomes a piece of byte-mapped characters scored by its negative rank, with
identity normalisation.  Texts are cut into pre-tokens, each is encoded by that model, and
ids decode by the inverse mapping.  Nothing is trained.

Speed: texts are first cut, by one regular expression, into chunks that begin at a
white-space boundary no pre-token can cross.  The ids of a chunk are remembered, so the pre-token
pattern and the model only run on chunks not seen before.  The memory is emptied at a fixed size.

The model is built once on the driver (1 MB, fixed by the vocabulary) and sent to the executors;
every document is a row of its own, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

#: Where the public vocabularies lie unless told otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Chunks remembered by a task before it starts anew.
REMEMBERED = 300_000
#: Characters cut into chunks at once.
CHARS = 2_000_000

#: The pre-token pattern of the vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A chunk: a word with the one blank or line end before it, or white space by the pattern's own rule.
_CHUNK = re.compile(r"[ \n]?\S+|\s+(?!\S)|\s")
#: Characters on which Python and the pattern disagree about white space.
_DISPUTED = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token bytes and their ranks, from a ``.tiktoken`` file."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece BPE model; piece i is the token of rank i, the last one is the unknown piece."""
    letters = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_varint(k << 3) + _varint(2**64 - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class ByteBpe:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._map = {b: c for b, c in enumerate(byte_characters())}
        self._pattern = regex.compile(PRE_TOKEN)
        self._ids: dict[str, list[int]] = {}
        self._words: dict[str, list[int]] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Encodes the words of new chunks, each word once, in one call."""
        cut = {c: [w.encode().decode("latin-1").translate(self._map) for w in self._pattern.findall(c)] for c in chunks}
        words = list({w for ws in cut.values() for w in ws} - self._words.keys())
        if words:
            self._words.update(zip(words, self._model.encode(words, num_threads=1), strict=True))
        for c, ws in cut.items():
            self._ids[c] = list(chain.from_iterable(map(self._words.__getitem__, ws)))

    def _chunks(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """The chunks of the texts, some CHARS characters' worth at a time, all of them known by then."""
        part, size = [], 0
        for text in texts:
            text = text or ""
            part.append([text] if _DISPUTED.search(text) else _CHUNK.findall(text))
            size += len(text)
            if size > CHARS:
                yield self._known(part)
                part, size = [], 0
        yield self._known(part)

    def _known(self, part: list[list[str]]) -> list[list[str]]:
        if len(self._ids) > REMEMBERED:
            self._ids.clear()
            self._words.clear()
        new = set().union(*part) - self._ids.keys()
        if new:
            self._learn(new)
        return part

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, without special tokens; null and empty texts give none."""
        known = self._ids
        return [list(chain.from_iterable(map(known.__getitem__, chunks))) for part in self._chunks(texts) for chunks in part]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        known = self._ids
        return [sum(map(len, map(known.__getitem__, chunks))) for part in self._chunks(texts) for chunks in part]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def count(self, text: str | None) -> int:
        return self.count_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        back = {c: b for b, c in self._map.items()}
        pieces = "".join(self._model.id_to_piece([int(i) for i in ids])) if len(ids) else ""
        return bytes(back[c] for c in pieces).decode("utf-8", "replace")


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (a list of int) of each document.

    Every row of ``documents`` gives one row, repeated and null keys included; null and
    empty texts give an empty list.  Whole texts are encoded, however long.
    """
    model = documents.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(tokenizer, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        for batch in batches:
            lists = bpe.encode_batch(batch.column(1).to_pylist())
            offsets = np.zeros(len(lists) + 1, dtype="int32")
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype="int32", count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of each document; null and empty texts count 0."""
    model = documents.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(tokenizer, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.count_batch(batch.column(1).to_pylist()), pa.int64())], names=[key, "n_tokens"])

    kind = dict(documents.dtypes)[key]
    return documents.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_corpus(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of each encoded document; null and empty lists give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(tokenizer, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(f"`{key}`", f"`{ids}`").mapInArrow(run, f"`{key}` {kind}, text string")
