"""Token ids of the corpus by a public byte-level BPE, through a sentencepiece model made from its vocabulary.

Method: the vocabulary's ranks become a sentencepiece BPE model (serialised here, nothing is trained):
every token's bytes are mapped to printable characters, its score is the negative rank, and the
normaliser is the identity. A text is cut into pre-tokens by the vocabulary's public pattern, and each
pre-token is encoded by the model; decoding maps pieces back to bytes.

Pre-tokens repeat, so ids are kept per chunk (a run of blanks and the letters after it) in a table of
bounded size inside the worker. A chunk boundary before a run of blanks is always a pre-token
boundary; texts with other white space take the pattern itself.

A null or an empty text has no ids. Strings of special tokens are ordinary text. Extra columns are
dropped.
"""

from __future__ import annotations

import base64
import gc
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.pii import portions

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
OTHER_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
CACHE, CACHE_CHARS = 400_000, 40_000_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(no: int, kind: int, body: bytes | int) -> bytes:
    if kind == 0:
        return _varint(no << 3) + _varint(body & (1 << 64) - 1)
    if kind == 5:
        return _varint(no << 3 | 5) + body
    return _varint(no << 3 | 2) + _varint(len(body)) + body


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the id after the last is unknown."""
    chars = byte_alphabet()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, 1))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, 2))
    n = len(ranks)
    trainer = _field(3, 0, 2) + _field(4, 0, n + 1) + _field(24, 0, 0) + _field(40, 0, n) + _field(41, 0, -1) + _field(42, 0, -1) + _field(43, 0, -1)
    normal = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normal))


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import regex
        import sentencepiece

        self.ranks = read_ranks(folder, name)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must be 0..n-1")
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.chars = str.maketrans(dict(enumerate(byte_alphabet())))
        self.back = {c: b for b, c in enumerate(byte_alphabet())}
        self.split, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.chars_known = 0

    def _pieces(self, text: str) -> list[str]:
        """Chunks whose ids can be joined: runs of blanks with what follows, or plain pre-tokens."""
        if OTHER_BLANK.search(text):
            return self.split(text)
        return CHUNK.findall(text)

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the table; their pre-tokens go to the model in one call."""
        known, cut, words = self.known, {}, set()
        self.chars_known += sum(map(len, chunks))
        for c in chunks:
            if c.isalpha() or (c[0] == " " and c[1:].isalpha()):  # one pre-token
                words.add(c)
                continue
            cut[c] = w = (self.ascii if c.isascii() else self.split)(c)
            words.update([x for x in w if x not in known])
        order = list(words)
        known.update(zip(order, self.sp.encode([w.encode().decode("latin-1").translate(self.chars) for w in order], num_threads=1)))
        for c, w in cut.items():
            if len(w) > 1:
                known[c] = [i for x in w for i in known[x]]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self._pieces(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE or self.chars_known > CACHE_CHARS:
            known.clear()
            self.chars_known = 0
        if new := {c for p in parts for c in p if c not in known}:
            self._learn(new)
        out = []
        for p in parts:
            ids: list[int] = []
            for c in p:
                ids += known[c]
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Codec:
    return Codec(folder, name)


def _quietly(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts, without garbage collection while one is worked on (many small lists without cycles)."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from parts
    finally:
        if was:
            gc.enable()


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids``: the ids of each text in order."""
    schema = pa.schema([pa.field(key, pa.int64()), pa.field("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(folder)
        for b in _quietly(whole.slice(at, end - at) for whole in batches for at, end in portions(whole.column(1).to_pylist(), 8_000_000, 10_000)):
            ids = pa.array(c.encode_batch(b.column(1).to_pylist()), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key, n_tokens``; the ids themselves never leave the worker."""
    schema = pa.schema([pa.field(key, pa.int64()), pa.field("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(folder)
        for b in _quietly(whole.slice(at, end - at) for whole in batches for at, end in portions(whole.column(1).to_pylist(), 8_000_000, 10_000)):
            n = pa.array([len(x) for x in c.encode_batch(b.column(1).to_pylist())], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), n], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, n_tokens long")
