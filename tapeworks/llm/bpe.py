"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Nothing is trained: every token of the vocabulary becomes a piece, its bytes mapped one to one to printable
characters, its score the negative rank, so that the best-scoring merge is the one of lowest rank. The normaliser is
the identity. Pre-tokens are encoded separately and decoded by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import bounded, in_worker, no_cycle_search, slices


@lru_cache(1)
def byte_chars() -> list[str]:
    """A printable character for each byte: itself if it is one and no space, else the next free one from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank; the ranks must be 0 to n - 1."""
    with open(path, "rb") as f:
        found = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, fixed32 (floats) or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces in order of rank, so that ids are ranks, then the unknown piece."""
    chars = byte_chars()
    body = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        body += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(body) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary; chunks seen before are looked up, within a bound on their bytes.

    With the public pattern a chunk is a word with the space before it, cut into pre-tokens once; with any other pattern
    it is a pre-token, found in the whole text.
    """

    def __init__(self, path: str, pattern: str, most: int = 128 << 20):
        import public_tokenizers
        import regex
        import sentencepiece

        self.known_pattern = pattern == public_tokenizers.PATTERN
        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.find, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        # a space that follows a character other than white space begins a pre-token
        self.chunk = regex.compile(r"(?<=\S)(?= )").split
        self.odd = regex.compile(r"\s ").search
        self.marks = frozenset(".,;:!?|)")
        self.space = regex.compile(r"\s").search
        self.chars = byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(self.chars)}
        self.pieces = [b"".join([back[c] for c in self.model.id_to_piece(i)]) for i in range(len(self.tokens))]
        self.most, self.held, self.chunks, self.pretokens = most, 0, {}, {}

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token: the token itself where the vocabulary has it whole, else the merges."""
        raw = [p.encode("utf-8", "replace") for p in pretokens]
        lead, chars = self.chars[0x20], self.chars
        mapped = [lead * (p[0] == " ") + p.lstrip(" ") if p.isascii() and p.lstrip(" ").isalnum() and p[:2] != "  " else "".join([chars[b] for b in r]) for p, r in zip(pretokens, raw, strict=True)]
        merged = self.model.encode(mapped, num_threads=1)
        return [[i] if (i := self.whole.get(r)) is not None else ids for r, ids in zip(raw, merged, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """Pieces joined, each character mapped back to its byte (the mapping is applied once per piece)."""
        return b"".join([self.pieces[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Chunks of whole pre-tokens: a space that follows a character other than white space begins one."""
        if not self.known_pattern:
            return [m.group() for m in self.matches(text) if m.group()]
        if self.odd(text) or text[:1] == " ":
            return [c for c in self.chunk(text) if c]
        first, *rest = text.split(" ")
        return [c for c in (first, *map(" ".__add__, rest)) if c]

    def learn(self, chunks: set[str]) -> None:
        """Tokens, ids in decimal joined by commas, and decoded bytes of each chunk not yet known."""
        new = [c for c in chunks if c not in self.chunks]
        # a chunk of n characters, its ids and its bytes take about 400 + 8 n bytes, with their places in both dictionaries
        size = 400 * len(new) + 8 * sum(map(len, new))
        if self.chunks and self.held + size > self.most:
            self.chunks.clear()
            self.pretokens.clear()
            self.held, new = 0, list(chunks)
            size = 400 * len(new) + 8 * sum(map(len, new))
        self.held += size
        found: dict[str, list[str]] = {}
        rest = []
        if not self.known_pattern:
            found, new = {c: [c] for c in new}, []
        for c in new:  # most are letters with at most one mark behind them, after a space
            body = c[1:] if c[0] == " " else c
            if body.isalpha():
                found[c] = [c]
            elif body[-1:] in self.marks and body[:-1].isalpha():
                found[c] = [c[:-1], body[-1]]
            else:
                rest.append(c)
        plain = [c for c in rest if not self.space(c[1:]) and (c[0] == " " and len(c) > 1 or not self.space(c[0]))]
        # one search over many chunks; between them a line break is a pre-token of its own
        flat, at = self.find("\n".join(plain)), 0
        for c in plain:
            end = at
            while end < len(flat) and flat[end] != "\n":
                end += 1
            found[c], at = flat[at:end], end + 1
        for c in rest:
            if c not in found:
                found[c] = self.find(c)
        known = self.pretokens
        fresh = list({p for ps in found.values() for p in ps if p not in known})
        for p, ids in zip(fresh, self.encode_pretokens(fresh), strict=True):
            known[p] = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        for c, ps in found.items():
            if len(ps) == 1:
                self.chunks[c] = known[ps[0]]
            else:
                n, ids, raw = zip(*[known[p] for p in ps], strict=True)
                self.chunks[c] = (sum(n), ",".join(ids), b"".join(raw))

    def parts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Per text: tokens, ids in decimal joined by commas, decoded bytes."""
        group, waiting = [], set()
        for k, t in enumerate(texts, 1):
            group.append(self.split(t))
            waiting.update(group[-1])
            if k == len(texts) or len(waiting) > 100_000:
                with no_cycle_search():
                    self.learn(waiting)
                for chunks in group:
                    if chunks:
                        n, ids, raw = zip(*map(self.chunks.__getitem__, chunks), strict=True)
                        yield sum(n), ",".join(ids), b"".join(raw)
                    else:
                        yield 0, "", b""
                group, waiting = [], set()

    def encode(self, text: str) -> list[int]:
        ids = next(self.parts([text]))[1]
        return [int(i) for i in ids.split(",")] if ids else []


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of int, decoded: binary) per row; null texts count as empty, rows are kept as they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(path, pattern)
        for b in slices(batches, 200):
            ids, decoded = [], []
            for t in b.column(1).to_pylist():
                ids.append(c.encode(t or ""))
                decoded.append(c.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_worker(run), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``encode_documents``: n_tokens, ids_sha256, decoded_sha256; ids do not leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(path, pattern)
        for b in slices(batches, 500):
            n, enc, dec = [], [], []
            for tokens, ids, raw in c.parts([t or "" for t in b.column(1).to_pylist()]):
                n.append(tokens)
                enc.append(hashlib.sha256(ids.encode()).hexdigest())
                dec.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_worker(run), schema).withColumnRenamed("id", id_col)
