"""Token counts of documents, from pieces counted once per distinct pre-token.

A first pass turns documents into frequencies of pre-tokens. So that a pre-token's string moves once per block of
documents and not once per document, a document refers to its block's word list by number. The lists' entries meet by
pre-token; each distinct one is counted once, and its count goes back to the blocks that asked. There counts are joined
to the documents' frequencies and summed. Ids are never made into rows or arrays.

Nothing grows without bound in one task: a block is closed at a number of words, of their bytes, of documents, or of
frequencies, and a pre-token has one entry per block at most, however many documents hold it.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import bounded, discard, in_worker, materialize, no_cycle_search, slices
from tapeworks.llm.pretokens import Pretokens

#: A block holds at most so many words, bytes of words, documents, and frequencies, but for what its last document adds.
WORDS, WORD_BYTES, DOCUMENTS, ENTRIES = 400_000, 16 << 20, 20_000, 4_000_000


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed with their bytes in planes, as most high bytes are zero."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Block:
    """Documents under way: a word list, and each document's frequencies by place in it."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.rows: list[tuple] = []
        self.entries = self.bytes = 0

    def full(self) -> bool:
        return len(self.words) >= WORDS or self.bytes >= WORD_BYTES or len(self.rows) >= DOCUMENTS or self.entries >= ENTRIES

    def places(self, chunk: str, cut: Pretokens) -> tuple[int, ...]:
        """Places in the word list of a chunk's pre-tokens."""
        words, found = self.words, []
        for p in cut.cut(chunk):
            if (at := words.get(p)) is None:
                at = words[p] = len(words)
                self.bytes += len(p)
            found.append(at)
        self.bytes += len(chunk)
        self.chunks[chunk] = out = tuple(found)
        return out

    def frequencies(self, segments: list[str], cut: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """Places in the word list and how often each occurs."""
        counted: Counter[str] = Counter()
        for s in segments:
            counted.update(cut.chunks(s))
        known, flat, sizes = self.chunks, [], []
        for c in counted:
            found = known.get(c) or self.places(c, cut)
            flat += found
            sizes.append(len(found))
        weights = np.repeat(np.fromiter(counted.values(), np.int64, len(counted)), sizes)
        places, which = np.unique(np.array(flat, np.int64), return_inverse=True)
        self.entries += len(places)
        # whole numbers below 2**53: exact in doubles
        return places.astype(np.uint32), np.bincount(which, weights).astype(np.uint32)

    def closed(self) -> tuple[list[str], list[tuple]]:
        """The words in order, and the rows with their places in that order (as differences) and frequencies packed."""
        words = sorted(self.words)
        rank = np.empty(len(words), np.int64)
        rank[[self.words[w] for w in words]] = np.arange(len(words))
        out = []
        for i, size, special, places, freqs in self.rows:
            places = rank[places]
            order = np.argsort(places)
            out.append((i, size, special, pack_numbers(np.diff(places[order], prepend=0)), pack_numbers(freqs[order])))
        return words, out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs``: tokens as the tokenizers library counts them by default.

    ``path``: a byte-level BPE tokenizer file. No begin, end or other special token is added; a special token's string
    within a text is that one token. Null and empty texts have no bytes and no tokens. Rows are counted one by one, so
    that null or repeated ids and repeated rows stay as they are; other columns are not carried. An empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, task, n = Pretokens(path), Block(), TaskContext.get().partitionId() << 32, 0
        id_type = None

        def closed() -> Iterator[pa.RecordBatch]:
            words, rows = block.closed()
            names = ["block", "id", "n_bytes", "n_special", "places", "freqs", "word", "at"]
            for at in range(0, len(rows), 1000):
                ids, size, special, places, freqs = zip(*rows[at : at + 1000], strict=True)
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task + n] * k, pa.int64()), pa.array(ids, id_type), pa.array(size, pa.int64()), pa.array(special, pa.int64()), pa.array(places, pa.binary()), pa.array(freqs, pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32())],
                    names=names,
                )
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task + n] * k, pa.int64()), pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(some, pa.string()), pa.array(range(at, at + k), pa.int32())],
                    names=names,
                )

        for b in slices(batches, 200):
            id_type = b.schema.field(0).type
            with no_cycle_search():
                for i, t, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    segments, special = cut.segments(t or "")
                    block.rows.append((i, size, special, *block.frequencies(segments, cut)))
                    if block.full():
                        yield from closed()
                        block, n = Block(), n + 1
        if block.rows:
            yield from closed()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by word: all entries of a word follow each other, so that it is counted once
        cut, last, n, held = Pretokens(path), None, 0, 0
        of: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

        def packed() -> pa.RecordBatch:
            rows = []
            for block, (at, counts) in of.items():
                at = np.array(at, np.int64)
                order = np.argsort(at)
                rows.append((block, pack_numbers(np.diff(at[order], prepend=0)), pack_numbers(np.array(counts, np.int64)[order])))
            of.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "n"])

        for b in slices(batches, 20_000):
            for w, block, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if w != last:
                    last, n = w, cut.count(w)
                places, counts = of[block]
                places.append(at)
                counts.append(n)
            held += b.num_rows
            if held > 500_000:
                yield packed()
                held = 0
        if of:
            yield packed()

    def summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [(np.cumsum(unpack_numbers(at)), unpack_numbers(n)) for at, n in zip(counts.column("at").to_pylist(), counts.column("n").to_pylist(), strict=True)]
        of = np.zeros(max((int(at[-1]) for at, _ in parts), default=-1) + 1, np.int64)
        for at, n in parts:
            of[at] = n
        tokens = []
        for places, freqs, special in zip(*(rows.column(c).to_pylist() for c in ("places", "freqs", "n_special")), strict=True):
            tokens.append(special + int(of[np.cumsum(unpack_numbers(places))] @ unpack_numbers(freqs)))
        return pa.table([rows.column("id"), rows.column("n_bytes"), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    made = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"block bigint, id {kind}, n_bytes bigint, n_special bigint, places binary, freqs binary, word string, at int"
    both = materialize(made.mapInArrow(in_worker(first_pass), schema), "tokencount-blocks")
    entries = both.filter("word is not null").select("word", "block", "at")
    counts = entries.repartition("word").sortWithinPartitions("word").mapInArrow(in_worker(pieces), "block bigint, at binary, n binary")
    rows = both.filter("word is null").select("block", "id", "n_bytes", "n_special", "places", "freqs")
    out = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(summed, f"id {kind}, n_bytes bigint, n_tokens bigint")
    done = materialize(out, "tokencount")
    discard(both)
    return done.withColumnRenamed("id", id_col)
