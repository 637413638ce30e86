"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenized where they lie; only (id, piece, length, checksum) move. The histogram has at most
``capacity`` lengths, whatever the number of documents; best-fit decreasing runs over its counts, treating equal bins
as one class, and gives a plan of a few rows per length. A piece takes its place by its rank within its length.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.bpe import byte_chars
from tapeworks.llm.common import bounded, gapless_rank, in_worker, materialize, no_cycle_search, slices
from tapeworks.llm.pretokens import LETTERS


#: Whether this machine's unsigned ints are little-endian numbers of 32 bits.
NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


class WordIds(dict):
    """Ids of a string without ASCII white space as little-endian uint32 bytes; emptied when its strings hold too many bytes.

    Strings of Latin letters and printable ASCII follow the tokenizer file here: lower case, then its pre-token pattern;
    each different pre-token is given to the tokenizer's model once. All others, and those that may hold a special token,
    go through the whole tokenizer, whose tables of letters, cases and compositions may be of another Unicode version.
    """

    def __init__(self, path: str, most: int = 40 << 20):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        kinds = [s["type"] for s in steps["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("not a lower-casing tokenizer that drops white space")
        self.tok, self.most = Tokenizer.from_file(path), most
        self.find = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n").findall
        self.plain = re.compile(f"[!-~{LETTERS}\n]*").fullmatch
        self.special = [t["content"][:2] for t in steps["added_tokens"]]
        self.pretokens: dict[str, bytes] = {}
        self.held = 0
        self.model, self.chars = self.tok.model, "".join(byte_chars())
        self.marks = {c: self.pretoken(c) for c in ".,;:!?|)"}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        # a string of n characters and its ids take about 200 + 5 n bytes, with their place here
        size = 200 * len(new) + 5 * sum(map(len, new))
        if self and self.held + size > self.most:
            self.clear()
            self.pretokens.clear()
            self.held, new = 0, list(words)
            size = 200 * len(new) + 5 * sum(map(len, new))
        self.held += size
        known, marks, plain = self.pretokens, self.marks, self.plain
        rest, odd = [], []
        if not plain("\n".join(new)):
            odd = [w for w in new if not plain(w)]
            new = [w for w in new if plain(w)]
        for w in new:  # most are letters with at most one mark behind them
            core, tail = (w, b"") if w.isalpha() else (w[:-1], marks.get(w[-1]))
            if tail is None or not core.isalpha():
                rest.append(w)
                continue
            low = core.lower()
            if (ids := self.get(low)) is None:  # a word in lower case is its own pre-token
                ids = self[low] = self.pretoken(low)
            if low != w:
                self[w] = ids + tail
        joined = "\n".join(rest)
        if any(s in joined for s in self.special):
            odd += [w for w in rest if any(s in w for s in self.special)]
            rest = [w for w in rest if not any(s in w for s in self.special)]
            joined = "\n".join(rest)
        flat, at = self.find(joined.lower()), 0
        for p in set(flat).difference(known, "\n"):
            known[p] = self.pretoken(p)
        for w in rest:
            end = at
            while end < len(flat) and flat[end] != "\n":
                end += 1
            self[w] = b"".join([known[p] for p in flat[at:end]])
            at = end + 1
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            for w, e in zip(some, self.tok.encode_batch(some, add_special_tokens=False), strict=True):
                self[w] = pack_ids(e.ids)

    def pretoken(self, p: str) -> bytes:
        return pack_ids([t.id for t in self.model.tokenize(charmap_decode(p.encode("utf-8", "replace"), "strict", self.chars)[0])])


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if NATIVE else struct.pack(f"<{len(ids)}I", *ids)


def token_bytes(texts: list[str | None], words: WordIds, end_id: int) -> list[bytes]:
    """Each text's ids and ``end_id`` as little-endian uint32s.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its parts between white space;
    each different part is tokenized once.
    """
    end, out = end_id.to_bytes(4, "little"), []
    cut = str.maketrans("\t\n\r\x0b\x0c", "     ")  # str.split() also cuts at the separators below, the tokenizer doesn't
    group: list[list[str]] = []
    waiting: set[str] = set()

    def flush() -> None:
        words.learn(waiting)
        for parts in group:
            out.append(b"".join(map(words.__getitem__, parts)) + end)
        group.clear()
        waiting.clear()

    for t in texts:
        odd = t and any(c in t for c in "\x1c\x1d\x1e\x1f")
        parts = [p for p in t.translate(cut).split(" ") if p] if odd else (t or "").split()
        group.append(parts)
        waiting.update(parts)
        if len(waiting) > 100_000:
            flush()
    flush()
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        width, words = 4 * capacity, WordIds(tokenizer)
        for b in slices(batches, 100):
            ids, cols = b.column(0).to_pylist(), ([], [], [], [], [], [])
            with no_cycle_search():
                found = token_bytes(b.column(1).to_pylist(), words, end_id)
            for k, raw in zip(ids, found, strict=True):
                for n, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    row = (k, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_worker(run), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Rows (length, first rank, items, first sequence, items per sequence, first offset): the i-th of the items goes to
    sequence first + i // per at offset + (i % per) * length. Open bins are classes of consecutive sequences with the
    same room, kept sorted by room; an item goes to the class of least room that holds it.
    """
    out, rooms, classes, opened = [], [], {}, 0  # rooms: sorted; classes: room -> [(first sequence, sequences)]

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                insort(rooms, room)
                classes[room] = []
            classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            items = min(left, per * n)
            out.append((length, rank, items, first, per, capacity - room))
            full, rest = divmod(items, per)
            give(room - per * length, first, full)
            if rest:
                give(room - rest * length, first + full, 1)
            give(room, first + full + bool(rest), n - full - bool(rest))
            left, rank = left - items, rank + items
    return out


def pack(parts: DataFrame, capacity: int = 2048, bucket_rows: int = 50_000) -> DataFrame:
    """``parts`` (rows with a positive length up to ``capacity``, told apart by id and piece) with sequence_id and offset.

    No piece is dropped; sequences overlap nowhere and have no gaps before their end. An empty table stays empty.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    placed = spark.createDataFrame(plan(counts, capacity), "p_length bigint, p_rank bigint, p_items bigint, p_first bigint, p_per bigint, p_offset bigint")
    # lengths of cut pieces and of empty texts may hold most rows: the most frequent one decides on the buckets of a rank
    buckets = max(32, -(-max(counts.values(), default=0) // bucket_rows))
    ranked = gapless_rank(parts, ["length"], ["id", "piece", "start", "ids_crc32"], "rank", buckets)
    i = F.col("rank") - F.col("p_rank")
    # the plan has a few rows per length, at most some thousands: safe to broadcast
    met = ranked.join(F.broadcast(placed), (F.col("length") == F.col("p_length")) & (i >= 0) & (i < F.col("p_items")))
    seq = F.col("p_first") + F.floor(i / F.col("p_per"))
    return met.select(*parts.columns, seq.cast("long").alias("sequence_id"), (F.col("p_offset") + i % F.col("p_per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack whole documents.

    Null and empty texts are one piece of the end id alone; repeated ids keep all rows; other columns are not carried.
    """
    parts = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "packing-pieces")
    return pack(parts, capacity).withColumnRenamed("id", id_col)
