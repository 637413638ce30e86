"""Alignment of two tokenizers' tokens by byte offsets, with corpus-wide counts of linked ids.

A links to B where a token of each ends at the same byte. A pair of ids is one 64-bit key, the first id in the upper
half. Documents are encoded once, to their digest and their different keys with multiplicities. Each partition sums its
keys with ``np.unique``; the partial counts are range-partitioned and sorted by key, and runs are summed on the way
into sorted shards: a file of keys and one of counts in the shared folder. To look keys up, a task maps the shards into
memory and searches them in order, so that it touches only pages that it needs; no count table is held by anyone.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import bounded, discard, in_worker, materialize, no_cycle_search, remove, shared_folder, slices
from tapeworks.llm.pretokens import LETTERS, MARKS, Pretokens

#: Different keys that a task holds before it passes its partial counts on, and those of a shard.
HELD, SHARD = 4_000_000, 2_000_000


class Pair:
    """Encodes chunks by both tokenizers and aligns them; chunks seen before are looked up, within a bound on their bytes.

    Texts are taken with a space before them. A chunk border (see ``Pretokens``) is a border of A's pre-tokens, and of B's
    pieces too if no piece has a space behind another character; so that both may encode chunks one by one.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 320 << 20):
        import sentencepiece

        self.cut = Pretokens(path_a)
        self.cut.tok.encode_special_tokens = True  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: i for i, c in enumerate(self.cut.chars)}
        vocab = self.cut.tok.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in piece)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("pieces of the second tokenizer reach over spaces")
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.space = self.b.piece_to_id("▁")
        if self.b.decode(self.b.encode("a  b ")) != "a  b " or self.b.encode("a")[:1] == self.b.encode(" a")[:1]:
            raise ValueError("the second tokenizer changes white space")
        # where no piece holds a letter before a mark, a word and the mark behind it are encoded apart
        joins = re.compile(f"[{LETTERS}][{re.escape(MARKS)}]").search
        separable = not any(joins(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.marks = {c: (self.cut.ids(c), self.b.encode("a" + c)[len(self.b.encode("a")) :]) for c in MARKS} if separable else {}
        # an id as text, with what follows it: within a group, and at a group's end
        self.a_text, self.b_text = (np.array([f"{i}," for i in range(n)] + [f"{i}{end}" for i in range(n)], object) for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")))
        self.a_len, self.b_len = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.most, self.held = most, 0
        #: chunk -> A's tokens, B's tokens, groups as a string, keys of the links in order; None where bytes differ
        self.chunks: dict[str, tuple[int, int, str, tuple[int, ...]] | None] = {}

    def align(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> Iterator[tuple[int, int, str, tuple[int, ...]] | None]:
        """Each chunk's alignment, from arrays over all of them: where ends of both sides fall together in their joined bytes."""
        raws = [c.encode("utf-8", "replace") for c in chunks]
        good = [b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y]) for raw, x, y in zip(raws, a, b, strict=True)]
        a, b = [x for x, g in zip(a, good, strict=True) if g], [x for x, g in zip(b, good, strict=True) if g]
        if not a:
            yield from (None for _ in chunks)
            return
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty
        of_a, of_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = shared[of_a] == ends_a, shared[of_b] == ends_b
        keys = (flat_a[last_a] << 32 | flat_b[last_b]).tolist()
        text = np.concatenate([self.a_text[flat_a + last_a * len(self.a_len)], self.b_text[flat_b + last_b * len(self.b_len)]])
        text = text[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")].tolist()
        tokens = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]).tolist()
        groups = (np.searchsorted(shared, ends_a[np.cumsum([len(x) for x in a]) - 1]) + 1).tolist()
        k = from_token = from_group = 0
        for g in good:
            if not g:
                yield None
                continue
            yield len(a[k]), len(b[k]), "".join(text[from_token : tokens[k]])[:-1], tuple(keys[from_group : groups[k]])
            from_token, from_group, k = tokens[k], groups[k], k + 1

    def learn(self, chunks: set[str]) -> None:
        known = self.chunks
        new = [c for c in chunks if c not in known]
        # a chunk of n characters, its ids, groups and keys take about 500 + 16 n bytes
        size = 500 * len(new) + 16 * sum(map(len, new))
        if known and self.held + size > self.most:
            known.clear()
            self.held, new = 0, list(chunks)
            size = 500 * len(new) + 16 * sum(map(len, new))
        self.held += size
        marked = [c for c in new if c[-1] in self.marks and self.cut.plain(c)]
        alone = list(dict.fromkeys([*set(new).difference(marked), *(w for c in marked if (w := c[:-1]) not in known)]))
        for at in range(0, len(alone), 20_000):
            some = alone[at : at + 20_000]
            a = [e.ids for e in self.cut.tok.encode_batch_fast(some, add_special_tokens=False)]
            # the second tokenizer puts a space before each; a space alone is not given to it
            b = [x if len(c) > 1 else [self.space] for c, x in zip(some, self.b.encode([c[1:] for c in some], num_threads=1), strict=True)]
            known.update(zip(some, self.align(some, a, b), strict=True))
        marks = dict(zip(self.marks, self.align(list(self.marks), *map(list, zip(*self.marks.values(), strict=True))), strict=True)) if self.marks else {}
        for c in marked:
            if word := known[c[:-1]]:
                m_a, m_b, more, last = marks[c[-1]]
                known[c] = word[0] + m_a, word[1] + m_b, f"{word[2]};{more}", word[3] + last
            else:
                known[c] = None

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text: n_a, n_b, n_groups, groups_sha256, different keys in order, and how often each is linked."""
        cut, none = [self.cut.chunks(" " + t) if t else [] for t in texts], np.empty(0, np.int64)
        at = 0
        while at < len(cut):
            end, waiting = at, set()
            while end < len(cut) and len(waiting) < 50_000:
                waiting.update(cut[end])
                end += 1
            self.learn(waiting)
            for chunks in cut[at:end]:
                counted = Counter(chunks)
                found = [self.chunks[c] for c in counted]
                if not found or any(f is None for f in found):
                    yield 0, 0, 0, "", none, none
                    continue
                times = np.fromiter(counted.values(), np.int64, len(counted))
                a, b, _, keys = zip(*found, strict=True)
                links = np.fromiter(map(len, keys), np.int64, len(keys))
                distinct, which = np.unique(np.fromiter(chain.from_iterable(keys), np.int64), return_inverse=True)
                weights = np.bincount(which, np.repeat(times, links)).astype(np.int64)  # below 2**53: exact in doubles
                known = self.chunks
                groups = ";".join([known[c][2] for c in chunks])
                yield int(times @ np.array(a)), int(times @ np.array(b)), int(times @ links), hashlib.sha256(groups.encode()).hexdigest(), distinct, weights
            at = end


def split_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """The two ids of each key as little-endian unsigned 32-bit numbers, which compress better than keys."""
    return (keys >> 32).astype("<u4").tobytes(), (keys & 0xFFFFFFFF).astype("<u4").tobytes()


def join_keys(a: bytes, b: bytes) -> np.ndarray:
    return np.frombuffer(a, "<u4").astype(np.int64) << 32 | np.frombuffer(b, "<u4").astype(np.int64)


def encode_pairs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, a, b, n) per row: a, b and n are the different linked ids and their multiplicities.

    Special tokens' strings are plain text. Texts that are null or empty, or that one of the tokenizers does not give
    back byte by byte behind a space, have no tokens: zeros, an empty digest, no links.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = Pair(path_a, path_b)
        for b in slices(batches, 200):
            with no_cycle_search():
                rows = [(n_a, n_b, n_groups, sha, *split_keys(keys), n.astype("<u4").tobytes()) for n_a, n_b, n_groups, sha, keys, n in pair.documents(b.column(1).to_pylist())]
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 3
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "n"])

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a binary, b binary, n binary"
    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_worker(run), schema)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts, in whole numbers."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[starts], np.add.reduceat(n, starts) if len(k) else n


def partial_counts(pairs: DataFrame) -> DataFrame:
    """(key, n): each partition's different keys; a partition of very many passes them on in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        keys, counts, waiting = none, none, ([], [])

        def merge() -> tuple[np.ndarray, np.ndarray]:
            out = summed([keys, *waiting[0]], [counts, *waiting[1]])
            waiting[0].clear()
            waiting[1].clear()
            return out

        def batch() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["key", "n"])

        for b in slices(batches, 500):
            for x, y, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                waiting[0].append(join_keys(x, y))
                waiting[1].append(np.frombuffer(n, "<u4").astype(np.int64))
            if sum(map(len, waiting[0])) > 1_000_000:
                keys, counts = merge()
            if len(keys) > HELD:
                yield from batch()
                keys, counts = none, none
        keys, counts = merge()
        yield from batch()

    return pairs.select("a", "b", "n").mapInArrow(in_worker(run), "key bigint, n bigint")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_shards(counts: DataFrame, folder: str, shards: int, shard: int = SHARD) -> DataFrame:
    """Shards of about ``shard`` counts, from ``shards`` ranges, below ``folder``; rows of (name, lo, hi) for each, and of (b, best): its highest counts by second id.

    Rows with equal keys meet by range partitioning and follow each other by the sort; a shard is written as it streams
    past, under a name of its own, so that a task that runs again disturbs nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "lo", "hi", "b", "best"]
        fs, root = open_folder(folder)
        held_k, held_n, best_b, best_n, size = [], [], np.empty(0, np.int64), np.empty(0, np.int64), 0

        def written(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            for what, x in (("keys", keys), ("counts", n)):
                with fs.open_output_stream(f"{root}/{name}.{what}") as f:
                    f.write(x.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(keys[0])], pa.int64()), pa.array([int(keys[-1])], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)

        def highest(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            b, n = np.concatenate([best_b, keys & 0xFFFFFFFF]), np.concatenate([best_n, n])
            order = np.lexsort((-n, b))
            b, n = b[order], n[order]
            first = np.concatenate([[True], b[1:] != b[:-1]])
            return b[first], n[first]

        for batch in slices(batches, max(1, shard // 4)):
            if not batch.num_rows:
                continue
            held_k.append(batch.column(0).to_numpy())
            held_n.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size > shard:
                keys, n = summed(held_k, held_n)
                # the last key may go on in the next batch
                held_k, held_n, size = [keys[-1:]], [n[-1:]], 1
                if len(keys) > 1:
                    best_b, best_n = highest(keys[:-1], n[:-1])
                    yield written(keys[:-1], n[:-1])
        if size:
            keys, n = summed(held_k, held_n)
            best_b, best_n = highest(keys, n)
            yield written(keys, n)
            k = len(best_b)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(best_b), pa.array(best_n)], names=names)

    slim = counts.select("key", "n").repartitionByRange(shards, "key").sortWithinPartitions("key")
    return slim.mapInArrow(in_worker(run), "name string, lo bigint, hi bigint, b bigint, best bigint")


class Shards:
    """Counts of keys from the sorted shards, each mapped into memory when it is first asked.

    A shared folder on this machine's own paths is mapped where it lies; from any other store a shard is copied first,
    into a file that is unlinked as soon as it is mapped.
    """

    def __init__(self, folder: str, shards: list[tuple[str, int, int]]):
        self.fs, self.root = open_folder(folder)
        self.shards, self.open, self.local = shards, {}, isinstance(self.fs, pafs.LocalFileSystem)

    def mapped(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in self.open:
            self.open[name] = tuple(self.map(f"{self.root}/{name}.{what}") for what in ("keys", "counts"))
        return self.open[name]

    def map(self, path: str) -> np.ndarray:
        if self.local:
            return np.memmap(path, "<i8", "r")
        with tempfile.NamedTemporaryFile() as own:
            with self.fs.open_input_stream(path) as f:
                shutil.copyfileobj(f, own)
            own.flush()
            return np.memmap(own.name, "<i8", "r")

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ``keys``, sorted and each in some shard."""
        out = np.zeros(len(keys), np.int64)
        for name, lo, hi in self.shards:
            i, j = np.searchsorted(keys, lo, "left"), np.searchsorted(keys, hi, "right")
            if i < j:
                k, n = self.mapped(name)
                out[i:j] = n[np.searchsorted(k, keys[i:j])]
        return out


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a``: a byte-level BPE file; ``path_b``: a sentencepiece BPE model that puts a space before texts. A group is
    what lies between two bytes where tokens of both end; as no token is empty, each group's end links one token of A
    and one of B. count_sum adds, over links, how many links of all documents hold the same two ids; n_best counts the
    links whose pair is as frequent as any with its B id. Null and repeated ids and repeated rows are rows like any
    other; other columns are not carried; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    pairs = materialize(encode_pairs(docs, path_a, path_b, id_col, text_col), "alignment-pairs")
    partial = materialize(partial_counts(pairs), "alignment-partial")
    folder = f"{shared_folder(spark).rstrip('/')}/alignment-shards-{uuid.uuid4().hex}"
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // SHARD))
    found = materialize(write_shards(partial, folder, shards), "alignment-found")
    # some numbers for each shard of two million keys, and one for each id of the second vocabulary
    names = [tuple(r) for r in found.filter("name is not null").select("name", "lo", "hi").orderBy("lo").collect()]
    tops = found.filter("b is not null").groupBy("b").agg(F.max("best").alias("best")).toArrow()
    best = np.zeros(max(tops.column("b").to_pylist(), default=0) + 1, np.int64)
    best[tops.column("b").to_numpy()] = tops.column("best").to_numpy()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, names)
        for rows in slices(batches, 500):
            a, b, n = (rows.column(c).to_pylist() for c in (5, 6, 7))
            keys = [join_keys(x, y) for x, y in zip(a, b, strict=True)]
            distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
            counts = shards.counts(distinct)
            top = counts == best[np.minimum(distinct & 0xFFFFFFFF, len(best) - 1)]
            links, n_best, total, at = [], [], [], 0
            for k, times in zip(keys, n, strict=True):
                times, mine = np.frombuffer(times, "<u4").astype(np.int64), which[at : at + len(k)]
                links.append(int(times.sum()))
                n_best.append(int(times[top[mine]].sum()))
                total.append(int(times @ counts[mine]))
                at += len(k)
            numbers = [pa.array(x, pa.int64()) for x in (links, n_best, total)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], *numbers, rows.column(4)], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    done = materialize(pairs.mapInArrow(in_worker(look_up), schema), "alignment")
    discard(pairs, partial, found)
    remove(spark, folder)
    return done.withColumnRenamed("id", id_col)
