"""Audit of how the sources of each language differ in their use of words.

Term counts by (language, source) come from partial sums of tasks and one shuffle. For the comparison of all sources of
a language, the kept terms fall into vocabulary chunks of bounded size, and each source's counts in a chunk are packed
into one row. Sources fall into blocks; a packed row goes to every pair of blocks that its source is in. The task of a
pair of blocks holds one chunk of two blocks at a time, adds up the submatrix of its pairs over successive chunks and
keeps no vectors. Terms that neither source of a pair has add the same value each, and are counted instead of visited.
A pair of blocks is divided into bands of chunks where the vocabulary is large; bands are summed by pair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.llm.common import bounded, discard, in_worker, materialize, no_cycle_search, slices

#: Entries that a task sums up before it passes them on; terms of a chunk, chunks of a band, sources of a block.
ENTRIES, CHUNK, BAND, BLOCK = 1_000_000, 4096, 64, 32
SCALE = 1_000_000_000
#: A term in UTF-8, A-Z lower-cased: bytes beyond ASCII belong to characters beyond it.
TERM = re.compile(rb"[a-z\x80-\xFF]+")


class Sums:
    """Occurrences and documents of each term by language and source."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str, tuple[Counter, Counter]]] = defaultdict(lambda: defaultdict(lambda: (Counter(), Counter())))

    def add(self, lang: str, source: str, text: bytes) -> None:
        n, df = self.of[lang][source]
        found = TERM.findall(text.lower())  # of bytes: A-Z only
        n.update(found)
        df.update(iter(dict.fromkeys(found)))  # in the same order, so that both keep their terms in one order

    def entries(self) -> int:
        return sum(len(n) for sources in self.of.values() for n, _ in sources.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row per language and term, with lists of the sources that have it."""
        for lang, sources in self.of.items():
            at: dict[bytes, int] = {}
            rows, source_no, n, df = [], [], [], []
            for k, (counted, docs) in enumerate(sources.values()):
                rows += [at.setdefault(t, len(at)) for t in counted]
                source_no.append(np.full(len(counted), k, np.int32))
                n += counted.values()
                df += docs.values()
            order = np.argsort(np.array(rows, np.int64), kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.array(rows, np.int64), minlength=len(at)))]).astype(np.int32)
            columns = [pa.array(list(sources), pa.string()).take(pa.array(np.concatenate(source_no)[order])), pa.array(np.array(n, np.int64)[order]), pa.array(np.array(df, np.int64)[order])]
            lists = [pa.ListArray.from_arrays(pa.array(offsets), c) for c in columns]
            terms = pa.array(list(at), pa.binary()).view(pa.string())
            whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(at)), terms, *lists], names=["lang", "term", "source", "n", "df"])
            yield from slices(iter([whole]), 20_000)
        self.of.clear()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, term, source, n, df) per task, the last three as arrays; a language's row with the term null lists all its sources, so that none is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, groups = Sums(), defaultdict(set)
        for b in slices(batches, 200):
            with no_cycle_search():
                for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    groups[lang].add(source)
                    sums.add(lang, source, text)
            if sums.entries() > ENTRIES:
                yield from sums.batches()
        yield from sums.batches()
        if groups:
            sources = [sorted(s) for s in groups.values()]
            zeros = [[0] * len(s) for s in sources]
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [list(groups), [None] * len(groups), sources, zeros, zeros]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["lang", "term", "source", "n", "df"])

    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col))
    return docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text")).mapInArrow(in_worker(run), "lang string, term string, source array<string>, n array<bigint>, df array<bigint>")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), in whole numbers: of 64 bits while they hold the product, else of up to 38 digits."""
    size = total + kept
    wide = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), size.cast("decimal(20,0)")).cast("long")
    return F.lit(1) + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), size)).otherwise(wide)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q): shares are at most SCALE + 1, so that squares stay below 2**63."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, size: int) -> np.ndarray:
    """``share`` of counts ``n`` where total + kept is ``size``; three decimal digits at a time, exact for sizes below 9 * 10**15."""
    out, rest = np.divmod(n + 1, size)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digits
    return out + 1


class Tile:
    """The pairs of two blocks of sources, summed over the chunks of one band."""

    def __init__(self, key: tuple[str, int, int, int]):
        self.key, self.sides, self.visited = key, ({}, {}), 0
        self.sums: np.ndarray | None = None

    def begin(self) -> None:
        self.names = [sorted(s) for s in self.sides]
        self.at = [{g: i for i, g in enumerate(names)} for names in self.names]
        self.sums = np.zeros((2, len(self.names[0]), len(self.names[1])), np.int64)
        self.size = [np.array([s[g] for g in names], np.int64) for s, names in zip(self.sides, self.names, strict=True)]
        self.none = [np.array([int(shares(np.zeros(1, np.int64), int(d))[0]) if d else 1 for d in size], np.int64) for size in self.size]

    def add(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """One chunk: (side, source, places, counts) of the sources that have terms of it."""
        if self.sums is None:
            self.begin()
        union = np.unique(np.concatenate([places for _, _, places, _ in rows]))
        dense = [np.repeat(none[:, None], len(union), 1) for none in self.none]
        for side, g, places, counts in rows:
            i = self.at[side][g]
            dense[side][i, np.searchsorted(union, places)] = shares(counts, int(self.size[side][i]))
        x, y = dense
        for i in range(len(x)):  # a row of pairs at a time: sources of a block times terms of a chunk
            d = (x[i] - y) ** 2
            self.sums[0, i] += (d // y).sum(1)
            self.sums[1, i] += (d // x[i]).sum(1)
        self.visited += len(union)

    def rows(self) -> Iterator[tuple]:
        """(lang, g, h, value, visited): value of g against h over the terms visited, and their number."""
        lang, i, j, _ = self.key
        if self.sums is None:
            self.begin()
        for x, g in enumerate(self.names[0]):
            for y, h in enumerate(self.names[1]):
                if g != h:
                    yield lang, g, h, int(self.sums[0, x, y]), self.visited
                    if i != j:
                        yield lang, h, g, int(self.sums[1, x, y]), self.visited


def tile_sums(rows: DataFrame) -> DataFrame:
    """Rows (lang, i, j, band, chunk, side, g, size, places, counts), sorted by tile and chunk, to (lang, g, h, value, visited).

    A tile's first rows, of chunk -1, have its sources and their sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, waiting, out = None, None, [], []

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["lang", "g", "h", "value", "visited"])
            out.clear()
            return made

        for b in slices(batches, 500):
            for lang, i, j, band, c, side, g, size, places, counts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                key = (lang, i, j, band)
                if waiting and (tile.key != key or c != chunk):
                    tile.add(waiting)
                    waiting = []
                if tile is None or tile.key != key:
                    if tile is not None:
                        out += tile.rows()
                    tile = Tile(key)
                chunk = c
                if c < 0:
                    tile.sides[side][g] = size
                else:
                    waiting.append((side, g, np.array(places, np.int64), np.array(counts, np.int64)))
            if len(out) > 20_000:
                yield batch()
        if waiting:
            tile.add(waiting)
        if tile is not None:
            out += tile.rows()
        if out:
            yield batch()

    return rows.select("lang", "i", "j", "band", "chunk", "side", "g", "size", "places", "counts").mapInArrow(in_worker(run), "lang string, g bigint, h bigint, value bigint, visited bigint")


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", chunk_terms: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` with every other source of the language, ``term`` with the source's own terms.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of ``least_docs``
    or more of its documents, repeated rows included. Shares are smoothed by one and scaled to whole numbers; the value
    of a pair sums floor((p - q)**2 / q) over all kept terms (0 without any), that of a term holds the source against
    its language, for terms more frequent there, of which the ``top_terms`` highest are given. Ties go to the smaller
    item by its UTF-8 bytes. Null texts, languages and sources are ''; a source without any kept term is compared like
    all others; ids and other columns play no part; an empty table gives an empty result.
    """
    # everything about a term of a language meets in one place: counts by source, then the language's sums over them
    parts = term_counts(bounded(docs), lang_col, source_col, text_col).repartition("lang", "term")
    each = parts.select("lang", "term", F.explode(F.arrays_zip("source", "n", "df")).alias("e")).select("lang", "term", "e.*")
    cells = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"in_lang": F.sum("n").over(term), "df": F.sum("df").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    cells = materialize(cells.filter(F.col("term").isNull() | (F.col("df") >= least_docs)).drop("df"), "divergence-cells")
    own = cells.filter("term is not null").select("lang", "source", "term", "n", "in_lang")
    kept = cells.filter("term is not null and first").select("lang", "term", "in_lang")
    chunks = max(1, -(-kept.count() // chunk_terms))

    # one row per source or language
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cells.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / block))
    groups = materialize(groups, "divergence-groups")

    met = own.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("in_lang"), F.col("lang_n"), F.col("v"))
    terms = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    # a term's place in its chunk, which holds about chunk_terms of all languages; the chunk's counts then meet where they are
    chunk = F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int")
    placed = own.select("lang", "source", chunk.alias("chunk"), F.dense_rank().over(Window.partitionBy("lang", chunk).orderBy("term")).alias("place"), "n")
    packed = placed.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("terms"))
    packed = packed.join(groups.select("lang", "source", "g", "blocks"), ["lang", "source"])
    packed = packed.select("lang", "g", "blocks", "chunk", F.lit(None).cast("long").alias("size"), F.col("terms.place").alias("places"), F.col("terms.n").alias("counts"))
    none = [F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<bigint>").alias("counts")]
    bands = -(-chunks // BAND)
    heads = groups.select("lang", "g", "blocks", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), F.lit(-1).alias("chunk"), (F.col("total") + F.col("v")).alias("size"), *none)
    every = heads.unionByName(packed.withColumn("band", F.floor(F.col("chunk") / BAND).cast("int")))
    # a source of block b is on the left of pairs (b, x >= b) and on the right of pairs (x <= b, b)
    b = F.floor(F.col("g") / block).cast("int")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    left = F.transform(F.sequence(b, F.col("blocks").cast("int") - 1), lambda x: pair(b, x, 0))
    right = F.transform(F.sequence(F.lit(0), b), lambda x: pair(x, b, 1))
    tiled = every.withColumn("pair", F.explode(F.concat(left, right))).select("lang", "pair.*", "band", "chunk", "g", "size", "places", "counts")
    tiled = tiled.repartition("lang", "i", "j", "band").sortWithinPartitions("lang", "i", "j", "band", "chunk")
    sums = tile_sums(tiled).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("visited").alias("visited"))

    one, other = groups.select("lang", "source", "g", "total", "v"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("total").alias("item_total"))
    zero = F.lit(0).cast("long")
    rest = F.when(F.col("v") > 0, excess(share(zero, F.col("total"), F.col("v")), share(zero, F.col("item_total"), F.col("v")))).otherwise(zero)
    pairs = sums.join(one, ["lang", "g"]).join(other, ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("v") - F.col("visited")) * rest).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    done = materialize(pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    discard(cells, groups)
    return done
