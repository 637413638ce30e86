"""Embedding near-duplicates by a subspace pigeonhole join.

On unit vectors, cosine >= c means squared distance <= 2 - 2c. After a fixed random rotation the dimensions are cut
into blocks; in at least one block, the squared distance of such a pair is at most its share of that budget. Each block
is a range join over cells, the signs of its first coordinates. Where two vectors lie on different sides of a plane,
their distance there is the sum of theirs from it; so over the planes that part them the squares of both sum to at most
the share, and for one of the two they are at most half of it. A vector has a home cell and visits the cells that it
reaches by half the share: one of any such pair meets the other at home. Where both do, the home of the smaller id counts.

Few first coordinates make the tiles, whose homes one task holds; a vector is copied to the tiles it visits. Within a
task all of them make the cells. Two joins follow each other. The first knows of a vector its coordinates in the block
alone, and tells which vectors have any other near in a block; these few have their whole vectors dealt to the second.
There pairs near in the block are verified in doubles, and count in the first block that holds them, so no pair is
counted twice and none is written: a task returns numbers of links, and the edges of a spanning forest of the links it saw.

Coordinates are whole numbers, whose sums are the same in any order: all tasks decide alike. The rotation is made of
whole numbers too; what rounding moves is allowed for in the share, and the cosine is that of the vectors as they came.

Equal vectors are one class throughout. Tiles hold at most about ``tile`` homes; copies stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import connected_components, in_worker, materialize, slices

#: Bits of a coordinate's fraction, and of the squares that are summed over planes: such sums are exact in single floats.
FRACTION, SQUARES = 14, 20
#: Numbers in a product's result.
ROOM = 1 << 22


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(raw: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The unit vectors' coordinates as whole numbers of 2**-14; products of whole numbers, so no batch changes them."""
    unit = np.rint(np.ldexp(raw / np.linalg.norm(raw, axis=1, keepdims=True), 20))
    return np.rint(np.ldexp(unit @ np.rint(np.ldexp(turn, 20)), FRACTION - 40)).astype(np.int16)


def reached(distance: float, dim: int) -> float:
    """The squared distance within which the rounded coordinates are of vectors at most ``distance`` apart."""
    return (distance + 2.02 * (dim**0.5 * 2.0 ** (-FRACTION - 1) + (dim**0.5 + dim) * 2.0**-21)) ** 2


def squares(z: np.ndarray) -> np.ndarray:
    return (z.astype(np.int64) ** 2 >> 2 * FRACTION - SQUARES).astype(np.float32)


class Forest:
    """Union by smallest number."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Tile:
    """The homes of one tile, by cell. ``z`` has their coordinates in the block."""

    def __init__(self, block: int, ids: np.ndarray, z: np.ndarray, conf: dict):
        self.block, self.conf = block, conf
        signs, code = self.signs(z)
        self.order = np.argsort(code, kind="stable")
        self.ids, self.z, self.code = ids[self.order], z[self.order], code[self.order]
        self.cells, self.starts = np.unique(self.code, return_index=True)
        self.ends = np.r_[self.starts[1:], len(ids)]
        self.bits = signs[self.order][self.starts].astype(np.float32)
        x = np.ldexp(self.z.astype(np.float32), -FRACTION)
        self.x = np.concatenate([x, (x**2).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)], 1)
        self.marked = np.zeros(len(ids), bool)
        # results of products go to the same memory each time: new pages cost several times the products
        self.room, self.flags = np.empty(ROOM, np.float32), np.empty(ROOM, bool)

    def signs(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signs = z[:, : self.conf["bits"]] >= 0
        return signs, signs.astype(np.int64) @ (1 << np.arange(signs.shape[1]))

    def at_most(self, a: np.ndarray, b: np.ndarray, plus: np.ndarray | None, most: np.float32) -> np.ndarray:
        """Where ``a @ b + plus`` is at most ``most``; holds until it is called again."""
        n = len(a) * b.shape[1]
        out, flags = self.room[:n].reshape(len(a), -1), self.flags[:n].reshape(len(a), -1)
        np.matmul(a, b, out=out)
        if plus is not None:
            np.add(out, plus, out=out)
        return np.less_equal(out, most, out=flags)

    def hits(self, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home, visitor) of all pairs near in the block whose visitor reaches the home's cell, and some that are a little further."""
        signs, _ = self.signs(z)
        q, own = squares(z[:, : signs.shape[1]]), signs.astype(np.float32)
        change, base = q * (1 - 2 * own), (q * own).sum(1)
        y = np.ldexp(z.astype(np.float32), -FRACTION)
        y = np.concatenate([-2 * y, np.ones((len(y), 1), np.float32), (y**2).sum(1, keepdims=True)], 1)
        some, most, change = max(1, ROOM // len(z)), np.float32(self.conf["share"] + 1e-5), np.ascontiguousarray(change.T)
        for c0 in range(0, len(self.cells), some):
            cell, at = np.divmod(np.flatnonzero(self.at_most(self.bits[c0 : c0 + some], change, base, self.conf["half"])), len(z))
            bounds = np.searchsorted(cell, np.arange(min(some, len(self.cells) - c0) + 1))
            for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
                for p0 in range(bounds[c], bounds[c + 1], 4096):
                    p = at[p0 : min(p0 + 4096, bounds[c + 1])]
                    other = np.ascontiguousarray(y[p].T)
                    for h0 in range(self.starts[c0 + c], self.ends[c0 + c], 1024):
                        near = self.at_most(self.x[h0 : min(h0 + 1024, self.ends[c0 + c])], other, None, most)
                        if near.any():
                            h, k = np.divmod(np.flatnonzero(near), len(p))  # far faster than np.nonzero of a table
                            yield h + h0, p[k]

    def meet(self, ids: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(ids), bool)
        for h, p in self.hits(z):
            other = self.ids[h] != ids[p]
            self.marked[h[other]] = seen[p[other]] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen])], names=["node"])

    def result(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.marked])], names=["node"])


class Verifying(Tile):
    """A tile with whole vectors, and what has been found for its homes."""

    def __init__(self, block: int, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, conf: dict):
        z = rotated(raw, conf["turn"])
        super().__init__(block, ids, z[:, block * conf["width"] :][:, : conf["width"]], conf)
        self.copies, self.raw, self.whole = copies[self.order], raw[self.order], z[self.order]
        self.norm, self.q = np.linalg.norm(self.raw, axis=1), squares(self.z[:, : conf["bits"]])
        self.links = np.zeros(len(ids), np.int64)
        self.forest, self.edges = Forest(), []

    def meet_whole(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, norm, links = rotated(raw, self.conf["turn"]), np.linalg.norm(raw, axis=1), np.zeros(len(ids), np.int64)
        z = whole[:, self.block * self.conf["width"] :][:, : self.conf["width"]]
        code = self.signs(z)[1]
        for hs, ps in self.hits(z):
            for k in range(0, len(hs), 16384):
                h, p = self.counted_here(hs[k : k + 16384], ps[k : k + 16384], ids, whole, code)
                cos = np.einsum("ij,ij->i", self.raw[h], raw[p]) / (self.norm[h] * norm[p])
                h, p = h[cos >= self.conf["cosine"]], p[cos >= self.conf["cosine"]]
                np.add.at(self.links, h, copies[p])
                np.add.at(links, p, self.copies[h])
                self.tie(self.ids[h], ids[p])
        some = links > 0
        yield _out(ids[some], links[some], [None] * int(some.sum()))

    def counted_here(self, h, p, ids, whole, code) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that are near in this block, in none before it, and whose other meeting in it, if any, does not count."""
        c, w = self.conf, self.conf["width"]
        other = self.ids[h] != ids[p]
        h, p = h[other], p[other]
        parted = (self.code[h] ^ code[p])[:, None] >> np.arange(c["bits"]) & 1
        ours = (self.ids[h] < ids[p]) | ((self.q[h] * parted).sum(1) > c["half"])
        h, p = h[ours], p[ours]
        for k in range(self.block + 1):
            apart = self.whole[h, k * w : k * w + w].astype(np.int64) - whole[p, k * w : k * w + w]
            near = (apart**2).sum(1) <= c["share"] * 4.0**FRACTION
            h, p = (h[near], p[near]) if k == self.block else (h[~near], p[~near])
        return h, p

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        """Ties of pairs; those that are tied already are found together."""
        known, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = np.array([self.forest.find(x) for x in known.tolist()], np.int64)[place]
        new = roots[: len(a)] != roots[len(a) :]
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            if self.forest.tie(x, y):
                self.edges.append((x, y))

    def result(self) -> Iterator[pa.RecordBatch]:
        some = self.links > 0
        yield _out(self.ids[some], self.links[some], [None] * int(some.sum()))
        if self.edges:
            a, b = np.array(self.edges, np.int64).T
            yield _out(a, np.zeros(len(a), np.int64), b)


def _out(a, n, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, n, b)], names=["a", "links", "b"])


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of doubles, each scaled by a power of two so that its largest component is about 1: no square under- or overflows, no cosine changes."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, initial=0))[1][:, None])


def _met(classes: DataFrame, conf: dict, blocks: int, cell_bits: int, tile: int, whole: bool) -> DataFrame:
    """What the tasks of one join return: with whole vectors links and edges, without them the nodes that have others near in a block."""
    spark, width = classes.sparkSession, conf["width"]
    n = classes.count()
    bits = min(cell_bits, width)
    # tiles for memory, some for tasks; about 64 homes a cell, as work on fewer is mostly overhead
    first = min(bits, max(((max(n, 1) - 1) // tile).bit_length(), 2 if n >= 8192 else 0))
    conf = conf | {"bits": min(bits, max(first, (n // 64).bit_length()))}
    turn, half = conf["turn"], conf["half"]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(blocks << first, np.int64)
        for b in slices(batches, 4096):
            z = rotated(_vectors(b.column(0)), turn)
            for k in range(blocks):
                np.add.at(counts, (k << first) + (z[:, k * width : k * width + first] >= 0) @ (1 << np.arange(first)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["at", "n"])

    # a tile of more homes than ``tile`` is several, to which its homes are dealt and which all its visitors visit
    parts = np.ones(blocks << first, np.int64)
    for r in classes.select("vec").mapInArrow(homes, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row per tile
        parts[r["at"]] = max(1, -(-r["n"] // tile))
    base = np.cumsum(parts) - parts
    block_of = np.repeat(np.arange(len(parts)) >> first, parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = (np.arange(1 << first)[:, None] >> np.arange(first) & 1).astype(np.float32)
        for b in slices(batches, 2048):
            z = rotated(_vectors(b.column(1)), turn)
            part = (b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for k in range(blocks):
                zb = z[:, k * width : k * width + width]
                own = (zb[:, :first] >= 0) @ (1 << np.arange(first))
                visits = squares(zb[:, :first]) @ reach.T <= half
                for flip in range(1 << first):
                    at = np.flatnonzero(visits[:, flip])
                    to = (k << first) + (own[at] ^ flip)
                    for i in range(int(parts[to].max(initial=0))):
                        here = at[parts[to] > i]
                        cell = base[to[parts[to] > i]] + i
                        home = (part[here] % parts[to[parts[to] > i]] == i) & (flip == 0)
                        take = b.take(pa.array(here))
                        vec = take.column(1) if whole else pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * width), pa.array(zb[here].ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(~home), take.column(0), take.column(2), vec], names=["cell", "visits", "node", "copies", "vec"])

    kind = classes.schema["vec"].dataType.simpleString() if whole else "array<smallint>"
    cells = classes.select("node", "vec", "copies").mapInArrow(in_worker(spread), f"cell int, visits boolean, node bigint, copies bigint, vec {kind}")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(8 * len(block_of), 4096))
    dealt = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "visits")

    def meet(held: Tile, columns: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 16384):
            ids, copies, vecs = (x[at : at + 16384] for x in columns)
            yield from held.meet_whole(ids, copies, vecs) if whole else held.meet(ids, vecs)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, waiting = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            """The homes, once all are here, are held and meet each other; visitors meet them."""
            nonlocal held, waiting
            if waiting:
                columns, waiting = [np.concatenate(x) for x in zip(*waiting, strict=True)], []
                if held is None:
                    block = int(block_of[cell])
                    held = Verifying(block, *columns, conf) if whole else Tile(block, columns[0], columns[2], conf)
                yield from meet(held, columns)

        for b in slices(batches, 16384):
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if keys[s, 0] != cell:
                    yield from flush()
                    if held is not None:
                        yield from held.result()
                    cell, held = keys[s, 0], None
                if keys[s, 1] and held is None:
                    yield from flush()
                if keys[s, 1] and held is None:
                    continue  # visitors of a tile without homes
                part = b.slice(s, e - s)
                vecs = _vectors(part.column(4)) if whole else part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                waiting.append((part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), vecs))
                if keys[s, 1] and sum(len(x[0]) for x in waiting) >= 16384:
                    yield from flush()
        yield from flush()
        if held is not None:
            yield from held.result()

    return dealt.mapInArrow(in_worker(join), "a bigint, links bigint, b bigint" if whole else "node bigint")


def near_vectors(df: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, blocks: int = 4, cell_bits: int = 12, tile: int = 131_072) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly. Rows whose vector is null, zero, of another length than ``dim`` or
    has null or non-finite components link with nothing. Equal vectors of one id are rows like others; different vectors of one id share
    their links. An empty table gives
    an empty result.
    """
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.when(ok, F.col(vec_col)).alias("vec"))
    classes = rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.filter("node is not null"), "subspace-classes")
    width = dim // blocks
    if width * blocks != dim:
        raise ValueError("blocks must divide the dimensions")
    share = reached((2 - 2 * cosine) ** 0.5, dim) / blocks
    conf = {"turn": rotation(dim), "width": width, "share": share, "half": np.float32(share / 2 * (1 << SQUARES)), "cosine": cosine}
    near = materialize(_met(classes, conf, blocks, cell_bits, tile, whole=False).distinct(), "subspace-near")
    some = materialize(classes.join(near.hint("merge"), "node", "left_semi").select(classes.columns), "subspace-some")
    met = materialize(_met(some, conf, blocks, cell_bits, tile, whole=True), "subspace-met")
    counts = met.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts_of = connected_components(met.filter("b is not null").select("a", "b"), "subspace-cc")
    labels = classes.join(counts, "node", "left").join(parts_of, "node", "left")
    labels = labels.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.filter("vec is not null").join(labels, "vec", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
