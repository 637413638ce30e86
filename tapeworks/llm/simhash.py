"""SimHash near-duplicates by anchor-point covering.

Texts become 64-bit fingerprints; two fingerprints link when they differ in at most two bits. The covering code is
the product of two binary Golay codes [23,12] over bits 0-22 and 23-45 (2**24 anchors). A Golay code is perfect with
covering radius 3: each block has one anchor part within distance 3, its home. A fingerprint y at distance at most 2
from x is, block by block, within 3 + t of x's home, the t summing to at most 2; so y is copied to every anchor that
near (about 61) and meets x at x's home. Each anchor compares its homes with the copies that came to it.

Anchors with more than ``hot`` homes (a cloud of near copies) do not compare pairs. Fingerprints at distance at most
2 share a point within distance 1 of both, and any two that share such a point link; so each member there goes to its
65 points and is tied to the smallest member of each point. That is exact and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import bounded, connected_components, discard, in_worker, materialize, slices

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles: lower-cased A-Z, words split at ASCII white space, repeats counted.

    Fewer words than ``shingle``: the whole sequence is the one shingle. No words (null, empty): 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ones, total, digest, part = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_digest, 1 << 14
    for at in range(0, total, part):  # long texts in parts: memory does not grow with the text's hashes
        some = words[at : min(at + part, total) + shingle - 1]
        hashes = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(some[i:] for i in range(shingle)), strict=False))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def signed(fp: int) -> int:
    """The 64 bits as Spark's long."""
    return fp - (fp >> 63 << 64)


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            fps = [signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_worker(run), f"id {kind}, fp bigint")


@lru_cache(4)
def code_tables(bits: int, generator: int, radius: int, reach: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For a perfect cyclic code: the syndrome of every word, and per t in 0..reach the error patterns by syndrome as (start, patterns)."""
    check = generator.bit_length() - 1
    unit = np.zeros(bits, np.int64)  # syndrome of each single bit: x^i modulo the generator
    for i in range(bits):
        r = 1 << i
        for j in range(i, check - 1, -1):
            if r >> j & 1:
                r ^= generator << (j - check)
        unit[i] = r
    syndrome = np.zeros(1 << bits, np.int16)
    for i in range(bits):
        syndrome[1 << i : 2 << i] = syndrome[: 1 << i] ^ unit[i]
    by_level = []
    for weights in (range(radius + 1), *[(radius + t,) for t in range(1, reach + 1)]):
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(bits), w)], np.int64)
        order = np.argsort(syndrome[pats], kind="stable")
        by_level.append((np.searchsorted(syndrome[pats][order], np.arange((1 << check) + 1)), pats[order]))
    return syndrome, by_level


#: Blocks of a fingerprint and their codes: (bits, generator, radius). TWO_GOLAY covers 46 bits.
TWO_GOLAY = ((23, GOLAY, 3), (23, GOLAY, 3))


def anchors(fps: np.ndarray, reach: int = 2, code: tuple = TWO_GOLAY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) for every anchor that a fingerprint (int64) goes to; an anchor is its blocks' messages."""
    blocks, shift = [], 0
    for bits, generator, radius in code:
        syndrome, levels = code_tables(bits, generator, radius, 2)
        y = fps >> shift & (1 << bits) - 1
        blocks.append((y, syndrome[y].astype(np.int64), levels, generator.bit_length() - 1))
        shift += bits
    message = code[1][0] - blocks[1][3]
    rows, at, home = [], [], []
    for t1 in range(reach + 1):
        for t2 in range(reach + 1 - t1):
            (y1, s1, l1, k1), (y2, s2, l2, k2) = blocks
            (o1, p1), (o2, p2) = l1[t1], l2[t2]
            n1, n2 = o1[s1 + 1] - o1[s1], o2[s2 + 1] - o2[s2]
            n = n1 * n2
            row = np.repeat(np.arange(len(fps)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            c1 = y1[row] ^ p1[o1[s1[row]] + k // n2[row]]
            c2 = y2[row] ^ p2[o2[s2[row]] + k % n2[row]]
            rows.append(row)
            at.append((c1 >> k1) << message | c2 >> k2)
            home.append(np.full(len(row), t1 + t2 == 0))
    return np.concatenate(rows), np.concatenate(at), np.concatenate(home)


def links(prints: DataFrame, hot: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose closure is that of all pairs at distance at most 2.

    ``prints`` has one row per fingerprint: fp, and node, the id that stands for it. Pairs are returned as nodes.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            fps = b.column(0).to_numpy(zero_copy_only=False)
            row, at, home = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(fps[row]), b.column(1).take(pa.array(row)), pa.array(home)], names=["anchor", "fp", "node", "home"])

    kind = prints.schema["node"].dataType.simpleString()
    copies = prints.select("fp", "node").mapInArrow(in_worker(spread), f"anchor int, fp bigint, node {kind}, home boolean")

    def home_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 20000):
            fps = b.column(0).to_numpy(zero_copy_only=False)
            row, at, _ = anchors(fps, reach=0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), b.column(1)], names=["at", "hfp", "hnode"])

    homes = prints.select("fp", "node").mapInArrow(in_worker(home_of), f"at int, hfp bigint, hnode {kind}")
    count = homes.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    cool = homes.join(count.filter(F.col("n") <= hot), "at", "left_semi").select("at", "hfp", "hnode")
    marks = count.filter(F.col("n") > hot).select("at", F.lit(None).cast("long").alias("hfp"), F.lit(None).cast(kind).alias("hnode"))
    near = (F.col("hfp") < F.col("fp")) & (F.bit_count(F.col("hfp").bitwiseXOR(F.col("fp"))) <= 2)
    # Spark takes copies for as large as the fingerprints they are made of, and would broadcast them: their joins are merged
    met = copies.hint("merge").join(cool.union(marks), (F.col("anchor") == F.col("at")) & (F.col("hfp").isNull() | near))
    met = materialize(met.select("fp", "node", "hfp", "hnode"), "simhash-met")
    pairs = met.filter("hfp is not null").select(F.col("hnode").alias("a"), F.col("node").alias("b"))
    cloud = met.filter("hfp is null").select("fp", "node").distinct()
    point = F.explode(F.concat(F.array(F.col("fp")), F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))")))
    points = cloud.select(point.alias("p"), "node")
    least = points.groupBy("p").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("p", "a")
    tied = points.hint("merge").join(least.hint("merge"), "p").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    return pairs.union(tied)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``: component_id is the smallest id reachable by links of at most 2 bits.

    Null and empty texts have fingerprint 0 and link like any other; repeated ids keep their rows; null ids never
    stand for a component unless no other id does; an empty table gives an empty result.
    """
    prints = materialize(with_fingerprint(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("node")), "simhash-distinct")
    parts = connected_components(links(distinct.filter("node is not null")), "simhash-cc")
    labels = distinct.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Sketches whose similarity is this near the limit don't decide: six standard errors of a sketch of 256.
MARGIN = 0.15
#: Buckets of hashed shingles whose counts order the shingles, and buckets in one row of counts.
BUCKETS, CHUNK = 1 << 21, 4096


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))]), ">u8").astype(np.uint64)


def prefix(h: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set (different hashes ``h``), in the order of all sets: by their bucket's level, then by hash.

    They are as many as a set may lack of one that is similar by ``least``, and one more: two such sets share one.
    """
    key = np.sort(levels[(h % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))
    return key[: int((1 - least) * len(h) + 1e-6) + 1].view(np.int64)


def sketch(text: str | np.ndarray | None, shingle: int, size: int | None) -> list[int]:
    """The ``size`` smallest different hashes of the shingles (or of such hashes, sorted), their upper 32 bits; or all of them, whole.

    Two sketches tell the similarity of the shingle sets, and exactly so where neither set exceeds them.
    """
    h = text if isinstance(text, np.ndarray) else np.unique(shingle_hashes(text, shingle))
    return h.view(np.int64).tolist() if size is None else (h[:size] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def similarity(a: list[int], b: list[int], size: int | None) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    kind = (np.int64, np.uint64) if size is None else (np.int32, np.uint32)
    a, b = (np.asarray(x, kind[0]).view(kind[1]) for x in (a, b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b)).sum() / len(both))


def probably_in(rows: DataFrame, ids: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """``rows`` whose id may be in ``ids``, found without moving them: a bitmap of hashed ids is broadcast.

    It has ``bits`` bits at most (8 MB), whatever the tables; some other rows stay, none of those asked for goes.
    """
    at = F.pmod(F.xxhash64(F.col("id")), F.lit(bits))
    bucket, place = F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at)
    maps = ids.select(bucket, place.alias("__place")).groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__map"))
    byte = F.conv(F.hex(F.expr("substring(__map, cast(__place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.select("*", bucket, place.alias("__place")).join(F.broadcast(maps), "__bucket")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(__place % 8 as int))")) != 0).select(rows.columns)


def similar_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, size: int) -> DataFrame:
    """(node, component) of texts that have a similar one; components are those of all pairs whose shingle sets have the similarity ``least`` or more.

    Equal sets are one class, tied to its smallest id. Classes meet by SimHash, as in ``near_duplicates``: fingerprints
    at most two bits apart link at the anchors of the covering code, and the texts that they stand for are held against
    each other. What these two bits leave apart, though similar, is met by the prefix filter: in one order of all shingles, rare ones first, two similar sets share a shingle among the first (1 - least) of each, at
    places that leave both enough to share. All pairs that do are met, but for those within a group: shingles of one
    group alone are left out, and pairs are made between the groups of a shingle, never within one. The order comes
    from counts by hashed bucket, of bounded size; it moves work only, never a result. Sketches then decide, and near
    the limit the whole shingle sets.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = bounded(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made_type = f"id {kind}, whole binary, n int, fp bigint, s array<int>, chunk int, counts binary"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["id", "whole", "n", "fp", "s", "chunk", "counts"], np.zeros(BUCKETS, np.uint32)
        types = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        id_type = None
        for b in slices(batches, 200):
            id_type, rows = b.schema.field(0).type, []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                np.add.at(counts, (h % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), signed(fingerprint(t)), sketch(h, shingle, size)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
        if id_type is not None:
            step = 16 * CHUNK  # the counts leave in small batches: as one they would be held three times over
            for at in range(0, BUCKETS, step):
                parts = np.minimum(counts[at : at + step], 65535).astype("<u2").reshape(-1, CHUNK)
                none = [pa.nulls(len(parts), t) for t in (id_type, *types)]
                numbers = np.arange(at // CHUNK, at // CHUNK + len(parts), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*none, pa.array(numbers), pa.array([x.tobytes() for x in parts], pa.binary())], names=names)

    # one pass over the texts for all that is small; each task's counts come last, as rows of their own
    both = materialize(texts.mapInArrow(in_worker(first_pass), made_type), "simhash-sets")
    made = both.filter("chunk is null").select("id", "whole", "n", "fp", "s")
    # tables of a row per class, text or shingle are merged below: as Parquet they are several times smaller than what a
    # broadcast of them holds, so that at some sizes Spark would send a hundred megabytes through the driver
    # the classes are a table of their own: joined straight from their aggregation, a large class's rows couldn't be split
    classes = materialize(made.groupBy("whole").agg(F.min("id").alias("node")), "simhash-classes")
    equal = made.select("id", "whole").join(classes.hint("merge"), "whole").filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    equal = materialize(equal.distinct(), "simhash-equal")
    reps = materialize(classes.select(F.col("node").alias("id")).distinct(), "simhash-reps")

    prints = materialize(made.join(reps.hint("merge"), "id").groupBy("id").agg(F.min("fp").alias("fp")), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("node")), "simhash-distinct")
    alike = prints.hint("merge").join(distinct.hint("merge"), "fp").filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    rough = materialize(alike.union(links(distinct)).distinct(), "simhash-candidates")

    def summed(rows: pa.Table) -> np.ndarray:
        total = np.zeros(CHUNK, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // CHUNK}").astype(np.int64)
        return total

    def part_sums(rows: pa.Table) -> pa.Table:
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "counts": pa.array([summed(rows).astype("<u8").tobytes()], pa.binary())})

    def to_levels(rows: pa.Table) -> pa.Table:
        level = np.minimum(np.rint(8 * np.log2(1 + summed(rows))), 255).astype(np.uint8)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})

    # in two steps, so that no group holds the counts of more than some hundreds of tasks
    counted = both.filter("chunk is not null").select("chunk", "counts", F.floor(F.spark_partition_id() / 512).alias("part"))
    counted = counted.groupBy("chunk", "part").applyInArrow(part_sums, "chunk int, counts binary")
    found = counted.groupBy("chunk").applyInArrow(to_levels, "chunk int, level binary").toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    for chunk, level in zip(found.column("chunk").to_pylist(), found.column("level").to_pylist(), strict=True):
        levels[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(level, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            rows = []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                rows.append((len(h), prefix(h, sent.value, least) if len(h) else h.view(np.int64)))
            n, tokens = zip(*rows, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), lists], names=["id", "n", "tokens"])

    def judged(pairs: DataFrame, most: int | None) -> DataFrame:
        """``pairs`` with their similarity, and whether it is exact, from sketches of at most ``most`` hashes."""

        def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 200):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t, shingle, None) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "s"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 200):
                x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
                s = [similarity(i, j, most) for i, j in zip(x, y, strict=True)]
                exact = [most is None or (len(i) < most and len(j) < most) for i, j in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array(exact, pa.bool_())], names=["a", "b", "s", "exact"])

        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if most is None:
            # an inner join (asked has no id twice): Spark would do a semi join before the filter, on all texts
            found = probably_in(texts, asked).join(asked, "id").select("id", "text").mapInArrow(in_worker(sketches), f"id {kind}, s array<bigint>")
            known = materialize(found, "simhash-sketches")
        else:
            known = probably_in(made.select("id", "s"), asked)
        known = known.groupBy("id").agg(F.min("s").alias("s"))  # repeated ids: one of their texts stands for them
        both = pairs.select("a", "b").join(known.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(known.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
        return materialize(both.select("a", "b", "sa", "sb").mapInArrow(in_worker(compare), f"a {kind}, b {kind}, s double, exact boolean"), "simhash-judged")

    def similar(pairs: DataFrame) -> DataFrame:
        seen = judged(pairs, size)
        clear = F.col("exact") | (F.col("s") >= least + MARGIN)
        fine = judged(seen.filter(~F.col("exact") & (F.abs(F.col("s") - least) < MARGIN)), None)
        return seen.filter(clear & (F.col("s") >= least)).select("a", "b").union(fine.filter(F.col("s") >= least).select("a", "b"))

    tied = materialize(equal.union(similar(rough)), "simhash-tied")
    group = materialize(connected_components(tied, "simhash-groups"), "simhash-groups")
    # texts of classes that the bitmap lets pass by mistake cost pairs of groups that are tied already
    prefixes = materialize(probably_in(texts, reps).mapInArrow(in_worker(rarest), f"id {kind}, n int, tokens array<bigint>"), "simhash-prefixes")
    tokens = prefixes.select("id", "n", F.posexplode("tokens").alias("place", "token"))
    # most tokens are of one text alone: they are counted, after partial sums, and stay where they are
    twice = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token"), "simhash-twice")
    some = probably_in(tokens.select(F.col("token").alias("id"), F.struct("id", F.expr("n - place").alias("left"), "n").alias("t")), twice.toDF("id"))
    some = some.select(F.col("id").alias("token"), "t.*").join(twice.hint("merge"), "token").join(group.toDF("id", "of").hint("merge"), "id", "left")
    some = materialize(some.select("token", "id", "left", "n", F.coalesce("of", "id").alias("of")), "simhash-tokens")

    def merged(group: DataFrame, links_: DataFrame) -> DataFrame:
        """``group`` with the groups of linked texts as one."""
        for side in "ab":
            links_ = links_.join(group.toDF(side, f"of_{side}").hint("merge"), side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
        wider = materialize(connected_components(links_.select("a", "b"), "simhash-cc"), "simhash-wider")
        inner = group.hint("merge").join(wider.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return materialize(inner.union(wider).distinct(), "simhash-groups")

    def of_several(some: DataFrame) -> DataFrame:
        """The shingles that texts of more than one group have; those of one group alone make no pairs."""
        shared = some.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).filter("lo < hi").select("token")
        return materialize(some.join(materialize(shared, "simhash-shared").hint("merge"), "token"), "simhash-tokens")

    # a pair's first shared shingle has nothing shared before it
    fits = F.least("la", "lb") >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-6
    side = lambda df, x, i: df.select("token", F.col("of").alias(x), F.col("id").alias(i), F.col("left").alias(f"l{i}"), F.col("n").alias(f"n{i}"))
    # first each text against one text of the shingle's first group, which is linear: most that is left of a large group joins it
    some = of_several(some)
    first = materialize(some.groupBy("token").agg(F.min(F.struct("of", "id", "left", "n")).alias("f")), "simhash-first")
    star = side(some, "y", "b").join(side(first.select("token", "f.*"), "x", "a").hint("merge"), "token").filter((F.col("x") != F.col("y")) & fits)
    group = merged(group, similar(materialize(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-star")))
    # then the members of any two groups that still share a shingle, where their sizes and its places leave enough to share
    some = some.drop("of").join(group.toDF("id", "of").hint("merge"), "id", "left").withColumn("of", F.coalesce("of", "id"))
    some = of_several(materialize(some, "simhash-tokens"))
    # sizes and places meet first, each once per group: many members of one group are one row there; members follow where these fit
    shapes = materialize(some.select("token", "of", "left", "n").distinct(), "simhash-shapes")
    shape = lambda x, i: shapes.select("token", F.col("of").alias(x), F.col("left").alias(f"l{i}"), F.col("n").alias(f"n{i}"))
    two = materialize(shape("x", "a").hint("merge").join(shape("y", "b"), "token").filter((F.col("x") < F.col("y")) & fits), "simhash-fits")
    both = two.hint("merge").join(side(some, "x", "a").hint("merge"), ["token", "x", "la", "na"]).join(side(some, "y", "b").hint("merge"), ["token", "y", "lb", "nb"])
    return merged(group, similar(materialize(both.select("a", "b").distinct(), "simhash-met")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, sketch_size: int = 256) -> DataFrame:
    """``docs`` with the document of smallest id of each group of near copies; all columns and null ids stay.

    Groups are the components of texts whose ``shingle``-word shingle sets have the similarity or more; they meet by
    SimHash and the covering code first, then by what these leave apart. Different texts
    of one id are documents of their own; rows equal in id and text are one document, and stay or go together.
    """
    # where ids repeat, which one pass over them tells, a document is known by its id and its text
    counted = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
    repeated = bool(counted.filter("__n > 1").take(1))
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")) if repeated else F.col(id_col)
    keyed = docs.withColumn("__key", F.when(F.col(id_col).isNotNull(), own))
    parts = similar_groups(keyed, "__key", text_col, shingle, similarity, sketch_size)
    gone = parts.filter("node <> component").select(F.col("node").alias("__id"))
    kept = keyed.join(gone.hint("merge"), F.col("__key") == F.col("__id"), "left_anti")
    return kept.drop("__key")
