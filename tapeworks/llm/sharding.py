"""K-d tree partitioning of documents into shards of near-equal bytes, on DataFrame functions only.

The unit is a group of equal texts, so that copies share a shard; only a group that alone exceeds a shard is cut, by id,
into blocks. Each unit has metadata: its first id, its size, language and source. A node that must give k shards is split
at the weighted median that leaves k//2 of k parts of its bytes on the left, along its widest dimension after scaling by
the table's ranges; among units that are equal there, the next widest dimension decides, and so on. Medians are found for
all nodes at once by histograms that close in on the border. The last few units at the border are dealt to the two sides
so that the left comes nearest its part. What comes to the driver is bounded by nodes x bins.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import gapless_rank, materialize

DIMS = ("size", "lang", "source", "first")
#: Places by a hash among which equal units at a border are dealt.
SLOTS = 4096


def _code(c: str) -> Column:
    """A string as a number from 0 to 1, the same everywhere; null is 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)) / float(1 << 20), F.lit(0.0))


def _nest(path: list[tuple[str, float, float]], inner: Column) -> Column:
    """Left of the border, or at the border and ``inner``: each step of ``path`` is a border within the one before."""
    for dim, lo, hi in reversed(path):
        inner = (F.col(dim) < lo) | ((F.col(dim) <= hi) & inner)
    return inner


def _inside(path: list[tuple[str, float, float]]) -> Column:
    out = F.lit(True)
    for dim, lo, hi in path:
        out = out & F.col(dim).between(lo, hi)
    return out


def _per_node(values: dict[int, Column], otherwise: Column) -> Column:
    """The value of the row's node as one CASE."""
    out = otherwise
    for n, v in values.items():
        out = F.when(F.col("node") == n, v).otherwise(out)
    return out


def _ranges() -> list[Column]:
    return [F.min(d).alias(f"lo_{d}") for d in DIMS] + [F.max(d).alias(f"hi_{d}") for d in DIMS]


def _border(rows: list, goal: float, below: float, least: int, most: int) -> tuple[list, float]:
    """The bins at the goal: the one that holds it, with neighbours until they have ``least`` units but not over ``most``; and the bytes below them."""
    at = 0
    while at < len(rows) - 1 and below + rows[at]["w"] <= goal:
        below += rows[at]["w"]
        at += 1
    i, j, n = at, at + 1, rows[at]["n"]
    while n < least:
        near = [(rows[k]["n"], k) for k in (i - 1, j) if 0 <= k < len(rows) and n + rows[k]["n"] <= most]
        if not near:
            break
        more, k = min(near)
        n += more
        if k < i:
            i, below = k, below - rows[k]["w"]
        else:
            j = k + 1
    return rows[i:j], below


def _fill(weights: list[tuple[float, int]], goal: float) -> list[int]:
    """Slots whose weights come near ``goal``: largest first, each if it fits; then one more if that is nearer."""
    taken, out, left = 0.0, [], []
    for w, slot in sorted(weights, key=lambda x: (-x[0], x[1])):
        if taken + w <= goal:
            taken, _ = taken + w, out.append(slot)
        else:
            left.append((w, slot))
    if left and abs(taken + left[-1][0] - goal) < goal - taken:
        out.append(left[-1][1])
    return out


def assign(units: DataFrame, shards: int, bins: int = 1024, least: int = 16, most: int = 64, rounds: int = 12) -> DataFrame:
    """``units`` (uid, bytes, and the columns of DIMS as doubles, uid unique) with a column shard from 0 to shards - 1.

    A border has up to ``most`` units, and ``least`` if there are, so that dealing them evens out the two sides. It closes
    in by ``bins`` at a time, at most ``rounds`` times a level, which tells values apart that differ by the range's
    ``bins ** rounds``-th part, far below a double's precision; units that are together after that are equal in all
    dimensions, and are dealt to the two sides by a hash of their uid, however many they are.
    """
    spark = units.sparkSession
    whole = units.agg(*_ranges()).first()
    width = {d: (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0) or 1.0 for d in DIMS}
    cur = units.withColumn("node", F.lit(0))
    todo = {0: (0, shards)}  # node: (first shard, number of shards); at most ``shards`` nodes
    following = 1
    while any(k > 1 for _, k in todo.values()):
        open_nodes = [n for n, (_, k) in todo.items() if k > 1]
        stats = cur.filter(F.col("node").isin(open_nodes)).groupBy("node").agg(F.sum("bytes").alias("w"), F.count(F.lit(1)).alias("n"), *_ranges()).collect()
        if not stats:
            break
        cut = {}
        for r in stats:
            k = todo[r["node"]][1]
            span = {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in DIMS}
            order = sorted(DIMS, key=lambda d: ((span[d][0] - span[d][1]) / width[d], DIMS.index(d)))  # noqa: B023
            cut[r["node"]] = {"order": order, "span": span, "path": [], "n": r["n"], "goal": r["w"] * (k // 2) / k, "below": 0.0}
        for _ in range(rounds):
            wide = {n: next((d for d in c["order"] if c["span"][d][1] > c["span"][d][0]), None) for n, c in cut.items() if c["n"] > most}
            wide = {n: d for n, d in wide.items() if d}
            if not wide:
                break
            x = _per_node({n: F.col(d) for n, d in wide.items()}, F.lit(None).cast("double"))
            lo, hi = (_per_node({n: F.lit(float(cut[n]["span"][d][i])) for n, d in wide.items()}, F.lit(None).cast("double")) for i in (0, 1))
            inside = cur.filter(_per_node({n: _inside(cut[n]["path"]) for n in wide}, F.lit(False)))
            slot = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias("slot")
            hist = defaultdict(list)
            for r in inside.groupBy("node", slot).agg(F.sum("bytes").alias("w"), F.count(F.lit(1)).alias("n"), *_ranges()).collect():
                hist[r["node"]].append(r)
            for n, d in wide.items():
                c = cut[n]
                rows, c["below"] = _border(sorted(hist[n], key=lambda r: r["slot"]), c["goal"], c["below"], least, most)
                c["n"] = sum(r["n"] for r in rows)
                c["span"] = {e: (min(r[f"lo_{e}"] for r in rows), max(r[f"hi_{e}"] for r in rows)) for e in DIMS}
                c["path"].append((d, *map(float, c["span"][d])))
        # what is left at the border is few units, or units that are equal in all dimensions: these go by a hash of uid
        place = F.pmod(F.xxhash64("uid"), F.lit(SLOTS)).cast("int")
        at_border = cur.filter(_per_node({n: _inside(c["path"]) for n, c in cut.items()}, F.lit(False)))
        dealt = defaultdict(list)
        for r in at_border.groupBy("node", place.alias("slot")).agg(F.sum("bytes").alias("w")).collect():
            dealt[r["node"]].append((r["w"], r["slot"]))
        to_left = [(n, slot) for n, c in cut.items() for slot in _fill(dealt[n], c["goal"] - c["below"])]
        to_left = spark.createDataFrame(to_left, "l_node int, l_slot int")  # at most nodes x SLOTS rows
        cur = cur.join(F.broadcast(to_left), (F.col("node") == F.col("l_node")) & (place == F.col("l_slot")), "left")
        left = _per_node({n: _nest(c["path"], F.col("l_slot").isNotNull()) for n, c in cut.items()}, F.lit(False))
        children, after = {}, dict(todo)
        for n in cut:
            first, k = todo[n]
            del after[n]
            after[following], after[following + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            children[n] = F.lit(following + 1) - F.col("left").cast("int")
            following += 2
        todo = after
        cur = materialize(cur.withColumn("left", left).withColumn("node", _per_node(children, F.col("node"))).drop("left", "l_node", "l_slot"), "kd-units")
    return cur.withColumn("shard", _per_node({n: F.lit(first) for n, (first, _) in todo.items()}, F.lit(0)).cast("int")).drop("node")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", block_share: float = 1 / 64) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1. The law is ``bytes``: shards have near-equal sums of size.
    Equal texts share a shard; only where they exceed a shard together, blocks of them do, of ``block_share`` of a shard.
    slot numbers a shard's documents from 0 without gaps. grown_shard is null under this law. Null ids and repeated
    ids are documents like others; columns of the input that are named like those of the result don't matter. An empty
    table gives an empty result.
    """
    text = F.col(text_col)
    row = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        *[(_code(c) if c in docs.columns else F.lit(0.0)).alias(c) for c in ("lang", "source")],
    )
    row = materialize(row, "kd-rows")
    total = row.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    share = max(1.0, (total["w"] or 0) / shards)
    block = max(1.0, share * block_share)
    group = row.groupBy("h", "size", "text_crc32").agg(F.sum("size").alias("group_bytes"))
    # a group that is cut exceeds a shard, so there are fewer of them than shards
    cuts = group.filter(F.col("group_bytes") > share).select("h", "size", "text_crc32", F.ceil(F.col("group_bytes") / block).alias("blocks"))
    row = row.join(F.broadcast(cuts), ["h", "size", "text_crc32"], "left")
    number = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id", "lang", "source"), F.col("blocks"))).otherwise(F.lit(0))
    row = row.withColumn("uid", F.xxhash64("h", "size", "text_crc32", number.cast("long")))
    first = F.coalesce(F.col("id").try_cast("double"), F.xxhash64("id").cast("double"))
    units = row.groupBy("uid").agg(
        F.sum("size").cast("double").alias("bytes"), F.max("size").cast("double").alias("size"), F.min("lang").alias("lang"),
        F.min("source").alias("source"), F.coalesce(F.min(F.when(F.col("id").isNotNull(), first)), F.lit(0.0)).alias("first"),
    )
    placed = assign(materialize(units, "kd-units"), shards).select("uid", "shard")
    out = row.select("id", "size", "text_crc32", "lang", "source", "uid").join(placed, "uid")
    out = gapless_rank(out, ["shard"], ["id", "text_crc32", "size", "lang", "source"], "slot", max(16, total["n"] // (shards * 20_000)))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
