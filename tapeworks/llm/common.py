"""Helpers that several operators share: shared-folder tables, ranks, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """Folder that all machines see: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session (as in tests) takes one below the warehouse; a cluster has no such place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = found.get()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root


#: Where each table of ``materialize`` lies, for ``discard``.
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a form that outlives executors and that later stages prune by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    _TABLES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read again."""
    for df in tables:
        if path := _TABLES.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


#: Bytes of an Arrow batch that takes texts to Python.
BATCH_BYTES = 1 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most 1 MB; a smaller bound of the user's own stays.

    Texts have no bound, so that the usual bound on a batch's rows bounds nothing: ten thousand long documents would be
    held by the JVM and again by Python. Spark reads this setting when it plans a result that the caller may run at any
    later time, so it can't be put back here; it changes how rows are handed over, never what they are.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key, "64m"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def in_worker(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives its memory back.

    Workers live on and serve other operators' tasks beside the executor's heap; what a task has freed would stay with
    the allocators' pools. Caches belong to the task (local variables of ``run``), so that they end with it as well.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, to bound the Python objects alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Python's search for reference cycles off: it is slow where very many small objects without cycles are made."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Add ``name``: a rank from 0 without gaps within ``keys``.

    One key may hold any share of the rows, so no window runs over a whole key: rows fall into ``buckets`` by a
    hash of ``order``, are ranked within (key, bucket), and the buckets' counts, summed up by key, are added. The
    counts are at most keys x buckets rows. ``order`` must tell rows apart for the ranks to be reproducible.
    """
    b, n, base = f"{name}__bucket", f"{name}__count", f"{name}__base"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inner = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1
    ranked = df.withColumn(name, inner.cast("long"))
    on = [ranked[k].eqNullSafe(counts[k]) for k in [*keys, b]]
    out = ranked.join(counts, on, "inner").withColumn(name, F.col(name) + F.col(base))
    for k in [*keys, b]:
        out = out.drop(counts[k])
    return out.drop(b, base)


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a, b: longs); component is its smallest node.

    Alternates large-star and small-star steps. Minima are taken by partial aggregation and joined back on the
    node, so a node with very many neighbours is a skewed join that adaptive execution splits, never one group in
    one task. Each round is a table in the shared folder. Self-links are ignored.
    """
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name
    )
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        # minima are a table of their own: joined straight from their aggregation, a hot node's rows couldn't be split
        low = materialize(low.select("k", F.least("k", "m").alias("m")), name)
        large = both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), name)
        discard(cur, low)
        low = materialize(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), name)
        small = large.join(low, F.col("a") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        cur = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        discard(large, low)
        # a forest of stars: every node has one parent, no parent is itself a child, and the edge set stays as it was
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
