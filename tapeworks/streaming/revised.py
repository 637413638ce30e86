"""Bars that are emitted at once and corrected when ticks come late or again.

State is kept by (symbol, bar), so that a busy symbol spreads over its bars: the bar's ticks by number, the last one
counting where a number repeats, and the bar's revision. An event-time timer drops the state once no tick of the bar
can come any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tapeworks.sources.bars import keep_last

BAR = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double, amount double, revision int"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this provider, which keeps it on executors' disks and its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Bar(StatefulProcessor):
    """One bar of one symbol."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getMapState("ticks", T.StructType([T.StructField("no", T.LongType())]), T.StructType([T.StructField("ts", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("seq", T.LongType())]))
        self.shown = handle.getValueState("shown", T.StructType([T.StructField("revision", T.IntegerType()), T.StructField("bar", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = int(key[1].timestamp() * 1000) + self.keep_ms
        if timerValues.getCurrentWatermarkInMs() >= ends:
            return  # the bar's state has ended, or does in this batch
        for part in rows:
            for no, ts, price, seq in zip(part["no"], part["micros"], part["price"], part["seq"], strict=True):
                held = self.ticks.getValue((int(no),)) if self.ticks.containsKey((int(no),)) else None
                if held is None or held[2] <= seq:
                    self.ticks.updateValue((int(no),), (int(ts), float(price), int(seq)))
        found = sorted((ts, no, price) for (no,), (ts, price, _) in self.ticks.iterator())
        prices = [p for _, _, p in found]
        bar = (prices[0], max(prices), min(prices), prices[-1], float(len(prices)), float(sum(prices)))
        old = self.shown.get() if self.shown.exists() else None
        if old is None:
            self.handle.registerTimer(ends)
        if old is None or old[1] != repr(bar):
            revision = 0 if old is None else old[0] + 1
            self.shown.update((revision, repr(bar)))
            yield pd.DataFrame([(key[0], key[1], *bar, revision)], columns=["symbol", "datetime", "open", "high", "low", "close", "volume", "amount", "revision"]).astype({"revision": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ticks.clear()
        self.shown.clear()
        yield from ()

    def close(self) -> None:
        pass


def revised_bars(ticks: DataFrame, symbol: str, ts: str, price: str, order: str, seq: str, width_minutes: int = 60, late_minutes: int = 7 * 24 * 60) -> DataFrame:
    """A stream of bars in update mode: a bar's first row has revision 0, each correction the next one.

    ``order`` numbers ticks; of ticks with one number in a bar the one of the largest ``seq`` counts, whichever comes first. Ticks
    may be ``late_minutes`` behind the newest; those behind that are dropped, and the state of their bars is gone. Null
    times, prices and numbers go.
    """
    use_rocksdb(ticks.sparkSession)
    t = ticks.filter(F.col(ts).isNotNull() & F.col(price).isNotNull() & F.col(order).isNotNull())
    t = t.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(price).cast("double").alias("price"), F.col(order).cast("long").alias("no"), F.col(seq).cast("long").alias("seq"))
    t = t.withWatermark("ts", f"{late_minutes} minutes").withColumn("bar", F.window("ts", f"{width_minutes} minutes")["start"])
    keep = (width_minutes + late_minutes) * 60_000
    return t.groupBy("symbol", "bar").transformWithStateInPandas(Bar(keep), BAR, "Update", "EventTime")


def latest(revisions: DataFrame) -> DataFrame:
    """The last revision of each bar that a stream has written."""
    return keep_last(revisions, ["symbol", "datetime"], F.col("revision"))


def last_ticks(ticks: DataFrame, order: str, seq: str) -> DataFrame:
    """Of ticks with one number the one of the largest ``seq``: what a batch over all of them counts."""
    w = Window.partitionBy(order).orderBy(F.desc(seq))
    return ticks.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
