"""Bar series of many symbols that are kept up to date by batches: what is missing, one commit per batch, the merged rows.

Layout below the root: ``data/<n>`` has the rows that commit n brought (new bars and corrected ones), ``state/<n>-<batch>``
one row per symbol with its coverage and the commits that hold live rows of it. A commit counts once its state is
complete; a batch that comes again changes nothing, and what a broken commit has left is named by no state. No file is
ever written again: a symbol whose segments have become many is merged within the next commit that touches it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.sources.bars import keep_last

STATE = "symbol string, coverage_start date, coverage_end date, last_bar timestamp_ntz, updated_at timestamp_ntz, segments array<bigint>"


def newer(found: Column, given: Column, best: Column) -> Column:
    return F.when(found.isNull(), given).when(given.isNull(), found).otherwise(best)


@dataclass(frozen=True)
class SeriesStore:
    spark: SparkSession
    root: str
    recheck_days: int = 7
    most_segments: int = 8

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _complete(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> list[tuple[int, str]]:
        """Numbers and names of complete commits, in order."""
        return [(int(n.split("-")[0]), n) for n in self._names("state") if self._complete(n)]

    def state(self, version: int | None = None) -> DataFrame:
        """One row per symbol as of the last commit, or of a ``version``."""
        known = [c for c in self.commits() if version is None or c[0] <= version]
        return self.spark.read.schema(STATE).parquet(f"{self.root}/state/{known[-1][1]}") if known else self.spark.createDataFrame([], STATE)

    def read(self, version: int | None = None, symbols: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame | None:
        """The merged bars: of each symbol and time the row of the latest live commit. None before the first rows.

        Symbols and days are filters of the scan; files of commits without live rows are not read.
        """
        state = self.state(version).select("symbol", "segments")
        if symbols is not None:
            state = state.filter(F.col("symbol").isin(symbols))
        live = sorted(r["n"] for r in state.select(F.explode("segments").alias("n")).distinct().collect())  # a number per commit
        if not live:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/data/{n:08d}" for n in live])
        if symbols is not None:
            rows = rows.filter(F.col("symbol").isin(symbols))
        if start is not None:
            rows = rows.filter(F.col("datetime") >= F.lit(str(start)).cast("timestamp_ntz"))
        if end is not None:
            rows = rows.filter(F.col("datetime") < F.lit(str(end + dt.timedelta(days=1))).cast("timestamp_ntz"))
        rows = rows.join(state, "symbol").filter(F.array_contains("segments", F.col("commit"))).drop("segments")
        return keep_last(rows, ["symbol", "datetime"], F.col("commit")).drop("commit")

    def due(self, wanted: DataFrame, now: dt.datetime, ttl: dt.timedelta) -> DataFrame:
        """(symbol, start, end) that must be fetched for ``wanted`` (symbol, start, end): days before and behind the coverage.

        Where nothing is missing, but the series was last updated longer than ``ttl`` ago: from ``recheck_days`` before its last bar on.
        """
        both = wanted.join(self.state().select("symbol", "coverage_start", "coverage_end", "last_bar", "updated_at"), "symbol", "left")
        c = F.col
        none = c("coverage_start").isNull()
        span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        early = F.when(c("start") < c("coverage_start"), span(c("start"), F.least(c("end"), F.date_sub("coverage_start", 1))))
        late = F.when(c("end") > c("coverage_end"), span(F.greatest(c("start"), F.date_add("coverage_end", 1)), c("end")))
        again = span(F.greatest(c("start"), F.date_sub(F.to_date(F.coalesce("last_bar", F.col("coverage_start").cast("timestamp_ntz"))), self.recheck_days)), c("end"))
        missing = F.filter(F.array(early, late), lambda r: r.isNotNull())
        stale = F.lit(now).cast("timestamp_ntz") - c("updated_at") > F.lit(ttl)
        ranges = F.when(none, F.array(span(c("start"), c("end")))).when(F.size(missing) > 0, missing).when(stale, F.array(again)).otherwise(F.slice(missing, 1, 0))
        return both.select("symbol", F.explode(ranges).alias("r")).select("symbol", "r.*").filter("start <= end")

    def commit(self, batch: str, bars: DataFrame, ranges: DataFrame, now: dt.datetime) -> int:
        """Take ``bars`` (symbol, datetime and others), which were fetched for ``ranges`` (symbol, start, end); the commit's number.

        Fetched rows replace those of the same symbol and time; others stay. Coverage grows by the ranges, also where they
        brought no bar. A ``batch`` that was committed before is left as it is.
        """
        mark = hashlib.sha256(batch.encode()).hexdigest()[:24]
        known = self.commits()
        for n, name in known:
            if name.endswith(mark):
                return n
        # numbers of broken commits are not used again
        n = max([0, *(int(x.split("-")[0]) for folder in ("state", "data") for x in self._names(folder))]) + 1
        old = self.state()
        new = keep_last(bars.withColumn("__no", F.monotonically_increasing_id()), ["symbol", "datetime"], F.col("__no")).drop("__no")
        many = old.filter(F.size("segments") >= self.most_segments).select("symbol").join(new.select("symbol").distinct(), "symbol")
        held = self.read()
        if held is not None:
            before = held.join(many, "symbol", "left_semi").withColumn("__new", F.lit(0))
            new = keep_last(before.unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True), ["symbol", "datetime"], F.col("__new")).drop("__new")
        new.withColumn("commit", F.lit(n).cast("long")).repartition("symbol").sortWithinPartitions("symbol", "datetime").write.parquet(f"{self.root}/data/{n:08d}")
        came = self.spark.read.parquet(f"{self.root}/data/{n:08d}").groupBy("symbol").agg(F.max("datetime").alias("__last"))
        asked = ranges.groupBy("symbol").agg(F.min("start").alias("__start"), F.max("end").alias("__end"))
        c = F.col
        merged = old.join(asked, "symbol", "full").join(came, "symbol", "full").join(many.withColumn("__many", F.lit(True)), "symbol", "left")
        own = F.when(c("__many"), F.array(F.lit(n).cast("long"))).otherwise(F.concat(F.coalesce("segments", F.array().cast("array<bigint>")), F.array(F.lit(n).cast("long"))))
        touched = c("__start").isNotNull() | c("__last").isNotNull()
        state = merged.select(
            "symbol", newer(c("coverage_start"), c("__start"), F.least("coverage_start", "__start")).alias("coverage_start"), newer(c("coverage_end"), c("__end"), F.greatest("coverage_end", "__end")).alias("coverage_end"),
            newer(c("last_bar"), c("__last"), F.greatest("last_bar", "__last")).alias("last_bar"), F.when(touched, F.lit(now).cast("timestamp_ntz")).otherwise(c("updated_at")).alias("updated_at"),
            F.when(c("__last").isNotNull(), own).otherwise(F.coalesce("segments", F.array().cast("array<bigint>"))).alias("segments"),
        )
        # readers of the state before this one see it as it was until the marker of this one is there
        state.write.parquet(f"{self.root}/state/{n:08d}-{mark}")
        return n


def deliveries(bars: DataFrame, batches: int, recheck_days: int = 7) -> DataFrame:
    """``bars`` as a vendor would deliver them in ``batches``: each brings its share of days and those of the re-check before it.

    A bar's volume is provisional (one too large) while it is younger than the re-check at the end of its batch.
    """
    day = F.to_date("datetime")
    span = bars.agg(F.min(day).alias("d0"), F.max(day).alias("d1"))
    # two dates are broadcast
    x = bars.crossJoin(F.broadcast(span)).withColumn("__days", F.date_diff("d1", "d0") + 1)
    part = lambda k: F.date_add("d0", F.floor(F.col("__days") * k / batches).cast("int"))
    each = [F.struct(F.lit(k).alias("batch"), part(k).alias("from"), F.date_sub(part(k + 1), 1).alias("to")) for k in range(batches)]
    x = x.withColumn("b", F.explode(F.array(*each))).filter((day >= F.date_sub("b.from", recheck_days)) & (day <= F.col("b.to")))
    young = day > F.date_sub("b.to", recheck_days)
    return x.select(*[c if c != "volume" else (F.col("volume") + F.when(young, 1.0).otherwise(0.0)).alias("volume") for c in bars.columns], "b.batch", F.col("b.from").alias("from"), F.col("b.to").alias("to"))
