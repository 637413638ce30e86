"""The data behind a chart: crossings, markers, default ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import lag

#: Bars shown at first, by period.
VISIBLE = {"daily": 220, "weekly": 156, "monthly": 120}


def macd_crossings(bars: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` crossings of DIF and DEA per symbol, with the price of their marker."""
    d = F.col("DIF") - F.col("DEA")
    x = bars.withColumns({"d": d, "d0": lag(d)}).filter("(d0 <= 0 and d > 0) or (d0 >= 0 and d < 0)")
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("datetime")))).filter(F.col("nth") <= n)
    up = F.col("d") > 0
    return x.select("symbol", "datetime", F.when(up, "golden").otherwise("death").alias("kind"), F.when(up, F.col("low") * 0.985).otherwise(F.col("high") * 1.015).alias("marker"))


def trigger_markers(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Long signals at their bars' lows."""
    return signals.filter("direction = 'long'").select("symbol", "pos", "setup", "score").join(bars.select("symbol", "pos", "datetime", "low"), ["symbol", "pos"])


def default_ranges(bars: DataFrame, period: str = "intraday") -> DataFrame:
    """Per symbol: the times and prices that a chart shows at first."""
    n = F.max("pos").over(Window.partitionBy("symbol"))
    gap = F.unix_micros(F.col("datetime").cast("timestamp")) - F.unix_micros(lag("datetime").cast("timestamp"))
    shown = bars.withColumns({"__n": n, "__gap": gap}).filter(F.col("pos") > F.col("__n") - VISIBLE.get(period, 300))
    g = shown.groupBy("symbol").agg(F.min("datetime").alias("x_from"), F.max("datetime").alias("last"), F.percentile("__gap", 0.5).alias("gap"), F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "datetime").alias("close"))
    span = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("x_from").cast("timestamp"))
    ahead = F.greatest(F.col("gap") * 24, span * 0.15).cast("long")
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.05, F.col("close") * 0.005, F.lit(0.01))
    until = F.timestamp_micros(F.unix_micros(F.col("last").cast("timestamp")) + ahead).cast("timestamp_ntz")
    return g.select("symbol", "x_from", until.alias("x_until"), (F.col("lo") - pad).alias("y_from"), (F.col("hi") + pad).alias("y_until"))


def price_range(bars: DataFrame, candidates: DataFrame, recent: int = 220) -> DataFrame:
    """Lowest and highest price to show: recent bars and the best candidate's target and invalidation, padded."""
    n = F.max("pos").over(Window.partitionBy("symbol"))
    b = bars.withColumn("__n", n).filter(F.col("pos") > F.col("__n") - recent).groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "pos").alias("close"))
    top = candidates.filter("rank = 1").select("symbol", F.least("zone_low", "invalidation").alias("c_lo"), F.greatest("zone_high", "invalidation").alias("c_hi"))
    x = b.join(top, "symbol", "left").withColumns({"lo": F.least("lo", "c_lo"), "hi": F.greatest("hi", "c_hi")})
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.05, F.col("close") * 0.005, F.lit(0.01))
    return x.select("symbol", (F.col("lo") - pad).alias("y_from"), (F.col("hi") + pad).alias("y_until"))


def colours(bars: DataFrame) -> DataFrame:
    """Sides of the volume and MACD bars."""
    side = lambda c: F.when(c, "up").otherwise("down")
    return bars.select("symbol", "datetime", "volume", side(F.col("close") >= F.col("open")).alias("volume_side"), "MACD", F.when(F.col("MACD").isNotNull(), side(F.col("MACD") >= 0)).alias("macd_side"))


def overlay(pivot_states: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best wave candidate's points, numbered."""
    top = candidates.filter("rank = 1").select("symbol", "scale", "pattern", F.posexplode("positions").alias("point", "pos"))
    known = pivot_states.select("symbol", "scale", F.explode(F.arrays_zip("pos", "price")).alias("p")).select("symbol", "scale", F.col("p.pos").alias("pos"), F.col("p.price").alias("price")).distinct()
    return top.join(known, ["symbol", "scale", "pos"])


def scenario_path(candidates: DataFrame, bars: DataFrame, steps: int = 12) -> DataFrame:
    """Nodes of each top candidate's conditional path: last close, confirmation, target; with a corridor that widens from 0.1 to 0.75 ATR."""
    now = bars.groupBy("symbol").agg(F.max_by("ATR14", "pos").alias("atr"), F.max("pos").alias("latest"))
    node = lambda i, at, p: F.struct(F.lit(i).alias("node"), (F.col("latest") + at).alias("pos"), p.alias("price"), (F.col("atr") * (0.1 + 0.65 * i / 2)).alias("half_width"))
    mid = (F.col("zone_low") + F.col("zone_high")) / 2
    x = candidates.filter("rank = 1").join(now, "symbol")
    return x.select("symbol", "pattern", F.explode(F.array(node(0, 0, F.col("close")), node(1, steps // 2, F.col("confirmation")), node(2, steps, mid))).alias("n")).select("symbol", "pattern", "n.*")
