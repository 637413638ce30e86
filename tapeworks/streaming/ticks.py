"""Bars from a stream of ticks, and recursive indicators that carry their state from bar to bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, order: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars that are emitted when the watermark passes their end; later ticks are dropped. Null times and prices go."""
    t = F.struct(ts, order)
    g = ticks.filter(F.col(ts).isNotNull() & F.col(price).isNotNull()).withWatermark(ts, late).groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
    return g.agg(
        F.min_by(price, t).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, t).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.sum(price).alias("amount"),
    ).select("symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume", "amount")


def stream_ema(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, datetime, close, ema): the exponential mean over ``n`` closes, its state kept per symbol.

    Bars of a symbol must come in order of time over the batches; within a batch they are sorted here.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, seen = state.get if state.exists else (0.0, 0)
        g = pd.concat(list(parts)).sort_values("datetime", kind="stable")
        out = []
        for c in g["close"]:
            mean, seen = (c if seen == 0 else mean + (c - mean) * 2 / (n + 1)), seen + 1
            out.append(mean if seen >= n else None)
        state.update((float(mean), int(seen)))
        yield pd.DataFrame({"symbol": key[0], "datetime": g["datetime"], "close": g["close"], "ema": pd.Series(out, index=g.index, dtype="float64")})

    rows = bars.select("symbol", F.col("datetime").cast("timestamp").alias("datetime"), "close")
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, datetime timestamp, close double, ema double", "mean double, seen int", "append", GroupStateTimeout.NoTimeout)
