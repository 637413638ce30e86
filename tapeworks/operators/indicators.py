"""Indicators over bars: rolling ones as windows, recursive ones as one pass per symbol.

Warm-up follows one rule: a value needs its full window of observations, else it is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.windows import full, lag, ordered, ratio, trailing

MA_PERIODS = (5, 10, 20, 60, 120, 250)
RECURSIVE = ("DIF", "DEA", "MACD", "RSI6", "RSI12", "RSI24", "K", "D", "J", "ATR14", "PLUS_DI14", "MINUS_DI14", "ADX14")


def _positive(n: int) -> int:
    if n <= 0:
        raise ValueError("the period must be positive")
    return n


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg, F.col(c) if isinstance(c, str) else c, _positive(n))


def bollinger(c: str = "close", n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, spread = sma(c, n), full(F.stddev_samp, F.col(c), n)
    return {"BOLL_MID": mid, "BOLL_UPPER": mid + width * spread, "BOLL_LOWER": mid - width * spread}


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def obv() -> Column:
    step = F.signum(F.col("close") - lag("close")) * F.coalesce("volume", F.lit(0.0))
    return F.coalesce(step, F.lit(0.0))


def volume_ratio(n: int = 5) -> Column:
    return ratio(F.col("volume"), full(F.avg, F.col("volume"), n, ago=1))


def smoothed(x: np.ndarray, alpha: float, least: int, state: tuple[float, float, int] | None = None) -> np.ndarray:
    """Exponential mean: starts at the first value; a missing value keeps the mean but ages its weight; null until ``least`` values.

    ``state`` (mean, weight, values seen) is what earlier values have left.
    """
    out, (mean, weight, seen) = np.full(len(x), np.nan), state or (np.nan, 1.0, 0)
    for i, v in enumerate(x):
        if v == v:
            mean = v if seen == 0 else (weight * mean + alpha * v) / (weight + alpha)
            weight, seen = 1 - alpha, seen + 1
        elif seen:
            weight *= 1 - alpha
        if seen >= least:
            out[i] = mean
    return out


def relative_strength(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        r = 100 - 100 / (1 + up / np.where(down == 0, np.nan, down))
    r = np.where((down == 0) & (up > 0), 100.0, r)
    return np.where((down == 0) & (up == 0), 50.0, r)


def _rsi(change: np.ndarray, n: int) -> np.ndarray:
    known = change == change
    return relative_strength(smoothed(np.where(change > 0, change, np.where(known, 0, np.nan)), 1 / n, n), smoothed(np.where(change < 0, -change, np.where(known, 0, np.nan)), 1 / n, n))


def stochastic_raw(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 9) -> np.ndarray:
    """The close's place between the lowest and the highest price of ``n`` bars, in percent; 50 where these are equal."""
    out = np.full(len(close), np.nan)
    for i in range(n - 1, len(close)):
        top, bottom = high[i - n + 1 : i + 1].max(), low[i - n + 1 : i + 1].min()
        out[i] = 50.0 if top == bottom else (close[i] - bottom) / (top - bottom) * 100
    return out


def stochastic(raw: np.ndarray, k: float = 50.0, d: float = 50.0) -> np.ndarray:
    """The lines K and D as two columns; a missing place leaves both as they are and has none."""
    out = np.full((len(raw), 2), np.nan)
    for i, v in enumerate(raw):
        if v == v:
            k += (v - k) / 3
            d += (k - d) / 3
            out[i] = k, d
    return out


def _recursive(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("datetime", kind="stable").reset_index(drop=True)
    h, lo, c = (bars[x].to_numpy(float) for x in ("high", "low", "close"))
    before = np.r_[np.nan, c[:-1]]
    out = {"DIF": smoothed(c, 2 / 13, 12) - smoothed(c, 2 / 27, 26)}
    out["DEA"] = smoothed(out["DIF"], 0.2, 9)
    out["MACD"] = 2 * (out["DIF"] - out["DEA"])
    for n in (6, 12, 24):
        out[f"RSI{n}"] = _rsi(c - before, n)
    out["K"], out["D"] = stochastic(stochastic_raw(h, lo, c)).T
    out["J"] = 3 * out["K"] - 2 * out["D"]
    tr = np.fmax(h - lo, np.fmax(np.abs(h - before), np.abs(lo - before)))
    out["ATR14"] = smoothed(tr, 1 / 14, 14)
    up, down = h - np.r_[np.nan, h[:-1]], np.r_[np.nan, lo[:-1]] - lo
    with np.errstate(all="ignore"):
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        p, m = (100 * smoothed(x, 1 / 14, 14) / np.where(out["ATR14"] == 0, np.nan, out["ATR14"]) for x in (plus, minus))
        dx = 100 * np.abs(p - m) / np.where(p + m == 0, np.nan, p + m)
    out["PLUS_DI14"], out["MINUS_DI14"], out["ADX14"] = p, m, smoothed(dx, 1 / 14, 14)
    return bars.assign(**out)


def recursive(bars: DataFrame) -> DataFrame:
    """``bars`` with the recursive columns: one group and one pass per symbol; ``scan.recursive`` spreads a long symbol over many tasks."""
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.DoubleType()) for c in RECURSIVE]])
    done = bars.groupBy("symbol").applyInPandas(_recursive, schema)
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in RECURSIVE})


def ema(bars: DataFrame, n: int, c: str = "close", name: str | None = None) -> DataFrame:
    """``bars`` with the exponential mean over ``n`` bars."""
    _positive(n)
    name = name or f"EMA{n}"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("datetime", kind="stable")
        return g.assign(**{name: smoothed(g[c].to_numpy(float), 2 / (n + 1), n)})

    out = bars.groupBy("symbol").applyInPandas(run, T.StructType([*bars.schema.fields, T.StructField(name, T.DoubleType())]))
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def add_indicators(bars: DataFrame, ma_periods: tuple[int, ...] = MA_PERIODS) -> DataFrame:
    """``bars`` with all indicators. The recursive pass comes first; all windows after it share one sort per symbol."""
    missing = {"symbol", "datetime", "open", "high", "low", "close", "volume"} - set(bars.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    cols = {f"MA{n}": sma("close", n) for n in ma_periods} | bollinger()
    cols |= {f"VOL_MA{n}": sma("volume", n) for n in (5, 10)} | {"VOL_RATIO": volume_ratio(), "TR": true_range(), "__obv": obv()}
    out = recursive(bars).withColumns(cols).withColumn("ATR14_PCT", ratio(F.col("ATR14") * 100, F.col("close")))
    running = ordered().rowsBetween(-(1 << 31) + 1, 0)
    return out.withColumn("OBV", F.sum("__obv").over(running)).drop("__obv")


__all__ = ["MA_PERIODS", "RECURSIVE", "add_indicators", "bollinger", "ema", "obv", "recursive", "relative_strength", "sma", "smoothed", "stochastic", "stochastic_raw", "trailing", "true_range", "volume_ratio"]
