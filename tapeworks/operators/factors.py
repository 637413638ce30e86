"""The 44 factors over bars with indicators; every factor at a bar depends on that bar and earlier ones only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.windows import full, lag, ordered, ratio, swing

#: Fixed order of the factor columns.
FACTORS = (
    "close_vs_ma20_atr", "close_vs_ma60_atr", "close_vs_ma120_atr", "ma20_slope_5", "ma60_slope_5", "ma120_slope_10", "ma20_ma60_spread_atr", "ma60_ma120_spread_atr",
    "return_5", "return_20", "return_60", "return_120", "rsi6", "rsi12", "rsi24", "rsi12_delta_3", "macd_dif", "macd_dea", "macd_hist", "macd_hist_delta_3", "price_momentum_20",
    "volume_ratio_5", "volume_ratio_20", "up_volume_ratio_20", "down_volume_ratio_20", "breakout_volume_ratio", "atr_pct", "atr_percentile_250", "boll_width",
    "boll_width_percentile_250", "realized_volatility_20", "max_drawdown_20", "max_drawdown_60", "distance_to_support_atr", "distance_to_resistance_atr",
    "nearest_support_strength", "nearest_resistance_strength", "distance_20d_high", "distance_60d_high", "distance_120d_high", "higher_high_count_20",
    "higher_low_count_20", "lower_high_count_20", "lower_low_count_20",
)


def share_not_above(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """Share of the last ``n`` rows (missing values count as rows) whose value is not above the current one; 0 where that is missing, null under ``least`` values.

    The window's values stay sorted: each bar costs two searches, one insertion and one removal.
    """
    out, held = np.full(len(x), np.nan), []
    for i, v in enumerate(x.tolist()):
        if i >= n and (old := x[i - n]) == old:
            held.pop(bisect_left(held, old))
        if v == v:
            insort(held, v)
        if len(held) >= min(least, n):
            out[i] = bisect_right(held, v) / min(i + 1, n) if v == v else 0.0
    return out


class Fall:
    """Highest value, lowest value and deepest fall (0 or less) of a stretch; stretches that follow each other combine."""

    none = (-np.inf, np.inf, 0.0)

    @staticmethod
    def join(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
        across = b[1] / a[0] - 1 if a[0] > 0 and b[1] < np.inf else 0.0
        return max(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2], across)


def drawdown(x: np.ndarray, n: int) -> np.ndarray:
    """The deepest fall from the highest value so far within the last ``n`` values (0 or less); null unless all are there.

    A sliding aggregate with two stacks: values enter at the back, whose sum is kept; when the front runs out, the back is
    turned over with sums from its end. Each value is combined a constant number of times, whatever ``n``.
    """
    out, front, back, total, missing = np.full(len(x), np.nan), [], [], Fall.none, 0
    for i, v in enumerate(x.tolist()):
        one = (v, v, 0.0) if v == v else Fall.none
        missing += v != v
        back.append(one)
        total = Fall.join(total, one)
        if i >= n:
            missing -= x[i - n] != x[i - n]
            if not front:
                later = Fall.none
                while back:
                    later = Fall.join(back.pop(), later)
                    front.append(later)
                total = Fall.none
            front.pop()
        if i >= n - 1 and not missing:
            out[i] = Fall.join(front[-1], total)[2] if front else total[2]
    return out


LEVEL_FACTORS = ("distance_to_support_atr", "distance_to_resistance_atr", "nearest_support_strength", "nearest_resistance_strength")
SLIDING = ("atr_percentile_250", "boll_width_percentile_250", "max_drawdown_20", "max_drawdown_60")


def published(bars: DataFrame, swing_width: int = 4) -> DataFrame:
    """(symbol, pos, close, atr, high, low, atr_pct, boll_width): the prices of the swings that become known at each bar, ``swing_width`` bars after they happened, and what sliding factors need."""
    out = bars.withColumns({f"__{c}": swing(F.col(c), swing_width, c == "high") for c in ("high", "low")})
    new = {c: F.when(F.lag(f"__{c}", swing_width).over(ordered()), F.lag(c, swing_width).over(ordered())) for c in ("high", "low")}
    share = ratio(F.col("ATR14"), F.col("close")).alias("atr_pct")
    width = ratio(F.col("BOLL_UPPER") - F.col("BOLL_LOWER"), F.col("BOLL_MID")).alias("boll_width")
    return out.select("symbol", "pos", "close", F.col("ATR14").alias("atr"), *[v.alias(c) for c, v in new.items()], share, width)


def near_count(levels: list[float], at: float, band: float) -> int:
    """How many of the sorted ``levels`` differ from ``at`` by ``band`` at most."""
    i, j = bisect_left(levels, at - band), bisect_right(levels, at + band)
    while i > 0 and abs(levels[i - 1] - at) <= band:
        i -= 1
    while i < j and abs(levels[i] - at) > band:
        i += 1
    while j < len(levels) and abs(levels[j] - at) <= band:
        j += 1
    while j > i and abs(levels[j - 1] - at) > band:
        j -= 1
    return j - i


def _nearest(g: pd.DataFrame) -> pd.DataFrame:
    """One pass over a symbol's bars that keeps the known swings sorted: a search per bar instead of all of them."""
    g = g.sort_values("pos")
    highs: list[float] = []
    lows: list[float] = []
    out = np.full((len(g), 4), np.nan)
    for k, (c, atr, high, low) in enumerate(g[["close", "atr", "high", "low"]].astype(float).itertuples(index=False)):
        if high == high:
            insort(highs, high)
        if low == low:
            insort(lows, low)
        if not atr > 0 or c != c:
            continue
        band = max(c * 0.008, atr * 0.5)
        if (i := bisect_left(lows, c)) > 0:
            out[k, 0], out[k, 2] = (c - lows[i - 1]) / atr, near_count(lows, lows[i - 1], band)
        if (i := bisect_right(highs, c)) < len(highs):
            out[k, 1], out[k, 3] = (highs[i] - c) / atr, near_count(highs, highs[i], band)
    done = pd.DataFrame(out, columns=LEVEL_FACTORS)
    close = g["close"].to_numpy(float)
    done["atr_percentile_250"], done["boll_width_percentile_250"] = (share_not_above(g[c].to_numpy(float), 250, 20) for c in ("atr_pct", "boll_width"))
    done["max_drawdown_20"], done["max_drawdown_60"] = drawdown(close, 20), drawdown(close, 60)
    done.insert(0, "pos", g["pos"].to_numpy())
    done.insert(0, "symbol", g["symbol"].to_numpy())
    return done


def level_factors(bars: DataFrame) -> DataFrame:
    """(symbol, pos) with the distance to the nearest known swing below and above the close, in ATR, the number of its kind near it, and the sliding shares and falls."""
    made = (*LEVEL_FACTORS, *SLIDING)
    found = published(bars).groupBy("symbol").applyInPandas(_nearest, "symbol string, pos int, " + ", ".join(f"{c} double" for c in made))
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in made})


def add_factors(bars: DataFrame) -> DataFrame:
    """``bars`` (with indicators) and the 44 factors; infinite values are null."""
    c, atr, col = F.col("close"), F.col("ATR14"), F.col
    vol = F.when(col("volume") >= 0, col("volume"))
    change, total = c - lag("close"), full(F.sum, vol, 20)
    up20 = lambda x: full(F.sum, F.coalesce(x, F.lit(0.0)), 20)
    count20 = lambda x: full(F.sum, F.coalesce(x, F.lit(False)).cast("double"), 20)
    dh, dl = col("high") - lag("high"), col("low") - lag("low")
    new = {f"close_vs_ma{n}_atr": ratio(c - col(f"MA{n}"), atr) for n in (20, 60, 120)}
    new |= {f"ma{n}_slope_{k}": ratio(col(f"MA{n}"), lag(f"MA{n}", k)) - 1 for n, k in ((20, 5), (60, 5), (120, 10))}
    new |= {f"ma{a}_ma{b}_spread_atr": ratio(col(f"MA{a}") - col(f"MA{b}"), atr) for a, b in ((20, 60), (60, 120))}
    new |= {f"return_{n}": ratio(c, lag("close", n)) - 1 for n in (5, 20, 60, 120)}
    new |= {f"rsi{n}": col(f"RSI{n}") for n in (6, 12, 24)} | {"rsi12_delta_3": col("RSI12") - lag("RSI12", 3)}
    new |= {"macd_dif": col("DIF"), "macd_dea": col("DEA"), "macd_hist": col("MACD"), "macd_hist_delta_3": col("MACD") - lag("MACD", 3)}
    new |= {"price_momentum_20": new["return_20"]} | {f"volume_ratio_{n}": ratio(vol, full(F.avg, vol, n, ago=1)) for n in (5, 20)}
    new |= {"up_volume_ratio_20": ratio(up20(F.when(change > 0, vol)), total), "down_volume_ratio_20": ratio(up20(F.when(change < 0, vol)), total)}
    new |= {"breakout_volume_ratio": new["volume_ratio_20"], "atr_pct": ratio(atr, c), "boll_width": ratio(col("BOLL_UPPER") - col("BOLL_LOWER"), col("BOLL_MID"))}
    new |= {"__log": F.ln(ratio(c, lag("close")))}
    new |= {f"distance_{n}d_high": ratio(c - full(F.max, col("high"), n), atr) for n in (20, 60, 120)}
    new |= {"higher_high_count_20": count20(dh > 0), "higher_low_count_20": count20(dl > 0), "lower_high_count_20": count20(dh < 0), "lower_low_count_20": count20(dl < 0)}
    out = bars.withColumns(new).join(level_factors(bars), ["symbol", "pos"], "left")
    out = out.withColumn("realized_volatility_20", full(F.stddev_samp, col("__log"), 20) * 252**0.5).drop("__log")
    out = out.withColumns({f: F.when(~F.isnan(f) & (F.abs(f) < float("inf")), col(f)) for f in FACTORS})
    return out.select(*[b for b in bars.columns if b.lower() not in FACTORS], *FACTORS)


def snapshot() -> Column:
    """The bar's factors as a map, rounded to 6 digits."""
    return F.map_from_arrays(F.array(*map(F.lit, FACTORS)), F.array(*[F.round(f, 6) for f in FACTORS]))
