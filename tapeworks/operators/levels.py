"""Support and resistance levels from confirmed swings, and the technical score of the last bar."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import flag, full, lag, ratio, swing, trailing


def swings(bars: DataFrame, width: int = 4) -> DataFrame:
    """(symbol, kind, position, price, volume_weight): lone extremes of ``width`` bars on both sides; the weight is the volume against the symbol's median, from 0.25 to 3."""
    m = bars.groupBy("symbol").agg(F.percentile(F.nullif("volume", F.lit(0.0)), 0.5).alias("__median"))
    marked = bars.withColumns({"__h": swing(F.col("high"), width, True), "__l": swing(F.col("low"), width, False)}).filter("__h or __l")
    kinds = F.explode(F.filter(F.array(F.when(F.col("__h"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("__l"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))), lambda x: x.isNotNull()))
    out = marked.withColumn("s", kinds).join(m, "symbol")
    weight = F.coalesce(F.col("volume"), F.lit(0.0)) / F.when(F.col("__median") > 0, F.col("__median")).otherwise(1.0)
    return out.select("symbol", "s.kind", F.col("pos").alias("position"), F.col("s.price").alias("price"), F.least(F.lit(3.0), F.greatest(F.lit(0.25), weight)).alias("volume_weight"))


LEVEL = "symbol string, kind string, price double, lower double, upper double, touches int, score double, confidence string, last_touch_pos int"


def _clusters(g: pd.DataFrame) -> pd.DataFrame:
    """Swings of one symbol and kind, by price, each joined to the first cluster whose mean is within the band.

    Prices ascend, and no mean is above the last price: a cluster whose mean is below the band takes nothing more.
    Only those that may are kept in front, each with its running sum, so that a swing meets a handful of clusters.
    """
    g = g.sort_values(["price", "position"], kind="stable")
    n, band = int(g["rows"].iloc[0]), float(g["band"].iloc[0])
    groups: list[list[tuple]] = []
    sums: list[float] = []
    front: list[int] = []
    for row in g[["price", "position", "volume_weight"]].itertuples(index=False):
        front = [k for k in front if row.price - sums[k] / len(groups[k]) <= band]
        home = next((k for k in front if abs(row.price - sums[k] / len(groups[k])) <= band), None)
        if home is None:
            front.append(len(groups))
            groups.append([row])
            sums.append(0 + row.price)
        else:
            groups[home].append(row)
            sums[home] += row.price
    out = []
    for c in groups:
        price, pos, vol = (np.array(v, float) for v in zip(*c, strict=True))
        fresh = np.exp(-(n - 1 - pos) / max(n * 0.35, 1.0))
        at = float(np.average(price, weights=np.maximum(fresh * (0.7 + 0.3 * vol), 0.01)))
        score = 0.7 * len(c) + 0.25 * np.minimum(vol, 2.5).sum() + 0.55 * fresh.sum()
        sure = "high" if len(c) >= 4 and score >= 5 else "medium" if len(c) >= 2 and score >= 2.7 else "low"
        out.append((g["symbol"].iloc[0], g["kind"].iloc[0], round(at, 4), round(at - band / 2, 4), round(at + band / 2, 4), len(c), round(score, 3), sure, int(pos.max())))
    return pd.DataFrame(out, columns=[x.split()[0] for x in LEVEL.split(", ")])


def levels(bars: DataFrame, width: int = 4, price_share: float = 0.008, atr_factor: float = 0.5) -> DataFrame:
    """All clusters per symbol and kind. Swings are few against bars, and a symbol's are bounded by its history."""
    now = bars.groupBy("symbol").agg(F.max_by(F.struct("close", "ATR14"), "datetime").alias("l"), F.count(F.lit(1)).cast("int").alias("rows"))
    band = F.greatest(F.col("l.close") * price_share, F.coalesce(F.col("l.ATR14") * atr_factor, F.lit(0.0)))
    now = now.filter(F.col("rows") >= width * 2 + 5).select("symbol", "rows", band.alias("band"))
    return swings(bars, width).join(now, "symbol").groupBy("symbol", "kind").applyInPandas(_clusters, LEVEL)


def nearest_levels(bars: DataFrame, least: float = 1.35, n: int = 3) -> DataFrame:
    """The ``n`` nearest supports below and resistances above the last close, of enough score, with their rank."""
    now = bars.groupBy("symbol").agg(F.max_by("close", "datetime").alias("close_now"))
    met = levels(bars).join(now, "symbol").filter(F.col("score") >= least)
    side = F.when((F.col("kind") == "low") & (F.col("price") < F.col("close_now")), "support").when((F.col("kind") == "high") & (F.col("price") > F.col("close_now")), "resistance")
    met = met.withColumn("side", side).filter("side is not null")
    w = Window.partitionBy("symbol", "side").orderBy(F.abs(F.col("price") - F.col("close_now")), "price")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def scenario(near: DataFrame) -> DataFrame:
    """Reward against risk between the nearest support's lower edge and the nearest resistance."""
    s = near.filter("rank = 1 and side = 'support'").select("symbol", "close_now", F.col("lower").alias("invalidation"), F.col("upper").alias("observation_lower"))
    r = near.filter("rank = 1 and side = 'resistance'").select("symbol", F.col("price").alias("target"), F.col("lower").alias("observation_upper"))
    c = F.col("close_now")
    out = s.join(r, "symbol").withColumn("reward_risk_ratio", F.round((F.col("target") - c) / (c - F.col("invalidation")), 2))
    return out.filter((c > F.col("invalidation")) & (F.col("target") > c))


def lower_confidence(near: DataFrame) -> DataFrame:
    """One step less sure, as for continuous futures."""
    return near.withColumn("confidence", F.when(F.col("confidence") == "high", "medium").otherwise("low"))


#: Fixed order of the snapshot's columns.
LATEST = (
    "close", "pct_change", "MA5", "MA10", "MA20", "MA60", "MA120", "MA250", "DIF", "DEA", "MACD", "RSI6", "RSI12", "RSI24", "K", "D", "J", "BOLL_MID", "BOLL_UPPER", "BOLL_LOWER",
    "ATR14", "ATR14_PCT", "ADX14", "PLUS_DI14", "MINUS_DI14", "VOL_MA5", "VOL_MA10", "VOL_RATIO", "OBV",
)


def latest(bars: DataFrame) -> DataFrame:
    """The last bar's 29 values per symbol, null where not finite; the change is against the bar before where the source has none.

    One aggregation: of each symbol only the last row leaves a task.
    """
    if "pct_change" not in bars.columns:
        bars = bars.withColumn("pct_change", (F.col("close") / lag("close") - 1) * 100)
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("datetime", *LATEST), "datetime").alias("l")).select("symbol", "l.*")
    return last.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in LATEST})


def slope(c: str, n: int = 5) -> Column:
    first = lag(c, n - 1)
    return F.when(F.count(c).over(trailing(n)) == n, ratio(F.col(c) - first, F.abs(first)) * 100)


def price_structure() -> Column:
    """1 where the last ten bars' high and low are above those of the ten before, -1 where both are below, else 0."""
    h1, h0, l1, l0 = full(F.max, F.col("high"), 10), full(F.max, F.col("high"), 10, 10), full(F.min, F.col("low"), 10), full(F.min, F.col("low"), 10, 10)
    return F.when((h1 > h0) & (l1 > l0), 1).when((h1 < h0) & (l1 < l0), -1).otherwise(0)


def divergence(bars: DataFrame) -> DataFrame:
    """(symbol, divergence) at the last bar: the last two swings (3 bars on both sides) among the last 30 bars, prices and RSI12 in opposite directions."""
    n = F.max("pos").over(Window.partitionBy("symbol"))
    last = bars.withColumn("__from", F.greatest(n - 29, F.lit(0))).filter(F.col("pos") >= F.col("__from")).select("symbol", "datetime", "pos", "high", "low", "RSI12")
    marks = last.withColumns({"__h": swing(F.col("high"), 3, True), "__l": swing(F.col("low"), 3, False)})
    two = lambda f, c: F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col(f), F.struct("pos", F.col(c).alias("p"), F.col("RSI12").alias("r")))))), 1, 2)
    g = marks.groupBy("symbol").agg(two("__l", "low").alias("lo"), two("__h", "high").alias("hi"), F.count(F.lit(1)).alias("n"))
    a, b = F.get("lo", F.lit(1)), F.get("lo", F.lit(0))
    x, y = F.get("hi", F.lit(1)), F.get("hi", F.lit(0))
    bull = (b["p"] < a["p"] * 0.995) & (b["r"] > a["r"] + 3)
    bear = (y["p"] > x["p"] * 1.005) & (y["r"] < x["r"] - 3)
    return g.select("symbol", F.when(F.col("n") >= 20, F.when(bull, "bullish").when(bear, "bearish")).alias("divergence"))


#: Fixed weights of trend, momentum, volume and risk by score regime.
WEIGHTS = {
    "high_volatility": (0.30, 0.20, 0.10, 0.40), "low_volatility": (0.25, 0.30, 0.25, 0.20), "uptrend": (0.50, 0.25, 0.10, 0.15), "downtrend": (0.50, 0.25, 0.10, 0.15), "range": (0.25, 0.40, 0.15, 0.20),
}


def technical_score(bars: DataFrame) -> DataFrame:
    """Last bar of each symbol: four components from 0 to 100 that start at 50, the regime that weighs them, the score, the state."""
    c = F.col
    b = bars.withColumns({f"__s_{x}": slope(x) for x in ("MA20", "MA60", "OBV")} | {"__structure": price_structure(), "__dif0": lag("DIF"), "__dea0": lag("DEA"), "__close0": lag("close"), "__m1": lag("MACD"), "__m2": lag("MACD", 2)})
    # the score is that of the last bar: of its 120 bars those not above it are counted, none are gathered
    now = bars.groupBy("symbol").agg(F.max_by("ATR14_PCT", "pos").alias("__now"), F.count(F.lit(1)).alias("__n"))
    recent = bars.select("symbol", "pos", "ATR14_PCT").join(now, "symbol").filter(c("pos") >= c("__n") - 120)
    share = recent.groupBy("symbol", "__n").agg((F.count_if(c("ATR14_PCT") <= c("__now")) / F.nullif(F.count("ATR14_PCT"), F.lit(0)) * 100).alias("__share"), F.max("__now").alias("__now"))
    share = share.withColumn("__share", F.when(c("__now").isNotNull(), c("__share"))).drop("__now")
    last = b.join(share, "symbol").filter(c("pos") == c("__n") - 1).join(divergence(bars), "symbol", "left")
    pts = lambda *cases: _sum([F.when(flag(cond), float(p)).otherwise(0.0) for cond, p in cases])
    trend = pts(*[(c("close") > c(m), p) for m, p in (("MA20", 7), ("MA60", 7), ("MA120", 5))], *[(c("close") < c(m), -p) for m, p in (("MA20", 7), ("MA60", 7), ("MA120", 5))],
                ((c("MA20") > c("MA60")) & (c("MA60") > c("MA120")), 8), ((c("MA20") < c("MA60")) & (c("MA60") < c("MA120")), -8), (c("__s_MA20") > 0.3, 4), (c("__s_MA20") < -0.3, -4),
                (c("__s_MA60") > 0.3, 4), (c("__s_MA60") < -0.3, -4), (c("__structure") > 0, 6), (c("__structure") < 0, -6))
    dif, dea, r = c("DIF"), c("DEA"), c("RSI12")
    rise, fall = (c("__m2") <= c("__m1")) & (c("__m1") <= c("MACD")), (c("__m2") >= c("__m1")) & (c("__m1") >= c("MACD"))
    has = dif.isNotNull() & dea.isNotNull()
    momentum = pts((has & (dif > 0), 6), (has & (dif < 0), -6), (dif > dea, 7), (dif < dea, -7), ((c("__dif0") <= c("__dea0")) & (dif > dea), 5), ((c("__dif0") >= c("__dea0")) & (dif < dea), -5),
                   (rise, 4), (fall & ~flag(rise), -4), (r >= 70, -4), (r <= 30, 3), ((r > 50) & (r < 70), 4), ((r > 30) & (r < 50), -3), (c("divergence") == "bullish", 6), (c("divergence") == "bearish", -6))
    base = F.nullif("VOL_MA5", F.lit(0.0)) / 2 + F.nullif("VOL_MA10", F.lit(0.0)) / 2
    vr, move = ratio(c("volume"), base), c("close") - c("__close0")
    volume = pts(((vr >= 1.5) & (move > 0), 12), ((vr >= 1.5) & (move < 0), -12), ((vr <= 0.65) & ~flag((vr >= 1.5) & (move != 0)), -3), (c("__s_OBV") > 1, 5), (c("__s_OBV") < -1, -5))
    a = c("ATR14_PCT")
    risk = pts((a <= 1.5, 8), ((a > 3) & (a <= 5), -8), (a > 5, -15))
    kind = (
        F.when(c("__share") >= 80, "high_volatility").when((c("__share") <= 20) & (c("ADX14").isNull() | (c("ADX14") < 22)), "low_volatility")
        .when((c("ADX14") >= 23) & (c("__s_MA20") > 0) & (c("close") > c("MA60")), "uptrend").when((c("ADX14") >= 23) & (c("__s_MA20") < 0) & (c("close") < c("MA60")), "downtrend").otherwise("range")
    )
    clip = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x + 50))
    out = last.select("symbol", "datetime", "close", clip(trend).alias("trend"), clip(momentum).alias("momentum"), clip(volume).alias("volume_score"), clip(risk).alias("risk"), kind.alias("score_regime"), "divergence", c("__n").alias("bars"))
    weigh = lambda i: _case(c("score_regime"), {k: v[i] for k, v in WEIGHTS.items()})
    score = F.bround(c("trend") * weigh(0) + c("momentum") * weigh(1) + c("volume_score") * weigh(2) + c("risk") * weigh(3), 0)
    out = out.withColumn("score", F.when(c("bars") >= 20, score))
    state = F.when(c("bars") < 20, "insufficient").when(c("score") >= 70, "strong").when(c("score") >= 58, "firm").when(c("score") >= 43, "neutral").when(c("score") >= 30, "soft").otherwise("weak")
    return out.withColumn("state", state)


def _sum(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def _case(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


__all__ = ["divergence", "levels", "lower_confidence", "nearest_levels", "price_structure", "scenario", "slope", "swings", "technical_score"]
