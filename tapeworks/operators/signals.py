"""Regimes, setups with triggers, and signals: one per life of a setup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import flag, full, lag, ordered
from tapeworks.operators.factors import snapshot

SETUPS = ("trend_pullback", "breakout", "support_reversal", "trend_breakdown")


def votes() -> tuple[Column, Column]:
    """Votes for an up and a down trend: the averages' order, the long averages, the slopes, the swings' counts."""
    c, n = F.col, lambda x: F.coalesce(x, F.lit(0.0))
    up20, down20 = n("higher_high_count_20") + n("higher_low_count_20"), n("lower_high_count_20") + n("lower_low_count_20")
    up = [(c("close") > c("MA20")) & (c("MA20") > c("MA60")), c("MA60") > c("MA120"), (c("ma20_slope_5") > 0) & (c("ma60_slope_5") > 0), up20 >= down20 + 4]
    down = [(c("close") < c("MA20")) & (c("MA20") < c("MA60")), c("MA60") < c("MA120"), (c("ma20_slope_5") < 0) & (c("ma60_slope_5") < 0), down20 >= up20 + 4]
    total = lambda xs: sum((flag(x).cast("int") for x in xs), F.lit(0))
    return total(up), total(down)


def add_regime(bars: DataFrame) -> DataFrame:
    """Adds regime and regime_confidence. It reads one row only: the regime of every prefix in one pass."""
    a, w = F.col("atr_percentile_250"), F.col("boll_width_percentile_250")
    up, down = votes()
    bars = bars.withColumns({"__up": up, "__down": down})
    up, down, early = F.col("__up"), F.col("__down"), F.col("pos") < 59
    high, low = flag(a >= 0.85), flag((a <= 0.20) & (w <= 0.25))
    rising, falling = (up >= 2) & (up > down), (down >= 2) & (down > up)
    regime = F.when(early, "INSUFFICIENT_DATA").when(high, "HIGH_VOLATILITY").when(low, "LOW_VOLATILITY").when(rising, "UPTREND").when(falling, "DOWNTREND").otherwise("RANGE")
    sure = (
        F.when(early, 0.0).when(high, F.least(F.lit(1.0), 0.55 + (a - 0.85) * 3)).when(low, F.least(F.lit(1.0), 0.55 + (0.20 - a) + (0.25 - w)))
        .when(rising, F.least(F.lit(0.95), 0.5 + up * 0.12)).when(falling, F.least(F.lit(0.95), 0.5 + down * 0.12)).otherwise(0.55 + 0.05 * F.least(up, down))
    )
    return bars.withColumns({"regime": regime, "regime_confidence": F.round(sure, 3)}).drop("__up", "__down")


def add_setups(bars: DataFrame) -> DataFrame:
    """Adds eight flags: each setup and its trigger; a missing input makes a condition false."""
    c = F.col
    top, bottom = full(F.max, c("high"), 20, ago=1), full(F.min, c("low"), 20, ago=1)
    reach = (top - c("close")) / F.when(c("ATR14") != 0, c("ATR14"))
    fit = (c("regime") == "UPTREND") & (c("close") > c("MA60")) & (c("MA20") > c("MA60")) & (c("ma20_slope_5") > 0)
    near = flag(c("close_vs_ma20_atr").between(-0.35, 0.85)) | flag(c("distance_to_support_atr").between(0, 0.8))
    calm = (c("volume_ratio_20") <= 1.05) & (c("higher_low_count_20") >= c("lower_low_count_20") - 2)
    down = c("regime").isin("UPTREND", "DOWNTREND", "HIGH_VOLATILITY") & (c("close") < c("MA20")) & (flag(c("MA20") <= c("MA60")) | flag(c("ma20_slope_5") < 0))
    first = {
        "trend_pullback": flag(fit & near & calm), "breakout": flag(reach.between(-0.25, 1.0) & (c("boll_width_percentile_250") <= 0.45)),
        "support_reversal": flag(c("regime").isin("RANGE", "UPTREND", "LOW_VOLATILITY") & c("distance_to_support_atr").between(0, 0.75) & (c("nearest_support_strength") >= 1)),
        "trend_breakdown": flag(down),
    }
    above = flag(c("close") > lag("high"))
    failed = flag((lag("close") < lag("MA20")) & (c("high") >= c("MA20")) & (c("close") < c("MA20")))
    ready = F.lag("breakout", 1, False).over(ordered())
    second = {
        "trend_pullback_trigger": c("trend_pullback") & above,
        "breakout_trigger": ready & flag((c("close") > top) & (c("breakout_volume_ratio") >= 1.2) & (c("macd_hist_delta_3") > 0)),
        "support_reversal_trigger": c("support_reversal") & above & flag(c("close") > c("open")) & (flag(c("rsi12_delta_3") > 0) | flag(c("volume_ratio_20") >= 1.0)),
        "trend_breakdown_trigger": c("trend_breakdown") & (flag(c("close") < bottom) | failed),
    }
    return bars.withColumns(first).withColumns(second)


def current_setups(bars: DataFrame) -> DataFrame:
    """Setups active or triggered at each symbol's last bar."""
    flags = [x for s in SETUPS for x in (s, f"{s}_trigger")]
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(*flags), "datetime").alias("l"))
    each = F.array(*[F.struct(F.lit(s).alias("setup"), F.col(f"l.{s}").alias("active"), F.col(f"l.{s}_trigger").alias("triggered")) for s in SETUPS])
    return last.select("symbol", F.explode(each).alias("s")).filter("s.active or s.triggered").select("symbol", "s.setup", "s.triggered")


def quality(reward_risk: Column) -> Column:
    """Rule score from 0 to 100, no probability."""
    c, s, r = F.col, F.col("setup"), F.col("regime")
    fits = (
        ((s == "trend_pullback") & (r == "UPTREND")) | ((s == "support_reversal") & r.isin("RANGE", "UPTREND"))
        | ((s == "breakout") & r.isin("UPTREND", "LOW_VOLATILITY")) | ((s == "trend_breakdown") & r.isin("DOWNTREND", "HIGH_VOLATILITY"))
    )
    m = c("macd_hist_delta_3")
    score = (
        45.0 + F.when(flag(fits), 15.0).otherwise(0.0) + F.when(flag(c("distance_to_support_atr").between(0, 0.75)), 8.0).otherwise(0.0)
        + F.when(flag(c("volume_ratio_20") >= F.when(s == "breakout", 1.2).otherwise(0.8)), 8.0).otherwise(0.0)
        + F.when(flag(((s == "trend_breakdown") & (m < 0)) | (m > 0)), 8.0).otherwise(0.0) + F.least(F.lit(12.0), F.greatest(F.lit(-8.0), (reward_risk - 1) * 6))
    )
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1)


def first_triggers(bars: DataFrame) -> DataFrame:
    """(bar columns, setup, setup_no): the first trigger of each unbroken run of bars where the setup or its trigger holds."""
    w = Window.partitionBy("symbol").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    cols, picks = {}, []
    for s in SETUPS:
        cols[f"__run_{s}"] = F.sum(F.when(F.col(s) | F.col(f"{s}_trigger"), 0).otherwise(1)).over(w)
    out = bars.withColumns(cols)
    for i, s in enumerate(SETUPS):
        run = Window.partitionBy("symbol", f"__run_{s}").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
        nth = F.sum(F.col(f"{s}_trigger").cast("int")).over(run)
        out = out.withColumn(f"__hit_{s}", F.col(f"{s}_trigger") & (nth == 1))
        picks.append(F.when(F.col(f"__hit_{s}"), F.struct(F.lit(i).alias("no"), F.lit(s).alias("name"))))
    out = out.withColumn("__pick", F.explode(F.filter(F.array(*picks), lambda p: p.isNotNull())))
    return out.withColumns({"setup": F.col("__pick.name"), "setup_no": F.col("__pick.no")}).drop("__pick", *[f"__{k}_{s}" for k in ("run", "hit") for s in SETUPS])


def signals(bars: DataFrame) -> DataFrame:
    """One row per signal, from bars with factors, regime and setups."""
    c, atr, d, r = F.col("close"), F.col("ATR14"), F.col("distance_to_support_atr"), F.col("distance_to_resistance_atr")
    out = first_triggers(bars)
    long = F.col("setup") != "trend_breakdown"
    priced = long & flag(atr > 0)
    support = F.when(d >= 0, c - d * atr)
    stop = F.when(priced, F.coalesce(support - 0.25 * atr, c - 2 * atr))
    out = out.withColumns({"__stop": stop, "__support": F.when(priced, support)})
    risk = F.when(priced, c - F.col("__stop"))
    goes = flag(risk > 0)
    one = F.when(goes, c + 1.5 * risk)
    two = F.when(goes, F.greatest(c + 2 * risk, F.when(r > 0, c + r * atr)))
    rr = F.when(goes, (one - c) / risk)
    brk = F.col("setup") == "breakout"
    return out.select(
        "symbol", "pos", F.col("datetime").alias("timestamp"), F.when(long, "long").otherwise("exit").alias("direction"), "setup", "setup_no", "regime",
        quality(F.coalesce(rr, F.lit(0.0))).alias("score"), F.round(quality(F.coalesce(rr, F.lit(0.0))) / 100, 3).alias("confidence"), F.round(c, 6).alias("entry_reference"),
        F.round(F.when(priced, F.when(brk, c - 0.1 * atr).otherwise(F.greatest(F.col("__support"), c - 0.25 * atr))), 6).alias("entry_zone_lower"),
        F.round(F.when(priced, F.when(brk, c + 0.15 * atr).otherwise(c + 0.1 * atr)), 6).alias("entry_zone_upper"), F.round(F.col("__stop"), 6).alias("stop_price"),
        F.round(one, 6).alias("target_1"), F.round(two, 6).alias("target_2"), F.round(risk, 6).alias("risk_per_share"), F.round(rr, 3).alias("reward_risk_ratio"), snapshot().alias("factors"),
    )
