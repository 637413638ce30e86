"""Execution at the next bar, triple barriers, trades that do not overlap, and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import lag, lead


@dataclass(frozen=True)
class Execution:
    entry_price: str = "next_open"
    commission_rate: float = 0.0003
    slippage_bps: float = 5.0
    t_plus_one: bool = True
    max_holding_bars: int = 20
    target_r_multiple: float = 2.0
    atr_stop_multiple: float = 2.0

    def __post_init__(self) -> None:
        if self.commission_rate < 0 or self.slippage_bps < 0 or self.max_holding_bars < 1 or self.target_r_multiple <= 0:
            raise ValueError("costs can't be negative, a position lasts a bar at least, its target is above its entry")


def fills(signals: DataFrame, bars: DataFrame, conf: Execution = Execution()) -> DataFrame:
    """``signals`` with fill_pos, fill_date, fill_price, fee, fill_atr and, where there is no fill, the reason."""
    price = "open" if conf.entry_price == "next_open" else "close"
    after = bars.select("symbol", (F.col("pos") - 1).alias("pos"), F.col("pos").alias("fill_pos"), F.col("datetime").alias("fill_date"), F.col(price).alias("__raw"), F.col("volume").alias("__volume"), F.col("ATR14").alias("fill_atr"))
    out = signals.join(after, ["symbol", "pos"], "left")
    reason = F.when(F.col("fill_pos").isNull(), "NO_NEXT_BAR").when(F.col("__raw").isNull() | (F.col("__raw") <= 0), "INVALID_PRICE").when(F.col("__volume") <= 0, "SUSPENDED_OR_NO_VOLUME")
    slip = conf.slippage_bps / 10_000
    filled = F.when(F.col("direction") == "long", F.col("__raw") * (1 + slip)).otherwise(F.col("__raw") * (1 - slip))
    out = out.withColumn("reason", reason).withColumn("fill_price", F.when(F.col("reason").isNull(), filled))
    return out.withColumn("fee", F.col("fill_price") * conf.commission_rate).drop("__raw", "__volume")


def barriers(entries: DataFrame, bars: DataFrame, exits: DataFrame, conf: Execution = Execution()) -> DataFrame:
    """Exit of each entry (symbol, key, fill_pos, fill_price, stop, target) by the first barrier its bars touch.

    Bars come by a range join on the symbol, at most ``max_holding_bars`` each. A scheduled exit (symbol, pos in
    ``exits``) counts first, at its open; then the stop, then the target; at the last bar the close. Entries without
    a bar to exit on give no row.
    """
    first = 1 if conf.t_plus_one or conf.entry_price == "next_close" else 0
    marked = bars.select("symbol", "pos", "datetime", "open", "high", "low", "close").join(exits.select("symbol", "pos").distinct().withColumn("__exit", F.lit(True)), ["symbol", "pos"], "left")
    offset = F.explode(F.sequence(F.lit(first), F.lit(conf.max_holding_bars)))
    wanted = entries.select("symbol", "key", "fill_pos", "fill_price", "stop", "target", offset.alias("holding_bars")).withColumn("pos", F.col("fill_pos") + F.col("holding_bars"))
    path = wanted.join(marked, ["symbol", "pos"])
    w = Window.partitionBy("symbol", "key").orderBy("pos")
    stop_hit, target_hit = F.col("low") <= F.col("stop"), F.col("high") >= F.col("target")
    last = F.lead("pos").over(w).isNull()
    why = (
        F.when(F.col("__exit"), "TREND_BREAKDOWN").when(stop_hit & target_hit, "STOP_AND_TARGET_SAME_BAR_CONSERVATIVE").when(stop_hit, "STOP")
        .when(target_hit, "TARGET").when(last, "TIME_BARRIER")
    )
    raw = F.when(F.col("__exit"), F.col("open")).when(stop_hit, F.col("stop")).when(target_hit, F.col("target")).otherwise(F.col("close"))
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda agg, c: agg(F.when(F.col("__exit"), F.col("open")).otherwise(F.col(c))).over(sofar)
    path = path.withColumns({"exit_reason": why, "raw_exit": raw, "__high": F.greatest("fill_price", seen(F.max, "high")), "__low": F.least("fill_price", seen(F.min, "low"))})
    risk = F.col("fill_price") - F.col("stop")
    done = path.filter("exit_reason is not null").withColumns({"mfe_r": (F.col("__high") - F.col("fill_price")) / risk, "mae_r": (F.col("fill_price") - F.col("__low")) / risk})
    best = done.groupBy("symbol", "key").agg(F.min_by(F.struct(F.col("pos").alias("exit_pos"), F.col("datetime").alias("exit_date"), "raw_exit", "exit_reason", "mfe_r", "mae_r", "holding_bars"), "pos").alias("e"))
    return best.select("symbol", "key", "e.*")


def _no_overlap(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["pos", "setup_no"], kind="stable")
    keep, busy = [], -1
    for at, exit_at in zip(g["pos"], g["exit_pos"], strict=True):
        keep.append(at >= busy)
        if keep[-1]:
            busy = exit_at
    return g[keep]


def strategy(signals: DataFrame, bars: DataFrame, conf: Execution = Execution()) -> tuple[DataFrame, DataFrame]:
    """(trades, candidates): every long signal is priced and exited on its own, then trades that would overlap go.

    The selection is the only sequential step: one pass over a symbol's candidate exits.
    """
    filled = fills(signals.drop("factors"), bars, conf).withColumn("key", F.struct("pos", "setup_no"))
    exits = filled.filter((F.col("direction") == "exit") & F.col("fill_pos").isNotNull()).select("symbol", F.col("fill_pos").alias("pos"))
    long = filled.filter("direction = 'long'")
    stop = F.when(F.col("stop_price") < F.col("fill_price"), F.col("stop_price")).otherwise(F.col("fill_price") - conf.atr_stop_multiple * F.col("fill_atr"))
    long = long.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(F.col("fill_atr") > 0, F.lit(False)), "INVALID_ATR"))).withColumn("stop", stop)
    long = long.withColumn("target", F.col("fill_price") + conf.target_r_multiple * (F.col("fill_price") - F.col("stop")))
    ends = barriers(long.filter("reason is null"), bars, exits, conf)
    cand = long.join(ends, ["symbol", "key"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("exit_pos").isNull(), "NO_EXIT_BAR"))).drop("key")
    done = cand.filter("reason is null")
    out = done.groupBy("symbol").applyInPandas(_no_overlap, done.schema)
    price = F.col("raw_exit") * (1 - conf.slippage_bps / 10_000)
    net = price - F.col("fill_price") - F.col("fee") - price * conf.commission_rate
    trades = out.select(
        "symbol", "setup", "regime", "pos", F.col("timestamp").alias("signal_date"), F.col("fill_date").alias("entry_date"), F.round("fill_price", 6).alias("entry_price"), "exit_date",
        F.round(price, 6).alias("exit_price"), F.round("stop", 6).alias("stop_price"), F.round("target", 6).alias("target_price"), "exit_reason", (net / F.col("fill_price")).alias("return_pct"),
        (net / (F.col("fill_price") - F.col("stop"))).alias("r_multiple"), "mfe_r", "mae_r", "holding_bars",
    )
    return trades, cand


def rejections(candidates: DataFrame, trades: DataFrame) -> DataFrame:
    """Rejected signals by reason. A signal that a running trade hides is not counted, whatever its own reason."""
    spans = trades.select("symbol", F.col("pos").alias("from"), F.col("entry_date"), F.col("exit_date").alias("until"))
    bad = candidates.filter("reason is not null")
    hidden = bad.join(spans, (bad["symbol"] == spans["symbol"]) & (bad["timestamp"] >= spans["entry_date"]) & (bad["timestamp"] < spans["until"]), "left_anti")
    return hidden.groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


def metrics(trades: DataFrame, keys: tuple[str, ...] = ("symbol",), by: str = "regime", order: tuple[str, ...] = ("entry_date",)) -> DataFrame:
    """Trade statistics per ``keys``, for all and for each value of ``by``, by grouping sets in two steps.

    Wealth follows trades in order, so each trade is first doubled (its group and ALL) and accumulated by a window.
    """
    both = trades.withColumn("group", F.explode(F.array(F.lit("ALL"), F.col(by))))
    w = Window.partitionBy(*keys, "group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__wealth", F.product(1 + F.col("return_pct")).over(w))
    both = both.withColumn("__fall", F.col("__wealth") / F.greatest(F.lit(1.0), F.max("__wealth").over(w)) - 1)
    r = F.col("r_multiple")
    quant = lambda c: [F.percentile(c, p).alias(f"{c}_p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    out = both.groupBy(*keys, "group").agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((r > 0).cast("double")).alias("__win"), F.avg(F.when(r > 0, r)).alias("__aw"), F.abs(F.avg(F.when(r < 0, r))).alias("__al"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("__gp"), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("__gl"), F.avg("holding_bars").alias("__hold"),
        F.greatest(F.sum("holding_bars"), F.lit(1)).alias("__bars"), F.max_by("__wealth", F.struct(*order)).alias("__end"), F.least(F.min("__fall"), F.lit(0.0)).alias("__deep"),
        F.avg("return_pct").alias("__mean"), F.stddev_samp("return_pct").alias("__sd"), *quant("mfe_r"), *quant("mae_r"),
    )
    c = F.col
    return out.select(
        *keys, "group", "trade_count", F.round(c("__win") * 100, 2).alias("win_rate"), F.round("__aw", 4).alias("average_win_r"), F.round("__al", 4).alias("average_loss_r"),
        F.round(c("__win") * F.coalesce("__aw", F.lit(0.0)) - (1 - c("__win")) * F.coalesce("__al", F.lit(0.0)), 4).alias("expectancy_r"),
        F.round(F.when(c("__gl") > 0, c("__gp") / c("__gl")), 4).alias("profit_factor"), F.round("__hold", 2).alias("average_holding_bars"), F.round(c("__deep") * 100, 3).alias("max_drawdown"),
        F.round((c("__end") - 1) * 100, 3).alias("cumulative_return"), F.round(F.when(c("__end") > 0, (F.pow(c("__end"), 252 / c("__bars")) - 1) * 100).otherwise(-100.0), 3).alias("annualized_return"),
        F.round(F.when(c("__sd") > 0, c("__mean") / c("__sd") * F.sqrt(252 / F.greatest(c("__hold"), F.lit(1.0)))), 4).alias("sharpe"),
        *[F.round(f"{x}_p{p}", 4).alias(f"{x}_p{p}") for x in ("mfe_r", "mae_r") for p in (25, 50, 75)],
    )


def cross_signals(bars: DataFrame) -> DataFrame:
    """``bars`` with side: 1 where DIF crosses above DEA with the averages rising, -1 the other way round, else 0."""
    c = F.col
    up = (c("close") > c("MA20")) & (c("MA20") > c("MA60")) & (lag("DIF") <= lag("DEA")) & (c("DIF") > c("DEA"))
    down = (c("close") < c("MA20")) & (c("MA20") < c("MA60")) & (lag("DIF") >= lag("DEA")) & (c("DIF") < c("DEA"))
    return bars.withColumn("side", F.when(up, 1).when(down, -1).otherwise(0))


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), cost: float = 0.001) -> DataFrame:
    """Per symbol, horizon and side (all, bullish, bearish): samples, win rate, mean, median, payoff of the crosses' returns."""
    s = cross_signals(bars).withColumns({f"__r{h}": (lead("close", h) / F.col("close") - 1) for h in horizons}).filter("side <> 0")
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"__r{h}") * F.col("side") - cost).alias("r")) for h in horizons]))
    rows = s.select("symbol", "side", each.alias("e")).select("symbol", "e.*", F.explode(F.array(F.lit("all"), F.when(F.col("side") > 0, "bullish").otherwise("bearish"))).alias("side"))
    r = F.col("r")
    win, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r))
    return rows.filter("r is not null").groupBy("symbol", "horizon", "side").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg((r > 0).cast("double")) * 100, 2).alias("win_rate"), F.round(F.avg("r") * 100, 3).alias("average_return"),
        F.round(F.percentile("r", 0.5) * 100, 3).alias("median_return"), F.round(win / F.abs(loss), 3).alias("payoff_ratio"),
    )


def wealth(bars: DataFrame, horizon: int = 10, cost: float = 0.001) -> DataFrame:
    """Per symbol: the deepest fall of wealth over the crosses' returns in order, and the return of just holding."""
    s = cross_signals(bars).withColumn("r", (lead("close", horizon) / F.col("close") - 1) * F.col("side") - cost)
    w = Window.partitionBy("symbol").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    hit = s.filter("side <> 0 and r is not null").withColumn("v", F.product(1 + F.col("r")).over(w))
    deep = hit.withColumn("fall", F.col("v") / F.max("v").over(w) - 1).groupBy("symbol").agg(F.round(F.min("fall") * 100, 3).alias("max_drawdown"))
    hold = bars.groupBy("symbol").agg(F.round((F.max_by("close", "datetime") / F.min_by("close", "datetime") - 1) * 100, 3).alias("benchmark_return"))
    return hold.join(deep, "symbol", "left")


def similar(trades: DataFrame, current: DataFrame) -> DataFrame:
    """Statistics of trades of the setups and regime that each symbol has now; the probability needs 30 of them."""
    t = trades.join(current.select("symbol", "setup", "regime").distinct(), ["symbol", "setup", "regime"], "left_semi")
    r, n = F.col("r_multiple"), F.count(F.lit(1))
    return t.groupBy("symbol").agg(
        n.alias("samples"), F.round(F.avg((r > 0).cast("double")) * 100, 2).alias("win_rate"), F.round(F.avg(r), 4).alias("average_r"), F.round(F.percentile("mfe_r", 0.5), 4).alias("median_mfe_r"),
        F.round(F.percentile("mae_r", 0.5), 4).alias("median_mae_r"), F.when(n >= 30, F.round(F.avg((r > 0).cast("double")), 4)).alias("historical_probability"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places by floor(x + 1/2), which all engines compute alike."""
    to = lambda c: F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits
    cols: list[Column] = [to(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema]
    return df.select(*cols)
