"""The current decision per symbol: signals of the last bar, conflicts, the setups' state, what to watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.windows import full, lag
from tapeworks.operators.signals import current_setups


def resolve(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, conflict, best): signals at each symbol's last bar; more than one direction is a conflict, else the largest score counts, the earlier setup on a tie."""
    last = bars.groupBy("symbol").agg(F.max("pos").alias("pos"))
    now = signals.join(last, ["symbol", "pos"], "left_semi")
    best = F.max_by(F.struct("setup", "direction", "score"), F.struct("score", -F.col("setup_no")))
    g = now.groupBy("symbol").agg((F.countDistinct("direction") > 1).alias("conflict"), best.alias("best"))
    return g.select("symbol", "conflict", F.when(~F.col("conflict"), F.col("best")).alias("best"))


#: The last bar's prices whose crossing confirms a setup: the bar before's high, the 20 bars' extremes before it, MA20.
TRIGGERS = (("trend_pullback", "before"), ("breakout", "top"), ("support_reversal", "before"), ("trend_breakdown", "bottom"), ("trend_breakdown", "MA20"))


def decide(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per symbol: status, the chosen setup, and the price that would confirm or end a setup that is watched, where there is a single one."""
    found = resolve(signals, bars)
    live = current_setups(bars).groupBy("symbol").agg(F.array_sort(F.collect_list("setup")).alias("setups"), F.max("triggered").alias("any_triggered"))
    at = bars.withColumns({"__before": lag("high"), "__top": full(F.max, F.col("high"), 20, 1), "__bottom": full(F.min, F.col("low"), 20, 1)})
    gap = F.col("distance_to_support_atr")
    support = F.when((F.col("ATR14") > 0) & (gap >= 0), F.col("close") - gap * F.col("ATR14"))
    here = F.struct("datetime", "regime", "MA20", F.col("__before").alias("before"), F.col("__top").alias("top"), F.col("__bottom").alias("bottom"), support.alias("support"))
    last = at.groupBy("symbol").agg(F.max_by(here, "datetime").alias("l"))
    out = last.join(found, "symbol", "left").join(live, "symbol", "left")
    has = lambda s: F.coalesce(F.array_contains("setups", s), F.lit(False))
    n = F.coalesce(F.size("setups"), F.lit(0))
    status = (
        F.when(F.col("conflict"), "conflict").when(F.col("best.direction") == "long", "long_trigger").when(F.col("best.direction") == "exit", "exit_trigger")
        .when(F.col("any_triggered"), "active_after_trigger").when(n > 0, "watch").otherwise("no_setup")
    )
    prices = F.filter(F.array(*[F.when(has(k), F.col(f"l.{c}")) for k, c in TRIGGERS]), lambda x: x.isNotNull())
    only = F.when(F.size(F.array_distinct(prices)) == 1, F.element_at(prices, 1))
    watch = status == "watch"
    return out.select(
        "symbol", F.col("l.datetime").alias("datetime"), F.col("l.regime").alias("regime"), status.alias("status"), F.col("best.setup").alias("setup"), F.col("best.score").alias("score"),
        F.array_join("setups", ",").alias("active_setups"), F.when(watch, only).alias("trigger_price"), F.when(watch & has("support_reversal"), F.col("l.support")).alias("invalidation_price"),
    )
