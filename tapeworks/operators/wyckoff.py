"""Trading-range phases: a frozen range per symbol, events of accumulation and distribution, projections, replay.

Distribution is accumulation on mirrored prices, so one state machine serves both. A single forward pass per symbol,
reset whenever the range is drawn anew, gives what was known at every bar; the rest is expressions and joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import lag, ratio, trailing
from tapeworks.operators.wave import first_outcome

LOOKBACK, RESEED, BREAK_BARS, COOLDOWN = 60, 40, 3, 4
#: Fixed names of the events by direction.
NAMES = {1: ("SC", "AR", "ST", "Spring", "Test", "SOS", "LPS"), -1: ("BC", "AR", "ST", "UTAD", "Test", "SOW", "LPSY")}
ROW = (
    "symbol string, pos int, direction int, phase string, event string, new_event string, range_start int, support double, resistance double, "
    "events int, kinds int, mean_volume double, confirmed int, invalidation double, strong boolean"
)


class Structure:
    """One direction's state; prices come mirrored where the direction is -1."""

    def __init__(self, side: int):
        self.side, self.names, self.events = side, NAMES[side], []
        self.phase, self.spring, self.strength, self.outside = "B", None, None, 0
        self.kinds: set[int] = set()

    def step(self, pos, low, high, close, support, resistance, atr, volume, spread, location, prior) -> str | None:
        """Advance by one bar; returns the event that the bar adds, at most one."""
        seen, width, first = self.kinds, resistance - support, self.events[0] if self.events else None
        calm, kind, phase = self.strength is None, None, self.phase
        event = {"pos": pos, "low": low, "volume": round(volume, 3), "followed": False}
        if calm and 0 not in seen and prior <= -0.035 and low <= support + atr * 0.25 and volume >= 1.25 and spread >= 1.0 and location >= 0.42:
            kind, phase = 0, "A"
        elif calm and 0 in seen and 1 not in seen and high >= support + width * 0.55 and pos > first["pos"]:
            kind, phase = 1, "B"
        elif calm and 1 in seen and 2 not in seen and first["low"] - atr * 0.15 <= low <= support + atr * 0.4:
            kind, phase = 2, "B"
        elif calm and low < support - atr * 0.05 and close > support and location >= 0.55 and volume >= 0.7:
            kind, phase, self.spring = 3, "C", event
        elif (s := self.spring) and calm and pos > s["pos"] and s["low"] - atr * 0.1 <= low <= support + atr * 0.4 and volume <= min(1.0, s["volume"] * 0.95) and close > support:
            kind, phase = 4, "C"
            s["followed"] = True
        elif calm and close > resistance and volume >= 1.1 and spread >= 0.9 and location >= 0.62:
            kind, phase, self.strength = 5, "D", event
        elif (s := self.strength) and pos > s["pos"] and low <= resistance + atr * 0.4 and close >= resistance - atr * 0.1 and volume <= 1.0:
            kind, phase = 6, "D"
            s["followed"] = True
        self.phase, added = phase, None
        if kind is not None:
            event["kind"] = kind
            last = self.events[-1] if self.events else None
            if not (last and last["kind"] == kind and pos - last["pos"] <= COOLDOWN):  # the phase has moved all the same
                self.events.append(event)
                self.kinds.add(kind)
                added = self.names[kind]
        self.outside = self.outside + 1 if close > resistance else 0
        if self.strength is not None and self.outside >= 2:
            self.phase = "E"
            self.strength["followed"] = True
        return added

    def invalid(self, support: float, resistance: float, atr: float) -> float:
        recent = self.events[-10:]
        last = lambda k: next((e for e in reversed(recent) if e["kind"] == k), None)
        if self.phase == "C" and (e := last(3)):
            return e["low"] - atr * 0.1
        if self.phase in "DE" and (e := last(6)):
            return e["low"] - atr * 0.15
        if self.phase in "DE" and last(5):
            return resistance - atr * 0.5
        return support - atr * 0.25


def _replay(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("pos", kind="stable").reset_index(drop=True)
    cols = ROW.split(", ")
    if len(g) <= LOOKBACK:
        return pd.DataFrame(columns=[c.split()[0] for c in cols])
    low, high, close, atr, vr, sr, loc, prior = (g[c].to_numpy(float) for c in ("low", "high", "close", "ATR14", "vr", "sr", "loc", "prior"))
    symbol, out = g["symbol"].iloc[0], []
    edges = lambda a, b: (float(np.quantile(low[a:b], 0.12)), float(np.quantile(high[a:b], 0.88)))
    (support, resistance), start, above, below = edges(0, LOOKBACK), 0, 0, 0
    both = {s: Structure(s) for s in (1, -1)}
    sums: dict[int, tuple] = {}
    for i in range(LOOKBACK, len(g)):
        margin = (atr[i] if atr[i] == atr[i] else 0.0) * 0.35
        above = above + 1 if close[i] > resistance + margin else 0
        below = below + 1 if close[i] < support - margin else 0
        if max(above, below) >= BREAK_BARS:
            start, above, below = max(0, i - RESEED + 1), 0, 0
            support, resistance = edges(start, i + 1)
            both = {s: Structure(s) for s in (1, -1)}
        usable = np.isfinite([atr[i], vr[i], sr[i], loc[i], prior[i]]).all()
        for side, s in both.items():
            added = None
            view = (support, resistance) if side > 0 else (-resistance, -support)
            if usable:
                lo, hi = (low[i], high[i]) if side > 0 else (-high[i], -low[i])
                added = s.step(i, lo, hi, side * close[i], *view, atr[i], vr[i], sr[i], loc[i] if side > 0 else 1 - loc[i], side * prior[i])
            # sums over a range's events change with an event or its follow-through only
            state = (len(s.events), *(e is not None and e["followed"] for e in (s.spring, s.strength)))
            if sums.get(side, (None,))[0] is not s or sums[side][1] != state:
                v = [min(1.6, max(0.4, e["volume"])) for e in s.events]
                sums[side] = (s, state, len(s.kinds), float(np.mean(v)) if v else None, sum(e["followed"] for e in s.events))
            _, _, kinds, mean, followed = sums[side]
            ends = side * s.invalid(*view, atr[i]) if atr[i] == atr[i] else None
            name = s.names[s.events[-1]["kind"]] if s.events else "Trading Range"
            strong = any(e["kind"] == 5 for e in s.events[-10:]) or s.phase == "E"
            out.append((symbol, i, side, s.phase, name, added, start, support, resistance, len(s.events), kinds, mean, followed, ends, strong))
    return pd.DataFrame(out, columns=[c.split()[0] for c in cols])


def replay(bars: DataFrame) -> DataFrame:
    """What was known at every bar from the 60th on, per direction. Symbols need positive volume on 80 % of the bars so far."""
    v = F.col("volume")
    mean = F.when(F.count(v).over(trailing(20, 1)) >= 10, F.avg(v).over(trailing(20, 1)))
    spread = F.col("high") - F.col("low")
    ready = bars.withColumns({
        "vr": ratio(v, mean), "sr": ratio(spread, F.col("ATR14")), "loc": ratio(F.col("close") - F.col("low"), spread), "prior": F.col("close") / lag("close", 10) - 1,
    }).select("symbol", "pos", "low", "high", "close", "ATR14", "vr", "sr", "loc", "prior")
    rows = ready.groupBy("symbol").applyInPandas(_replay, ROW)
    sofar = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    good = bars.withColumn("reliable", F.avg(F.when(v > 0, 1.0).otherwise(0.0)).over(sofar) >= 0.8).select("symbol", "pos", "reliable")
    return rows.join(good.filter("reliable and pos >= 79"), ["symbol", "pos"], "left_semi")


def events(bars: DataFrame) -> DataFrame:
    return replay(bars).filter("new_event is not null").select("symbol", "pos", "direction", F.col("new_event").alias("event"), "phase", "range_start", "support", "resistance")


def project(known: DataFrame) -> DataFrame:
    """Confirmation, target zone (half to one range width beyond the range) and whether strength has confirmed the path."""
    up, width = F.col("direction") > 0, F.col("resistance") - F.col("support")
    return known.withColumns({
        "confirmation": F.when(up, F.col("resistance")).otherwise(F.col("support")), "already": F.col("strong"),
        "zone_low": F.when(up, F.col("resistance") + width * 0.5).otherwise(F.col("support") - width), "zone_high": F.when(up, F.col("resistance") + width).otherwise(F.col("support") - width * 0.5),
    })


def current(bars: DataFrame) -> DataFrame:
    """Both candidates of each symbol at its last bar, scored and ranked, with projection; ambiguous if the scores are within 0.08."""
    n = bars.groupBy("symbol").agg((F.count(F.lit(1)) - 1).cast("int").alias("pos"), F.max_by("OBV", "pos").alias("obv"), F.max_by("close", "pos").alias("close"), F.max_by("MA20", "pos").alias("ma"))
    obv10 = bars.withColumn("obv10", lag("OBV", 9)).groupBy("symbol").agg(F.max_by("obv10", "pos").alias("obv10"))
    last = replay(bars).join(n, ["symbol", "pos"]).join(obv10, "symbol")
    seg = last.filter("direction = 1").select("symbol", "range_start", "support", "resistance").join(bars.select("symbol", "pos", "low", "high", "close", "ATR14"), "symbol").filter("pos >= range_start")
    mid = seg.groupBy("symbol").agg(F.percentile("ATR14", 0.5).alias("atr"))
    seg, tol = seg.join(mid, "symbol"), F.coalesce("atr", F.lit(0.0)) * 0.25
    q = seg.groupBy("symbol").agg(
        F.avg(F.col("close").between(F.col("support") - tol, F.col("resistance") + tol).cast("double")).alias("contained"),
        (F.count_if(F.col("low") <= F.col("support") + tol) + F.count_if(F.col("high") >= F.col("resistance") - tol)).alias("tests"), F.max((F.col("resistance") - F.col("support")) / F.nullif("atr", F.lit(0.0))).alias("width_atr"),
    )
    c = F.col
    range_score = F.round(c("contained") * 0.55 + F.least(F.lit(1.0), c("tests") / 6) * 0.25 + F.when(c("width_atr").between(2, 15), 1.0).otherwise(0.55) * 0.2, 3) * 100
    seq = F.least(F.lit(100.0), F.least(F.lit(100.0), 20.0 + c("kinds") * 14.0) + F.when(c("phase").isin("D", "E"), 10.0).otherwise(0.0))
    vol = F.when(c("events") > 0, F.least(F.lit(100.0), c("mean_volume") / 1.2 * 100)).otherwise(35.0)
    follow = F.least(F.lit(100.0), c("confirmed") * 35.0 + F.when(c("events") > 0, 15.0).otherwise(0.0))
    likes = F.when(c("obv10").isNotNull(), F.when(c("obv") >= c("obv10"), 1).otherwise(-1)).otherwise(F.when(c("close") >= c("ma"), 1).otherwise(-1))
    w = Window.partitionBy("symbol")
    other = F.sum("events").over(w) - c("events")
    total = range_score * 0.35 + seq * 0.35 + vol * 0.15 + follow * 0.15 + F.when(c("direction") == likes, 5.0).otherwise(0.0) - F.least(F.lit(20.0), other * 4.0)
    out = last.join(q, "symbol").withColumn("fit", F.round(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1) / 100, 3))
    out = out.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("fit"), F.desc("direction"))), "ambiguous": F.max("fit").over(w) - F.min("fit").over(w) < 0.08})
    return project(out).select("symbol", "pos", "rank", "direction", "phase", "event", "range_start", "support", "resistance", "events", "fit", "ambiguous", "confirmation", "invalidation", "zone_low", "zone_high", c("already").alias("path_confirmed"))


def history(bars: DataFrame, lookahead: int = 20, most: int = 420, stride: int = 3) -> DataFrame:
    """Each frozen range and direction once, at the first checked bar in phase C to E; rates from 30 cases on."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    first = F.greatest(F.lit(80), F.col("n") - most)
    seen = replay(bars).join(n, "symbol").filter((F.col("pos") >= first) & (F.col("pos") < F.col("n") - lookahead) & ((F.col("pos") - first) % stride == 0))
    seen = seen.filter("phase in ('C', 'D', 'E') and event <> 'Trading Range'")
    keys = ["symbol", "range_start", "direction"]
    cases = project(seen.groupBy(*keys).agg(F.min("pos").alias("at"), F.min_by(F.struct("phase", "event", "support", "resistance", "invalidation", "strong"), "pos").alias("c")).select(*keys, "at", "c.*"))
    up = F.col("direction") > 0
    done = first_outcome(cases, bars, keys, lookahead, F.when(up, F.col("close") <= F.col("invalidation")).otherwise(F.col("close") >= F.col("invalidation")),
                         F.when(up, F.col("close") > F.col("confirmation")).otherwise(F.col("close") < F.col("confirmation")), F.when(up, F.col("high") >= F.col("zone_low")).otherwise(F.col("low") <= F.col("zone_high")))
    sure, hit, out = F.count_if("confirmed"), F.count_if(F.col("outcome") == "target_first"), F.count_if(F.col("outcome").isin("target_first", "invalidation_first"))
    settled = F.count_if(F.col("confirmed") & F.col("outcome").isin("target_first", "invalidation_first"))
    return done.groupBy("symbol", "direction").agg(
        F.count(F.lit(1)).alias("samples"), out.alias("resolved"), sure.alias("confirmed"), settled.alias("confirmed_resolved"), hit.alias("target_first"),
        F.when(F.count(F.lit(1)) >= 30, F.round(sure / F.count(F.lit(1)) * 100, 1)).alias("confirmation_rate"), F.when(settled >= 30, F.round(hit / settled * 100, 1)).alias("target_first_rate"),
        *[F.count_if(F.col("phase") == p).alias(f"phase_{p}") for p in "CDE"],
    )


def context(now: DataFrame, decisions: DataFrame) -> DataFrame:
    """How the leading structure bears on each symbol's decision: pending before phase D, then supportive or conflicting."""
    top = now.filter("rank = 1").select("symbol", "direction", "phase", "fit", "ambiguous")
    wants = F.when(F.col("status").isin("long_trigger", "active_after_trigger", "watch"), 1).when(F.col("status") == "exit_trigger", -1)
    verdict = (
        F.when(F.col("phase").isNull() | wants.isNull(), "neutral").when(F.col("ambiguous"), "ambiguous").when(F.col("phase").isin("A", "B", "C"), "pending")
        .when(F.col("direction") == wants, "supportive").otherwise("conflicting")
    )
    return decisions.join(top, "symbol", "left").select("symbol", "status", "direction", "phase", "fit", verdict.alias("context"))
