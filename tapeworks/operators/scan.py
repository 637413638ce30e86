"""Recursive indicators of one long series over many tasks: a two-level associative scan.

Exponential means, Wilder's means and the stochastic lines are affine in their state: what a block of bars does to any
state that comes in is a few numbers. So each block is summed up on its own, the summaries of a series are folded in
order of time (one row per block, not per bar), and each block then runs from the state that reaches it. The first
bars of a block see the last bars before it as a halo, for differences and ranges over several bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.operators.indicators import RECURSIVE, relative_strength, smoothed, stochastic, stochastic_raw


@dataclass(frozen=True)
class Ewm:
    """Exponential mean with ageing gaps. State: mean, missing values since the last one, values seen."""

    alpha: float
    least: int

    start = (0.0, 0.0, 0.0)

    def summary(self, x: np.ndarray) -> tuple[float, ...]:
        """Length, values, missing values before the first and after the last, the first, and the map of the mean behind the first: a * mean + b."""
        valid = np.flatnonzero(x == x)
        if not len(valid):
            return float(len(x)), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
        a, b, keep = 1.0, 0.0, 1 - self.alpha
        for v, gap in zip(x[valid[1:]], np.diff(valid), strict=True):
            weight = keep**gap
            a, b = a * weight / (weight + self.alpha), (weight * b + self.alpha * v) / (weight + self.alpha)
        return float(len(x)), float(len(valid)), float(valid[0]), float(len(x) - 1 - valid[-1]), float(x[valid[0]]), a, b

    def join(self, state: tuple[float, ...], block: tuple[float, ...]) -> tuple[float, ...]:
        mean, gap, seen = state
        size, values, lead, trail, first, a, b = block
        if not values:
            return mean, gap + size if seen else 0.0, seen
        if seen:
            weight = (1 - self.alpha) ** (1 + gap + lead)
            first = (weight * mean + self.alpha * first) / (weight + self.alpha)
        return a * first + b, trail, seen + values

    def run(self, x: np.ndarray, state: tuple[float, ...]) -> np.ndarray:
        mean, gap, seen = state
        return smoothed(x, self.alpha, self.least, (mean, (1 - self.alpha) ** (1 + gap), int(seen)) if seen else None)


class Stochastic:
    """The lines K and D, each a third of the way to its input; missing inputs are skipped. State: K, D."""

    start = (50.0, 50.0)

    def summary(self, x: np.ndarray) -> tuple[float, ...]:
        """K = p * k + q and D = p * d + r * k + s for the lines k and d that come in."""
        p, q, r, s = 1.0, 0.0, 0.0, 0.0
        for v in x[x == x]:
            p, q = p * 2 / 3, q + (v - q) / 3
            r, s = r + (p - r) / 3, s + (q - s) / 3
        return p, q, r, s

    def join(self, state: tuple[float, ...], block: tuple[float, ...]) -> tuple[float, ...]:
        (k, d), (p, q, r, s) = state, block
        return p * k + q, p * d + r * k + s

    def run(self, x: np.ndarray, state: tuple[float, ...]) -> np.ndarray:
        return stochastic(x, *state)


Machine = Ewm | Stochastic


def scan(rows: DataFrame, inputs: Callable[[pd.DataFrame], dict[str, np.ndarray]], machines: dict[str, tuple[str, Machine]], outputs: Callable[[pd.DataFrame, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: T.StructType) -> DataFrame:
    """``rows`` (symbol, block, pos, halo and others) without their halo, with the columns of ``schema`` made by ``outputs``.

    ``inputs`` makes series of a block's rows in order, halo first; each of ``machines`` (input, machine) runs over one;
    ``outputs`` gets the rows and all series, in full length, with null before the block's own rows for machines.
    """
    names = list(machines)

    def own(g: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        g = g.sort_values("pos", kind="stable").reset_index(drop=True)
        return g, int(g["halo"].sum())

    def sum_up(g: pd.DataFrame) -> pd.DataFrame:
        g, halo = own(g)
        if halo == len(g):  # a block that has no bars of its own
            return pd.DataFrame({"symbol": [], "block": [], "maps": []}, dtype=object)
        x = inputs(g)
        maps = [float(v) for n in names for v in machines[n][1].summary(x[machines[n][0]][halo:])]
        return pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "block": [g["block"].iloc[0]], "maps": [maps]})

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        states, out = {n: machines[n][1].start for n in names}, []
        for maps in g.sort_values("block")["maps"]:
            out.append([float(v) for n in names for v in states[n]])
            at = 0
            for n in names:
                size = 7 if isinstance(machines[n][1], Ewm) else 4
                states[n] = machines[n][1].join(states[n], tuple(maps[at : at + size]))
                at += size
        return pd.DataFrame({"symbol": g["symbol"].iloc[0], "block": sorted(g["block"]), "states": out})

    def run(g: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        g, halo = own(g)
        if halo == len(g):
            return g.iloc[:0].reindex(columns=[f.name for f in schema.fields])
        x, given, at = inputs(g), list(states["states"].iloc[0]), 0
        for n in names:
            source, machine = machines[n]
            size = len(machine.start)
            made = machine.run(x[source][halo:], tuple(given[at : at + size]))
            x[n] = np.concatenate([np.full((halo, *made.shape[1:]), np.nan), made])
            at += size
        return g.assign(**outputs(g, x)).iloc[halo:][[f.name for f in schema.fields]]

    keys = rows.schema["block"].dataType.simpleString()
    maps = rows.groupBy("symbol", "block").applyInPandas(sum_up, f"symbol string, block {keys}, maps array<double>")
    states = maps.groupBy("symbol").applyInPandas(fold, f"symbol string, block {keys}, states array<double>")
    return rows.groupBy("symbol", "block").cogroup(states.groupBy("symbol", "block")).applyInPandas(run, schema)


def in_blocks(bars: DataFrame, size: int, halo: int) -> DataFrame:
    """``bars`` with their block of ``size`` positions; the last ``halo`` bars of a block come again at the head of the next."""
    at = F.floor(F.col("pos") / size).cast("int")
    again = F.when(F.col("pos") % size >= size - halo, F.struct((at + 1).alias("block"), F.lit(True).alias("halo")))
    both = F.filter(F.array(F.struct(at.alias("block"), F.lit(False).alias("halo")), again), lambda b: b.isNotNull())
    return bars.withColumn("__b", F.explode(both)).select(*bars.columns, "__b.block", "__b.halo")


HALO = 8
FIRST = {"fast": ("close", Ewm(2 / 13, 12)), "slow": ("close", Ewm(2 / 27, 26)), "range": ("tr", Ewm(1 / 14, 14)), "plus14": ("plus", Ewm(1 / 14, 14)), "minus14": ("minus", Ewm(1 / 14, 14)), "kd": ("raw", Stochastic())}
FIRST |= {f"{side}{n}": (side, Ewm(1 / n, n)) for n in (6, 12, 24) for side in ("up", "down")}
SECOND = {"DEA": ("DIF", Ewm(0.2, 9)), "ADX14": ("DX", Ewm(1 / 14, 14))}


def _series(g: pd.DataFrame) -> dict[str, np.ndarray]:
    h, lo, c = (g[x].to_numpy(float) for x in ("high", "low", "close"))
    before, higher, lower = np.r_[np.nan, c[:-1]], h - np.r_[np.nan, h[:-1]], np.r_[np.nan, lo[:-1]] - lo
    change = c - before
    known = change == change
    with np.errstate(all="ignore"):
        return {
            "close": c, "tr": np.fmax(h - lo, np.fmax(np.abs(h - before), np.abs(lo - before))), "raw": stochastic_raw(h, lo, c),
            "up": np.where(change > 0, change, np.where(known, 0, np.nan)), "down": np.where(change < 0, -change, np.where(known, 0, np.nan)),
            "plus": np.where((higher > lower) & (higher > 0), higher, 0.0), "minus": np.where((lower > higher) & (lower > 0), lower, 0.0),
        }


def _first(g: pd.DataFrame, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {"DIF": x["fast"] - x["slow"], "K": x["kd"][:, 0], "D": x["kd"][:, 1], "ATR14": x["range"]}
    out["J"] = 3 * out["K"] - 2 * out["D"]
    out |= {f"RSI{n}": relative_strength(x[f"up{n}"], x[f"down{n}"]) for n in (6, 12, 24)}
    with np.errstate(all="ignore"):
        p, m = (100 * x[k] / np.where(out["ATR14"] == 0, np.nan, out["ATR14"]) for k in ("plus14", "minus14"))
        out["DX"] = 100 * np.abs(p - m) / np.where(p + m == 0, np.nan, p + m)
    return out | {"PLUS_DI14": p, "MINUS_DI14": m}


def recursive(bars: DataFrame, block: int = 65_536) -> DataFrame:
    """``indicators.recursive`` for series that one task should not hold: any symbol spreads over a task per ``block`` bars.

    Needs ``pos``, the bar's number from 0 in its symbol without gaps. Equal to the single pass but for rounding. A
    symbol's fold has one row per block. Bars move twice more than in the single pass, which is the better one while
    symbols are many and none of them is long.
    """
    if block <= HALO:
        raise ValueError("a block must be longer than its halo")
    made = [c for c in RECURSIVE if c not in ("DEA", "MACD", "ADX14")] + ["DX"]
    add = lambda df, cols: T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in cols]])
    rows = in_blocks(bars, block, HALO)
    first = scan(rows, _series, FIRST, _first, add(rows, made))
    done = scan(first, lambda g: {c: g[c].to_numpy(float) for c in ("DIF", "DX")}, SECOND, lambda g, x: {c: x[c] for c in SECOND}, add(first, SECOND))
    done = done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in [*made, *SECOND]}).withColumn("MACD", 2 * (F.col("DIF") - F.col("DEA")))
    return done.select(*bars.columns, *RECURSIVE)
