"""Wave candidates from confirmed zigzag pivots at three scales, their projections, and a replay without lookahead.

Swings are windows; the zigzag is one fold over a symbol's swings in order of confirmation, which gives the pivots that
were known after each confirmation. Everything else is expressions on the last six pivots and joins to later bars.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import lead, ordered, swing, trailing

#: Scale, bars on both sides of a swing, least move in ATR.
SCALES = (("small", 2, 0.8), ("standard", 3, 1.0), ("large", 5, 1.5))
LAST = 6
STATE = "symbol string, scale string, at int, kinds array<string>, pos array<int>, price array<double>, macd array<double>, vol array<double>"


def raw_swings(bars: DataFrame, width: int) -> DataFrame:
    """(symbol, kind, position, confirm, price, atr, macd, vol): swings with a usable ATR when they are confirmed."""
    marked = bars.withColumns({"__h": swing(F.col("high"), width, True), "__l": swing(F.col("low"), width, False), "__atr": lead("ATR14", width), "__vol": F.avg("volume").over(trailing(3))})
    one = lambda f, k, c: F.when(F.col(f), F.struct(F.lit(k).alias("kind"), F.col(c).alias("price")))
    kinds = F.explode(F.filter(F.array(one("__h", "high", "high"), one("__l", "low", "low")), lambda x: x.isNotNull()))
    out = marked.filter((F.col("__h") | F.col("__l")) & (F.col("__atr") > 0)).withColumn("s", kinds)
    return out.select("symbol", "s.kind", F.col("pos").alias("position"), (F.col("pos") + width).alias("confirm"), "s.price", F.col("__atr").alias("atr"), F.col("MACD").alias("macd"), F.col("__vol").alias("vol"))


def zigzag(rows: list[tuple], least: float) -> list[tuple[int, list[tuple]]]:
    """States (confirmation, last pivots) after each swing that changes the pivots. A further swing of one kind replaces the last pivot if it is more extreme."""
    pivots: list[tuple] = []
    out = []
    for r in rows:  # (kind, position, confirm, price, atr, macd, vol)
        if pivots:
            last = pivots[-1]
            if r[1] <= last[1]:
                continue
            if r[0] == last[0]:
                if (r[3] > last[3]) != (r[0] == "high") or r[3] == last[3]:
                    continue
                pivots[-1] = r
                out.append((r[2], pivots[-LAST:]))
                continue
            if abs(r[3] - last[3]) / r[4] < least:
                continue
        pivots.append(r)
        out.append((r[2], pivots[-LAST:]))
    return out


def _fold(scale: str, least: float):
    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["confirm", "position", "kind"], kind="stable")
        cols = ["kind", "position", "confirm", "price", "atr", "macd", "vol"]
        found = zigzag(list(g[cols].itertuples(index=False, name=None)), least)
        pick = lambda p, i: [x[i] for x in p]
        rows = [(g["symbol"].iloc[0], scale, at, pick(p, 0), pick(p, 1), pick(p, 3), pick(p, 5), pick(p, 6)) for at, p in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    return fold


def states(bars: DataFrame) -> DataFrame:
    """(symbol, scale, at, last pivots): what was known from bar ``at`` on."""
    out = None
    for scale, width, least in SCALES:
        part = raw_swings(bars, width).groupBy("symbol").applyInPandas(_fold(scale, least), STATE)
        out = part if out is None else out.union(part)
    last = Window.partitionBy("symbol", "scale", "at").orderBy(F.desc(F.element_at("pos", -1)), F.desc(F.size("pos")))
    return out.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def closeness(x: Column, typical: tuple[float, ...]) -> Column:
    """1 at a typical ratio, falling to 0 at 35 % from the nearest."""
    d = F.least(*[F.abs(x - t) / max(t, 0.001) for t in typical]) if len(typical) > 1 else F.abs(x - typical[0]) / typical[0]
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / 0.35)), F.lit(0.0))


def _tail(c: str, n: int) -> list[Column]:
    return [F.try_element_at(c, F.lit(-n + i)) for i in range(n)]


def candidates(known: DataFrame) -> DataFrame:
    """One row per pattern that the last pivots fit, with fit and projection; a replaced state has its own rows."""
    near, nan = closeness, F.lit(None).cast("double")
    built = []

    def add(name: str, n: int, ok, fib, momentum, done: bool, confirm: int, invalid: int) -> None:
        p, k, m, v = _tail("price", n), _tail("kinds", n), _tail("macd", n), _tail("vol", n)
        d = F.when(k[0] == "low", 1).otherwise(-1) if n >= 5 else F.when(p[1] > p[0], 1).otherwise(-1)
        enough = F.size("pos") >= n
        macd = F.when(m[1].isNotNull() & m[-3 if n == 6 else 3].isNotNull(), F.when((m[3] - m[1]) * d > 0, 1.0).otherwise(0.35)) if momentum else None
        vol = F.when(v[1] > 0, F.least(F.lit(1.0), v[3] / v[1] / 1.2)) if momentum else None
        mom = F.coalesce((macd + vol) / 2, macd, vol, F.lit(0.5)) if momentum else F.lit(0.5)
        f = F.round(fib(p, d), 3)
        path = -d if done else d
        move = F.abs(p[-1] - p[0]) if done else F.abs(p[1] - p[0])
        a, b = ((0.236, 0.382) if done else (0.618, 1.0))
        z = [p[-1] + path * move * a, p[-1] + path * move * b]
        built.append(F.when(enough & F.coalesce(ok(p, d), F.lit(False)), F.struct(
            F.lit(name).alias("pattern"), d.cast("int").alias("direction"), F.lit("completed" if done else "developing").alias("status"), F.slice("pos", F.size("pos") - n + 1, n).alias("positions"),
            F.round(F.least(F.lit(0.95), 0.35 + 0.4 * f + 0.25 * F.round(mom, 3)), 3).alias("fit"), path.cast("int").alias("path"), F.round(p[confirm], 4).alias("confirmation"),
            F.round(p[invalid], 4).alias("invalidation"), F.round(F.least(*z), 4).alias("zone_low"), F.round(F.greatest(*z), 4).alias("zone_high"), F.round(p[-1], 6).alias("anchor"), F.round(move, 6).alias("move"))))

    leg = lambda p, d, i: d * (p[i + 1] - p[i])
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), nan)
    add("impulse", 6, lambda p, d: (F.least(leg(p, d, 0), leg(p, d, 2), leg(p, d, 4)) > 0) & (d * (p[2] - p[0]) > 0) & (leg(p, d, 2) >= F.least(leg(p, d, 0), leg(p, d, 4))) & (d * (p[4] - p[1]) > 0),
        lambda p, d: (near(safe(p[1] - p[2], p[1] - p[0]), (0.382, 0.5, 0.618, 0.786)) + near(safe(p[3] - p[2], p[1] - p[0]), (1.0, 1.618, 2.618))
                      + near(safe(p[3] - p[4], p[3] - p[2]), (0.236, 0.382, 0.5)) + near(safe(p[5] - p[4], p[1] - p[0]), (0.618, 1.0, 1.618))) / 4, True, True, -2, -1)
    add("unfinished_impulse", 5, lambda p, d: (d * (p[2] - p[0]) > 0) & (d * (p[4] - p[1]) > 0), lambda p, d: near(F.abs(p[3] - p[4]) / F.greatest(F.abs(p[3] - p[2]), F.lit(1e-12)), (0.236, 0.382, 0.5)), True, False, -2, -1)
    add("abc_zigzag", 4, lambda p, d: (F.abs(p[1] - p[0]) > 0) & (F.abs(p[3] - p[2]) > 0) & (F.abs(p[2] - p[1]) < F.abs(p[1] - p[0])),
        lambda p, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(safe(F.abs(p[3] - p[2]), F.abs(p[1] - p[0])) - 1) / 0.7)), False, True, -2, -1)
    add("unfinished_abc", 3, lambda p, d: (F.abs(p[1] - p[0]) > 0) & (F.abs(p[2] - p[1]) < F.abs(p[1] - p[0])), lambda p, d: near(safe(F.abs(p[2] - p[1]), F.abs(p[1] - p[0])), (0.382, 0.5, 0.618, 0.786)), False, False, 1, 0)
    each = known.select("symbol", "scale", "at", F.explode(F.filter(F.array(*built), lambda x: x.isNotNull())).alias("c")).select("symbol", "scale", "at", "c.*")
    w = Window.partitionBy("symbol", "scale", "at").orderBy(F.desc("fit"), "pattern")
    return each.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def state_of(close: Column) -> Column:
    c, up = F.col, F.col("path") > 0
    beyond = lambda level: F.when(up, close > level).otherwise(close < level)
    lost = F.when(up, close < c("invalidation")).otherwise(close > c("invalidation"))
    return (
        F.when(lost, "invalidated").when(close.between(c("zone_low"), c("zone_high")), "in_target_zone")
        .when(F.when(up, close > c("zone_high")).otherwise(close < c("zone_low")), "target_reached").when(beyond(c("confirmation")), "confirmed").otherwise("waiting")
    )


#: Retracements that follow a completed structure.
STAGES = ((0.236, 0.382), (0.5, 0.618), (0.618, 0.786), (0.786, 1.0))


def current(bars: DataFrame, n: int = 3) -> DataFrame:
    """The best ``n`` candidates per symbol over all scales at the last bar, the zones of completed ones moved past the close."""
    known = states(bars)
    last = known.groupBy("symbol", "scale").agg(F.max_by(F.struct(*[c for c in known.columns if c not in ("symbol", "scale")]), "at").alias("s")).select("symbol", "scale", "s.*")
    found = candidates(last)
    first = Window.partitionBy("symbol", "pattern", "direction", "positions").orderBy(F.when(F.col("scale") == "small", 0).when(F.col("scale") == "standard", 1).otherwise(2))
    found = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "rank")
    now = bars.groupBy("symbol").agg(F.max_by("close", "pos").alias("close"))
    found = found.join(now, "symbol")
    stage, up = F.lit(len(STAGES)), F.col("path") > 0
    edge = lambda r: F.round(F.col("anchor") + F.col("path") * F.col("move") * r, 4)
    for i in range(len(STAGES) - 1, 0, -1):
        far = edge(STAGES[i - 1][1])
        stage = F.when(~F.when(up, F.col("close") > far).otherwise(F.col("close") < far), i).otherwise(stage)
    found = found.withColumn("zone_stage", F.when(F.col("status") == "completed", stage))
    for name, pick in (("zone_low", F.least), ("zone_high", F.greatest)):
        z = F.col(name)
        for i, (a, b) in enumerate(STAGES, 1):
            z = F.when(F.col("zone_stage") == i, pick(edge(a), edge(b))).otherwise(z)
        found = found.withColumn(f"__{name}", z)
    found = found.withColumns({"zone_low": F.col("__zone_low"), "zone_high": F.col("__zone_high")}).drop("__zone_low", "__zone_high")
    w = Window.partitionBy("symbol").orderBy(F.desc("fit"), "scale", "pattern", "direction")
    return found.withColumns({"rank": F.row_number().over(w), "state": state_of(F.col("close"))}).filter(F.col("rank") <= n)


def first_outcome(cases: DataFrame, bars: DataFrame, keys: list[str], lookahead: int, lost: Column, confirmed: Column, hit: Column) -> DataFrame:
    """``cases`` (with symbol and at) with outcome and bars, by the first bar after ``at`` that decides.

    Losing beats confirming, confirming beats the target on one bar. ``already`` says that a case is confirmed at ``at``.
    """
    path = cases.withColumn("bars", F.explode(F.sequence(F.lit(1), F.lit(lookahead)))).withColumn("pos", F.col("at") + F.col("bars")).join(bars.select("symbol", "pos", "high", "low", "close"), ["symbol", "pos"])
    w = Window.partitionBy(*keys)
    path = path.withColumns({"__lost": F.min(F.when(lost, F.col("bars"))).over(w), "__sure": F.when(F.col("already"), 0).otherwise(F.min(F.when(confirmed, F.col("bars"))).over(w))})
    g = path.groupBy(*keys).agg(F.first("__lost").alias("lost"), F.first("__sure").alias("sure"), F.min(F.when(hit & (F.col("bars") > F.col("__sure")), F.col("bars"))).alias("hit"))
    out = cases.join(g, keys, "left")
    big = F.lit(1 << 30)
    lost_at, hit_at, sure_at = F.coalesce("lost", big), F.coalesce("hit", big), F.coalesce("sure", F.when(F.col("already"), 0), big)
    kind = F.when((lost_at < big) & (lost_at <= hit_at), "invalidation_first").when(hit_at < lost_at, "target_first").when(sure_at < big, "unresolved").otherwise("unconfirmed")
    return out.withColumns({"outcome": kind, "bars": F.when(F.least(lost_at, hit_at) < big, F.least(lost_at, hit_at))}).withColumn("confirmed", F.least(sure_at, big) <= F.least(lost_at, hit_at, F.lit(lookahead))).drop("lost", "sure", "hit")


def history(bars: DataFrame, lookahead: int = 20, least: int = 80, most: int = 480) -> DataFrame:
    """Outcomes of all candidates in each symbol's last bars, counted by scale, pattern, direction and status."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    sample = bars.withColumn("__n", n).filter(F.col("pos") >= F.col("__n") - (most + lookahead))
    sample = sample.withColumns({"pos": (F.row_number().over(ordered()) - 1).cast("int"), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    size = sample.groupBy("symbol").agg(F.max("__n").alias("n"))
    known = states(sample)
    until = F.lead("at").over(Window.partitionBy("symbol", "scale").orderBy("at"))
    spans = known.withColumn("until", until).select("symbol", "scale", "at", "until")
    found = candidates(known).join(spans, ["symbol", "scale", "at"]).join(size, "symbol")
    found = found.withColumns({"start": F.greatest("at", F.lit(least)), "end": F.least(F.coalesce("until", F.col("n")), F.col("n") - lookahead)}).filter(F.col("start") < F.col("end"))
    # the first bar of its time at which a candidate isn't lost already
    lives = found.withColumn("at_pos", F.explode(F.sequence(F.col("start").cast("int"), (F.col("end") - 1).cast("int"))))
    seen = lives.join(sample.select("symbol", F.col("pos").alias("at_pos"), "close"), ["symbol", "at_pos"])
    alive = F.when(F.col("path") > 0, F.col("close") >= F.col("invalidation")).otherwise(F.col("close") <= F.col("invalidation"))
    keys = ["symbol", "scale", "pattern", "direction", "status", "positions"]
    rest = ["fit", "path", "confirmation", "invalidation", "zone_low", "zone_high", "close"]
    cases = seen.filter(alive).groupBy(*keys).agg(F.min("at_pos").alias("at"), F.min_by(F.struct(*rest), "at_pos").alias("c")).select(*keys, "at", "c.*")
    up = F.col("path") > 0
    over = lambda c, level: F.when(up, c > F.col(level)).otherwise(c < F.col(level))
    cases = cases.withColumn("already", over(F.col("close"), "confirmation")).drop("close")
    lost = F.when(up, F.col("close") < F.col("invalidation")).otherwise(F.col("close") > F.col("invalidation"))
    done = first_outcome(cases, sample, keys, lookahead, lost, over(F.col("close"), "confirmation"), F.when(up, F.col("high") >= F.col("zone_low")).otherwise(F.col("low") <= F.col("zone_high")))
    o = lambda k: F.count_if(F.col("outcome") == k)
    resolved = o("target_first") + o("invalidation_first")
    return done.groupBy("symbol", "scale", "pattern", "direction", "status").agg(
        F.count(F.lit(1)).alias("samples"), resolved.alias("resolved"), o("target_first").alias("target_first"), o("invalidation_first").alias("invalidation_first"), o("unresolved").alias("unresolved"),
        o("unconfirmed").alias("unconfirmed"), F.when(resolved >= 30, F.round(o("target_first") / resolved * 100, 1)).alias("target_first_rate"),
        F.when(resolved >= 30, F.round(F.percentile(F.when(F.col("outcome") == "target_first", F.col("bars")), 0.5), 1)).alias("median_target_bars"),
    )
