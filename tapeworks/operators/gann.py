"""Price-time geometry from confirmed pivots: anchors, fans, price zones, time windows, confluence, scenarios, studies.

Pivots are one fold over swings; anchors, lines, events and outcomes are joins and windows over bars. What looks at the
last bar only (windows, confluence, scenarios) works on the few rows of a symbol's current anchors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.functions.windows import lag, lead, ordered
from tapeworks.sources.tables import kept, release

#: Lines of the fan (price units per bar), multiples of a cycle, weights of confluence.
ANGLES = (("8x1", 8.0), ("4x1", 4.0), ("2x1", 2.0), ("1x1", 1.0), ("1x2", 0.5), ("1x4", 0.25), ("1x8", 0.125))
MULTIPLES = (0.5, 1.0, 1.5, 2.0, 3.0)
WEIGHTS = {"angle": 20.0, "time": 20.0, "price_level": 15.0, "horizontal": 15.0, "fibonacci": 10.0, "higher_timeframe": 10.0, "momentum": 5.0, "volume": 5.0}
HORIZONS = {"daily": 15, "weekly": 6, "monthly": 4}
CAP = 20
RETURNS = (1, 3, 5, 10, 20)


@dataclass(frozen=True)
class Config:
    window: int = 3
    atr_factor: float = 1.0
    price_share: float = 0.01
    atr_multiplier: float = 0.25
    percent_unit: float = 0.005
    mode: str = "atr"
    cycles: int = 7
    tolerance: float = 0.10
    zone_atr: float = 0.20
    confluence_atr: float = 0.35
    visible: int = 3
    least_score: float = 35.0

    def __post_init__(self) -> None:
        if self.mode not in ("atr", "percent", "log"):
            raise ValueError(f"unknown scale {self.mode}")


PIVOT = "symbol string, no int, kind string, position int, confirm int, price double, atr double, swing double, duration int, prev_kind string, prev_price double, prev_position int, opp_price double, opp_position int"


@dataclass(frozen=True)
class Parts:
    """What several results of one query share, computed once.

    ``view`` has a row per anchor under study: the anchor, the bar that it is seen from (latest, now_*), and the
    durations of the swings known there, newest first.
    """

    pivots: DataFrame
    view: DataFrame

    def release(self) -> None:
        release(self.pivots, self.view)


NOW = ["close", "DIF", "DEA", "VOL_RATIO", "MA20", "MA60", "BOLL_UPPER", "BOLL_LOWER"]


def prepare(bars: DataFrame, conf: Config = Config()) -> Parts:
    """Pivots, and active anchors seen from the last bar, as tables until released; rows are few against bars."""
    found = kept(pivots(bars, conf))
    last = known(found, conf).groupBy("symbol").agg(F.max_by("d", "no").alias("d"))
    view = active(bars, conf, found).join(last_bar(bars), "symbol").join(last, "symbol", "left")
    return Parts(found, kept(view))


def replay(bars: DataFrame, conf: Config = Config()) -> Parts:
    """Pivots, and every anchor seen from the bar of its own confirmation, with the swings known by then: an as-of join on the version.

    Pivots are appended and never moved, so that those known at a confirmation are the ones up to the anchor's number.
    """
    found = kept(pivots(bars, conf))
    seen = bars.select("symbol", F.col("pos").alias("confirm"), F.col("datetime").alias("now_datetime"), *[F.col(c).alias(f"now_{c}") for c in NOW])
    view = anchors(bars, conf, found).join(seen, ["symbol", "confirm"]).withColumn("latest", F.col("confirm")).join(known(found, conf), ["symbol", "no"])
    return Parts(found, kept(view))


def known(found: DataFrame, conf: Config = Config()) -> DataFrame:
    """(symbol, no, d): the last swings' durations of two bars or more that are known with each pivot, newest first."""
    by = Window.partitionBy("symbol").orderBy("no")
    long = F.when(F.col("duration") >= 2, F.col("duration").cast("double"))
    # durations of long swings are numbered, so that the last ones of any pivot are those of the last numbers
    x = found.select("symbol", "no", long.alias("long"), F.count(long).over(by).alias("k"))
    at = x.filter("long is not null").select("symbol", "k", F.reverse(F.collect_list("long").over(Window.partitionBy("symbol").orderBy("no").rowsBetween(1 - conf.cycles, 0))).alias("d"))
    return x.select("symbol", "no", "k").join(at, ["symbol", "k"], "left").select("symbol", "no", "d")


def lone(c: Column, width: int, high: bool) -> Column:
    """An extreme of its window to which no other value is close (relative 1e-5, absolute 1e-8)."""
    w = ordered().rowsBetween(-width, width)
    around = F.collect_list(c).over(w)
    alike = F.size(F.filter(around, lambda x: F.abs(x - c) <= 1e-8 + 1e-5 * F.abs(c)))
    return F.coalesce((F.size(around) == 2 * width + 1) & (c == (F.max if high else F.min)(c).over(w)) & (alike == 1), F.lit(False))


def pivots(bars: DataFrame, conf: Config = Config()) -> DataFrame:
    """Accepted pivots in order. Each is appended, never moved: a more extreme one of the same kind follows the last."""
    k = conf.window
    m = bars.withColumns({"__h": lone(F.col("high"), k, True), "__l": lone(F.col("low"), k, False), "__atr": lead("ATR14", k)}).filter((F.col("__h") | F.col("__l")) & (F.col("__atr") > 0))
    one = lambda f, kind, c: F.when(F.col(f), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("price")))
    raw = m.withColumn("s", F.explode(F.filter(F.array(one("__h", "high", "high"), one("__l", "low", "low")), lambda x: x.isNotNull())))
    raw = raw.select("symbol", "s.kind", F.col("pos").alias("position"), (F.col("pos") + k).alias("confirm"), "s.price", F.col("__atr").alias("atr"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in g.sort_values(["confirm", "position", "kind"], kind="stable").itertuples(index=False):
            last = kept[-1] if kept else None
            if last and r.position <= last["position"]:
                continue
            least = max(r.atr * conf.atr_factor, r.price * conf.price_share)
            opposite = next((p for p in reversed(kept) if p["kind"] != r.kind), None)
            before = last
            if last and r.kind == last["kind"]:
                further = r.price > last["price"] if r.kind == "high" else r.price < last["price"]
                if not further or abs(r.price - last["price"]) < least:
                    continue
                before = opposite or last
            swing = abs(r.price - before["price"]) if before else 0.0
            if before and swing < least:
                continue
            kept.append({
                "symbol": r.symbol, "no": len(kept), "kind": r.kind, "position": r.position, "confirm": r.confirm, "price": r.price, "atr": r.atr, "swing": swing, "duration": r.position - before["position"] if before else 0,
                "prev_kind": before["kind"] if before else None, "prev_price": before["price"] if before else None, "prev_position": before["position"] if before else None,
                "opp_price": opposite["price"] if opposite else None, "opp_position": opposite["position"] if opposite else None,
            })
        out = pd.DataFrame(kept, columns=[c.split()[0] for c in PIVOT.split(", ")])
        return out.astype({c: "Int32" for c in ("no", "position", "confirm", "duration", "prev_position", "opp_position")})

    return raw.groupBy("symbol").applyInPandas(fold, PIVOT)


def anchors(bars: DataFrame, conf: Config = Config(), found: DataFrame | None = None) -> DataFrame:
    """Pivots (``found``, if known) with an earlier opposite one, scored from 0 to 100 on bars up to their confirmation only."""
    p = (pivots(bars, conf) if found is None else found).filter("opp_price is not null")
    b = bars.select("symbol", "pos", "high", "low", "close", "volume")
    seg = p.select("symbol", "no", "position", "confirm", "price", "atr").withColumn("pos", F.explode(F.sequence(F.greatest(F.col("position") - 20, F.lit(0)), F.col("confirm")))).join(b, ["symbol", "pos"])
    near = lambda c: F.count_if(F.abs(F.col(c) - F.col("price")) <= F.col("atr") * 0.35)
    vol = F.when(F.col("volume") != 0, F.col("volume"))
    at = lambda c, pos: F.max(F.when(F.col("pos") == pos, c))
    g = seg.groupBy("symbol", "no").agg(
        (near("high") + near("low")).alias("touches"), F.percentile(vol, 0.5).alias("median"), at(vol, F.col("position")).alias("volume"),
        at(F.col("close"), F.greatest(F.col("position") - 2, F.lit(0))).alias("before"), at(F.col("close"), F.col("confirm")).alias("after"),
    )
    c = F.col
    unit = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 4)
    swing, sign = c("swing") / c("atr"), F.when(c("kind") == "low", 1).otherwise(-1)
    parts = {
        "s_strength": unit(F.greatest(swing / 5, c("duration") / 24)) * 25, "s_swing": unit(swing / 6) * 20, "s_atr": unit(swing / 4) * 15, "s_touches": unit(c("touches") / 4) * 15,
        "s_volume": F.coalesce(F.when(c("median") > 0, unit(c("volume") / c("median") / 2)), F.lit(0.5)) * 10, "s_reversal": unit((c("after") - c("before")) * sign / c("atr") / 2) * 10, "s_time": unit(c("duration") / 20) * 5,
    }
    out = p.join(g, ["symbol", "no"]).withColumns({k: F.round(v, 2) for k, v in parts.items()})
    total = sum(c(k).cast("decimal(10,2)") for k in parts)  # exact, so that its rounding hangs on no order of addition
    ident = F.substring(F.sha1(F.concat_ws("|", "symbol", "kind", "position", F.format_number("price", 8))), 1, 16)
    out = out.withColumns({"score": F.round(total, 1).cast("double"), "direction": F.when(c("kind") == "low", "up").otherwise("down"), "anchor_id": ident})
    return out.drop("touches", "median", "volume", "before", "after")


def alive(found: DataFrame, until: Column) -> DataFrame:
    """A row per bar (pos) of each anchor's life, from the bar after its confirmation to the one before ``until``.

    Lives of one direction don't overlap, so there are at most twice as many rows as bars.
    """
    lives = found.filter(F.col("confirm") + 1 < until)
    return lives.withColumn("pos", F.explode(F.sequence(F.col("confirm") + 1, (until - 1).cast("int"))))


def lifecycles(bars: DataFrame, conf: Config = Config(), found: DataFrame | None = None) -> DataFrame:
    """Anchors with their successor, the first close that breaches them before it, and status."""
    a = anchors(bars, conf, found).drop("swing")
    w = Window.partitionBy("symbol", "direction").orderBy("no")
    a = a.withColumns({"next_confirm": F.lead("confirm").over(w), "replacement": F.lead("anchor_id").over(w)})
    b, n = bars.select("symbol", "pos", "close"), bars.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"))
    breach = F.when(F.col("direction") == "up", F.col("close") < F.col("price") - F.col("atr") * 0.15).otherwise(F.col("close") > F.col("price") + F.col("atr") * 0.15)
    slim = a.select("symbol", "no", "direction", "confirm", "next_confirm", "price", "atr").join(n, "symbol")
    life = alive(slim, F.coalesce("next_confirm", "n")).join(b, ["symbol", "pos"]).filter(breach)
    first = life.groupBy("symbol", "no").agg(F.min("pos").alias("breached_at"))
    status = F.when(F.col("breached_at").isNotNull(), "invalidated").when(F.col("replacement").isNotNull(), "replaced").otherwise("active")
    return a.join(first, ["symbol", "no"], "left").withColumn("status", status)


def active(bars: DataFrame, conf: Config = Config(), found: DataFrame | None = None) -> DataFrame:
    """The latest anchor per symbol and direction, with the best older score as a reference."""
    a = anchors(bars, conf, found)
    w = Window.partitionBy("symbol", "direction").orderBy(F.desc("no"))
    older = F.max("score").over(Window.partitionBy("symbol", "direction").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    return a.withColumns({"reference_score": older, "__n": F.row_number().over(w)}).filter("__n = 1").drop("__n")


def unit(conf: Config) -> Column:
    return {"atr": F.col("atr") * conf.atr_multiplier, "percent": F.col("price") * conf.percent_unit, "log": F.lit(math.log1p(conf.percent_unit))}[conf.mode]


def line(ratio_: Column | float, pos: Column, conf: Config) -> Column:
    """Price of a line of the fan at a bar, from columns price, atr, position and direction of an anchor."""
    run = F.greatest(pos - F.col("position"), F.lit(0)) * ratio_ * unit(conf) * F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)
    return F.col("price") * F.exp(run) if conf.mode == "log" else F.col("price") + run


def last_bar(bars: DataFrame) -> DataFrame:
    keep = ["pos", "datetime", *NOW]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*keep), "pos").alias("l")).select("symbol", F.col("l.pos").alias("latest"), *[F.col(f"l.{k}").alias(f"now_{k}") for k in keep[1:]])


def fan(bars: DataFrame, conf: Config = Config(), horizon: int = 12, parts: Parts | None = None) -> DataFrame:
    """The seven lines of each active anchor at the last bar and at the horizon, and the anchor's state."""
    parts = parts or prepare(bars, conf)
    a = parts.view
    sign = F.when(F.col("direction") == "up", 1).otherwise(-1)
    ok = lambda r: (F.col("now_close") - line(r, F.col("latest"), conf)) * sign >= 0
    state = F.when(ok(2.0), "STRONG_BULL").when(ok(1.0), "BULL").when(ok(0.5), "NEUTRAL").otherwise("BEAR")
    mirrored = F.when(state == "STRONG_BULL", "STRONG_BEAR").when(state == "BULL", "BEAR").when(state == "BEAR", "BULL").otherwise(state)
    a = a.withColumn("state", F.when(F.col("direction") == "up", state).otherwise(mirrored))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("angle"), F.lit(r).alias("ratio")) for n, r in ANGLES]))
    a = a.withColumn("f", each).withColumns({"angle": F.col("f.angle"), "ratio": F.col("f.ratio")})
    return a.select("symbol", "anchor_id", "direction", "score", "state", "angle", F.round(line(F.col("ratio"), F.col("latest"), conf), 6).alias("current_price"),
                    F.round(line(F.col("ratio"), F.col("latest") + horizon, conf), 6).alias("end_price"), F.col("angle").isin("2x1", "1x1", "1x2").alias("default_visible"))


def price_levels(bars: DataFrame, horizontal: DataFrame | None = None, conf: Config = Config(), parts: Parts | None = None) -> DataFrame:
    """(anchor, source, label, price, weight): eighths, retracements, the prior pivot, indicators and given horizontal levels."""
    parts = parts or prepare(bars, conf)
    a = parts.view
    lo, hi, sign = F.least("price", "opp_price"), F.greatest("price", "opp_price"), F.when(F.col("direction") == "up", 1).otherwise(-1)
    s = lambda src, label, price, weight: F.struct(F.lit(src).alias("source"), F.lit(label).alias("label"), F.round(price, 6).alias("level"), F.lit(weight).alias("weight"))
    made = [s("eighth", f"{i}/8", lo + (hi - lo) * (i / 8), 15.0 if i == 4 else 10.0) for i in range(1, 9)]
    made += [s("fibonacci", f"{f:g}", F.col("price") + sign * (hi - lo) * f, 15.0) for f in (0.382, 0.5, 0.618, 1.0)]
    made += [s("prior_pivot", "prior", F.col("opp_price"), 15.0)] + [s("indicator", m, F.col(f"now_{m}"), 10.0) for m in ("MA20", "MA60", "BOLL_UPPER", "BOLL_LOWER")]
    keys = ["symbol", "anchor_id", "direction", "price", "atr", "position", "score", "latest", "now_close"]
    out = a.select(*keys, F.explode(F.array(*made)).alias("s")).select(*keys, "s.*")
    if horizontal is not None:
        h = a.select(*keys).join(horizontal.select("symbol", F.col("price").alias("__p")), "symbol")
        out = out.union(h.select(*keys, F.lit("horizontal"), F.lit("horizontal"), F.round("__p", 6), F.lit(15.0)))
    return out.filter("level is not null")


def price_zones(levels: DataFrame, conf: Config = Config()) -> DataFrame:
    """Levels joined to zones where the step from one to the next is within the tolerance; ranked by strength."""
    tol = F.greatest(F.col("atr") * conf.zone_atr, F.col("price") * 0.0005)
    w = Window.partitionBy("symbol", "anchor_id").orderBy("level", "source", "label")
    x = levels.withColumns({"tol": tol, "__gap": (F.col("level") - F.lag("level").over(w)) > tol}).withColumn("zone", F.sum(F.when(F.col("__gap"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    z = x.groupBy("symbol", "anchor_id", "zone").agg(
        F.round(F.min("level") - F.max("tol") * 0.15, 6).alias("price_low"), F.round(F.max("level") + F.max("tol") * 0.15, 6).alias("price_high"), F.round(F.avg("level"), 6).alias("center"),
        F.count(F.lit(1)).alias("factors"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.sum("weight").alias("__w"),
    )
    z = z.withColumn("strength", F.round(F.least(F.lit(100.0), 20.0 + F.col("__w") * 0.7 + F.size("sources") * 8.0), 1)).drop("__w")
    rank = F.row_number().over(Window.partitionBy("symbol", "anchor_id").orderBy(F.desc("strength"), F.desc("factors"), "price_low"))
    return z.withColumn("rank", rank).withColumn("default_visible", F.col("rank") <= conf.visible)


def middle(d: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(d), F.size(d)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


def cycle_lengths(d: Column) -> Column:
    """The last, the previous and the median duration, each length once."""
    return F.array_distinct(F.transform(F.array(F.get(d, F.lit(0)), F.coalesce(F.get(d, F.lit(1)), F.get(d, F.lit(0))), F.bround(middle(d))), lambda x: F.greatest(F.lit(2), x.cast("int"))))


def cycle_strength(d: Column) -> Column:
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.round(45 + (1 - F.least(sd / F.greatest(mean, F.lit(1.0)), F.lit(1.0))) * 35 + F.least(n, F.lit(5)) * 4, 1)


def base_cycles(bars: DataFrame, conf: Config = Config(), parts: Parts | None = None) -> DataFrame:
    """(symbol, key, cycle, strength): the last, the previous and the median duration of recent swings, each length once."""
    last = known(parts.pivots if parts else pivots(bars, conf), conf).groupBy("symbol").agg(F.max_by("d", "no").alias("d")).filter("d is not null")
    d = F.col("d")
    three = F.array(F.lit("recent"), F.lit("previous"), F.lit("median"))
    of = [F.get(d, F.lit(0)), F.coalesce(F.get(d, F.lit(1)), F.get(d, F.lit(0))), F.bround(middle(d))]
    named = F.arrays_zip(three.alias("key"), F.transform(F.array(*of), lambda x: F.greatest(F.lit(2), x.cast("int"))).alias("cycle"))
    each = last.select("symbol", cycle_strength(d).alias("strength"), cycle_lengths(d).alias("lengths"), named.alias("named"))
    first = F.transform("lengths", lambda x: F.struct(F.get(F.filter("named", lambda k: k["cycle"] == x), F.lit(0))["key"].alias("key"), x.alias("cycle")))
    return each.select("symbol", F.explode(first).alias("e"), "strength").select("symbol", "e.*", "strength")


def tenths(x: Column) -> Column:
    """A value from 8 to 512 rounded to one decimal by its exact binary value, half to even: whole numbers of 2**-50 decide."""
    n = (x * float(1 << 50)).cast("decimal(38,0)") * 10
    unit_ = F.lit(1 << 50).cast("decimal(38,0)")
    whole = F.call_function("div", n, unit_)
    rest = n - whole.cast("decimal(20,0)") * unit_
    half = F.lit(1 << 49).cast("decimal(38,0)")
    return (whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)).cast("double") / 10


def future_time(latest: Column, ahead: Column, period: str) -> Column:
    """Time of the ``ahead``-th bar after ``latest``: business days, weeks, month ends or minutes; days for other periods."""
    minutes = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60}.get(period)
    day = F.to_date(latest)
    if minutes:
        return latest + F.make_dt_interval(mins=ahead * minutes)
    if period == "daily":
        # a weekend counts as the Friday before it; then whole weeks, and the days left, over the next weekend if they reach it
        start = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
        rest = ahead % 5
        to = F.date_add(start, (F.floor(ahead / 5) * 7 + rest + F.when(F.weekday(start) + rest > 4, 2).otherwise(0)).cast("int"))
    elif period == "monthly":
        to = F.last_day(F.add_months(day, ahead - F.when(day == F.last_day(day), 0).otherwise(1)))
    else:
        to = F.date_add(day, (ahead * (7 if period == "weekly" else 1)).cast("int"))
    return latest + F.make_dt_interval(days=F.date_diff(to, day))


def candidates(a: DataFrame, conf: Config, horizon: int) -> DataFrame:
    """Rows of ``a`` (with d, position, latest, aligned, nearby) times at most 15 candidates: a base cycle and a multiple each."""
    c = F.col
    a = a.withColumns({"lengths": cycle_lengths(c("d")), "strength": cycle_strength(c("d"))}).select("*", F.posexplode("lengths").alias("i", "x"))
    ms = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(8.0 if m >= 3 else 3.0 if m >= 2 else 0.0).alias("far")) for k, m in enumerate(MULTIPLES)])
    a = a.withColumn("f", F.explode(ms)).withColumn("first", (c("position") + F.bround(c("x") * c("f.m"))).cast("int"))
    a = a.withColumns({
        "center": F.when(c("first") <= c("latest"), c("first") + c("x") * (F.floor((c("latest") - c("first")) / c("x")) + 1)).otherwise(c("first")).cast("int"), "tol": F.greatest(F.lit(1), F.bround(c("x") * conf.tolerance).cast("int")),
    }).filter(c("center") <= c("latest") + horizon)
    overlap = F.size(F.filter("lengths", lambda o: F.abs(c("center") - (c("position") + F.bround(o * c("f.m")))) <= c("tol")))
    total = F.least(F.lit(30.0), c("strength") * 0.3) + F.least(F.lit(20.0), F.greatest(overlap - 1, F.lit(0)) * 10.0) + 8.0 + F.when(c("aligned"), 12.0).otherwise(6.0)
    total = total + F.least(F.lit(15.0), c("nearby") * 15.0) + 15.0 - c("f.far")
    a = a.withColumn("total", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    return a.withColumns({"start": F.greatest(c("latest") + 1, c("center") - c("tol")).cast("int"), "end": F.least(c("latest") + horizon, c("center") + c("tol")).cast("int"), "score": tenths(c("total")), "order": c("i") * len(MULTIPLES) + c("f.k")})


def merged(windows: Column) -> Column:
    """Sorted (start, minus, order, center, end), those that overlap as one (center, start, end, score, cycles): in order of start, then of
    falling score (minus), the first's centre, the widest end, the highest score so far and 7 more for each that joins."""
    kind = "array<struct<center:int,start:int,end:int,score:double,cycles:int>>"

    def joined(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fresh = F.struct(w["center"].alias("center"), w["start"].alias("start"), w["end"].alias("end"), (-w["minus"]).alias("score"), F.lit(1).alias("cycles"))
        more = F.round(F.least(F.lit(100.0), F.greatest(last["score"], -w["minus"]) + 7), 1)
        wider = F.struct(last["center"].alias("center"), last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"), more.alias("score"), (last["cycles"] + 1).alias("cycles"))
        return F.when((F.size(done) > 0) & (w["start"] <= last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider)).cast(kind)).otherwise(F.concat(done, F.array(fresh)).cast(kind))

    return F.aggregate(windows, F.array().cast(kind), joined)


def time_windows(bars: DataFrame, zones: DataFrame | None = None, higher: DataFrame | None = None, conf: Config = Config(), horizon: int = CAP, parts: Parts | None = None, period: str = "60m") -> DataFrame:
    """Windows after the bar that each anchor is seen from, up to the hard horizon, at multiples of the base cycles; overlapping ones are merged in order.

    ``zones`` are the anchors' price zones: up to six of them raise a window's score (without, three are taken); so does a ``higher`` timeframe
    (symbol, direction) that goes the anchor's way. Times of future bars are those of the ``period``.
    """
    parts = parts or prepare(bars, conf)
    a = with_higher(parts.view.filter("d is not null").select("symbol", "anchor_id", "direction", "position", "latest", "now_datetime", "d"), higher)
    if zones is None:
        a = a.withColumn("nearby", F.lit(0.5))
    else:
        a = a.join(zones.groupBy("symbol", "anchor_id").agg(F.count(F.lit(1)).alias("zones")), ["symbol", "anchor_id"], "left")
        a = a.withColumn("nearby", F.least(F.lit(1.0), F.coalesce("zones", F.lit(0)) / 6))
    each = F.struct("start", (-F.col("score")).alias("minus"), "order", "center", "end")
    a = candidates(a, conf, horizon).groupBy("symbol", "anchor_id", "latest", "now_datetime").agg(F.array_sort(F.collect_list(each)).alias("all"))
    a = a.withColumn("w", F.explode(merged(F.col("all"))))
    when = lambda k: future_time(F.col("now_datetime"), F.col(f"w.{k}") - F.col("latest"), period).alias(f"{k}_time")
    return a.select("symbol", "anchor_id", "w.center", "w.start", "w.end", (F.col("w.center") - F.col("latest")).alias("bars_from_now"), "w.score", "w.cycles", when("start"), when("center"), when("end"))


def with_higher(anchors_: DataFrame, higher: DataFrame | None) -> DataFrame:
    """Anchors with a column aligned: whether the higher timeframe of their symbol goes their way."""
    if higher is None:
        return anchors_.withColumn("aligned", F.lit(False))
    h = higher.select("symbol", F.col("direction").alias("__way"))
    return anchors_.join(h, "symbol", "left").withColumn("aligned", F.coalesce(F.col("__way") == F.col("direction"), F.lit(False))).drop("__way")


def decay(ahead: Column) -> Column:
    return F.when(ahead <= 5, 1.0).when(ahead <= 10, 0.85).when(ahead <= 15, 0.65).otherwise(0.45)


def confluence(bars: DataFrame, horizontal: DataFrame | None = None, conf: Config = Config(), higher: DataFrame | None = None, horizon: int = CAP, parts: Parts | None = None) -> DataFrame:
    """Zones where a line at a time window meets a price zone, per active anchor: a join on the anchor with a tolerance."""
    parts = parts or prepare(bars, conf)
    z = price_zones(price_levels(bars, horizontal, conf, parts), conf)
    return ranked(time_windows(bars, z, higher, conf, horizon, parts), z, higher, conf, parts)


def ranked(windows: DataFrame, zones: DataFrame, higher: DataFrame | None, conf: Config, parts: Parts) -> DataFrame:
    z = zones.drop("default_visible").withColumnRenamed("rank", "zone_rank")
    rank = F.row_number().over(Window.partitionBy("symbol", "anchor_id").orderBy(F.desc("score"), "center", "angle_no", "zone_rank"))
    one = meetings(windows, z, higher, conf, parts).withColumn("rank", rank).withColumn("default_visible", (F.col("rank") <= conf.visible) & (F.col("score") >= 65))
    return one.drop("tol", "angle_no", "zone_rank")


def meetings(w: DataFrame, z: DataFrame, higher: DataFrame | None, conf: Config, parts: Parts) -> DataFrame:
    """Where a line at one of the windows ``w`` meets one of the zones ``z`` of its anchor; of those close in price and time the best."""
    a = parts.view.select("symbol", "anchor_id", "direction", "price", "atr", "position", "score", "latest", "now_close", "now_DIF", "now_DEA", "now_VOL_RATIO").withColumnRenamed("score", "anchor_score")
    a = with_higher(a, higher)
    w = w.select("symbol", "anchor_id", "center", "start", "bars_from_now", F.col("score").alias("window_score"))
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("angle"), F.lit(r).alias("ratio")) for i, (n, r) in enumerate(ANGLES) if n in ("2x1", "1x1", "1x2")]))
    x = a.join(w, ["symbol", "anchor_id"]).withColumn("f", lines)
    x = x.withColumns({"angle": F.col("f.angle"), "angle_no": F.col("f.no"), "projected": line(F.col("f.ratio"), F.col("center"), conf), "tol": F.greatest(F.col("atr") * conf.confluence_atr, F.col("price") * 0.001)})
    z = z.withColumnRenamed("center", "zone_center")
    met = x.join(z, ["symbol", "anchor_id"]).filter((F.col("projected") >= F.col("price_low") - F.col("tol")) & (F.col("projected") <= F.col("price_high") + F.col("tol")))
    has = lambda *names: F.arrays_overlap("sources", F.array(*map(F.lit, names)))
    sign = F.when(F.col("direction") == "up", 1).otherwise(-1)
    take = lambda cond, k: F.when(cond, WEIGHTS[k]).otherwise(0.0)
    raw = (
        WEIGHTS["angle"] + WEIGHTS["time"] * F.least(F.lit(1.0), F.col("window_score") / 70) + take(has("eighth", "prior_pivot"), "price_level") + take(has("horizontal"), "horizontal")
        + take(has("fibonacci"), "fibonacci") + take(F.col("aligned"), "higher_timeframe") + take((F.col("now_DIF") - F.col("now_DEA")) * sign > 0, "momentum") + take(F.col("now_VOL_RATIO") >= 1, "volume")
    )
    met = met.withColumns({"raw_score": F.round(F.least(F.lit(100.0), raw), 1), "middle": (F.col("projected") + F.col("zone_center")) / 2})
    met = met.withColumns({
        "score": F.round(F.least(F.lit(100.0), raw) * decay(F.col("bars_from_now")), 1), "mid": F.round("middle", 6), "zone_low": F.round(F.least("price_low", F.col("middle") - F.col("tol") * 0.3), 6),
        "zone_high": F.round(F.greatest("price_high", F.col("middle") + F.col("tol") * 0.3), 6), "type": F.when(F.col("middle") >= F.col("now_close"), "resistance").otherwise("support"), "start_bar": F.col("start") - F.col("latest"),
    })
    # an anchor has some hundred meetings at most: 15 windows, three lines, the zones of its few levels
    row = F.struct((-F.col("score")).alias("minus"), "center", "angle_no", "zone_rank", "direction", "anchor_score", "angle", "start_bar", "mid", "zone_low", "zone_high", "raw_score", "score", "type", "tol")
    ranked = met.groupBy("symbol", "anchor_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    close = lambda r, k: (F.abs(r["mid"] - k["mid"]) <= r["tol"] * 0.5) & (F.abs(r["start_bar"] - k["start_bar"]) <= 1)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, r: F.when(F.exists(done, lambda k: close(r, k)), done).otherwise(F.concat(done, F.array(r))))
    cols = ["direction", "anchor_score", "angle", "center", "start_bar", "mid", "zone_low", "zone_high", "raw_score", "score", "type", "tol", "angle_no", "zone_rank"]
    return ranked.select("symbol", "anchor_id", F.explode(kept).alias("k")).select("symbol", "anchor_id", *[f"k.{c}" for c in cols])


def confluence_events(bars: DataFrame, conf: Config = Config(), least: float = 60.0, parts: Parts | None = None) -> DataFrame:
    """Zones of a raw score of ``least`` or more as they stood when each anchor was confirmed, and what came of them.

    The whole zone engine runs once over all anchors, each seen from its own confirmation (``replay``): levels, zones and
    windows of the swings and indicators known then, without horizontal levels or a higher timeframe. A zone is entered
    at the close of its window's first bar, if the next anchor of the direction is not confirmed by then; the 20 bars
    after it tell the moves for and against, in ATR of the anchor. Anchors confirmed before bar 29, or with under 21 bars behind the
    confirmation, take no part.
    """
    parts = parts or replay(bars, conf)
    z = price_zones(price_levels(bars, None, conf, parts), conf).withColumnRenamed("rank", "zone_rank")
    met = meetings(time_windows(bars, None, None, conf, CAP, parts), z, None, conf, parts).filter(F.col("raw_score") >= least)
    w = Window.partitionBy("symbol", "direction").orderBy("no")
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"))
    of = parts.view.select("symbol", "anchor_id", "confirm", "atr", F.lead("confirm").over(w).alias("next_confirm")).join(size, "symbol")
    of = of.filter((F.col("confirm") >= 29) & (F.col("confirm") + 21 < F.col("n")))
    met = met.join(of, ["symbol", "anchor_id"]).withColumn("pos", (F.col("confirm") + F.col("start_bar")).cast("int"))
    met = met.filter((F.col("pos") < F.coalesce("next_confirm", "n")) & (F.col("pos") + 20 < F.col("n")))
    ahead = ordered().rowsBetween(1, 20)
    b = bars.select("symbol", "pos", "close", F.max("high").over(ahead).alias("top"), F.min("low").over(ahead).alias("bottom"), *[(lead("close", h) / F.col("close") - 1).alias(f"r{h}") for h in RETURNS])
    sign = F.when(F.col("direction") == "up", 1).otherwise(-1)
    up, down = F.col("top") - F.col("close"), F.col("close") - F.col("bottom")
    gain, loss = F.when(sign > 0, up).otherwise(down), F.when(sign > 0, down).otherwise(up)
    in_atr = lambda x: F.round(F.greatest(F.lit(0.0), x) / F.col("atr"), 3)
    return met.join(b, ["symbol", "pos"]).select(
        "symbol", "anchor_id", "direction", "pos", "angle", "center", "mid", F.col("raw_score").alias("raw_score"), "score", (gain >= F.col("atr")).alias("target_hit"), (loss >= F.col("atr")).alias("invalidated"),
        *[F.round(F.col(f"r{h}") * sign, 6).alias(f"return_{h}") for h in RETURNS], *[(F.col(f"r{h}") * sign > 0).alias(f"correct_{h}") for h in RETURNS], in_atr(gain).alias("mfe_atr"), in_atr(loss).alias("mae_atr"),
    )


def confluence_study(events: DataFrame) -> DataFrame:
    """Per symbol and bucket of raw score (60, 70, 80 and 90 upwards; ``80+`` for all from 80): hits, invalidations, moves, accuracies and returns.

    ``monotonic`` tells whether the accuracy after five bars never falls from one of a symbol's four buckets to the next.
    """
    s = F.col("raw_score")
    own = F.when(s >= 90, "90+").when(s >= 80, "80~90").when(s >= 70, "70~80").otherwise("60~70")
    x = events.withColumn("bucket", F.explode(F.filter(F.array(own, F.when(s >= 80, "80+")), lambda k: k.isNotNull())))
    rate = lambda c: F.round(F.avg(c.cast("double")) * 100, 1)
    g = x.groupBy("symbol", "bucket").agg(
        F.count(F.lit(1)).alias("samples"), rate(F.col("target_hit")).alias("target_hit_rate"), rate(F.col("invalidated")).alias("invalidation_rate"),
        F.round(F.percentile("mfe_atr", 0.5), 3).alias("median_mfe_atr"), F.round(F.percentile("mae_atr", 0.5), 3).alias("median_mae_atr"),
        *[rate(F.col(f"return_{h}") > 0).alias(f"accuracy_{h}") for h in RETURNS], *[rate(F.col(f"correct_{h}")).alias(f"correct_{h}") for h in RETURNS],
        *[F.round(F.percentile(f"return_{h}", 0.5) * 100, 3).alias(f"median_return_{h}") for h in RETURNS],
    )
    # the bucket of all from 80 stands outside the order
    w = Window.partitionBy("symbol", F.col("bucket") == "80+").orderBy("bucket")
    rises = F.when(F.col("bucket") != "80+", F.coalesce(F.col("accuracy_5") >= F.lag("accuracy_5").over(w), F.lit(True)))
    return g.withColumn("__r", rises).withColumn("monotonic", F.min("__r").over(Window.partitionBy("symbol"))).drop("__r")


@dataclass(frozen=True)
class Stages:
    """Levels, zones, windows and meetings of the anchors in view, as tables: each is read several times."""

    levels: DataFrame
    zones: DataFrame
    windows: DataFrame
    met: DataFrame


def stages(bars: DataFrame, horizontal: DataFrame | None, conf: Config, higher: DataFrame | None, cap: int, parts: Parts) -> Stages:
    found = kept(price_levels(bars, horizontal, conf, parts))
    zones = kept(price_zones(found, conf))
    windows = kept(time_windows(bars, zones, higher, conf, cap, parts))
    return Stages(found, zones, windows, kept(ranked(windows, zones, higher, conf, parts)))


def scenarios(bars: DataFrame, horizontal: DataFrame | None = None, conf: Config = Config(), higher: DataFrame | None = None, horizon: int = 12, cap: int = CAP, parts: Parts | None = None, made: Stages | None = None) -> DataFrame:
    """Break and reject scenarios of each active anchor; confidences are a softmax of the two scores at temperature 12.

    The break aims at the first two of the (at most three) confluence zones of 65 or more beyond the 1x1 line, else at
    the best one beyond it, else at the nearest price level beyond it, else two ATR beyond it; the reject at the 1x2
    line. Both name the first two time windows of 55 or more, else the best one.
    """
    parts = parts or prepare(bars, conf)
    c = F.col
    lines = fan(bars, conf, horizon, parts).groupBy("symbol", "anchor_id", "direction", "score", "state").agg(F.max(F.when(c("angle") == "1x1", c("current_price"))).alias("one"), F.max(F.when(c("angle") == "1x2", c("current_price"))).alias("slow"))
    f = lines.join(parts.view.select("symbol", "anchor_id", "atr"), ["symbol", "anchor_id"]).withColumn("sign", F.when(c("direction") == "up", 1).otherwise(-1))
    slim = f.select("symbol", "anchor_id", "one", "sign")
    made = made or stages(bars, horizontal, conf, higher, cap, parts)
    found = made.levels
    beyond = lambda x: (c(x) - c("one")) * c("sign") > 0
    met = made.met.select("symbol", "anchor_id", "rank", "mid", "zone_low", "zone_high", c("score").alias("z"))
    met = met.join(slim, ["symbol", "anchor_id"]).filter(beyond("mid"))
    pair = F.struct("rank", F.array(F.round("zone_low", 6), F.round("zone_high", 6)).alias("zone"), "z")
    best = F.array_sort(F.collect_list(F.when(c("z") >= 65, pair)))
    met = met.groupBy("symbol", "anchor_id").agg(F.slice(best, 1, 3).alias("strong"), F.min_by(pair, "rank").alias("any"))
    level = found.join(slim, ["symbol", "anchor_id"]).filter(beyond("level")).groupBy("symbol", "anchor_id").agg(F.min_by("level", F.abs(c("level") - c("one"))).alias("level"))
    windows = made.windows
    w = F.struct("center", "start", "end", c("score"), "start_time", "center_time", "end_time")
    windows = windows.groupBy("symbol", "anchor_id").agg(F.slice(F.array_sort(F.collect_list(F.when(c("score") >= 55, w))), 1, 2).alias("shown"), F.max_by(w, F.struct("score", -c("center"))).alias("most"))
    g = f.join(met, ["symbol", "anchor_id"], "left").join(level, ["symbol", "anchor_id"], "left").join(windows, ["symbol", "anchor_id"], "left")
    around = lambda x: F.array(F.round(x - c("atr") * 0.25, 6), F.round(x + c("atr") * 0.25, 6))
    strong = F.coalesce(F.size("strong"), F.lit(0)) > 0
    target = F.when(strong, F.transform(F.slice("strong", 1, 2), lambda x: x["zone"])).when(c("any").isNotNull(), F.array(c("any.zone"))).otherwise(F.array(around(F.coalesce("level", c("one") + c("sign") * c("atr") * 2))))
    chosen = F.when(F.coalesce(F.size("shown"), F.lit(0)) > 0, c("shown")).when(c("most").isNotNull(), F.array("most")).otherwise(F.slice(F.array("most"), 1, 0))
    bonus = F.coalesce(F.array_max(F.transform("strong", lambda x: x["z"])), F.lit(0.0))
    go = c("score") * 0.45 + F.when(c("state") == "NEUTRAL", 12.0).otherwise(25.0) + bonus * 0.2
    stop = c("score") * 0.35 + F.when(c("state") == "NEUTRAL", 25.0).otherwise(15.0) + 15
    p = 1 / (1 + F.exp((stop - go) / 12))
    g = g.withColumns({"go": go, "stop": stop, "p": p, "windows": chosen})
    other = F.when(c("direction") == "up", "down").otherwise("up")

    def row(k: str, d: Column, s: Column, q: Column, zones: Column, invalid: str) -> Column:
        return F.struct(F.lit(k).alias("scenario"), d.alias("path"), F.round(s, 1).alias("scenario_score"), F.round(q, 4).alias("confidence"), F.round(q * decay(F.lit(horizon)), 4).alias("effective_confidence"),
                        c("one").alias("trigger"), c(invalid).alias("invalidation"), zones.alias("target_zones"))

    both = F.explode(F.array(row("break_1x1", c("direction"), c("go"), c("p"), target, "slow"), row("reject_1x1", other, c("stop"), 1 - c("p"), F.array(around(c("slow"))), "one")))
    return g.select("symbol", "anchor_id", both.alias("s"), "windows").select("symbol", "anchor_id", "s.*", "windows")


def flat(scen: DataFrame) -> DataFrame:
    """Scenarios with their (at most two) targets as columns and their windows' centres as text."""
    zone = lambda i, j: F.get(F.get("target_zones", F.lit(i)), F.lit(j))
    keep = [c for c in scen.columns if c not in ("target_zones", "windows")]
    centers = F.array_join(F.transform("windows", lambda w: w["center"].cast("string")), ",")
    return scen.select(*keep, zone(0, 0).alias("target_low"), zone(0, 1).alias("target_high"), zone(1, 0).alias("second_low"), zone(1, 1).alias("second_high"), F.coalesce(centers, F.lit("")).alias("window_centers"))


def projection(bars: DataFrame, horizontal: DataFrame | None = None, conf: Config = Config(), higher: DataFrame | None = None, horizon: int = 12, cap: int = CAP, parts: Parts | None = None) -> DataFrame:
    """One row per active anchor: its state, what its structure scores, and its main scenario with target, first window and best meeting.

    The structural fit is the mean of five parts: the anchor's score, its state (85 if strong, 50 if neutral, else 70), the best window,
    the best meeting (0 without one), and 80 or 50 for a higher timeframe that goes its way or not.
    """
    parts = parts or prepare(bars, conf)
    made = stages(bars, horizontal, conf, higher, cap, parts)
    c = F.col
    at = ["symbol", "anchor_id"]
    view = with_higher(parts.view.select(*at, "direction", "price", "atr", "position", "confirm", "score"), higher).withColumn("price_unit", F.round(unit(conf), 8))
    state = fan(bars, conf, horizon, parts).groupBy(*at).agg(F.first("state").alias("state"))
    window = made.windows.groupBy(*at).agg(F.max("score").alias("time_cycle"))
    met = made.met.groupBy(*at).agg(F.max("score").alias("confluence"), F.min_by(F.struct("angle", "center", "mid", "score"), "rank").alias("top"))
    main = scenarios(bars, horizontal, conf, higher, horizon, cap, parts, made).filter("scenario = 'break_1x1'")
    main = main.select(*at, "path", "confidence", "trigger", "invalidation", F.element_at("target_zones", 1).alias("target"), F.get("windows", F.lit(0)).alias("window"))
    out = view.join(state, at).join(window, at, "left").join(met, at, "left").join(main, at)
    shape = F.when(c("state").startswith("STRONG"), 85.0).when(c("state") == "NEUTRAL", 50.0).otherwise(70.0)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    fit = {"anchor_quality": F.round("score", 1), "angle_state": shape, "time_cycle": zero("time_cycle"), "confluence": zero("confluence"), "higher_timeframe": F.when(c("aligned"), 80.0).otherwise(50.0)}
    out = out.withColumns(fit)
    total = c("anchor_quality") + c("angle_state") + c("time_cycle") + c("confluence") + c("higher_timeframe")
    return out.select(
        *at, "direction", "position", "confirm", "score", F.round("price", 6).alias("price"), F.round("atr", 6).alias("atr"), "price_unit", "state", *fit, F.round(total / 5 / 100, 3).alias("structural_fit"), "path", "confidence", "trigger", "invalidation",
        c("target")[0].alias("target_low"), c("target")[1].alias("target_high"), c("window.center").alias("window_center"), c("window.center_time").alias("window_time"), c("top.angle").alias("top_angle"), c("top.mid").alias("top_mid"),
    )


def analysis(projections: DataFrame, conf: Config = Config()) -> DataFrame:
    """The best anchor's projection per symbol (by score, then the later confirmation), how far the next one is behind, and whether that leaves the reading open.

    ``ambiguous``: another anchor is less than 8 points behind; without another the gap is 100. ``low_confidence``: the anchor scores under the least.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("score"), F.desc("confirm"))
    gap = F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(100.0))
    out = projections.withColumns({"__n": F.row_number().over(w), "score_gap": F.round(gap, 1), "alternatives": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "ambiguous": gap < 8, "low_confidence": F.col("score") < conf.least_score})
    return out.filter("__n = 1").drop("__n")


def higher_timeframe(weekly: DataFrame, conf: Config = Config()) -> DataFrame:
    """Direction and score of the best active anchor on completed weekly bars with indicators, for symbols of 25 weeks or more."""
    n = weekly.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 25")
    a = active(weekly.join(n, "symbol", "left_semi"), conf)
    return a.groupBy("symbol").agg(F.max_by("direction", F.struct("score", "confirm")).alias("direction"), F.max("score").alias("score"))


def angle_events(bars: DataFrame, conf: Config = Config(), found: DataFrame | None = None) -> DataFrame:
    """Crossings and rejections of an anchor's lines while it lives, with what the next 20 bars brought in its direction."""
    life = lifecycles(bars, conf, found).select("symbol", "no", "anchor_id", "direction", "price", "atr", "position", "confirm", F.col("score").alias("anchor_score"), "next_confirm")
    ahead = ordered().rowsBetween(1, 20)
    b = bars.withColumns({f"r{h}": lead("close", h) / F.col("close") - 1 for h in RETURNS} | {"close0": lag("close"), "top": F.max("high").over(ahead), "bottom": F.min("low").over(ahead), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    b = b.select("symbol", "pos", "datetime", "high", "low", "close", "close0", "top", "bottom", "n", *[f"r{h}" for h in RETURNS])
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("last"))
    x = alive(life.join(n, "symbol"), F.least(F.coalesce("next_confirm", "last"), F.col("last") - max(RETURNS))).join(b, ["symbol", "pos"])
    sign, here, before = F.when(F.col("direction") == "up", 1).otherwise(-1), F.col("pos"), F.col("pos") - 1
    x = x.withColumns({"l1": line(1.0, here, conf), "p1": line(1.0, before, conf), "l2": line(0.5, here, conf), "p2": line(0.5, before, conf)})
    x = x.withColumns({"s": (F.col("close") - F.col("l1")) * sign, "s0": (F.col("close0") - F.col("p1")) * sign, "q": (F.col("close") - F.col("l2")) * sign, "q0": (F.col("close0") - F.col("p2")) * sign})
    touched = (F.col("low") <= F.col("l1") + F.col("atr") * 0.15) & (F.col("high") >= F.col("l1") - F.col("atr") * 0.15)
    event = (
        F.when((F.col("s0") < 0) & (F.col("s") >= 0), "reclaim_1x1").when((F.col("s0") >= 0) & (F.col("s") < 0), "break_1x1").when((F.col("q0") >= 0) & (F.col("q") < 0), "break_1x2")
        .when(touched & (F.col("s") < 0) & (F.col("s0") < 0), "reject_1x1")
    )
    x = x.withColumn("event", event).filter("event is not null")
    way = F.when(F.col("event") == "reclaim_1x1", sign).otherwise(-sign)
    up, down = F.greatest(F.col("top") - F.col("close"), F.lit(0.0)) / F.col("atr"), F.greatest(F.col("close") - F.col("bottom"), F.lit(0.0)) / F.col("atr")
    return x.select("symbol", "anchor_id", "anchor_score", "event", "pos", "datetime", F.when(way > 0, "up").otherwise("down").alias("direction"), *[F.round(F.col(f"r{h}") * way, 6).alias(f"return_{h}") for h in RETURNS],
                    F.round(F.when(way > 0, up).otherwise(down), 3).alias("mfe_atr"), F.round(F.when(way > 0, down).otherwise(up), 3).alias("mae_atr"))


def event_summary(events: DataFrame, keys: tuple[str, ...] = ("symbol", "event")) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), *[F.round(F.avg((F.col(f"return_{h}") > 0).cast("double")) * 100, 1).alias(f"accuracy_{h}") for h in RETURNS],
        *[F.round(F.percentile(f"return_{h}", 0.5) * 100, 3).alias(f"median_{h}") for h in RETURNS], F.round(F.percentile("mfe_atr", 0.5), 3).alias("median_mfe_atr"), F.round(F.percentile("mae_atr", 0.5), 3).alias("median_mae_atr"),
    )


def walk_forward(events: DataFrame) -> DataFrame:
    """Events in order, 60 / 20 / 20 percent, each part's accuracy after five bars."""
    w = Window.partitionBy("symbol").orderBy("pos", "anchor_id")
    x = events.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    part = F.when(F.col("i") < F.floor(F.col("n") * 0.6), "train").when(F.col("i") < F.floor(F.col("n") * 0.8), "validation").otherwise("test")
    return x.withColumn("part", part).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg((F.col("return_5") > 0).cast("double")) * 100, 1).alias("accuracy_5"))


def score_buckets(events: DataFrame) -> DataFrame:
    """Accuracy after five bars by anchor score (low, medium, high) and whether it never falls from one to the next."""
    b = F.when(F.col("anchor_score") < 50, 0).when(F.col("anchor_score") < 70, 1).otherwise(2)
    g = events.withColumn("bucket", b).groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg((F.col("return_5") > 0).cast("double")) * 100, 1).alias("accuracy_5"))
    w = Window.partitionBy("symbol").orderBy("bucket")
    rises = F.coalesce(F.col("accuracy_5") >= F.lag("accuracy_5").over(w), F.lit(True))
    return g.withColumn("__r", rises).withColumn("monotonic", F.min("__r").over(Window.partitionBy("symbol"))).drop("__r")


def survival(bars: DataFrame, conf: Config = Config()) -> DataFrame:
    """Share of replaced anchors never breached before their successor, and revisions per bar."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    g = lifecycles(bars, conf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("anchors"), F.avg(F.when(F.col("next_confirm").isNotNull(), F.col("breached_at").isNull().cast("double"))).alias("survival")
    )
    return g.join(n, "symbol").select("symbol", "anchors", F.round("survival", 6).alias("survival"), F.round(F.greatest(F.col("anchors") - 2, F.lit(0)) / F.col("bars"), 6).alias("revision_frequency"))


def window_study(bars: DataFrame, conf: Config = Config(), found: DataFrame | None = None) -> DataFrame:
    """One bar per pivot, the base cycle of the swings visible then after it, against as many other bars spread evenly.

    Rates of local extremes (2 bars on both sides), of ranges that widen by a quarter over the 10 bars before, and of
    closes beyond those bars' extremes within 4 bars; ``edge`` is the windows' rate of turns less the baseline's.
    """
    p = pivots(bars, conf) if found is None else found
    by = Window.partitionBy("symbol").orderBy("no")
    long = p.filter("duration >= 2").select("symbol", "no", F.collect_list("duration").over(by.rowsBetween(1 - conf.cycles, 0)).alias("d"))
    p = p.join(long, ["symbol", "no"], "left").withColumns({"d": F.last("d", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("no").over(by)})
    s, n = F.array_sort("d"), F.size("d")
    median = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    three = F.array(F.element_at("d", -1), F.coalesce(F.try_element_at("d", F.lit(-2)), F.element_at("d", -1)), F.bround(median).cast("int"))
    cycle = F.element_at(F.array_distinct(F.transform(three, lambda x: F.greatest(x, F.lit(2)))), -1)
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = p.filter("next is not null and d is not null").select("symbol", "confirm", (F.col("position") + cycle).alias("pos")).join(size, "symbol")
    at = at.filter((F.col("pos") >= F.col("confirm")) & (F.col("pos") < F.col("n") - 2)).select("symbol", "pos").distinct()

    near, before, ahead = ordered().rowsBetween(-2, 2), ordered().rowsBetween(-10, -1), ordered().rowsBetween(0, 3)
    span = F.col("high") - F.col("low")
    high, low = F.col("high") >= F.max("high").over(near), F.col("low") <= F.min("low").over(near)
    room = (F.col("pos") >= 10) & (F.col("pos") + 3 < F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    flags = bars.withColumns({
        "high_": high, "low_": low, "turn": high | low, "wide": room & (F.avg(span).over(ahead) > F.percentile(span, 0.5).over(before) * 1.25),
        "out": room & ((F.max("close").over(ahead) > F.max("high").over(before)) | (F.min("close").over(ahead) < F.min("low").over(before))),
    })
    names = ("turn", "wide", "out", "high_", "low_")
    flags = flags.join(size, "symbol").filter((F.col("pos") >= 2) & (F.col("pos") < F.col("n") - 2)).select("symbol", "pos", *[F.coalesce(F.col(k), F.lit(False)).cast("double").alias(k) for k in names])
    hit = flags.join(at, ["symbol", "pos"], "left_semi")
    rest = flags.join(at, ["symbol", "pos"], "left_anti").withColumns({"i": F.row_number().over(Window.partitionBy("symbol").orderBy("pos")) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    sizes = at.groupBy("symbol").agg(F.count(F.lit(1)).alias("k"))
    take = sizes.join(rest.select("symbol", "m").distinct(), "symbol").withColumn("k", F.least("k", "m"))
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    take = take.select("symbol", "k", "m", j.alias("j")).select("symbol", F.when((F.col("j") == F.col("k") - 1) & (F.col("k") > 1), F.col("m") - 1).otherwise(F.floor(F.col("j") * ((F.col("m") - 1) / F.greatest(F.col("k") - 1, F.lit(1))))).alias("i"))
    base = rest.join(take, ["symbol", "i"])
    rate = lambda df, pre: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(f"{pre}samples"), *[F.avg(k).alias(f"{pre}{k.strip('_')}_rate") for k in names])
    out = rate(hit, "").join(rate(base, "baseline_"), "symbol", "left").withColumn("edge", F.round((F.col("turn_rate") - F.col("baseline_turn_rate")) * 100, 1))
    return out.withColumns({c: F.round(F.col(c) * 100, 1) for c in out.columns if c.endswith("_rate")})


def calibrate(bars: DataFrame, multipliers: tuple[float, ...] = (0.125, 0.25, 0.5)) -> DataFrame:
    """Per symbol of 90 bars or more: the multiplier with the best accuracy after five bars, then most events, then first in order, on the
    60 to 80 percent part of the bars; its figures on the first 60 percent, and on the last 20 percent, which no choice has seen.

    Each part is a series of its own, so that no event looks over its end. Pivots don't depend on the multiplier.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    b = bars.withColumn("__n", n).filter("__n >= 90")
    a, z = F.floor(F.col("__n") * 0.6), F.floor(F.col("__n") * 0.8)
    b = b.withColumn("__part", F.when(F.col("pos") < a, "train").when(F.col("pos") < z, "validation").otherwise("test"))
    first = F.when(F.col("__part") == "train", 0).when(F.col("__part") == "validation", a).otherwise(z)
    b = b.withColumns({"pos": (F.col("pos") - first).cast("int"), "symbol": F.concat_ws("\x1f", "symbol", "__part")}).drop("__n", "__part")
    found = kept(pivots(b))
    out = None
    for i, m in enumerate(multipliers):
        e = angle_events(b, Config(atr_multiplier=m), found).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("return_5") > 0).cast("double")) * 100, 1).alias("acc"))
        e = e.withColumns({"i": F.lit(i), "atr_multiplier": F.lit(m)})
        out = e if out is None else out.union(e)
    cut = F.split("symbol", "\x1f")
    out = out.select(F.element_at(cut, 1).alias("symbol"), F.element_at(cut, 2).alias("part"), "i", "atr_multiplier", "n", "acc")
    of = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    g = out.groupBy("symbol", "i", "atr_multiplier").agg(*[of(p, c).alias(f"{p}_{k}") for p in ("train", "validation", "test") for c, k in (("n", "samples"), ("acc", "accuracy"))])
    counts = [f"{p}_samples" for p in ("train", "validation", "test")]
    g = g.filter("validation_accuracy is not null").fillna(0, counts)
    best = F.max_by(F.struct(*[c for c in g.columns if c not in ("symbol", "i")]), F.struct("validation_accuracy", "validation_samples", -F.col("i")))
    return g.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*").withColumn("calibrated", F.col("test_samples") >= 30)


def snapshots(scen: DataFrame) -> DataFrame:
    """Immutable rows: an id from symbol and anchor, a fingerprint of the content; to be stored insert-only."""
    g = scen.groupBy("symbol", "anchor_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("scenario", "path", "scenario_score", "confidence", "trigger", "invalidation", "target_zones", "windows")))).alias("payload"))
    return g.withColumns({"snapshot_id": F.substring(F.sha2(F.concat_ws(":", "symbol", "anchor_id"), 256), 1, 32), "fingerprint": F.sha2("payload", 256)})


def context(scen: DataFrame, decisions: DataFrame) -> DataFrame:
    """Whether the likelier scenario supports each symbol's current decision; unclear where the two are within 0.08."""
    w = Window.partitionBy("symbol").orderBy(F.desc("confidence"), "anchor_id")
    top = scen.withColumns({"__n": F.row_number().over(w), "gap": F.col("confidence") - F.lead("confidence").over(w)}).filter("__n = 1")
    wants = F.when(F.col("status").isin("long_trigger", "active_after_trigger", "watch"), "up").when(F.col("status") == "exit_trigger", "down")
    verdict = F.when(F.col("path").isNull() | wants.isNull(), "neutral").when(F.coalesce(F.col("gap"), F.lit(1.0)) < 0.08, "ambiguous").when(F.col("path") == wants, "supportive").otherwise("conflicting")
    return decisions.join(top.select("symbol", "path", "confidence", "gap"), "symbol", "left").select("symbol", "status", "path", "confidence", verdict.alias("context"))


