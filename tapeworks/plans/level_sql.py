"""DuckDB SQL of levels, score, decision and chart ranges, on top of the steps of ``sql``."""

from __future__ import annotations

from tapeworks.operators.levels import WEIGHTS
from tapeworks.plans.sql import NAMES, gate, r6, swing_sql, upto

NOW = """now as (select symbol, arg_max(close, pos) as close_now, arg_max(ATR14, pos) as atr_now, count(*) as n from enriched group by 1)"""

#: One row per swing, then the clusters: swings by price, each in the first cluster whose mean is within the band.
LEVELS = f""", {NOW}, typical as (select symbol, median(nullif(volume, 0)) as m from bars group by 1
), swing as (
    select s.symbol, s.kind, s.pos, s.price, least(3.0, greatest(0.25, coalesce(s.volume, 0) / case when t.m > 0 then t.m else 1.0 end)) as vw, n.n,
           greatest(n.close_now * 0.008::double, coalesce(n.atr_now * 0.5::double, 0)) as band, row_number() over (partition by s.symbol, s.kind order by s.price, s.pos) as i
    from (select symbol, 'high' as kind, pos, high as price, volume from marked where sh union all select symbol, 'low', pos, low, volume from marked where sl) s
    join typical t using (symbol) join now n using (symbol) where n.n >= 13
), fold as (
    select symbol, kind, i, [price] as sums, [1] as counts, 1::bigint as k from swing where i = 1
    union all
    select symbol, kind, i, case when k > len(sums) then list_append(sums, price) else list_transform(range(1, len(sums) + 1), lambda j: case when j = k then sums[j] + price else sums[j] end) end,
           case when k > len(sums) then list_append(counts, 1) else list_transform(range(1, len(sums) + 1), lambda j: case when j = k then counts[j] + 1 else counts[j] end) end, k
    from (select s.symbol, s.kind, s.i, s.price, f.sums, f.counts, coalesce(list_min(list_filter(range(1, len(f.sums) + 1), lambda j: abs(s.price - f.sums[j] / f.counts[j]) <= s.band)), len(f.sums) + 1) as k
          from fold f join swing s on s.symbol = f.symbol and s.kind = f.kind and s.i = f.i + 1)
), fresh as (
    select s.*, f.k, exp(-(s.n - 1 - s.pos) / greatest(s.n * 0.35::double, 1.0)) as age from swing s join fold f on f.symbol = s.symbol and f.kind = s.kind and f.i = s.i
), cluster as (
    select symbol, kind, count(*) as touches, max(pos) as last_touch_pos, any_value(band) as band,
           sum(price * greatest(age * (0.7::double + 0.3::double * vw), 0.01)) / sum(greatest(age * (0.7::double + 0.3::double * vw), 0.01)) as centre,
           0.7::double * count(*) + 0.25::double * sum(least(vw, 2.5)) + 0.55::double * sum(age) as raw from fresh group by symbol, kind, k
), level as (
    select symbol, kind, round(centre, 4) as price, round(centre - band / 2, 4) as lower, round(centre + band / 2, 4) as upper, cast(touches as integer) as touches, round(raw, 3) as score,
           case when touches >= 4 and raw >= 5 then 'high' when touches >= 2 and raw >= 2.7 then 'medium' else 'low' end as confidence, cast(last_touch_pos as integer) as last_touch_pos from cluster
), sided as (
    select l.*, n.close_now, case when kind = 'low' and price < close_now then 'support' when kind = 'high' and price > close_now then 'resistance' end as side
    from level l join now n using (symbol) where score >= 1.35
), near as (
    select * from (select *, cast(row_number() over (partition by symbol, side order by abs(price - close_now), price) as integer) as rank from sided where side is not null) where rank <= 3
)"""

LEVELS_TOPK = upto("factored", LEVELS + " select * from near")
FUTURES_LEVELS = upto("factored", LEVELS + " select * replace (case when confidence = 'high' then 'medium' else 'low' end as confidence) from near")
LEVEL_SCENARIO = upto("factored", LEVELS + """
    select s.symbol, s.close_now, s.lower as invalidation, s.upper as observation_lower, r.price as target, r.lower as observation_upper,
           round((r.price - s.close_now) / (s.close_now - s.lower), 2) as reward_risk_ratio
    from near s join near r on r.symbol = s.symbol and s.side = 'support' and r.side = 'resistance' and s.rank = 1 and r.rank = 1 where s.close_now > s.lower and r.price > s.close_now""")


def _turn(c: str, kind: str) -> str:
    agg = "max" if kind == "high" else "min"
    return swing_sql(c, agg, 3)


DIVERGENCE = f""", late as (select * from (select symbol, datetime, pos, high, low, RSI12, max(pos) over (partition by symbol) as n from enriched) where pos >= greatest(n - 29, 0)
), turns as (select *, {_turn('high', 'high')} as th, {_turn('low', 'low')} as tl from late
), pairs as (
    select symbol, count(*) as n, list(struct_pack(p := low, r := RSI12) order by pos desc) filter (where tl) as lo, list(struct_pack(p := high, r := RSI12) order by pos desc) filter (where th) as hi from turns group by 1
), div as (
    select symbol, case when n >= 20 then case when lo[1].p < lo[2].p * 0.995::double and lo[1].r > lo[2].r + 3 then 'bullish' when hi[1].p > hi[2].p * 1.005::double and hi[1].r < hi[2].r - 3 then 'bearish' end end as divergence from pairs
)"""
DIVERGENCE_SQL = upto("enriched", DIVERGENCE + " select symbol, divergence from div")


def _points(*cases: tuple[str, int]) -> str:
    return "50.0::double + " + " + ".join(f"case when {c} then {p} else 0 end" for c, p in cases)


def _score() -> str:
    slopes = ", ".join(f"case when count({c}) over (w rows 4 preceding) = 5 then ({c} - lag({c}, 4) over w) / nullif(abs(lag({c}, 4) over w), 0) * 100 end as s_{c}" for c in ("MA20", "MA60", "OBV"))
    h1, h0, l1, l0 = gate(10, "max", "high"), gate(10, "max", "high", 10), gate(10, "min", "low"), gate(10, "min", "low", 10)
    sides = [(f"close {o} {m}", p if o == ">" else -p) for o in "><" for m, p in (("MA20", 7), ("MA60", 7), ("MA120", 5))]
    trend = _points(*sides, ("MA20 > MA60 and MA60 > MA120", 8), ("MA20 < MA60 and MA60 < MA120", -8), ("s_MA20 > 0.3", 4), ("s_MA20 < -0.3", -4), ("s_MA60 > 0.3", 4), ("s_MA60 < -0.3", -4),
                    ("structure > 0", 6), ("structure < 0", -6))
    momentum = _points(("DIF > 0 and DEA is not null", 6), ("DIF < 0 and DEA is not null", -6), ("DIF > DEA", 7), ("DIF < DEA", -7), ("dif0 <= dea0 and DIF > DEA", 5), ("dif0 >= dea0 and DIF < DEA", -5),
                       ("m2 <= m1 and m1 <= MACD", 4), ("m2 >= m1 and m1 >= MACD and not coalesce(m2 <= m1 and m1 <= MACD, false)", -4), ("RSI12 >= 70", -4), ("RSI12 <= 30", 3),
                       ("RSI12 > 50 and RSI12 < 70", 4), ("RSI12 > 30 and RSI12 < 50", -3), ("divergence = 'bullish'", 6), ("divergence = 'bearish'", -6))
    volume = _points(("vr >= 1.5 and move > 0", 12), ("vr >= 1.5 and move < 0", -12), ("vr <= 0.65 and not coalesce(vr >= 1.5 and move <> 0, false)", -3), ("s_OBV > 1", 5), ("s_OBV < -1", -5))
    risk = _points(("ATR14_PCT <= 1.5", 8), ("ATR14_PCT > 3 and ATR14_PCT <= 5", -8), ("ATR14_PCT > 5", -15))
    clip = lambda x: f"least(100.0::double, greatest(0.0::double, {x}))"
    weigh = lambda i: "case score_regime " + " ".join(f"when '{k}' then {v[i]}::double" for k, v in WEIGHTS.items()) + " end"
    return upto("enriched", DIVERGENCE + f""", wide as (
        select *, {slopes}, case when {h1} > {h0} and {l1} > {l0} then 1 when {h1} < {h0} and {l1} < {l0} then -1 else 0 end as structure, lag(DIF) over w as dif0, lag(DEA) over w as dea0,
               lag(MACD) over w as m1, lag(MACD, 2) over w as m2, close - lag(close) over w as move, volume / nullif(nullif(VOL_MA5, 0) / 2 + nullif(VOL_MA10, 0) / 2, 0) as vr,
               case when ATR14_PCT is not null then len(list_filter(list(ATR14_PCT) over (w rows 119 preceding), lambda x: x <= ATR14_PCT)) / count(ATR14_PCT) over (w rows 119 preceding) * 100 end as share,
               count(*) over (partition by symbol) as n from enriched window w as (partition by symbol order by pos)
    ), parts as (
        select w.symbol, datetime, close, {clip(trend)} as trend, {clip(momentum)} as momentum, {clip(volume)} as volume_score, {clip(risk)} as risk,
               case when share >= 80 then 'high_volatility' when share <= 20 and (ADX14 is null or ADX14 < 22) then 'low_volatility' when ADX14 >= 23 and s_MA20 > 0 and close > MA60 then 'uptrend'
                    when ADX14 >= 23 and s_MA20 < 0 and close < MA60 then 'downtrend' else 'range' end as score_regime, divergence, n as bars
        from wide w left join div using (symbol) where pos = n - 1
    ), scored as (select *, case when bars >= 20 then round_even(trend * {weigh(0)} + momentum * {weigh(1)} + volume_score * {weigh(2)} + risk * {weigh(3)}, 0) end as score from parts)
    select *, case when bars < 20 then 'insufficient' when score >= 70 then 'strong' when score >= 58 then 'firm' when score >= 43 then 'neutral' when score >= 30 then 'soft' else 'weak' end as state from scored""")


TECHNICAL_SCORE = _score()


def _decision() -> str:
    has = lambda s: f"coalesce(list_contains(active, '{s}'), false)"
    live = ", ".join(f"case when {s} or {s}_trigger then '{s}' end" for s in NAMES)
    hit = " or ".join(f"{s}_trigger" for s in NAMES)
    prices = ", ".join(f"case when {has(k)} then {c} end" for k, c in (("trend_pullback", "before"), ("breakout", "top"), ("support_reversal", "before"), ("trend_breakdown", "bottom"), ("trend_breakdown", "MA20")))
    return upto("signals", f""", flagged as (
        select *, list_sort(list_filter([{live}], lambda x: x is not null)) as active, {hit} as hit, lag(high) over w as before, {gate(20, 'max', 'high', 1)} as top, {gate(20, 'min', 'low', 1)} as bottom
        from setups window w as (partition by symbol order by pos)
    ), final as (select * from flagged qualify pos = max(pos) over (partition by symbol)
    ), chosen as (
        select s.symbol, count(distinct s.long) > 1 as conflict, arg_max(struct_pack(setup := s.setup, long := s.long, score := round(s.score, 1)), (round(s.score, 1), -s.setup_no)) as best
        from signals s join final f on f.symbol = s.symbol and f.pos = s.pos group by 1
    ), state as (
        select f.*, case when not coalesce(c.conflict, false) then c.best end as best,
               case when c.conflict then 'conflict' when c.best.long then 'long_trigger' when not c.best.long then 'exit_trigger' when hit then 'active_after_trigger' when len(active) > 0 then 'watch' else 'no_setup' end as status,
               case when ATR14 > 0 and distance_to_support_atr >= 0 then close - distance_to_support_atr * ATR14 end as support, list_distinct(list_filter([{prices}], lambda x: x is not null)) as prices
        from final f left join chosen c using (symbol)
    ), out as (
        select symbol, datetime, regime, status, best.setup as setup, best.score as score, case when len(active) > 0 then array_to_string(active, ',') end as active_setups,
               case when status = 'watch' and len(prices) = 1 then prices[1] end as trigger_price, case when status = 'watch' and {has('support_reversal')} then support end as invalidation_price from state
    ) select symbol, datetime, regime, status, setup, active_setups, {r6('score', 'trigger_price', 'invalidation_price')} from out""")


DECISION = _decision()

CHART_RANGES = upto("bars", """, g as (
        select symbol, min(datetime) as x_from, max(datetime) as last_, quantile_cont(gap, 0.5) as gap, min(low) as lo, max(high) as hi, arg_max(close, datetime) as close
        from (select *, epoch_us(datetime) - lag(epoch_us(datetime)) over (partition by symbol order by pos) as gap, max(pos) over (partition by symbol) as n from bars) where pos > n - 300 group by 1)
    select symbol, x_from, make_timestamp(epoch_us(last_) + cast(trunc(greatest(gap * 24, (epoch_us(last_) - epoch_us(x_from)) * 0.15::double)) as bigint)) as x_until,
           lo - greatest((hi - lo) * 0.05::double, close * 0.005::double, 0.01) as y_from, hi + greatest((hi - lo) * 0.05::double, close * 0.005::double, 0.01) as y_until from g""")
