"""The same pipeline in DuckDB SQL: bars, indicators (one recursive pass), factors, regime, setups, signals.

Each step is a list of common table expressions; ``upto`` joins those that a query needs.
"""

from __future__ import annotations

from tapeworks.operators.factors import FACTORS

BARS = """bars as (
    select *, cast(row_number() over (partition by symbol order by datetime) - 1 as integer) as pos from (
        select event_type as symbol, time_bucket(interval 1 hour, ts) as datetime, arg_min(value, (ts, event_id)) as open, max(value) as high,
               min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume, sum(value) as amount
        from events where ts is not null and value is not null group by 1, 2)
)"""

BASE = """base as (
    select *, lag(close) over w as c0, lag(high) over w as h0, lag(low) over w as l0,
           max(high) over (w rows 8 preceding) as top9, min(low) over (w rows 8 preceding) as low9
    from bars window w as (partition by symbol order by datetime)
), step as (
    select *, coalesce(greatest(high - low, abs(high - c0), abs(low - c0)), high - low) as tr, close - c0 as ch,
           case when high - h0 > l0 - low and high - h0 > 0 then high - h0 else 0.0 end as pdm,
           case when l0 - low > high - h0 and l0 - low > 0 then l0 - low else 0.0 end as mdm,
           case when top9 = low9 then 50.0 else (close - low9) / (top9 - low9) * 100 end as rsv from base
)"""


def _rec() -> str:
    """One recursive pass that carries the state of every recursive indicator."""
    first, nxt = [], []
    for n in (6, 12, 24):
        first += [f"cast(null as double) as u{n}", f"cast(null as double) as d{n}"]
        for x, v in (("u", "greatest(b.ch, 0.0)"), ("d", "greatest(-b.ch, 0.0)")):
            nxt.append(f"case when b.pos = 1 then {v} else r.{x}{n} + ({v} - r.{x}{n}) / {n}.0 end")
    e12, e26 = "r.e12 + (b.close - r.e12) * (2.0 / 13)", "r.e26 + (b.close - r.e26) * (2.0 / 27)"
    dif = f"(({e12}) - ({e26}))"
    k = "r.k + (b.rsv - r.k) / 3.0"
    atr, p, m = "r.atr + (b.tr - r.atr) / 14.0", "r.p + (b.pdm - r.p) / 14.0", "r.m + (b.mdm - r.m) / 14.0"
    dx = f"(case when b.pos >= 13 and ({atr}) <> 0 and ({p}) + ({m}) <> 0 then 100 * abs(100 * ({p}) / ({atr}) - 100 * ({m}) / ({atr})) / (100 * ({p}) / ({atr}) + 100 * ({m}) / ({atr})) end)"
    return f"""rec as (
    select symbol, pos, close as e12, close as e26, cast(null as double) as dea, 50.0::double as k, 50.0::double as d, tr as atr, pdm as p, mdm as m,
           cast(null as double) as adx, 1.0::double as wt, 0 as seen, {', '.join(first)} from step where pos = 0
    union all
    select b.symbol, b.pos, {e12}, {e26}, case when b.pos = 25 then {dif} when b.pos > 25 then r.dea + ({dif} - r.dea) * 0.2 end,
           case when b.pos >= 8 then {k} else 50.0 end, case when b.pos >= 8 then r.d + (({k}) - r.d) / 3.0 else 50.0 end, {atr}, {p}, {m},
           case when {dx} is null then r.adx when r.seen = 0 then {dx} else (r.wt * r.adx + {dx} / 14) / (r.wt + 1.0 / 14) end,
           case when {dx} is null then (case when r.seen > 0 then r.wt * (1 - 1.0 / 14) else r.wt end) else 1 - 1.0 / 14 end, r.seen + case when {dx} is null then 0 else 1 end,
           {', '.join(nxt)}
    from rec r join step b on b.symbol = r.symbol and b.pos = r.pos + 1
)"""


def gate(n: int, agg: str, c: str, ago: int = 0) -> str:
    frame = f"(w rows between {n - 1 + ago} preceding and {'current row' if not ago else f'{ago} preceding'})"
    return f"case when count({c}) over {frame} = {n} then {agg}({c}) over {frame} end"


IND = f"""ind as (
    select b.symbol, b.datetime, b.open, b.high, b.low, b.close, b.volume, b.amount, b.pos, case when b.pos >= 25 then r.e12 - r.e26 end as DIF, case when b.pos >= 33 then r.dea end as DEA,
           case when b.pos >= 33 then 2 * (r.e12 - r.e26 - r.dea) end as MACD,
           {', '.join(f"case when b.pos >= {n} then case when r.d{n} = 0 then case when r.u{n} > 0 then 100.0 else 50.0 end else 100 - 100 / (1 + r.u{n} / r.d{n}) end end as RSI{n}" for n in (6, 12, 24))},
           case when b.pos >= 8 then r.k end as K, case when b.pos >= 8 then r.d end as D, case when b.pos >= 8 then 3 * r.k - 2 * r.d end as J,
           case when b.pos >= 13 then r.atr end as ATR14, case when b.pos >= 13 and r.atr <> 0 then 100 * r.p / r.atr end as PLUS_DI14,
           case when b.pos >= 13 and r.atr <> 0 then 100 * r.m / r.atr end as MINUS_DI14, case when r.seen >= 14 then r.adx end as ADX14,
           {', '.join(f"{gate(n, 'avg', 'b.close')} as MA{n}" for n in (5, 10, 20, 60, 120, 250))}, {gate(5, 'avg', 'b.volume')} as VOL_MA5, {gate(10, 'avg', 'b.volume')} as VOL_MA10,
           {gate(20, 'stddev_samp', 'b.close')} as sd20, b.volume / nullif({gate(5, 'avg', 'b.volume', 1)}, 0) as VOL_RATIO, b.tr as TR,
           sum(coalesce(sign(b.ch) * coalesce(b.volume, 0), 0)) over (w rows unbounded preceding) as OBV
    from rec r join step b on b.symbol = r.symbol and b.pos = r.pos window w as (partition by b.symbol order by b.pos)
), enriched as (
    select * exclude (sd20), MA20 as BOLL_MID, MA20 + 2 * sd20 as BOLL_UPPER, MA20 - 2 * sd20 as BOLL_LOWER, ATR14 * 100 / nullif(close, 0) as ATR14_PCT from ind
)"""


def swing_sql(c: str, agg: str, width: int = 4) -> str:
    w = f"(partition by symbol order by pos rows between {width} preceding and {width} following)"
    return f"(count({c}) over {w} = {2 * width + 1} and {c} = {agg}({c}) over {w} and len(list_filter(list({c}) over {w}, lambda v: v = {c})) = 1)"


def _share(c: str) -> str:
    w = "(partition by symbol order by pos rows 249 preceding)"
    return f"case when count({c}) over {w} >= 20 then case when {c} is null then 0.0 else len(list_filter(list({c}) over {w}, lambda v: v <= {c})) / count(*) over {w} end end"


def _drawdown(n: int) -> str:
    w = f"(partition by symbol order by pos rows {n - 1} preceding)"
    # every fall within the window: a value against the highest at or before it
    return f"case when count(close) over {w} = {n} then least(0.0, list_min(list_transform(range(1, {n + 1}), lambda i: (list(close) over {w})[i] / list_max((list(close) over {w})[1:i]) - 1))) end"


def _factors() -> str:
    n0 = lambda c: f"nullif({c}, 0)"
    lag = lambda c, k: f"lag({c}, {k}) over w"
    f = {f"close_vs_ma{n}_atr": f"(close - MA{n}) / {n0('ATR14')}" for n in (20, 60, 120)}
    f |= {f"ma{n}_slope_{k}": f"MA{n} / nullif({lag(f'MA{n}', k)}, 0) - 1" for n, k in ((20, 5), (60, 5), (120, 10))}
    f |= {f"ma{a}_ma{b}_spread_atr": f"(MA{a} - MA{b}) / {n0('ATR14')}" for a, b in ((20, 60), (60, 120))}
    f |= {f"return_{n}": f"close / nullif({lag('close', n)}, 0) - 1" for n in (5, 20, 60, 120)}
    f |= {f"rsi{n}": f"RSI{n}" for n in (6, 12, 24)} | {"rsi12_delta_3": f"RSI12 - {lag('RSI12', 3)}"}
    f |= {"macd_dif": "DIF", "macd_dea": "DEA", "macd_hist": "MACD", "macd_hist_delta_3": f"MACD - {lag('MACD', 3)}", "price_momentum_20": f"close / nullif({lag('close', 20)}, 0) - 1"}
    f |= {f"volume_ratio_{n}": f"volume / nullif({gate(n, 'avg', 'volume', 1)}, 0)" for n in (5, 20)}
    total = gate(20, "sum", "volume")
    f |= {f"{d}_volume_ratio_20": f"{gate(20, 'sum', d + 'v')} / nullif({total}, 0)" for d in ("up", "down")}
    f |= {"breakout_volume_ratio": f"volume / nullif({gate(20, 'avg', 'volume', 1)}, 0)", "atr_pct": f"ATR14 / {n0('close')}", "boll_width": f"(BOLL_UPPER - BOLL_LOWER) / {n0('BOLL_MID')}"}
    f |= {f"max_drawdown_{n}": _drawdown(n) for n in (20, 60)}
    f |= {f"distance_{n}d_high": f"(close - {gate(n, 'max', 'high')}) / {n0('ATR14')}" for n in (20, 60, 120)}
    f |= {f"{a}_count_20": gate(20, "sum", x) for a, x in (("higher_high", "hh"), ("higher_low", "hl"), ("lower_high", "lh"), ("lower_low", "ll"))}
    first = ", ".join(f"{v} as {k}" for k, v in f.items())
    near = lambda l, s: f"len(list_filter({l}, lambda v: abs(v - {s}) <= greatest(close * 0.008, ATR14 * 0.5)))"
    return f"""marked as (
    select *, {swing_sql('high', 'max')} as sh, {swing_sql('low', 'min')} as sl, close - {lag('close', 1)} as chg,
           coalesce(case when close > {lag('close', 1)} then volume end, 0.0) as upv, coalesce(case when close < {lag('close', 1)} then volume end, 0.0) as downv,
           coalesce(cast(high > {lag('high', 1)} as double), 0) as hh, coalesce(cast(low > {lag('low', 1)} as double), 0) as hl,
           coalesce(cast(high < {lag('high', 1)} as double), 0) as lh, coalesce(cast(low < {lag('low', 1)} as double), 0) as ll, ln(close / {lag('close', 1)}) as lr
    from enriched window w as (partition by symbol order by pos)
), told as (
    select *, case when lag(sh, 4) over w then lag(high, 4) over w end as nh, case when lag(sl, 4) over w then lag(low, 4) over w end as nl
    from marked window w as (partition by symbol order by pos)
), known as (
    select *, coalesce(list(nh) filter (where nh is not null) over (w rows unbounded preceding), []) as hs, coalesce(list(nl) filter (where nl is not null) over (w rows unbounded preceding), []) as ls
    from told window w as (partition by symbol order by pos)
), f1 as (
    select *, list_max(list_filter(ls, lambda v: v < close)) as sup, list_min(list_filter(hs, lambda v: v > close)) as res, {first},
           {gate(20, 'stddev_samp', 'lr')} * sqrt(252) as realized_volatility_20
    from known window w as (partition by symbol order by pos)
), factored as (
    select * exclude (sh, sl, chg, upv, downv, hh, hl, lh, ll, lr, nh, nl, hs, ls, sup, res),
           {_share('atr_pct')} as atr_percentile_250, {_share('boll_width')} as boll_width_percentile_250,
           case when ATR14 > 0 then (close - sup) / ATR14 end as distance_to_support_atr, case when ATR14 > 0 then (res - close) / ATR14 end as distance_to_resistance_atr,
           case when ATR14 > 0 and sup is not null then cast({near('ls', 'sup')} as double) end as nearest_support_strength,
           case when ATR14 > 0 and res is not null then cast({near('hs', 'res')} as double) end as nearest_resistance_strength
    from f1
)"""


def _vote(*conds: str) -> str:
    return " + ".join(f"cast(coalesce({c}, false) as integer)" for c in conds)


UP20 = "coalesce(higher_high_count_20, 0) + coalesce(higher_low_count_20, 0)"
DOWN20 = "coalesce(lower_high_count_20, 0) + coalesce(lower_low_count_20, 0)"
REGIME = f"""voted as (
    select *, {_vote('close > MA20 and MA20 > MA60', 'MA60 > MA120', 'ma20_slope_5 > 0 and ma60_slope_5 > 0', f'{UP20} >= {DOWN20} + 4')} as up,
           {_vote('close < MA20 and MA20 < MA60', 'MA60 < MA120', 'ma20_slope_5 < 0 and ma60_slope_5 < 0', f'{DOWN20} >= {UP20} + 4')} as down from factored
), regimes as (
    select * exclude (up, down), case when pos < 59 then 'INSUFFICIENT_DATA' when atr_percentile_250 >= 0.85 then 'HIGH_VOLATILITY'
           when atr_percentile_250 <= 0.20 and boll_width_percentile_250 <= 0.25 then 'LOW_VOLATILITY' when up >= 2 and up > down then 'UPTREND' when down >= 2 and down > up then 'DOWNTREND' else 'RANGE' end as regime,
           round(case when pos < 59 then 0.0 when atr_percentile_250 >= 0.85 then least(1.0, 0.55 + (atr_percentile_250 - 0.85) * 3)
           when atr_percentile_250 <= 0.20 and boll_width_percentile_250 <= 0.25 then least(1.0, 0.55 + (0.20 - atr_percentile_250) + (0.25 - boll_width_percentile_250))
           when up >= 2 and up > down then least(0.95, 0.5 + up * 0.12) when down >= 2 and down > up then least(0.95, 0.5 + down * 0.12) else 0.55 + 0.05 * least(up, down) end, 3) as regime_confidence
    from voted
)"""

SETUPS = f"""ready as (
    select *, {gate(20, 'max', 'high', 1)} as top, {gate(20, 'min', 'low', 1)} as bottom, lag(high) over w as h1, lag(close) over w as c1, lag(MA20) over w as m1
    from regimes window w as (partition by symbol order by pos)
), s1 as (
    select *, coalesce(regime = 'UPTREND' and close > MA60 and MA20 > MA60 and ma20_slope_5 > 0
               and (coalesce(close_vs_ma20_atr between -0.35 and 0.85, false) or coalesce(distance_to_support_atr between 0 and 0.8, false))
               and volume_ratio_20 <= 1.05 and higher_low_count_20 >= lower_low_count_20 - 2, false) as trend_pullback,
           coalesce((top - close) / nullif(ATR14, 0) between -0.25 and 1.0 and boll_width_percentile_250 <= 0.45, false) as breakout,
           coalesce(regime in ('RANGE', 'UPTREND', 'LOW_VOLATILITY') and distance_to_support_atr between 0 and 0.75 and nearest_support_strength >= 1, false) as support_reversal,
           coalesce(regime in ('UPTREND', 'DOWNTREND', 'HIGH_VOLATILITY') and close < MA20 and (coalesce(MA20 <= MA60, false) or coalesce(ma20_slope_5 < 0, false)), false) as trend_breakdown
    from ready
), setups as (
    select * exclude (top, bottom, h1, c1, m1), trend_pullback and coalesce(close > h1, false) as trend_pullback_trigger,
           lag(breakout, 1, false) over (partition by symbol order by pos) and coalesce(close > top and breakout_volume_ratio >= 1.2 and macd_hist_delta_3 > 0, false) as breakout_trigger,
           support_reversal and coalesce(close > h1, false) and coalesce(close > open, false) and (coalesce(rsi12_delta_3 > 0, false) or coalesce(volume_ratio_20 >= 1.0, false)) as support_reversal_trigger,
           trend_breakdown and (coalesce(close < bottom, false) or coalesce(c1 < m1 and high >= MA20 and close < MA20, false)) as trend_breakdown_trigger
    from s1
)"""

NAMES = ("trend_pullback", "breakout", "support_reversal", "trend_breakdown")
SIGNALS = (
    "lives as ("
    + " union all ".join(f"select *, '{s}' as setup, {i} as setup_no, {s} or {s}_trigger as act, {s}_trigger as trig from setups" for i, s in enumerate(NAMES))
    + """), islands as (
    select *, sum(cast(not act as integer)) over (partition by symbol, setup order by pos rows unbounded preceding) as isle from lives
), nth as (
    select *, sum(cast(trig as integer)) over (partition by symbol, setup, isle order by pos rows unbounded preceding) as n from islands
), sig0 as (
    select *, setup <> 'trend_breakdown' as long, setup <> 'trend_breakdown' and coalesce(ATR14 > 0, false) as priced from nth where trig and n = 1
), sig1 as (
    select *, case when priced then coalesce(case when distance_to_support_atr >= 0 then close - distance_to_support_atr * ATR14 end - 0.25 * ATR14, close - 2 * ATR14) end as stop from sig0
), sig2 as (
    select *, case when priced then close - stop end as risk, case when priced and close - stop > 0 then (close + 1.5 * (close - stop) - close) / (close - stop) end as rr from sig1
), signals as (
    select *, least(100.0, greatest(0.0, 45.0
        + case when (setup = 'trend_pullback' and regime = 'UPTREND') or (setup = 'support_reversal' and regime in ('RANGE', 'UPTREND')) or (setup = 'breakout' and regime in ('UPTREND', 'LOW_VOLATILITY')) or (setup = 'trend_breakdown' and regime in ('DOWNTREND', 'HIGH_VOLATILITY')) then 15.0 else 0.0 end
        + case when coalesce(distance_to_support_atr between 0 and 0.75, false) then 8.0 else 0.0 end
        + case when coalesce(volume_ratio_20 >= case when setup = 'breakout' then 1.2 else 0.8 end, false) then 8.0 else 0.0 end
        + case when coalesce((setup = 'trend_breakdown' and macd_hist_delta_3 < 0) or macd_hist_delta_3 > 0, false) then 8.0 else 0.0 end
        + least(12.0, greatest(-8.0, (coalesce(rr, 0.0) - 1) * 6)))) as score from sig2
)"""
)

EXECUTION = """filled as (
    select s.*, b.pos as fill_pos, b.datetime as fill_date, b.ATR14 as fill_atr,
           case when b.pos is null then 'NO_NEXT_BAR' when b.open is null or b.open <= 0 then 'INVALID_PRICE' when b.volume <= 0 then 'SUSPENDED_OR_NO_VOLUME' end as reason,
           case when s.long then b.open * 1.0005 else b.open * 0.9995 end as fill_price, case when s.priced then round(s.stop, 6) end as stop_price
    from signals s left join enriched b on b.symbol = s.symbol and b.pos = s.pos + 1
), entries as (
    select *, case when stop_price < fill_price then stop_price else fill_price - 2 * fill_atr end as stop_at from filled where long and reason is null and coalesce(fill_atr > 0, false)
), aimed as (
    select symbol, pos, setup_no, setup, regime, datetime as signal_date, fill_pos, fill_date, fill_price, stop_at, fill_price + 2 * (fill_price - stop_at) as target_at from entries
), path as (
    select e.*, b.pos as at_pos, b.datetime as at_date, b.open as o, b.high as h, b.low as l, b.close as c, x.symbol is not null as ex,
           max(b.pos) over (partition by e.symbol, e.pos, e.setup_no) as last_at
    from aimed e join enriched b on b.symbol = e.symbol and b.pos between e.fill_pos + 1 and e.fill_pos + 20
    left join (select distinct symbol, fill_pos from filled where not long and fill_pos is not null) x on x.symbol = b.symbol and x.fill_pos = b.pos
), touched as (
    select *, case when ex then 'TREND_BREAKDOWN' when l <= stop_at and h >= target_at then 'STOP_AND_TARGET_SAME_BAR_CONSERVATIVE' when l <= stop_at then 'STOP' when h >= target_at then 'TARGET' when at_pos = last_at then 'TIME_BARRIER' end as why,
           case when ex then o when l <= stop_at then stop_at when h >= target_at then target_at else c end as raw_exit,
           (greatest(fill_price, max(case when ex then o else h end) over w) - fill_price) / (fill_price - stop_at) as mfe_r, (fill_price - least(fill_price, min(case when ex then o else l end) over w)) / (fill_price - stop_at) as mae_r
    from path window w as (partition by symbol, pos, setup_no order by at_pos rows unbounded preceding)
), exits as (
    select * from touched where why is not null qualify row_number() over (partition by symbol, pos, setup_no order by at_pos) = 1
), queue as (
    select *, row_number() over (partition by symbol order by pos, setup_no) as k from exits
), walk as (
    select symbol, k, true as taken, at_pos as busy from queue where k = 1
    union all
    select q.symbol, q.k, q.pos >= w.busy, case when q.pos >= w.busy then q.at_pos else w.busy end from walk w join queue q on q.symbol = w.symbol and q.k = w.k + 1
), trades as (
    select q.symbol, q.setup, q.regime, q.pos, q.signal_date, q.fill_date as entry_date, q.fill_price, q.stop_at, q.target_at, q.at_date as exit_date, q.raw_exit * 0.9995 as exit_at, q.why as exit_reason, q.mfe_r, q.mae_r, cast(q.at_pos - q.fill_pos as integer) as holding_bars,
           (q.raw_exit * 0.9995 - q.fill_price - q.fill_price * 0.0003 - q.raw_exit * 0.9995 * 0.0003) as net
    from queue q join walk w on w.symbol = q.symbol and w.k = q.k and w.taken
)"""

STEPS = {"bars": BARS, "enriched": f"{BASE}, {_rec()}, {IND}", "factored": _factors(), "regimes": REGIME, "setups": SETUPS, "signals": SIGNALS, "trades": EXECUTION}


def upto(step: str, select: str) -> str:
    parts = []
    for name, text in STEPS.items():
        parts.append(text)
        if name == step:
            break
    return f"with recursive {', '.join(parts)} {select}"


def r6(*cols: str) -> str:
    """Columns rounded to six places by floor(x + 1/2)."""
    return ", ".join(f"floor({c} * 1000000.0::double + 0.5) / 1000000.0::double as {c}" for c in cols)


__all__ = ["FACTORS", "NAMES", "STEPS", "gate", "r6", "swing_sql", "upto"]
