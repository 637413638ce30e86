"""DuckDB SQL of pivots, anchors, line events and the studies on them: one recursive pass over swings, then joins."""

from __future__ import annotations

from tapeworks.operators.gann import ANGLES, RETURNS
from tapeworks.plans.level_sql import LEVELS
from tapeworks.plans.sql import r6, upto


def rounded(x: str, places: int) -> str:
    """Half up on the shortest decimal form of a double, as Spark rounds."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 20)), {places}) as double)"


def _lone(c: str, agg: str) -> str:
    w = "(partition by symbol order by pos rows between 3 preceding and 3 following)"
    return f"(len(list({c}) over {w}) = 7 and {c} = {agg}({c}) over {w} and len(list_filter(list({c}) over {w}, lambda x: abs(x - {c}) <= 1e-8::double + 1e-5::double * abs({c}))) = 1)"


BARS = "select symbol, pos, datetime, high, low, close, volume, ATR14 from enriched"


def _pivots(source: str) -> str:
    return f""", gb as ({source}
), gm as (
    select *, {_lone('high', 'max')} as gh, {_lone('low', 'min')} as gl, lead(ATR14, 3) over (partition by symbol order by pos) as atr_c from gb
), graw as (
    select *, row_number() over (partition by symbol order by confirm, position, kind) as i from (
        select symbol, 'high' as kind, pos as position, pos + 3 as confirm, high as price, atr_c as atr from gm where gh and atr_c > 0
        union all select symbol, 'low', pos, pos + 3, low, atr_c from gm where gl and atr_c > 0)
), gfold as (
    select symbol, i, kind, position, confirm, price, atr, true as keep, 0.0::double as swing, 0 as duration, null::varchar as prev_kind, null::double as prev_price, null::integer as prev_position,
           null::double as opp_price, null::integer as opp_position, case when kind = 'high' then price end as hp, case when kind = 'high' then position end as hq,
           case when kind = 'low' then price end as lp, case when kind = 'low' then position end as lq, kind as lk from graw where i = 1
    union all
    select symbol, i, kind, position, confirm, price, atr, keep, swing, cast(position - bq as integer), bk, bp, bq, op, oq, case when keep and kind = 'high' then price else hp end, case when keep and kind = 'high' then position else hq end,
           case when keep and kind = 'low' then price else lp end, case when keep and kind = 'low' then position else lq end, case when keep then kind else lk end
    from (select *, position > last_q and (kind <> lk or (case when kind = 'high' then price > last_p else price < last_p end and abs(price - last_p) >= least_move)) and swing >= least_move as keep
    from (select *, abs(price - bp) as swing, greatest(atr, price * 0.01::double) as least_move
    from (select *, case when kind = lk then coalesce(op, last_p) else last_p end as bp, case when kind = lk then coalesce(oq, last_q) else last_q end as bq, case when kind = lk and op is not null then case when kind = 'high' then 'low' else 'high' end else lk end as bk
    from (select r.symbol, r.i, r.kind, r.position, r.confirm, r.price, r.atr, f.hp, f.hq, f.lp, f.lq, f.lk, case when f.lk = 'high' then f.hp else f.lp end as last_p, case when f.lk = 'high' then f.hq else f.lq end as last_q,
                 case when r.kind = 'high' then f.lp else f.hp end as op, case when r.kind = 'high' then f.lq else f.hq end as oq
          from gfold f join graw r on r.symbol = f.symbol and r.i = f.i + 1))))
), gpiv as (
    select * exclude (i, keep, hp, hq, lp, lq, lk), cast(row_number() over (partition by symbol order by i) - 1 as integer) as no from gfold where keep
)"""


PIVOTS = upto("enriched", _pivots(BARS) + f""" select symbol, no, kind, cast(position as integer) as position, cast(confirm as integer) as confirm, duration, prev_kind, prev_position, opp_position,
    {r6('price', 'atr', 'swing', 'prev_price', 'opp_price')} from gpiv""")


def _unit(x: str) -> str:
    return rounded(f"least(1.0::double, greatest(0.0::double, {x}))", 4)


PARTS = {
    "s_strength": f"{_unit('greatest(swing / atr / 5, duration / 24)')} * 25", "s_swing": f"{_unit('swing / atr / 6')} * 20", "s_atr": f"{_unit('swing / atr / 4')} * 15", "s_touches": f"{_unit('touches / 4')} * 15",
    "s_volume": f"coalesce(case when med > 0 then {_unit('vol / med / 2')} end, 0.5) * 10", "s_reversal": f"{_unit('(close_after - close_before) * sign / atr / 2')} * 10", "s_time": f"{_unit('duration / 20')} * 5",
}

ANCHORS = f""", gseg as (
    select p.symbol, p.no, count(*) filter (where abs(b.high - p.price) <= p.atr * 0.35::double) + count(*) filter (where abs(b.low - p.price) <= p.atr * 0.35::double) as touches, median(nullif(b.volume, 0)) as med,
           max(case when b.pos = p.position then nullif(b.volume, 0) end) as vol, max(case when b.pos = greatest(p.position - 2, 0) then b.close end) as close_before, max(case when b.pos = p.confirm then b.close end) as close_after
    from gpiv p join gb b on b.symbol = p.symbol and b.pos between greatest(p.position - 20, 0) and p.confirm where p.opp_price is not null group by 1, 2
), gparts as (
    select *, {', '.join(f'{rounded(v, 2)} as {k}' for k, v in PARTS.items())} from (select p.*, s.touches, s.med, s.vol, s.close_before, s.close_after, case when p.kind = 'low' then 1 else -1 end as sign from gpiv p join gseg s using (symbol, no))
), ganc as (
    select * exclude (touches, med, vol, close_before, close_after, sign), cast(round({' + '.join(f'cast({k} as decimal(10, 2))' for k in PARTS)}, 1) as double) as score, case when kind = 'low' then 'up' else 'down' end as direction,
           substring(sha1(symbol || '|' || kind || '|' || position || '|' || format('{{:,.8f}}', price)), 1, 16) as anchor_id from gparts
), gnext as (
    select *, lead(confirm) over w as next_confirm, lead(anchor_id) over w as replacement from ganc window w as (partition by symbol, direction order by no)
), gsize as (select symbol, count(*) as n from gb group by 1
), glife as (
    select a.* exclude (swing), f.breached_at, case when f.breached_at is not null then 'invalidated' when a.replacement is not null then 'replaced' else 'active' end as status from gnext a
    left join (select a.symbol, a.no, min(b.pos) as breached_at from gnext a join gb b on b.symbol = a.symbol and b.pos > a.confirm and (a.next_confirm is null or b.pos < a.next_confirm)
               and case when a.direction = 'up' then b.close < a.price - a.atr * 0.15::double else b.close > a.price + a.atr * 0.15::double end group by 1, 2) f on f.symbol = a.symbol and f.no = a.no
)"""

LIFECYCLES = upto("enriched", _pivots(BARS) + ANCHORS + f""" select symbol, no, kind, cast(position as integer) as position, cast(confirm as integer) as confirm, duration, prev_kind, prev_position, opp_position, direction, anchor_id,
    cast(next_confirm as integer) as next_confirm, replacement, cast(breached_at as integer) as breached_at, status, {r6('price', 'atr', 'prev_price', 'opp_price', 'score', *PARTS)} from glife""")


def _line(ratio: float, pos: str, multiplier: float) -> str:
    return f"a.price + greatest({pos} - a.position, 0) * {ratio}::double * (a.atr * {multiplier}::double) * case when a.direction = 'up' then 1.0::double else -1.0::double end"


def _events(name: str = "gev", multiplier: float = 0.25) -> str:
    sides = ", ".join(f"({c} - ({_line(r, p, multiplier)})) * a.sign as {n}" for n, c, r, p in (("s", "b.close", 1.0, "b.pos"), ("s0", "b.close0", 1.0, "(b.pos - 1)"), ("q", "b.close", 0.5, "b.pos"), ("q0", "b.close0", 0.5, "(b.pos - 1)")))
    returns = ", ".join(f"{rounded(f'r{h} * way', 6)} as return_{h}" for h in RETURNS)
    up, down = "greatest(top - close, 0.0) / atr", "greatest(close - bottom, 0.0) / atr"
    return f""", {name}_b as (
    select *, lag(close) over w as close0, max(high) over (w rows between 1 following and 20 following) as top, min(low) over (w rows between 1 following and 20 following) as bottom,
           {', '.join(f'lead(close, {h}) over w / close - 1 as r{h}' for h in RETURNS)} from gb window w as (partition by symbol order by pos)
), {name}_x as (
    select a.symbol, a.anchor_id, a.score as anchor_score, a.direction as way0, a.sign, a.atr, b.pos, b.datetime, b.high, b.low, b.close, b.top, b.bottom, {', '.join(f'b.r{h}' for h in RETURNS)}, {_line(1.0, 'b.pos', multiplier)} as l1, {sides}
    from (select *, case when direction = 'up' then 1 else -1 end as sign from glife) a join gsize n on n.symbol = a.symbol
    join {name}_b b on b.symbol = a.symbol and b.pos > a.confirm and b.pos < least(coalesce(a.next_confirm, n.n), n.n - 20)
), {name}_y as (
    select *, case when s0 < 0 and s >= 0 then 'reclaim_1x1' when s0 >= 0 and s < 0 then 'break_1x1' when q0 >= 0 and q < 0 then 'break_1x2'
                   when low <= l1 + atr * 0.15::double and high >= l1 - atr * 0.15::double and s < 0 and s0 < 0 then 'reject_1x1' end as event from {name}_x
), {name} as (
    select symbol, anchor_id, anchor_score, event, cast(pos as integer) as pos, datetime, case when way > 0 then 'up' else 'down' end as direction, {returns},
           {rounded(f'case when way > 0 then {up} else {down} end', 3)} as mfe_atr, {rounded(f'case when way > 0 then {down} else {up} end', 3)} as mae_atr
    from (select *, case when event = 'reclaim_1x1' then sign else -sign end as way from {name}_y where event is not null)
)"""


EVENT_STEPS = _pivots(BARS) + ANCHORS + _events()
EVENTS = upto("enriched", EVENT_STEPS + " select * from gev")


def _accuracy(h: int) -> str:
    return rounded(f"avg(cast(return_{h} > 0 as double)) * 100", 1)


SUMMARY = upto("enriched", EVENT_STEPS + f""" select symbol, event, count(*) as samples, {', '.join(f'{_accuracy(h)} as accuracy_{h}' for h in RETURNS)},
    {', '.join(f'{rounded(f"median(return_{h}) * 100", 3)} as median_{h}' for h in RETURNS)}, {rounded('median(mfe_atr)', 3)} as median_mfe_atr, {rounded('median(mae_atr)', 3)} as median_mae_atr from gev group by 1, 2""")
WALK_FORWARD = upto("enriched", EVENT_STEPS + f""" select symbol, part, count(*) as samples, {_accuracy(5)} as accuracy_5 from (
    select *, case when i < floor(n * 0.6::double) then 'train' when i < floor(n * 0.8::double) then 'validation' else 'test' end as part from (
        select *, row_number() over (partition by symbol order by pos, anchor_id) - 1 as i, count(*) over (partition by symbol) as n from gev)) group by 1, 2""")
BUCKETS = upto("enriched", EVENT_STEPS + f""", g as (select symbol, cast(case when anchor_score < 50 then 0 when anchor_score < 70 then 1 else 2 end as integer) as bucket, count(*) as samples, {_accuracy(5)} as accuracy_5 from gev group by 1, 2)
    select * exclude (rises), min(rises) over (partition by symbol) as monotonic from (select *, coalesce(accuracy_5 >= lag(accuracy_5) over (partition by symbol order by bucket), true) as rises from g)""")
SURVIVAL = upto("enriched", _pivots(BARS) + ANCHORS + f""" select symbol, count(*) as anchors, {rounded('avg(case when next_confirm is not null then cast(breached_at is null as double) end)', 6)} as survival,
    {rounded('greatest(count(*) - 2, 0) / any_value(n)', 6)} as revision_frequency from glife join gsize using (symbol) group by symbol""")


def _study() -> str:
    names = ("turn", "wide", "out", "high_", "low_")
    rates = lambda pre: ", ".join(f"avg({k}) as {pre}{k.strip('_')}_rate" for k in names)
    shown = ", ".join(f"{rounded(f'{p}{k.strip('_')}_rate * 100', 1)} as {p}{k.strip('_')}_rate" for p in ("", "baseline_") for k in names)
    return upto("enriched", _pivots(BARS) + f""", glong as (
        select symbol, no, list(duration) over (partition by symbol order by no rows 6 preceding) as d from gpiv where duration >= 2
    ), gseen as (
        select p.*, last_value(l.d ignore nulls) over (partition by p.symbol order by p.no rows unbounded preceding) as dd, lead(p.no) over (partition by p.symbol order by p.no) as next_no from gpiv p left join glong l on l.symbol = p.symbol and l.no = p.no
    ), gcycle as (
        select symbol, position, confirm, [greatest(2, dd[-1]), greatest(2, coalesce(dd[-2], dd[-1])), greatest(2, cast(round_even(list_median(dd), 0) as integer))] as c from gseen where next_no is not null and dd is not null
    ), gsize as (select symbol, count(*) as n from gb group by 1
    ), gat as (
        select distinct symbol, position + c as pos, n from (select symbol, position, confirm, case when c[3] <> c[1] and c[3] <> c[2] then c[3] when c[2] <> c[1] then c[2] else c[1] end as c from gcycle) join gsize using (symbol)
        where position + c >= confirm and position + c < n - 2
    ), gflag as (
        select symbol, pos, cast(h or l as double) as turn, cast(room and coalesce(avg(high - low) over (w rows between current row and 3 following) > median(high - low) over (w rows between 10 preceding and 1 preceding) * 1.25::double, false) as double) as wide,
               cast(room and coalesce(max(close) over (w rows between current row and 3 following) > max(high) over (w rows between 10 preceding and 1 preceding)
                    or min(close) over (w rows between current row and 3 following) < min(low) over (w rows between 10 preceding and 1 preceding), false) as double) as out, cast(h as double) as high_, cast(l as double) as low_, n
        from (select *, high >= max(high) over (v rows between 2 preceding and 2 following) as h, low <= min(low) over (v rows between 2 preceding and 2 following) as l, pos >= 10 and pos + 3 < n as room
              from gb join gsize using (symbol) window v as (partition by symbol order by pos)) window w as (partition by symbol order by pos)
    ), gin as (select * from gflag where pos >= 2 and pos < n - 2
    ), ghit as (select f.* from gin f semi join gat a on a.symbol = f.symbol and a.pos = f.pos
    ), grest as (select f.*, row_number() over (partition by f.symbol order by f.pos) - 1 as i, count(*) over (partition by f.symbol) as m from gin f anti join gat a on a.symbol = f.symbol and a.pos = f.pos
    ), gtake as (
        select symbol, case when j = k - 1 and k > 1 then m - 1 else cast(floor(j * ((m - 1) / greatest(k - 1, 1))) as bigint) end as i from (
            select symbol, k, m, unnest(range(k)) as j from (select symbol, least(k, m) as k, m from (select symbol, count(*) as k from gat group by 1) join (select distinct symbol, m from grest) using (symbol)))
    ), gh1 as (select symbol, count(*) as samples, {rates('')} from ghit group by 1
    ), gb1 as (select r.symbol, count(*) as baseline_samples, {rates('baseline_')} from grest r join gtake t on t.symbol = r.symbol and t.i = r.i group by 1)
    select symbol, samples, baseline_samples, {rounded('(turn_rate - baseline_turn_rate) * 100', 1)} as edge, {shown} from gh1 left join gb1 using (symbol)""")


STUDY = _study()


def _calibration() -> str:
    parts = """select symbol || '|' || part as symbol, pos - case part when 'train' then 0 when 'validation' then cast(floor(n * 0.6::double) as bigint) else cast(floor(n * 0.8::double) as bigint) end as pos, datetime, high, low, close, volume, ATR14
        from (select *, case when pos < floor(n * 0.6::double) then 'train' when pos < floor(n * 0.8::double) then 'validation' else 'test' end as part from (select *, count(*) over (partition by symbol) as n from enriched) where n >= 90)"""
    ms = (0.125, 0.25, 0.5)
    each = " union all ".join(f"select {i} as i, {m}::double as atr_multiplier, symbol, count(*) as n, {_accuracy(5)} as acc from gev{i} group by symbol" for i, m in enumerate(ms))
    cols = ", ".join(f"coalesce(max(n) filter (where part = '{p}'), 0) as {p}_samples, max(acc) filter (where part = '{p}') as {p}_accuracy" for p in ("train", "validation", "test"))
    return upto("enriched", _pivots(parts) + ANCHORS + "".join(_events(f"gev{i}", m) for i, m in enumerate(ms)) + f""", gall as ({each}
    ), gwide as (select symbol, i, atr_multiplier, {cols} from (select split_part(symbol, '|', 1) as symbol, split_part(symbol, '|', 2) as part, i, atr_multiplier, n, acc from gall) group by 1, 2, 3)
    select * exclude (i), test_samples >= 30 as calibrated from gwide where validation_accuracy is not null qualify row_number() over (partition by symbol order by validation_accuracy desc, validation_samples desc, i) = 1""")


CALIBRATION = _calibration()


ACTIVE = """, gact as (
    select * exclude (r), max(score) over (partition by symbol, direction order by no rows between unbounded preceding and 1 preceding) as reference_score from (select *, row_number() over (partition by symbol, direction order by no desc) as r from ganc) qualify r = 1
), glast as (
    select symbol, max(pos) as latest, arg_max(close, pos) as now_close, arg_max(coalesce(MA20, 'nan'), pos) as MA20, arg_max(coalesce(MA60, 'nan'), pos) as MA60, arg_max(coalesce(BOLL_UPPER, 'nan'), pos) as BOLL_UPPER, arg_max(coalesce(BOLL_LOWER, 'nan'), pos) as BOLL_LOWER from enriched group by 1
)"""


def _fan() -> str:
    side = lambda r: f"(now_close - ({_line(r, 'latest', 0.25)})) * sign >= 0"
    angles = ", ".join(f"struct_pack(angle := '{n}', ratio := {r}::double)" for n, r in ANGLES)
    at = lambda pos: f"a.price + greatest({pos} - a.position, 0) * f.ratio * (a.atr * 0.25::double) * case when a.direction = 'up' then 1.0::double else -1.0::double end"
    return upto("enriched", _pivots(BARS) + ANCHORS + ACTIVE + f""", ga as (
        select a.*, l.latest, l.now_close, case when direction = 'up' then 1 else -1 end as sign from gact a join glast l using (symbol)
    ), gs as (
        select *, case when {side(2.0)} then 1 when {side(1.0)} then 2 when {side(0.5)} then 3 else 4 end as s from ga a
    ) select symbol, anchor_id, direction, score, case when direction = 'up' then ['STRONG_BULL', 'BULL', 'NEUTRAL', 'BEAR'][s] else ['STRONG_BEAR', 'BEAR', 'NEUTRAL', 'BULL'][s] end as state, f.angle,
        {rounded(at('latest'), 6)} as current_price, {rounded(at('(latest + 12)'), 6)} as end_price, f.angle in ('2x1', '1x1', '1x2') as default_visible from (select *, unnest([{angles}]) as f from gs) a""")


FAN = _fan()


def _zones() -> str:
    made = [f"struct_pack(source := 'eighth', label := '{i}/8', level := {rounded(f'lo + (hi - lo) * ({i} / 8)', 6)}, weight := {15.0 if i == 4 else 10.0}::double)" for i in range(1, 9)]
    made += [f"struct_pack(source := 'fibonacci', label := '{f:g}', level := {rounded(f'price + sign * (hi - lo) * {f}::double', 6)}, weight := 15.0::double)" for f in (0.382, 0.5, 0.618, 1.0)]
    made += [f"struct_pack(source := 'prior_pivot', label := 'prior', level := {rounded('opp_price', 6)}, weight := 15.0::double)"]
    made += [f"struct_pack(source := 'indicator', label := '{m}', level := case when not isnan({m}) then {rounded(m, 6)} end, weight := 10.0::double)" for m in ("MA20", "MA60", "BOLL_UPPER", "BOLL_LOWER")]
    return upto("factored", LEVELS + _pivots(BARS) + ANCHORS + ACTIVE + f""", ga as (
        select a.*, l.* exclude (symbol), least(price, opp_price) as lo, greatest(price, opp_price) as hi, case when direction = 'up' then 1 else -1 end as sign from gact a join glast l using (symbol)
    ), glevel as (
        select symbol, anchor_id, price, atr, f.source, f.label, f.level, f.weight from (select *, unnest([{', '.join(made)}]) as f from ga)
        union all select a.symbol, a.anchor_id, a.price, a.atr, 'horizontal', 'horizontal', {rounded('n.price', 6)}, 15.0::double from ga a join near n using (symbol)
    ), gstep as (
        select *, greatest(atr * 0.2::double, price * 0.0005::double) as tol from glevel where level is not null
    ), gzone as (
        select *, sum(cast(gap as integer)) over (partition by symbol, anchor_id order by level, source, label rows unbounded preceding) as zone
        from (select *, coalesce(level - lag(level) over (partition by symbol, anchor_id order by level, source, label) > tol, false) as gap from gstep)
    ), gsum as (
        select symbol, anchor_id, cast(zone as bigint) as zone, min(level) - max(tol) * 0.15::double as price_low, max(level) + max(tol) * 0.15::double as price_high, avg(level) as center, count(*) as factors,
               array_to_string(list_sort(list_distinct(list(source))), ',') as sources, {rounded("least(100.0::double, 20.0::double + sum(weight) * 0.7::double + count(distinct source) * 8.0::double)", 1)} as strength from gzone group by 1, 2, 3
    ), granked as (select *, cast(row_number() over (partition by symbol, anchor_id order by strength desc, factors desc, price_low) as integer) as rank from gsum)
    select symbol, anchor_id, zone, factors, sources, rank, rank <= 3 as default_visible, {r6('price_low', 'price_high', 'center', 'strength')} from granked""")


ZONES = _zones()

CYCLES = upto("enriched", _pivots(BARS) + f""", gd as (
        select symbol, list_transform(list(duration order by no desc)[1:7], lambda x: cast(x as double)) as d from gpiv where duration >= 2 group by 1
    ), gq as (select *, len(d) as n, list_sum(d) / len(d) as mean from gd
    ), gr as (
        select *, {rounded("45 + (1 - least(sqrt(list_sum(list_transform(d, lambda x: (x - mean) * (x - mean))) / n) / greatest(mean, 1.0::double), 1.0::double)) * 35 + least(n, 5) * 4", 1)} as strength from gq
    ), ge as (
        select symbol, strength, unnest([struct_pack(i := 0, key := 'recent', x := d[1]), struct_pack(i := 1, key := 'previous', x := coalesce(d[2], d[1])), struct_pack(i := 2, key := 'median', x := list_median(d))]) as e from gr
    ) select symbol, key, cycle, strength from (select symbol, strength, e.i as i, e.key as key, greatest(2, cast(round_even(e.x, 0) as integer)) as cycle from ge) qualify row_number() over (partition by symbol, cycle order by i) = 1""")

HIGHER = upto("enriched", _pivots(BARS.replace("from enriched", "from enriched where symbol in (select symbol from bars group by 1 having count(*) >= 25)")) + ANCHORS + ACTIVE
              + " select symbol, arg_max(direction, (score, confirm)) as direction, max(score) as score from gact group by 1").replace("interval 1 hour", "interval 8 hour")
