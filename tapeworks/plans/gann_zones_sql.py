"""DuckDB SQL of time windows, confluence zones and the study of zones: one recursive pass merges windows, one thins zones."""

from __future__ import annotations

from tapeworks.operators.gann import ANGLES, CAP, MULTIPLES, RETURNS, WEIGHTS
from tapeworks.plans import gann_sql as g
from tapeworks.plans.level_sql import LEVELS
from tapeworks.plans.sql import upto

NOW = ("DIF", "DEA", "VOL_RATIO", "MA20", "MA60", "BOLL_UPPER", "BOLL_LOWER")
number = lambda x: f"case when not isnan({x}) then {x} end"

#: Durations of swings of two bars or more known with each pivot, newest first.
KNOWN = """, vlong as (
    select symbol, no, list(duration) over (partition by symbol order by no rows 6 preceding) as d from gpiv where duration >= 2
), vknown as (
    select p.symbol, p.no, list_transform(list_reverse(last_value(l.d ignore nulls) over (partition by p.symbol order by p.no rows unbounded preceding)), lambda x: cast(x as double)) as d
    from gpiv p left join vlong l on l.symbol = p.symbol and l.no = p.no
)"""

#: Active anchors seen from the last bar, with the higher timeframe's direction.
VIEW_NOW = (
    g.ACTIVE
    + KNOWN
    + f""", vhigh as ({g.HIGHER}
), vlast as (
    select symbol, arg_max(datetime, pos) as now_datetime, {', '.join(f"arg_max(coalesce({c}, 'nan'), pos) as {c}" for c in NOW)} from enriched group by 1
), view as (
    select a.symbol, a.anchor_id, a.no, a.confirm, a.direction, a.price, a.atr, a.position, a.opp_price, a.score as anchor_score, l.latest, l.now_close, v.now_datetime, {', '.join(f"{number(f'v.{c}')} as {c}" for c in NOW)},
           k.d, coalesce(h.direction = a.direction, false) as aligned, case when a.direction = 'up' then 1 else -1 end as sign
    from gact a join glast l using (symbol) join vlast v using (symbol)
    join (select symbol, arg_max(coalesce(d, []), no) as d from vknown group by 1) k using (symbol) left join vhigh h using (symbol)
)"""
)

#: Every anchor seen from the bar of its confirmation.
VIEW_THEN = (
    KNOWN
    + f""", view as (
    select a.symbol, a.anchor_id, a.no, a.confirm, a.direction, a.price, a.atr, a.position, a.opp_price, a.score as anchor_score, a.confirm as latest, b.close as now_close, b.datetime as now_datetime, {', '.join(f'b.{c}' for c in NOW)},
           coalesce(k.d, []) as d, false as aligned, case when a.direction = 'up' then 1 else -1 end as sign
    from ganc a join enriched b on b.symbol = a.symbol and b.pos = a.confirm join vknown k on k.symbol = a.symbol and k.no = a.no
)"""
)


def zones(horizontal: bool) -> str:
    made = [f"struct_pack(source := 'eighth', label := '{i}/8', level := {g.rounded(f'lo + (hi - lo) * ({i} / 8)', 6)}, weight := {15.0 if i == 4 else 10.0}::double)" for i in range(1, 9)]
    made += [f"struct_pack(source := 'fibonacci', label := '{f:g}', level := {g.rounded(f'price + sign * (hi - lo) * {f}::double', 6)}, weight := 15.0::double)" for f in (0.382, 0.5, 0.618, 1.0)]
    made += [f"struct_pack(source := 'prior_pivot', label := 'prior', level := {g.rounded('opp_price', 6)}, weight := 15.0::double)"]
    made += [f"struct_pack(source := 'indicator', label := '{m}', level := {g.rounded(m, 6)}, weight := 10.0::double)" for m in ("MA20", "MA60", "BOLL_UPPER", "BOLL_LOWER")]
    more = f"union all select a.symbol, a.anchor_id, a.price, a.atr, 'horizontal', 'horizontal', {g.rounded('n.price', 6)}, 15.0::double from view a join near n using (symbol)" if horizontal else ""
    by = "partition by symbol, anchor_id order by level, source, label"
    return f""", zlevel as (
        select symbol, anchor_id, price, atr, f.source, f.label, f.level, f.weight from (select *, unnest([{', '.join(made)}]) as f from (select *, least(price, opp_price) as lo, greatest(price, opp_price) as hi from view)) {more}
    ), zstep as (select *, greatest(atr * 0.2::double, price * 0.0005::double) as tol from zlevel where level is not null
    ), zgroup as (
        select *, sum(cast(gap as integer)) over ({by} rows unbounded preceding) as zone from (select *, coalesce(level - lag(level) over ({by}) > tol, false) as gap from zstep)
    ), zsum as (
        select symbol, anchor_id, {g.rounded('min(level) - max(tol) * 0.15::double', 6)} as price_low, {g.rounded('max(level) + max(tol) * 0.15::double', 6)} as price_high, {g.rounded('avg(level)', 6)} as zone_center, count(*) as factors,
               list_distinct(list(source)) as sources, {g.rounded("least(100.0::double, 20.0::double + sum(weight) * 0.7::double + count(distinct source) * 8.0::double)", 1)} as strength from zgroup group by symbol, anchor_id, zone
    ), zones as (select *, row_number() over (partition by symbol, anchor_id order by strength desc, factors desc, price_low) as zone_rank from zsum)"""


def _tenths(x: str) -> str:
    """Rounded to one decimal by the exact binary value, half to even."""
    whole, rest, one = f"(cast({x} * 1125899906842624::double as hugeint) * 10 // 1125899906842624)", f"(cast({x} * 1125899906842624::double as hugeint) * 10 % 1125899906842624)", "562949953421312"
    return f"cast({whole} + case when {rest} > {one} or {rest} = {one} and {whole} % 2 = 1 then 1 else 0 end as double) / 10"


def windows(nearby: str) -> str:
    ms = ", ".join(f"struct_pack(m := {m}::double, k := {k}, minus := {8.0 if m >= 3 else 3.0 if m >= 2 else 0.0}::double)" for k, m in enumerate(MULTIPLES))
    strength = g.rounded("45 + (1 - least(sqrt(list_sum(list_transform(d, lambda x: (x - mean) * (x - mean))) / n) / greatest(mean, 1.0::double), 1.0::double)) * 35 + least(n, 5) * 4", 1)
    total = "least(30.0::double, strength * 0.3::double) + least(20.0::double, greatest(overlap - 1, 0) * 10.0::double) + 8.0::double + case when aligned then 12.0::double else 6.0::double end + least(15.0::double, nearby * 15.0::double) + 15.0::double - f.minus"
    score = _tenths("total")
    minutes = lambda c: f"now_datetime + to_minutes(60 * ({c} - latest))"
    return f""", w0 as (
        select *, len(d) as n, list_sum(d) / len(d) as mean, [greatest(2, cast(d[1] as integer)), greatest(2, cast(coalesce(d[2], d[1]) as integer)), greatest(2, cast(round_even(list_median(d), 0) as integer))] as three, {nearby} as nearby
        from view where len(d) > 0
    ), w1 as (
        select *, {strength} as strength, [three[1]] || case when three[2] <> three[1] then [three[2]] else [] end || case when three[3] <> three[1] and three[3] <> three[2] then [three[3]] else [] end as lengths from w0
    ), w2 as (
        select *, unnest([{ms}]) as f from (select *, unnest(lengths) as x, unnest(range(len(lengths))) as i from w1)
    ), w3 as (
        select *, case when first <= latest then first + x * (cast(floor((latest - first) / x) as integer) + 1) else first end as center, greatest(1, cast(round_even(x * 0.1::double, 0) as integer)) as tol
        from (select *, position + cast(round_even(x * f.m, 0) as integer) as first from w2)
    ), w4 as (
        select *, len(list_filter(lengths, lambda o: abs(center - (position + round_even(o * f.m, 0))) <= tol)) as overlap from w3 where center <= latest + {CAP}
    ), w5 as (
        select symbol, anchor_id, latest, now_datetime, center, greatest(latest + 1, center - tol) as start, least(latest + {CAP}, center + tol) as stop, {score} as score, i * {len(MULTIPLES)} + f.k as nth
        from (select *, greatest(0.0::double, least(100.0::double, {total})) as total from w4)
    ), w6 as (select *, row_number() over (partition by symbol, anchor_id order by start, -score, nth) as r from w5
    ), wfold as (
        select symbol, anchor_id, latest, now_datetime, r, 1 as island, center, start, stop, score, 1 as cycles from w6 where r = 1
        union all
        select w.symbol, w.anchor_id, w.latest, w.now_datetime, w.r, case when w.start <= f.stop then f.island else f.island + 1 end, case when w.start <= f.stop then f.center else w.center end, case when w.start <= f.stop then f.start else w.start end,
               case when w.start <= f.stop then greatest(f.stop, w.stop) else w.stop end, case when w.start <= f.stop then {g.rounded('least(100.0::double, greatest(f.score, w.score) + 7)', 1)} else w.score end, case when w.start <= f.stop then f.cycles + 1 else 1 end
        from wfold f join w6 w on w.symbol = f.symbol and w.anchor_id = f.anchor_id and w.r = f.r + 1
    ), windows as (
        select symbol, anchor_id, cast(center as integer) as center, cast(start as integer) as start, cast(stop as integer) as stop, cast(center - latest as integer) as bars_from_now, score, cast(cycles as integer) as cycles,
               {minutes('start')} as start_time, {minutes('center')} as center_time, {minutes('stop')} as end_time
        from wfold qualify row_number() over (partition by symbol, anchor_id, island order by r desc) = 1
    )"""


def meetings() -> str:
    angles = ", ".join(f"struct_pack(no := {i}, name := '{n}', ratio := {r}::double)" for i, (n, r) in enumerate(ANGLES) if n in ("2x1", "1x1", "1x2"))
    has = lambda *names: " or ".join(f"list_contains(sources, '{n}')" for n in names)
    take = lambda cond, k: f"case when {cond} then {WEIGHTS[k]}::double else 0.0::double end"
    raw = " + ".join([
        f"{WEIGHTS['angle']}::double", f"{WEIGHTS['time']}::double * least(1.0::double, window_score / 70)", take(has("eighth", "prior_pivot"), "price_level"), take(has("horizontal"), "horizontal"), take(has("fibonacci"), "fibonacci"),
        take("aligned", "higher_timeframe"), take("(DIF - DEA) * sign > 0", "momentum"), take("VOL_RATIO >= 1", "volume"),
    ])
    decay = "case when bars_from_now <= 5 then 1.0::double when bars_from_now <= 10 then 0.85::double when bars_from_now <= 15 then 0.65::double else 0.45::double end"
    return f""", m0 as (
        select v.*, w.center, w.start, w.bars_from_now, w.score as window_score, unnest([{angles}]) as f from view v join windows w on w.symbol = v.symbol and w.anchor_id = v.anchor_id
    ), m1 as (
        select *, price + greatest(center - position, 0) * f.ratio * (atr * 0.25::double) * case when direction = 'up' then 1.0::double else -1.0::double end as projected, greatest(atr * 0.35::double, price * 0.001::double) as tol from m0
    ), m2 as (
        select m.*, z.* exclude (symbol, anchor_id), least(100.0::double, {raw}) as raw, (projected + zone_center) / 2 as middle
        from m1 m join zones z on z.symbol = m.symbol and z.anchor_id = m.anchor_id where projected >= price_low - tol and projected <= price_high + tol
    ), m3 as (
        select symbol, anchor_id, no, confirm, direction, anchor_score, atr, f.name as angle, f.no as angle_no, zone_rank, center, start - latest as start_bar, {g.rounded('middle', 6)} as mid, {g.rounded('least(price_low, middle - tol * 0.3::double)', 6)} as zone_low,
               {g.rounded('greatest(price_high, middle + tol * 0.3::double)', 6)} as zone_high, {g.rounded('raw', 1)} as raw_score, {g.rounded(f'raw * {decay}', 1)} as score, case when middle >= now_close then 'resistance' else 'support' end as type, tol from m2
    ), m4 as (select *, row_number() over (partition by symbol, anchor_id order by score desc, center, angle_no, zone_rank) as r from m3
    ), mfold as (
        select symbol, anchor_id, r, true as keep, [struct_pack(mid := mid, bar := start_bar)] as kept from m4 where r = 1
        union all
        select symbol, anchor_id, r, keep, case when keep then list_append(kept, struct_pack(mid := mid, bar := start_bar)) else kept end from (
            select m.symbol, m.anchor_id, m.r, m.mid, m.start_bar, f.kept, len(list_filter(f.kept, lambda k: abs(m.mid - k.mid) <= m.tol * 0.5::double and abs(m.start_bar - k.bar) <= 1)) = 0 as keep
            from mfold f join m4 m on m.symbol = f.symbol and m.anchor_id = f.anchor_id and m.r = f.r + 1)
    ), met as (select m.* exclude (r), m.r as r from m4 m join mfold f on f.symbol = m.symbol and f.anchor_id = m.anchor_id and f.r = m.r where f.keep)"""


_count = "(select count(*) from zones z where z.symbol = view.symbol and z.anchor_id = view.anchor_id)"
NOW_STEPS = LEVELS + g._pivots(g.BARS) + g.ANCHORS + VIEW_NOW + zones(True) + windows(f"least(1.0::double, {_count} / 6)")
WINDOWS = upto("factored", NOW_STEPS + " select * exclude (stop), stop as end from windows")
CONFLUENCE = upto("factored", NOW_STEPS + meetings() + """ select symbol, anchor_id, direction, anchor_score, angle, center, cast(start_bar as integer) as start_bar, mid, zone_low, zone_high, raw_score, score, type, rank, rank <= 3 and score >= 65 as default_visible
    from (select *, cast(row_number() over (partition by symbol, anchor_id order by r) as integer) as rank from met)""")


def _projection() -> str:
    """State, parts of the structural fit, and the main scenario: beyond the 1x1 line two strong meetings, else the best one, else the nearest level, else two ATR."""
    at = lambda r: g._line(r, "a.latest", 0.25)
    ok = lambda r: f"(now_close - ({at(r)})) * a.sign >= 0"
    states = "case when direction = 'up' then ['STRONG_BULL', 'BULL', 'NEUTRAL', 'BEAR'][s] else ['STRONG_BEAR', 'BEAR', 'NEUTRAL', 'BULL'][s] end"
    pair = "struct_pack(lo := zone_low, hi := zone_high, z := score)"
    return NOW_STEPS + meetings() + f""", pmet as (select *, row_number() over (partition by symbol, anchor_id order by r) as rank from met
    ), pstate as (
        select *, {states} as state from (select a.*, case when {ok(2.0)} then 1 when {ok(1.0)} then 2 when {ok(0.5)} then 3 else 4 end as s, {g.rounded(at(1.0), 6)} as one, {g.rounded(at(0.5), 6)} as slow from view a)
    ), pbest as (
        select p.symbol, p.anchor_id, max(m.score) as confluence, arg_min(m.angle, m.rank) as top_angle, arg_min(m.mid, m.rank) as top_mid from pstate p join pmet m using (symbol, anchor_id) group by 1, 2
    ), pbeyond as (
        select p.symbol, p.anchor_id, list({pair} order by m.rank) as far, list({pair} order by m.rank) filter (where m.score >= 65) as strong from pstate p join pmet m using (symbol, anchor_id) where (m.mid - p.one) * p.sign > 0 group by 1, 2
    ), plevel as (
        select p.symbol, p.anchor_id, arg_min(l.level, abs(l.level - p.one)) as level from pstate p join zlevel l using (symbol, anchor_id) where (l.level - p.one) * p.sign > 0 group by 1, 2
    ), pwindow as (
        select symbol, anchor_id, max(score) as time_cycle, arg_min(center, center) filter (where score >= 55) as shown, arg_min(center_time, center) filter (where score >= 55) as shown_time,
               arg_max(center, (score, -center)) as most, arg_max(center_time, (score, -center)) as most_time from windows group by 1, 2
    ), p0 as (
        select p.*, b.confluence as best, b.top_angle, b.top_mid, {g.rounded('p.anchor_score', 1)} as anchor_quality, case when state like 'STRONG%' then 85.0::double when state = 'NEUTRAL' then 50.0::double else 70.0::double end as angle_state,
               coalesce(w.time_cycle, 0.0::double) as time_cycle, coalesce(b.confluence, 0.0::double) as confluence, case when p.aligned then 80.0::double else 50.0::double end as higher_timeframe, coalesce(w.shown, w.most) as window_center,
               coalesce(w.shown_time, w.most_time) as window_time, f.strong, f.far, coalesce(l.level, p.one + p.sign * p.atr * 2) as near
        from pstate p left join pbest b using (symbol, anchor_id) left join pbeyond f using (symbol, anchor_id) left join plevel l using (symbol, anchor_id) left join pwindow w using (symbol, anchor_id)
    ), p1 as (
        select *, anchor_score * 0.45::double + case when state = 'NEUTRAL' then 12.0::double else 25.0::double end + coalesce(list_max(list_transform(strong[1:3], lambda x: x.z)), 0.0::double) * 0.2::double as go,
               anchor_score * 0.35::double + case when state = 'NEUTRAL' then 25.0::double else 15.0::double end + 15 as stop from p0
    ), projection as (
        select symbol, anchor_id, direction, cast(position as integer) as position, cast(confirm as integer) as confirm, anchor_score as score, {g.rounded('price', 6)} as price, {g.rounded('atr', 6)} as atr, {g.rounded('atr * 0.25::double', 8)} as price_unit, state,
               anchor_quality, angle_state, time_cycle, confluence, higher_timeframe, {g.rounded('(anchor_quality + angle_state + time_cycle + confluence + higher_timeframe) / 5 / 100', 3)} as structural_fit, direction as path,
               {g.rounded('1 / (1 + exp((stop - go) / 12))', 4)} as confidence, one as trigger, slow as invalidation, case when len(strong) > 0 then strong[1].lo when far is not null then far[1].lo else {g.rounded('near - atr * 0.25::double', 6)} end as target_low,
               case when len(strong) > 0 then strong[1].hi when far is not null then far[1].hi else {g.rounded('near + atr * 0.25::double', 6)} end as target_high, window_center, window_time, top_angle, top_mid from p1
    )"""


def _scenarios() -> str:
    """Both scenarios of each anchor with up to two targets and windows."""
    around = lambda x: f"[struct_pack(lo := {g.rounded(f'{x} - atr * 0.25::double', 6)}, hi := {g.rounded(f'{x} + atr * 0.25::double', 6)})]"
    slim = "list_transform({}, lambda x: struct_pack(lo := x.lo, hi := x.hi))"
    return _projection() + f""", swin as (
        select symbol, anchor_id, list(center order by center) filter (where score >= 55) as shown, [arg_max(center, (score, -center))] as most from windows group by 1, 2
    ), sboth as (
        select p.*, s.name, case when len(w.shown) > 0 then w.shown[1:2] else coalesce(w.most, []) end as shown_windows, case when s.name = 'break_1x1' then direction when direction = 'up' then 'down' else 'up' end as path,
               case when s.name = 'break_1x1' then go else stop end as points, case when s.name = 'break_1x1' then 1 / (1 + exp((stop - go) / 12)) else 1 - 1 / (1 + exp((stop - go) / 12)) end as q,
               case when s.name = 'reject_1x1' then {around('slow')} when len(strong) > 0 then {slim.format('strong[1:2]')} when far is not null then {slim.format('far[1:1]')} else {around('near')} end as targets
        from p1 p cross join (values ('break_1x1'), ('reject_1x1')) s(name) left join swin w using (symbol, anchor_id)
    ) select symbol, anchor_id, name as scenario, path, {g.rounded('points', 1)} as scenario_score, {g.rounded('q', 4)} as confidence, {g.rounded('q * 0.65::double', 4)} as effective_confidence, one as trigger,
             case when name = 'break_1x1' then slow else one end as invalidation, targets[1].lo as target_low, targets[1].hi as target_high, targets[2].lo as second_low, targets[2].hi as second_high, array_to_string(shown_windows, ',') as window_centers from sboth"""


SCENARIOS = upto("factored", _scenarios())
PROJECTION = upto("factored", _projection() + " select * from projection")
ANALYSIS = upto("factored", _projection() + f""" select * exclude (gap), {g.rounded('gap', 1)} as score_gap, gap < 8 as ambiguous, score < 35 as low_confidence from (
    select *, coalesce(score - lead(score) over w, 100.0::double) as gap, count(*) over (partition by symbol) as alternatives from projection window w as (partition by symbol order by score desc, confirm desc) qualify row_number() over w = 1)""")


def _events() -> str:
    returns = ", ".join(f"{g.rounded(f'r{h} * sign', 6)} as return_{h}, r{h} * sign > 0 as correct_{h}" for h in RETURNS)
    in_atr = lambda x: g.rounded(f"greatest(0.0::double, {x}) / atr", 3)
    return g._pivots(g.BARS) + g.ANCHORS + VIEW_THEN + zones(False) + windows("0.5::double") + meetings() + f""", eb as (
        select symbol, pos, close, max(high) over (w rows between 1 following and 20 following) as top, min(low) over (w rows between 1 following and 20 following) as bottom, {', '.join(f'lead(close, {h}) over w / close - 1 as r{h}' for h in RETURNS)}
        from gb window w as (partition by symbol order by pos)
    ), enext as (select symbol, anchor_id, next_confirm from gnext
    ), events as (
        select symbol, anchor_id, direction, cast(pos as integer) as pos, angle, center, mid, raw_score, score, gain >= atr as target_hit, loss >= atr as invalidated, {returns}, {in_atr('gain')} as mfe_atr, {in_atr('loss')} as mae_atr
        from (select m.*, b.pos, sign, {', '.join(f'b.r{h}' for h in RETURNS)}, case when sign > 0 then top - close else close - bottom end as gain, case when sign > 0 then close - bottom else top - close end as loss
              from (select *, confirm + start_bar as at, case when direction = 'up' then 1 else -1 end as sign from met) m join enext e on e.symbol = m.symbol and e.anchor_id = m.anchor_id join gsize n on n.symbol = m.symbol
              join eb b on b.symbol = m.symbol and b.pos = m.at
              where raw_score >= 60 and m.confirm >= 29 and m.confirm + 21 < n.n and m.at < coalesce(e.next_confirm, n.n) and m.at + 20 < n.n)
    )"""


EVENTS = upto("enriched", _events() + " select * from events")


def _study() -> str:
    rate = lambda c: g.rounded(f"avg(cast({c} as double)) * 100", 1)
    return upto("enriched", _events() + f""", sbucket as (
        select *, unnest([case when raw_score >= 90 then '90+' when raw_score >= 80 then '80~90' when raw_score >= 70 then '70~80' else '60~70' end] || case when raw_score >= 80 then ['80+'] else [] end) as bucket from events
    ), sg as (
        select symbol, bucket, count(*) as samples, {rate('target_hit')} as target_hit_rate, {rate('invalidated')} as invalidation_rate, {g.rounded('median(mfe_atr)', 3)} as median_mfe_atr, {g.rounded('median(mae_atr)', 3)} as median_mae_atr,
               {', '.join(f"{rate(f'return_{h} > 0')} as accuracy_{h}, {rate(f'correct_{h}')} as correct_{h}, {g.rounded(f'median(return_{h}) * 100', 3)} as median_return_{h}" for h in RETURNS)}
        from sbucket group by 1, 2
    ) select s.*, m.monotonic from sg s join (
        select symbol, min(rises) as monotonic from (select symbol, coalesce(accuracy_5 >= lag(accuracy_5) over (partition by symbol order by bucket), true) as rises from sg where bucket <> '80+') group by 1) m using (symbol)""")


STUDY = _study()
