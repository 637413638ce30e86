"""DuckDB SQL of the zigzag (swings of three scales, one recursive pass over each), its candidates and their chart data."""

from __future__ import annotations

from tapeworks.operators.wave import LAST, SCALES, STAGES
from tapeworks.plans.gann_sql import rounded
from tapeworks.plans.sql import r6, swing_sql, upto


def _raw(source: str, scale: str, width: int, least: float) -> str:
    part = lambda kind, c, agg: f"select symbol, '{scale}' as scale, {least}::double as least_move, '{kind}' as kind, pos as position, pos + {width} as confirm, {c} as price, atr_c as atr, MACD as macd, vol from w_{scale} where {agg}"
    return f"""w_{scale} as (
    select *, {swing_sql('high', 'max', width)} as is_h, {swing_sql('low', 'min', width)} as is_l, lead(ATR14, {width}) over (partition by symbol order by pos) as atr_c,
           avg(volume) over (partition by symbol order by pos rows 2 preceding) as vol from {source}
), r_{scale} as (select * from ({part('high', 'high', 'is_h')} union all {part('low', 'low', 'is_l')}) where atr > 0)"""



def _states(source: str) -> str:
    return ", " + ", ".join(_raw(source, *s) for s in SCALES) + f""", zraw as (
    select *, row_number() over (partition by symbol, scale order by confirm, position, kind) as i from ({' union all '.join(f'select * from r_{s}' for s, _, _ in SCALES)})
), zfold as (
    select symbol, scale, i, confirm, true as changed, [struct_pack(kind := kind, pos := position, price := price, macd := macd, vol := vol)] as p from zraw where i = 1
    union all
    select symbol, scale, i, confirm, act <> 'skip', case act when 'skip' then p when 'move' then list_append(p[1:len(p) - 1], x) else list_append(p[-{LAST - 1}:], x) end
    from (select r.symbol, r.scale, r.i, r.confirm, f.p, struct_pack(kind := r.kind, pos := r.position, price := r.price, macd := r.macd, vol := r.vol) as x,
                 case when r.position <= f.p[-1].pos then 'skip' when r.kind = f.p[-1].kind then case when (r.price > f.p[-1].price) <> (r.kind = 'high') or r.price = f.p[-1].price then 'skip' else 'move' end
                      when abs(r.price - f.p[-1].price) / r.atr < r.least_move then 'skip' else 'add' end as act
          from zfold f join zraw r on r.symbol = f.symbol and r.scale = f.scale and r.i = f.i + 1)
), zstate as (
    select symbol, scale, cast(confirm as integer) as at_bar, p from zfold where changed qualify row_number() over (partition by symbol, scale, confirm order by p[-1].pos desc, len(p) desc, i desc) = 1
)"""


STATES = _states("enriched")
PIVOTS = upto("enriched", STATES + f""", zall as (select symbol, scale, at_bar, unnest(range(len(p))) as nth, p from zstate
    ) select symbol, scale, at_bar as at, cast(nth as integer) as nth, e.kind, cast(e.pos as integer) as pos, {r6('price', 'macd', 'vol')} from (select *, p[nth + 1] as e, p[nth + 1].price as price, p[nth + 1].macd as macd, p[nth + 1].vol as vol from zall)""")


def _near(x: str, *typical: float) -> str:
    d = [f"abs({x} - {t}::double) / {t}::double" for t in typical]
    return f"coalesce(greatest(0.0::double, least(1.0::double, 1 - {'least(' + ', '.join(d) + ')' if len(d) > 1 else d[0]} / 0.35::double)), 0.0)"


def _pattern(name: str, n: int, ok: str, fib: str, momentum: bool, done: bool, confirm: int, invalid: int) -> str:
    """One pattern over all states: columns p0 .. are the last ``n`` pivots' prices, m1, m3, v1, v3 their momentum and volume."""
    cols = ", ".join(f"p[len(p) - {n - 1 - i}].price as p{i}" for i in range(n))
    first = "case when p[len(p) - %d].kind = 'low' then 1 else -1 end" % (n - 1) if n >= 5 else f"case when p[len(p) - {n - 2}].price > p[len(p) - {n - 1}].price then 1 else -1 end"
    more = ", ".join(f"p[len(p) - {n - 1 - i}].{c} as {c[0]}{i}" for i in (1, 3) for c in ("macd", "vol")) if momentum else "null::double as m1, null::double as m3, null::double as v1, null::double as v3"
    macd, vol = "case when m1 is not null and m3 is not null then case when (m3 - m1) * d > 0 then 1.0::double else 0.35::double end end", "case when v1 > 0 then least(1.0::double, v3 / v1 / 1.2::double) end"
    mom = f"coalesce(({macd} + {vol}) / 2, {macd}, {vol}, 0.5::double)" if momentum else "0.5::double"
    last, path = f"p{n - 1}", "-d" if done else "d"
    move = f"abs({last} - p0)" if done else "abs(p1 - p0)"
    a, b = (0.236, 0.382) if done else (0.618, 1.0)
    z = [f"({last} + {path} * {move} * {r}::double)" for r in (a, b)]
    pick = lambda i: f"p{i % n}"
    return f"""select symbol, scale, at_bar, '{name}' as pattern, d as direction, '{'completed' if done else 'developing'}' as status, list_transform(p[len(p) - {n - 1}:], lambda x: cast(x.pos as integer)) as positions,
        {rounded(f'least(0.95::double, 0.35::double + 0.4::double * {rounded(fib, 3)} + 0.25::double * {rounded(mom, 3)})', 3)} as fit, {path} as path, {rounded(pick(confirm), 4)} as confirmation, {rounded(pick(invalid), 4)} as invalidation,
        {rounded(f'least({z[0]}, {z[1]})', 4)} as zone_low, {rounded(f'greatest({z[0]}, {z[1]})', 4)} as zone_high, {rounded(last, 6)} as anchor, {rounded(move, 6)} as move
        from (select symbol, scale, at_bar, p, {cols}, {first} as d, {more} from {{states}} where len(p) >= {n}) where coalesce({ok}, false)"""


def _candidates(states: str) -> str:
    over = lambda a, b: f"({a}) / nullif({b}, 0)"
    parts = [
        _pattern("impulse", 6, "least(d * (p1 - p0), d * (p3 - p2), d * (p5 - p4)) > 0 and d * (p2 - p0) > 0 and d * (p3 - p2) >= least(d * (p1 - p0), d * (p5 - p4)) and d * (p4 - p1) > 0",
                 f"({_near(over('p1 - p2', 'p1 - p0'), 0.382, 0.5, 0.618, 0.786)} + {_near(over('p3 - p2', 'p1 - p0'), 1.0, 1.618, 2.618)} + {_near(over('p3 - p4', 'p3 - p2'), 0.236, 0.382, 0.5)} + {_near(over('p5 - p4', 'p1 - p0'), 0.618, 1.0, 1.618)}) / 4",
                 True, True, -2, -1),
        _pattern("unfinished_impulse", 5, "d * (p2 - p0) > 0 and d * (p4 - p1) > 0", _near("(abs(p3 - p4) / greatest(abs(p3 - p2), 1e-12::double))", 0.236, 0.382, 0.5), True, False, -2, -1),
        _pattern("abc_zigzag", 4, "abs(p1 - p0) > 0 and abs(p3 - p2) > 0 and abs(p2 - p1) < abs(p1 - p0)", f"greatest(0.0::double, least(1.0::double, 1 - abs({over('abs(p3 - p2)', 'abs(p1 - p0)')} - 1) / 0.7::double))", False, True, -2, -1),
        _pattern("unfinished_abc", 3, "abs(p1 - p0) > 0 and abs(p2 - p1) < abs(p1 - p0)", _near(over("abs(p2 - p1)", "abs(p1 - p0)"), 0.382, 0.5, 0.618, 0.786), False, False, 1, 0),
    ]
    return f"select * from ({' union all '.join(parts).replace('{states}', states)}) qualify row_number() over (partition by symbol, scale, at_bar order by fit desc, pattern) <= 3"


def _current() -> str:
    edge = lambda r: rounded(f"anchor + path * move * {r}::double", 4)
    stage = "case " + " ".join(f"when not case when path > 0 then close > {edge(STAGES[i][1])} else close < {edge(STAGES[i][1])} end then {i + 1}" for i in range(len(STAGES) - 1)) + f" else {len(STAGES)} end"
    zone = lambda pick, c: "case zone_stage " + " ".join(f"when {i} then {pick}({edge(a)}, {edge(b)})" for i, (a, b) in enumerate(STAGES, 1)) + f" else {c} end"
    lost, up = "case when path > 0 then close < invalidation else close > invalidation end", "case when path > 0 then close > {0} else close < {1} end"
    return STATES + f""", zlast as (select * from zstate qualify row_number() over (partition by symbol, scale order by at_bar desc) = 1
), zcand as ({_candidates('zlast')}
), zone1 as (
    select * from zcand qualify row_number() over (partition by symbol, pattern, direction, positions order by case scale when 'small' then 0 when 'standard' then 1 else 2 end) = 1
), znow as (select symbol, arg_max(close, pos) as close, arg_max(ATR14, pos) as atr, max(pos) as latest from enriched group by 1
), zstaged as (select c.*, n.close, case when status = 'completed' then {stage} end as zone_stage from zone1 c join znow n using (symbol)
), zmoved as (select * replace ({zone('least', 'zone_low')} as zone_low, {zone('greatest', 'zone_high')} as zone_high) from zstaged
), zcur as (
    select *, cast(row_number() over (partition by symbol order by fit desc, scale, pattern, direction) as integer) as rank,
           case when {lost} then 'invalidated' when close between zone_low and zone_high then 'in_target_zone' when {up.format('zone_high', 'zone_low')} then 'target_reached' when {up.format('confirmation', 'confirmation')} then 'confirmed' else 'waiting' end as state
    from zmoved qualify rank <= 3
)"""


CURRENT_STEPS = _current()
CURRENT = upto("enriched", CURRENT_STEPS + """ select symbol, scale, at_bar as at, pattern, cast(direction as integer) as direction, status, array_to_string(positions, ',') as positions, fit, cast(path as integer) as path, confirmation, invalidation,
    zone_low, zone_high, anchor, move, close, cast(zone_stage as integer) as zone_stage, rank, state from zcur""")
PRICE_RANGE = upto("enriched", CURRENT_STEPS + """, b as (select symbol, min(low) as lo, max(high) as hi, arg_max(close, pos) as close from (select *, max(pos) over (partition by symbol) as n from enriched) where pos > n - 220 group by 1
    ), x as (select b.symbol, least(lo, least(zone_low, invalidation)) as lo, greatest(hi, greatest(zone_high, invalidation)) as hi, b.close from b left join (select * from zcur where rank = 1) using (symbol))
    select symbol, lo - greatest((hi - lo) * 0.05::double, close * 0.005::double, 0.01) as y_from, hi + greatest((hi - lo) * 0.05::double, close * 0.005::double, 0.01) as y_until from x""")
OVERLAY = upto("enriched", CURRENT_STEPS + """, known as (select distinct symbol, scale, e.pos as pos, e.price as price from (select symbol, scale, unnest(p) as e from zstate)
    ), top as (select symbol, scale, pattern, positions, unnest(range(len(positions))) as point from zcur where rank = 1)
    select t.symbol, t.scale, cast(k.pos as integer) as pos, t.pattern, cast(t.point as integer) as point, k.price from top t join known k on k.symbol = t.symbol and k.scale = t.scale and k.pos = t.positions[t.point + 1]""")
PATH = upto("enriched", CURRENT_STEPS + f""", n as (
        select c.symbol, c.pattern, unnest([struct_pack(node := 0, at := 0, price := c.close), struct_pack(node := 1, at := 6, price := c.confirmation), struct_pack(node := 2, at := 12, price := (c.zone_low + c.zone_high) / 2)]) as e, z.latest, z.atr
        from zcur c join znow z using (symbol) where c.rank = 1
    ) select symbol, pattern, cast(e.node as integer) as node, cast(latest + e.at as integer) as pos, {r6('price', 'half_width')} from (select *, e.price as price, atr * (0.1::double + 0.65::double * e.node / 2) as half_width from n)""")


def _history() -> str:
    beyond = lambda c, level: f"case when path > 0 then {c} > {level} else {c} < {level} end"
    keys = "symbol, scale, pattern, direction, status, positions"
    n = lambda kind: f"count(*) filter (where outcome = '{kind}')"
    return upto("enriched", """, sample as (
        select * replace (cast(row_number() over (partition by symbol order by pos) - 1 as integer) as pos) from (select *, count(*) over (partition by symbol) as n0 from enriched) where pos >= n0 - 500
    ), size as (select symbol, count(*) as n from sample group by 1)""" + _states("sample") + f""", zcand as ({_candidates('zstate')}
    ), span as (select symbol, scale, at_bar, lead(at_bar) over (partition by symbol, scale order by at_bar) as until from zstate
    ), found as (
        select * from (select c.*, greatest(c.at_bar, 80) as start, least(coalesce(s.until, z.n), z.n - 20) as stop from zcand c join span s on s.symbol = c.symbol and s.scale = c.scale and s.at_bar = c.at_bar join size z on z.symbol = c.symbol) where start < stop
    ), cases as (
        select f.* exclude (start, stop, at_bar, anchor, move), s.pos as at_pos, {beyond('s.close', 'confirmation')} as already from found f join sample s on s.symbol = f.symbol and s.pos >= f.start and s.pos < f.stop
            and case when f.path > 0 then s.close >= f.invalidation else s.close <= f.invalidation end
        qualify row_number() over (partition by {', '.join('f.' + k for k in keys.split(', '))} order by s.pos) = 1
    ), walk as (
        select c.*, s.pos - c.at_pos as step, {beyond('s.close', 'confirmation')} as sure_now, case when path > 0 then s.close < invalidation else s.close > invalidation end as lost_now, case when path > 0 then s.high >= zone_low else s.low <= zone_high end as hit_now
        from cases c join sample s on s.symbol = c.symbol and s.pos between c.at_pos + 1 and c.at_pos + 20
    ), firsts as (
        select *, min(step) filter (where lost_now) over (partition by {keys}) as lost, case when already then 0 else min(step) filter (where sure_now) over (partition by {keys}) end as sure from walk
    ), met as (select {keys}, any_value(lost) as lost, any_value(sure) as sure, min(step) filter (where hit_now and step > sure) as hit from firsts group by all
    ), done as (
        select c.*, coalesce(m.lost, 1 << 30) as lost, coalesce(m.hit, 1 << 30) as hit, coalesce(m.sure, case when c.already then 0 end, 1 << 30) as sure
        from cases c left join met m on m.symbol = c.symbol and m.scale = c.scale and m.pattern = c.pattern and m.direction = c.direction and m.status = c.status and m.positions = c.positions
    ), judged as (
        select *, case when lost < 1 << 30 and lost <= hit then 'invalidation_first' when hit < lost then 'target_first' when sure < 1 << 30 then 'unresolved' else 'unconfirmed' end as outcome from done
    ), counted as (
        select symbol, scale, pattern, cast(direction as integer) as direction, status, count(*) as samples, {n('target_first')} + {n('invalidation_first')} as resolved, {n('target_first')} as target_first, {n('invalidation_first')} as invalidation_first,
               {n('unresolved')} as unresolved, {n('unconfirmed')} as unconfirmed, median(least(lost, hit)) filter (where outcome = 'target_first') as middle from judged group by 1, 2, 3, 4, 5
    ) select * exclude (middle), case when resolved >= 30 then {rounded('target_first / resolved * 100', 1)} end as target_first_rate, case when resolved >= 30 then {rounded('middle', 1)} end as median_target_bars from counted""")


HISTORY = _history()
