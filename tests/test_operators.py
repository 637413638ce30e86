"""Causality, isolation of symbols, closed forms, and same-bar rules."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import backtest as bt
from tapeworks.operators import factors, gann, indicators, levels, research, scan, signals, wave, wyckoff
from tapeworks.operators.indicators import smoothed
from tapeworks.sources.bars import event_bars, with_pos

SCHEMA = "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


def frame(spark, n=320, symbols=("a",)):
    rows = []
    for k, s in enumerate(symbols):
        for i in range(n):
            c = 10 + 0.025 * i + (0.35 + 0.3 * k) * math.sin(i / (5 + k)) + 0.5 * math.sin(i / 23)
            o = c - 0.08 * math.sin(i / 3)
            v = 100000 + 2500 * (i * 7 % 17)
            rows.append((s, dt.datetime(2024, 1, 2) + dt.timedelta(days=i), o, max(o, c) + 0.16, min(o, c) - 0.16, c, float(v), v * c))
    return with_pos(spark.createDataFrame(rows, SCHEMA))


def analysed(b):
    return signals.add_setups(signals.add_regime(factors.add_factors(indicators.add_indicators(b))))


def rows(df, *cols):
    return {(r["symbol"], r["pos"]): tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.select("symbol", "pos", *cols).collect()}


def test_prefixes_and_symbols_do_not_change_rows(spark):
    cols = ["MA20", "ATR14", "ADX14", "K", "OBV", "regime", "trend_pullback", "breakout_trigger", "trend_breakdown_trigger", *factors.FACTORS]
    both = rows(analysed(frame(spark, 320, ("a", "b"))), *cols)
    part = rows(analysed(frame(spark, 250)), *cols)
    assert len(part) == 250
    assert all(both[k] == v for k, v in part.items())


def test_warm_up(spark):
    b = indicators.add_indicators(frame(spark))
    first = b.agg(*[F.min(F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("MA5", "DIF", "DEA", "RSI12", "K", "ATR14", "ADX14", "BOLL_MID", "VOL_RATIO", "OBV")]).first()
    assert first.asDict() == {"MA5": 4, "DIF": 25, "DEA": 33, "RSI12": 12, "K": 8, "ATR14": 13, "ADX14": 26, "BOLL_MID": 19, "VOL_RATIO": 5, "OBV": 0}
    with pytest.raises(ValueError):
        indicators.sma("close", 0)
    with pytest.raises(ValueError):
        indicators.add_indicators(frame(spark).drop("close"))


def test_scan_equals_the_single_pass(spark):
    """Blocks of some bars, with missing prices, flat stretches and series shorter than a block or than any warm-up."""
    g = np.random.default_rng(7)
    rows = []
    for s, n in (("long", 700), ("short", 30), ("tiny", 5), ("even", 128)):
        c = 50.0
        for i in range(n):
            c += 0.0 if 200 <= i < 260 else float(g.standard_normal())
            gap = s == "long" and (g.random() < 0.05 or 300 <= i < 360)
            o, spread = c, 0.0 if 200 <= i < 260 else 0.3
            rows.append((s, dt.datetime(2024, 1, 2) + dt.timedelta(days=i), o, *((None,) * 3 if gap else (c + spread, c - spread, c)), 1.0, c, i))
    b = spark.createDataFrame(rows, SCHEMA + ", pos int")
    key = lambda df: {(r["symbol"], r["pos"]): [r[c] for c in indicators.RECURSIVE] for r in df.collect()}
    want = key(indicators.recursive(b))
    for block in (9, 32, 64, 1000):
        got = key(scan.recursive(b, block))
        assert set(got) == set(want)
        for k, values in want.items():
            for c, x, y in zip(indicators.RECURSIVE, values, got[k], strict=True):
                assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(x))), (block, k, c, x, y)
    assert scan.recursive(b.limit(0)).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few bars into one task
    tasks = scan.recursive(b.filter("symbol = 'long'"), 32).select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1, "one symbol stays in one task"
    with pytest.raises(ValueError):
        scan.recursive(b, 8)


def test_sliding_shares_and_falls_equal_whole_windows():
    g = np.random.default_rng(3)
    x = np.round(g.standard_normal(400), 1) + 5
    x[g.random(400) < 0.1] = np.nan
    for n, least in ((250, 20), (7, 3), (1, 1)):
        got = factors.share_not_above(x, n, least)
        for i in range(len(x)):
            w = x[max(0, i - n + 1) : i + 1]
            if np.sum(w == w) < min(least, n):
                assert got[i] != got[i]
            else:
                assert got[i] == (np.sum(w <= x[i]) / len(w) if x[i] == x[i] else 0.0)
    for n in (1, 2, 20, 60):
        got = factors.drawdown(x, n)
        for i in range(len(x)):
            w = x[max(0, i - n + 1) : i + 1]
            if len(w) < n or np.isnan(w).any():
                assert got[i] != got[i]
            else:
                assert got[i] == min(0.0, (w / np.maximum.accumulate(w) - 1).min())


def test_level_clusters_are_the_plain_ones_and_fast():
    import time

    import pandas as pd

    def plain(prices, band):
        groups = []
        for p in prices:
            home = next((c for c in groups if abs(p - sum(c) / len(c)) <= band), None)
            if home is None:
                groups.append([p])
            else:
                home.append(p)
        return [len(c) for c in groups]

    g = np.random.default_rng(5)
    swings = lambda n, band: pd.DataFrame({"symbol": "a", "kind": "low", "price": np.sort(g.random(n) * 50), "position": np.arange(n), "volume_weight": 1.0, "rows": n + 9, "band": band})
    for band in (0.01, 0.4, 3.0, 80.0):
        x = swings(600, band)
        assert list(levels._clusters(x)["touches"]) == plain(list(x["price"]), band)
    began = time.perf_counter()
    assert levels._clusters(swings(100_000, 0.3))["touches"].sum() == 100_000
    assert time.perf_counter() - began < 20


def test_exponential_mean_with_gaps():
    import pandas as pd

    g = np.random.default_rng(1)
    x = g.standard_normal(200)
    x[g.random(200) < 0.2] = np.nan
    want = pd.Series(x).ewm(alpha=0.3, adjust=False, min_periods=5).mean().to_numpy()
    assert np.allclose(smoothed(x, 0.3, 5), want, equal_nan=True)


def barrier(spark, path, **conf):
    b = spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + i), float(o), float(h), float(lo), float(c), 1.0, 1.0) for i, (o, h, lo, c) in enumerate(path)], SCHEMA)
    e = spark.createDataFrame([("a", 1, 0, 10.0, 9.0, 12.0)], "symbol string, key int, fill_pos int, fill_price double, stop double, target double")
    ex = spark.createDataFrame(conf.pop("exits", []), "symbol string, pos int")
    r = bt.barriers(e, with_pos(b), ex, bt.Execution(**conf)).collect()
    return (r[0]["exit_reason"], r[0]["raw_exit"], r[0]["holding_bars"]) if r else None


def test_barriers_count_the_stop_first(spark):
    assert barrier(spark, [(10, 10, 10, 10), (10, 12.5, 8.5, 10)]) == ("STOP_AND_TARGET_SAME_BAR_CONSERVATIVE", 9.0, 1)
    assert barrier(spark, [(10, 12.5, 10, 10), (10, 11, 9.5, 10), (10, 12, 9.5, 10)]) == ("TARGET", 12.0, 2)
    assert barrier(spark, [(10, 10, 10, 10), (10, 11, 9.5, 10.5)]) == ("TIME_BARRIER", 10.5, 1)
    assert barrier(spark, [(10, 10, 10, 10), (9.7, 13, 8, 10)], exits=[("a", 1)]) == ("TREND_BREAKDOWN", 9.7, 1)
    assert barrier(spark, [(10, 10, 10, 10)]) is None
    with pytest.raises(ValueError):
        bt.Execution(max_holding_bars=0)


def test_trades_do_not_overlap(spark, sf_dir):
    full = analysed(event_bars(spark, sf_dir)).cache()
    trades, _ = bt.strategy(signals.signals(full), full)
    at = full.select("symbol", "datetime", "pos")
    t = trades.join(at.withColumnsRenamed({"datetime": "exit_date", "pos": "exit_pos"}), ["symbol", "exit_date"]).orderBy("symbol", "pos").collect()
    assert t
    assert all(y["pos"] >= x["exit_pos"] for x, y in zip(t, t[1:], strict=False) if x["symbol"] == y["symbol"])
    m = {(r["symbol"], r["group"]): r["trade_count"] for r in bt.metrics(trades).collect()}
    assert sum(v for (s, g), v in m.items() if g == "ALL") == len(t) == sum(v for (s, g), v in m.items() if g != "ALL")


def test_levels_and_score(spark):
    rows_ = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *(20 + 2 * math.sin(math.pi * i / 10) + d for d in (0, 0.2, -0.2, 0)), 100000.0, 1.0) for i in range(220)]
    b = indicators.add_indicators(with_pos(spark.createDataFrame(rows_, SCHEMA)))
    near = levels.nearest_levels(b).collect()
    assert {r["side"] for r in near} == {"support", "resistance"}
    low = [r for r in near if r["side"] == "support"][0]
    assert abs(low["price"] - 17.8) < 0.2 and low["confidence"] == "high" and low["touches"] > 5
    s = levels.technical_score(indicators.add_indicators(frame(spark))).first()
    assert 0 <= s["score"] <= 100 and s["state"] in ("strong", "firm", "neutral", "soft", "weak")


def test_zigzag_replaces_and_needs_a_move():
    r = lambda kind, pos, price: (kind, pos, pos + 2, price, 1.0, None, 1.0)
    got = wave.zigzag([r("low", 2, 9.0), r("high", 5, 12.0), r("high", 7, 13.0), r("low", 9, 12.5), r("low", 11, 10.0)], 1.0)
    assert [[p[1] for p in last] for _, last in got] == [[2], [2, 5], [2, 7], [2, 7, 11]]


def test_wave_states_are_causal(spark):
    b = indicators.add_indicators(frame(spark, 320))
    key = lambda df: sorted((r["scale"], r["at"], tuple(r["pos"])) for r in df.collect())
    whole = key(wave.states(b))
    part = key(wave.states(b.filter("pos < 200")))
    assert part == [x for x in whole if x[1] < 200]
    c = wave.current(b).collect()
    assert c and all(0 < r["fit"] <= 0.95 for r in c)
    h = wave.history(b).collect()
    assert all(r["samples"] == r["resolved"] + r["unresolved"] + r["unconfirmed"] for r in h)


def test_outcomes_take_the_careful_side_on_one_bar(spark):
    bars = spark.createDataFrame([("a", i, *x) for i, x in enumerate([(10.0, 10.0, 10.0), (13.0, 9.0, 10.5), (13.0, 10.0, 11.0), (13.0, 10.0, 8.0)])], "symbol string, pos int, high double, low double, close double")
    up = F.lit(True)
    run = lambda conf: wave.first_outcome(spark.createDataFrame([("a", 0, conf <= 10)], "symbol string, at int, already boolean"), bars, ["symbol"], 3, F.when(up, F.col("close") < 9), F.col("close") > conf, F.col("high") >= 12).first()
    assert (run(10.4)["outcome"], run(10.4)["bars"]) == ("target_first", 2)  # confirmed on bar 1, whose high does not count
    assert (run(9.0)["outcome"], run(9.0)["bars"]) == ("target_first", 1)
    assert (run(10.9)["outcome"], run(10.9)["bars"]) == ("invalidation_first", 3)


def wyckoff_rows(mirror=False):
    out = []
    for i in range(100):
        o, h, lo, c, v = 11.0, 12.1, 9.9, 11.0, 100.0
        if i == 70:
            o, h, lo, c, v = 10.2, 10.9, 9.5, 10.7, 110.0
        elif i == 73:
            o, h, lo, c, v = 10.3, 10.6, 9.95, 10.4, 70.0
        elif i == 76:
            o, h, lo, c, v = 11.0, 12.9, 11.0, 12.7, 160.0
        elif i == 78:
            o, h, lo, c, v = 12.4, 12.6, 12.0, 12.3, 80.0
        if mirror:
            o, h, lo, c = 22 - o, 22 - lo, 22 - h, 22 - c
        out.append(("m" if mirror else "u", i, h, lo, c, 0.5, v))
    return out


def test_wyckoff_sequence_and_its_mirror(spark):
    b = spark.createDataFrame(wyckoff_rows() + wyckoff_rows(True), "symbol string, pos int, high double, low double, close double, ATR14 double, volume double").withColumn("datetime", F.timestamp_seconds(F.col("pos") * 86400).cast("timestamp_ntz"))
    v = wyckoff.replay(b)
    assert v.filter("pos = 99").count() == 4
    import pandas as pd

    g = b.withColumns({"vr": F.col("volume") / 100, "sr": (F.col("high") - F.col("low")) / 0.5, "loc": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low")), "prior": F.lit(0.0)}).toPandas()
    seen = {s: [e for e in wyckoff._replay(pd.DataFrame(x)).query(f"direction == {d}")["new_event"] if e] for s, d, x in (("u", 1, g[g.symbol == "u"]), ("m", -1, g[g.symbol == "m"]))}
    assert [e for e in seen["u"] if e != "AR"][:4] == ["Spring", "Test", "SOS", "LPS"]
    assert [e for e in seen["m"] if e != "AR"][:4] == ["UTAD", "Test", "SOW", "LPSY"]


def test_gann_pivots_never_move(spark):
    b = indicators.add_indicators(frame(spark, 320))
    key = lambda df: [(r["no"], r["kind"], r["position"], round(r["price"], 9)) for r in df.orderBy("no").collect()]
    whole, part = key(gann.pivots(b)), key(gann.pivots(b.filter("pos < 220")))
    assert part and part == whole[: len(part)]
    a = gann.lifecycles(b).collect()
    assert all(0 <= r["score"] <= 100 for r in a) and {r["status"] for r in a} <= {"active", "replaced", "invalidated"}
    f = gann.fan(b).collect()
    assert len(f) == 7 * len({r["anchor_id"] for r in f})
    with pytest.raises(ValueError):
        gann.Config(mode="other")


def test_gann_higher_timeframe_and_targets(spark):
    b = indicators.add_indicators(frame(spark, 320)).cache()
    parts = gann.prepare(b)
    ways = {r["anchor_id"]: (r["direction"], r["position"], r["atr"], r["price"]) for r in parts.view.collect()}
    assert ways
    window = lambda h: {(r["anchor_id"], r["center"]): (r["score"], r["cycles"]) for r in gann.time_windows(b, None, h, parts=parts).collect()}
    plain, up = window(None), window(spark.createDataFrame([(b.first()["symbol"], "up")], "symbol string, direction string"))
    assert set(plain) == set(up) and plain
    for k, (score, cycles) in up.items():
        # a window of one cycle gains six points where the higher timeframe goes its way; scores end at 100
        gain = score - plain[k][0]
        assert gain == (0 if ways[k[0]][0] == "down" else min(6.0, round(100 - plain[k][0], 1))) or (cycles > 1 and gain >= 0)
    rows = gann.scenarios(b, parts=parts).collect()
    zones = {}
    for r in gann.confluence(b, parts=parts).collect():
        zones.setdefault(r["anchor_id"], []).append(r)
    assert len(rows) == 2 * len(ways)
    for r in rows:
        direction, _, atr, _ = ways[r["anchor_id"]]
        assert 1 <= len(r["target_zones"]) <= 2 and all(a <= z for a, z in r["target_zones"]) and len(r["windows"]) <= 2
        if r["scenario"] == "reject_1x1":
            assert r["invalidation"] == r["trigger"] and r["path"] != direction
            continue
        sign = 1 if direction == "up" else -1
        ahead = [z for z in sorted(zones.get(r["anchor_id"], []), key=lambda z: z["rank"]) if (z["mid"] - r["trigger"]) * sign > 0]
        strong = [z for z in ahead if z["score"] >= 65][:3]
        if strong or ahead:
            assert r["target_zones"] == [[round(z["zone_low"], 6), round(z["zone_high"], 6)] for z in (strong[:2] or ahead[:1])]
        else:
            assert r["target_zones"][0][1] - r["target_zones"][0][0] == pytest.approx(atr / 2, abs=1e-5)
    parts.release()


def test_confluence_replay_equals_one_run_per_prefix(spark):
    """Every anchor's zones, from one pass over 300 bars, are those of a run that ends at its confirmation."""
    b = indicators.add_indicators(frame(spark, 300)).cache()
    parts = gann.replay(b)
    z = gann.price_zones(gann.price_levels(b, parts=parts)).withColumnRenamed("rank", "zone_rank")
    names = ("anchor_id", "angle", "center", "mid", "zone_low", "zone_high", "raw_score", "score", "type", "start_bar")
    at = {r["anchor_id"]: r["confirm"] for r in parts.view.collect()}
    got = {}
    for r in gann.meetings(gann.time_windows(b, parts=parts), z, None, gann.Config(), parts).collect():
        got.setdefault(r["anchor_id"], set()).add(tuple(r[n] for n in names))
    # prefixes as symbols of their own; an anchor's identity holds its symbol, so that they are told apart by their confirmation
    ends = sorted(set(at.values()))
    cut = spark.createDataFrame([(e,) for e in ends], "end int")
    prefixes = b.crossJoin(cut).filter("pos <= end").withColumn("symbol", F.concat_ws("@", "symbol", "end")).drop("end")
    many = gann.prepare(prefixes)
    own = {(r["symbol"], r["anchor_id"]): r["confirm"] for r in many.view.collect()}
    zones = gann.price_zones(gann.price_levels(prefixes, parts=many)).withColumnRenamed("rank", "zone_rank")
    want = {}
    for r in gann.meetings(gann.time_windows(prefixes, parts=many), zones, None, gann.Config(), many).collect():
        end = int(r["symbol"].split("@")[1])
        if own[r["symbol"], r["anchor_id"]] == end:
            want.setdefault(end, set()).add(tuple(r[n] for n in names if n != "anchor_id"))
    assert sum(map(len, got.values())) > 50
    assert {at[k]: {x[1:] for x in v} for k, v in got.items()} == want
    events = gann.confluence_events(b, parts=parts).collect()
    bars = {r["pos"]: r for r in b.select("pos", "close", "high", "low").collect()}
    assert events and all(r["raw_score"] >= 60 for r in events)
    for r in events:
        sign, here = 1 if r["direction"] == "up" else -1, bars[r["pos"]]["close"]
        assert r["return_5"] == pytest.approx((bars[r["pos"] + 5]["close"] / here - 1) * sign, abs=1e-6)
    study = gann.confluence_study(gann.confluence_events(b, parts=parts)).collect()
    assert sum(r["samples"] for r in study if r["bucket"] != "80+") == len(events)


def test_times_of_future_bars(spark):
    day = lambda y, m, d, h=0: dt.datetime(y, m, d, h)
    rows = [
        ("daily", day(2024, 3, 8, 15), 1, day(2024, 3, 11, 15)), ("daily", day(2024, 3, 8), 6, day(2024, 3, 18)), ("daily", day(2024, 3, 9), 1, day(2024, 3, 11)), ("daily", day(2024, 3, 10), 5, day(2024, 3, 15)), ("daily", day(2024, 3, 6), 13, day(2024, 3, 25)),
        ("weekly", day(2024, 3, 8), 3, day(2024, 3, 29)), ("monthly", day(2024, 1, 30), 1, day(2024, 1, 31)), ("monthly", day(2024, 1, 31), 1, day(2024, 2, 29)), ("monthly", day(2023, 12, 5), 3, day(2024, 2, 29)),
        ("60m", day(2024, 3, 8, 23), 2, day(2024, 3, 9, 1)), ("15m", day(2024, 3, 8), 4, day(2024, 3, 8, 1)), ("other", day(2024, 2, 28), 2, day(2024, 3, 1)),
    ]
    df = spark.createDataFrame(rows, "period string, latest timestamp_ntz, ahead int, want timestamp_ntz")
    for period in {r[0] for r in rows}:
        for r in df.filter(F.col("period") == period).withColumn("got", gann.future_time(F.col("latest"), F.col("ahead"), period)).collect():
            assert r["got"] == r["want"], r


def test_tenths_round_as_python_does(spark):
    g = np.random.default_rng(4)
    xs = [float(x) for x in np.concatenate([g.integers(2000, 20000, 3000) * 0.005, g.random(500) * 90 + 9])]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r["y"] == round(r["x"], 1) for r in df.withColumn("y", gann.tenths(F.col("x"))).collect())


def test_gann_on_an_empty_table(spark):
    b = indicators.add_indicators(frame(spark, 40).limit(0))
    for build in (gann.time_windows, gann.confluence, gann.scenarios, gann.angle_events, gann.confluence_events, wave.current, wyckoff.current):
        assert build(b).count() == 0


def test_research(spark):
    b = frame(spark, 100)
    s = research.walk_forward(b, 60, 20, 20)
    assert [tuple(r)[1:] for r in s.collect()] == [(0, 60, 80, 100)]
    with pytest.raises(ValueError):
        research.time_split(b, 0.9, 0.2)
    x = spark.createDataFrame([(float(i), (-1.0) ** i) for i in range(10)], "f double, r double")
    got = research.bucket_study(x, "f", "r").orderBy("bucket").collect()
    assert [r["samples"] for r in got] == [2] * 5 and got[0]["lower"] == 0.0 and got[4]["upper"] == 9.0
    best = research.select_best(spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, 7.0)], "parameter double, k double"), "k").first()
    assert best["parameter"] == 2.0


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    from tapeworks.sources.bars import bars_from_ticks
    from tapeworks.streaming.ticks import stream_bars, stream_ema

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    for k in range(3):
        e.filter(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_bars(src, "event_type", "ts", "value", "event_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["symbol"], r["datetime"]): (r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["symbol"], r["datetime"]): (r["open"], r["close"], r["volume"]) for r in bars_from_ticks(e, "event_type", "ts", "value", "event_id").collect()}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items())
    bars = spark.read.parquet(str(tmp_path / "out"))
    live = stream_ema(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "out")), 12)
    live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    batch = indicators.ema(bars, 12).filter("EMA12 is not null").select("symbol", "EMA12").collect()
    assert spark.table("live").filter("ema is not null").count() == len(batch)
