"""Records: round trips of flat and nested rows, and what can't be read."""

import datetime as dt

from tapeworks.sources.records import export, rebuild

BAR = "symbol string, datetime timestamp_ntz, day date, close double, volume double, n int, up boolean, note string"
NESTED = "anchor string, target_zones array<array<double>>, windows array<struct<center int, time timestamp_ntz, score double>>"


def test_bars_and_scenarios_come_back(spark):
    at = dt.datetime(2024, 1, 2, 9, 30)
    bars = [("a", at, at.date(), 1.25, 3.0, 4, True, 'x "quoted" é'), ("b", at + dt.timedelta(microseconds=7), None, None, float("nan"), None, None, None), ("c", None, None, float("inf"), 1e-7, -1, False, "")]
    df = spark.createDataFrame(bars, BAR)
    rows, bad = rebuild(export(df, ["symbol"]), BAR.split(", ", 1)[1], ["symbol"])
    assert dict(rows.dtypes) == dict(df.dtypes)
    want = [("a", at, at.date(), 1.25, 3.0, 4, True, 'x "quoted" é'), ("b", at + dt.timedelta(microseconds=7), None, None, None, None, None, None), ("c", None, None, None, 0.0, -1, False, "")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str) and bad.count() == 0
    nested = [("k", [[1.0, 2.5], [3.0, None]], [(5, at, 70.5), (6, None, None)]), ("l", [], None), ("m", None, [])]
    df = spark.createDataFrame(nested, NESTED)
    rows, bad = rebuild(export(df, ["anchor"]), NESTED.split(", ", 1)[1], ["anchor"])
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.collect())) and bad.count() == 0


def test_broken_records_go_aside(spark):
    given = [
        (1, '{"close": 1.5, "n": 2}'), (2, '{"close": 1.5, "n"'), (3, "[1, 2]"), (4, None), (5, '{"close": "many", "n": "x"}'), (6, '{"close": null, "more": {"deep": [1]}}'),
        (7, "{}"), (8, "5"), (9, '{"close": 2, "n": 3.0}'), (10, ""), (1, '{"close": 1.5, "n": 2}'),
    ]
    rows, bad = rebuild(spark.createDataFrame(given, "id int, payload string"), "close double, n int", ["id"])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, 1.5, 2), (1, 1.5, 2), (6, None, None), (7, None, None), (9, 2.0, 3)], key=str)
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(2, "no object"), (3, "no object"), (4, "no object"), (5, "unreadable: close, n"), (8, "no object"), (10, "no object")]
    assert all(r.count() == 0 for r in rebuild(spark.createDataFrame([], "id int, payload string"), "close double", ["id"]))
