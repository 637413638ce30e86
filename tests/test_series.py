"""The incremental series: batches against one run, files that stay, broken and repeated commits, what is due."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThanOrEqual, In, LessThan

from tapeworks.sources import bars as src
from tapeworks.sources import vendor
from tapeworks.sources.series import SeriesStore, deliveries
from tests.test_operators import frame

NOW = dt.datetime(2024, 6, 1)


def rows(df):
    return sorted(tuple(r) for r in df.select("symbol", "datetime", "open", "high", "low", "close", "volume").collect())


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names}


def ranges(spark, *given):
    return spark.createDataFrame(given, "symbol string, start date, end date")


def test_ten_corrected_batches_equal_one_run(spark, tmp_path):
    bars = frame(spark, 120, ("a", "b", "c")).drop("pos").cache()
    store = SeriesStore(spark, str(tmp_path), most_segments=4)
    came = deliveries(bars, 10).cache()
    assert store.read() is None
    for k in range(10):
        part = came.filter(F.col("batch") == k)
        asked = part.groupBy("symbol").agg(F.min(F.date_sub("from", 7)).alias("start"), F.max("to").alias("end"))
        before = files(tmp_path)
        n = store.commit(f"batch {k}", part.drop("batch", "from", "to"), asked, NOW + dt.timedelta(days=k))
        after = files(tmp_path)
        assert all(after[f] == t for f, t in before.items()), "a file was written again"
        assert store.commit(f"batch {k}", part.drop("batch", "from", "to"), asked, NOW) == n and files(tmp_path) == after
    last = max(r["datetime"] for r in bars.collect())
    want = sorted((s, d, o, h, lo, c, v + (d > last - dt.timedelta(days=7))) for s, d, o, h, lo, c, v in rows(bars))
    assert rows(store.read()) == want
    assert max(r["n"] for r in store.state().select(F.size("segments").alias("n")).collect()) <= 4
    # an earlier version still reads as it was
    early = store.read(version=3)
    assert 0 < early.count() < len(want)
    some = store.read(symbols=["b"], start=dt.date(2024, 2, 1), end=dt.date(2024, 2, 3))
    assert {(r["symbol"], r["datetime"].day) for r in some.collect()} == {("b", 1), ("b", 2), ("b", 3)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(datetime" in plan and "EqualTo(symbol,b)" in plan


def test_only_touched_symbols_move_and_broken_commits_are_not_seen(spark, tmp_path):
    bars = frame(spark, 30, ("a", "b")).drop("pos")
    store = SeriesStore(spark, str(tmp_path))
    day = lambda d: dt.date(2024, 1, d)
    store.commit("all", bars, ranges(spark, ("a", day(2), day(31)), ("b", day(2), day(31))), NOW)
    fixed = bars.filter("symbol = 'a'").limit(1).withColumn("close", F.lit(99.0))
    # a commit that broke between data and state
    fixed.withColumn("commit", F.lit(2).cast("long")).write.parquet(f"{tmp_path}/data/00000002")
    os.makedirs(f"{tmp_path}/state/00000002-broken")
    assert rows(store.read()) == rows(bars)
    n = store.commit("fix", fixed, ranges(spark, ("a", day(2), day(2))), NOW + dt.timedelta(days=1))
    assert n == 3 and {r["symbol"] for r in spark.read.parquet(f"{tmp_path}/data/00000003").collect()} == {"a"}
    state = {r["symbol"]: r for r in store.state().collect()}
    assert state["b"]["segments"] == [1] and state["b"]["updated_at"] == NOW and state["a"]["segments"] == [1, 3]
    assert [r["close"] for r in store.read(symbols=["a"]).orderBy("datetime").limit(1).collect()] == [99.0]
    # an empty answer still counts as covered
    store.commit("none", bars.limit(0), ranges(spark, ("q", day(1), day(9))), NOW)
    q = {r["symbol"]: r for r in store.state().collect()}["q"]
    assert (q["coverage_start"], q["coverage_end"], q["segments"], q["last_bar"]) == (day(1), day(9), [], None)


def test_what_is_due(spark, tmp_path):
    bars = frame(spark, 20, ("a",)).drop("pos")  # 2 to 21 January
    store = SeriesStore(spark, str(tmp_path))
    day = lambda d: dt.date(2024, 1, d)
    store.commit("all", bars, ranges(spark, ("a", day(2), day(25))), NOW)
    soon, late, ttl = NOW + dt.timedelta(minutes=5), NOW + dt.timedelta(hours=3), dt.timedelta(hours=2)
    due = lambda now, *r: sorted(tuple(x) for x in store.due(ranges(spark, *r), now, ttl).collect())
    assert due(soon, ("a", day(3), day(20))) == []
    assert due(soon, ("a", day(1), day(28)), ("new", day(1), day(2))) == [("a", day(1), day(1)), ("a", day(26), day(28)), ("new", day(1), day(2))]
    # nothing is missing but the series is old: seven days before its last bar and on
    assert due(late, ("a", day(3), day(25))) == [("a", day(14), day(25))]
    assert due(late, ("a", day(18), day(24))) == [("a", day(18), day(24))]
    assert due(late, ("a", day(1), day(25))) == [("a", day(1), day(1))]


def vendor_folder(path, symbols, days=5):
    os.makedirs(path)
    for i, s in enumerate(symbols):
        lines = ["日期,开盘,最高,最低,收盘,成交量,换手率"]
        lines += [f"2024-01-0{d} 00:00:00,{10 + i},{11 + i},{9 + i},{10.5 + i},{d * 100},0.02" for d in range(1, days + 1)]
        lines += ["kaputt,1,1,1,1,1,1", "2024-01-09 00:00:00,10,9,11,10,1,1"]  # no time; a high below the low
        with open(f"{path}/{s}.csv", "w", encoding="utf-8") as f:
            f.write("\n".join(lines))


def test_vendor_source_plans_by_filters(spark, tmp_path):
    root = str(tmp_path / "v")
    vendor_folder(root, ["AA", "BB", "CC"])
    df = vendor.vendor_bars(spark, root)
    assert df.columns[0] == "symbol" and dict(df.dtypes)["日期"] == "timestamp_ntz" and df.count() == 21
    made = lambda: vendor.VendorBars({"path": root}).reader(df.schema)
    r = made()
    kept = list(r.pushFilters([In(("symbol",), ("AA", "CC")), GreaterThanOrEqual(("日期",), dt.datetime(2024, 1, 3)), LessThan(("日期",), dt.datetime(2024, 1, 5)), EqualNullSafe(("收盘",), "1")]))
    assert kept == [EqualNullSafe(("收盘",), "1")] and [p.symbol for p in r.partitions()] == ["AA", "CC"]
    assert [x["日期"].day for b in r.read(r.partitions()[0]) for x in b.to_pylist()] == [3, 4]
    none = made()
    assert list(none.pushFilters([EqualTo(("symbol",), "ZZ")])) == [] and [b for p in none.partitions() for b in none.read(p)] == []
    some = df.filter((F.col("symbol") == "BB") & (F.col("日期") >= F.lit("2024-01-04").cast("timestamp_ntz")))
    assert some.rdd.getNumPartitions() == 1 and sorted(r["日期"].day for r in some.collect()) == [4, 5, 9]
    assert src.normalize(df).count() == 15


def test_fetch_falls_back_by_symbol(spark, tmp_path):
    vendor_folder(str(tmp_path / "one"), ["AA", "BB"])
    vendor_folder(str(tmp_path / "two"), ["BB", "CC", "DD"], days=9)
    one = vendor.Source("one", lambda s: vendor.vendor_bars(s, str(tmp_path / "one")), ("stock",), ("daily",), units=lambda raw: raw.withColumnRenamed("成交量", "volume").withColumn("volume", F.col("volume").try_cast("double") / 100))
    two = vendor.Source("two", lambda s: vendor.vendor_bars(s, str(tmp_path / "two")), ("stock", "etf"), ("daily",), ("none", "qfq"))
    day = lambda d: dt.date(2024, 1, d)
    rows = [("AA", "stock", "daily", "none", day(2), day(3)), ("BB", "stock", "daily", "none", day(7), day(8)), ("CC", "stock", "daily", "none", day(1), day(2)), ("DD", "etf", "daily", "none", day(1), day(1)),
            ("EE", "stock", "daily", "none", day(1), day(2)), ("FF", "future", "daily", "none", day(1), day(2)), ("GG", "etf", "1m", "none", day(1), day(2))]
    wanted = spark.createDataFrame(rows, "symbol string, asset_type string, period string, adjust string, start date, end date")
    bars, rest = vendor.fetch(spark, wanted, [one, two])
    got = sorted((r["symbol"], r["datetime"].day, r["source"], r["volume"]) for r in bars.collect())
    # BB's range is one that only the second source covers
    assert got == [("AA", 2, "one", 2.0), ("AA", 3, "one", 3.0), ("BB", 7, "two", 700.0), ("BB", 8, "two", 800.0), ("CC", 1, "two", 100.0), ("CC", 2, "two", 200.0), ("DD", 1, "two", 100.0)]
    assert sorted((r["symbol"], r["reason"]) for r in rest.collect()) == [("EE", "empty"), ("FF", "unsupported"), ("GG", "unsupported")]
    can = {(r["asset_type"], r["period"], r["adjust"]): r["sources"] for r in vendor.capabilities(spark, [one, two]).collect()}
    assert can[("stock", "daily", "none")] == ["one", "two"] and can[("etf", "daily", "qfq")] == ["two"]
    lots = src.lots_and_percent(spark.createDataFrame([(250.0, 0.031)], "volume double, turnover double")).first()
    assert (lots["volume"], round(lots["turnover"], 9)) == (2.5, 3.1)
