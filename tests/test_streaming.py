"""Corrected bars of a stream against a batch over all ticks."""

import datetime as dt
import random

from tapeworks.sources.bars import bars_from_ticks
from tapeworks.streaming.revised import last_ticks, latest, revised_bars

TICK = "no long, symbol string, ts timestamp, price double, seq long"


def test_shuffled_late_and_repeated_ticks_equal_a_batch(spark, tmp_path):
    g = random.Random(8)
    start = dt.datetime(2024, 1, 2)
    ticks = [(i, g.choice("ab"), start + dt.timedelta(minutes=g.randrange(6 * 60)), float(g.randrange(90, 110)), 0) for i in range(400)]
    # a number comes again with another price, before or after the tick that it corrects
    again = [(i, s, ts, p + 3, 1) for i, s, ts, p, _ in g.sample(ticks, 60)]
    every = ticks + again
    g.shuffle(every)
    for k in range(4):
        spark.createDataFrame(every[k::4], TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = revised_bars(src, "symbol", "ts", "price", "no", "seq")
    found = []

    def keep(batch, n):
        found.extend(batch.collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not q.isActive
    names = ["symbol", "datetime", "open", "high", "low", "close", "volume", "amount"]
    got = latest(spark.createDataFrame(found, out.schema))
    want = bars_from_ticks(last_ticks(spark.createDataFrame(every, TICK), "no", "seq"), "symbol", "ts", "price", "no")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[c] for c in names) for r in want.collect())
    assert max(r["revision"] for r in found) >= 2, "nothing was corrected"
    bars = {}
    for r in found:
        bars.setdefault((r["symbol"], r["datetime"]), []).append(r["revision"])
    assert all(v == list(range(len(v))) for v in bars.values())


def test_state_ends_and_ticks_behind_it_are_dropped(spark, tmp_path):
    day = dt.datetime(2024, 1, 2)
    parts = [[(1, "a", day, 5.0, 0)], [(2, "a", day + dt.timedelta(days=3), 6.0, 0)], [(3, "a", day + dt.timedelta(minutes=1), 7.0, 0), (4, "a", day + dt.timedelta(days=3, minutes=1), 8.0, 0)]]
    for rows in parts:
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = sorted(p.name for p in (tmp_path / "in").glob("*.parquet"))
    assert len(names) == 3
    src = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = revised_bars(src, "symbol", "ts", "price", "no", "seq", late_minutes=60).writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted((r["datetime"].day, r["revision"], r["volume"]) for r in found)
    # the tick of the first day that comes after the third day is behind the watermark
    assert rows == [(2, 0, 1.0), (5, 0, 1.0), (5, 1, 2.0)]
