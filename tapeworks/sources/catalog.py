"""Instruments, clocks, cache tables and readers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.sources.bars import ALIASES, normalize

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
    "json": lambda spark, path: spark.read.json(path),
    "parquet": lambda spark, path: spark.read.parquet(path),
    "orc": lambda spark, path: spark.read.orc(path),
}


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Normalised bars of a source. Symbols are filters on the source's column; so are days where its time is a date or time, so Parquet prunes by them."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; known: {', '.join(sorted(READERS))}")
    raw = READERS[kind](spark, path)
    if symbols is not None and "symbol" in raw.columns:
        raw = raw.filter(F.col("symbol").isin(symbols))
    at = next((a for a in ALIASES["datetime"] if a in raw.columns), None)
    if at and raw.schema[at].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        # a day of slack on both sides for time zones: the exact limits follow below
        for day, shift in ((start, -1), (end, 2)):
            if day is not None:
                bound = F.lit(str(dt.date.fromisoformat(day[:10]) + dt.timedelta(days=shift))).cast(raw.schema[at].dataType)
                raw = raw.filter(F.col(at) >= bound if shift < 0 else F.col(at) <= bound)
    out = normalize(raw if "symbol" in raw.columns else raw.withColumn("symbol", F.lit(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])))
    if start is not None:
        out = out.filter(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("datetime") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return out


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol; only the symbols in ``bars`` are replaced."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "datetime").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("symbol").parquet(path)


def exchange(symbol: Column) -> Column:
    """Exchange prefix of a six-digit domestic symbol by its first digit."""
    first = F.substring(symbol, 1, 1)
    return F.when(first.isin("4", "8"), "bj").when(first.isin("5", "6", "9"), "sh").otherwise("sz")


#: First two digits of exchange-traded funds, the index symbols, the futures served.
FUND_PREFIXES = ("15", "16", "18", "50", "51", "52", "56", "58")
INDEXES = (".IXIC", ".NDX", ".INX", ".DJI")
FUTURES = ("GC", "SI", "HG", "CL", "NG", "OIL", "XAU", "XAG")


def identify(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """symbol, asset_type, name and method: an asset type that is asked for (column asset_type, else ``auto``) holds if its rules allow the
    symbol (null otherwise); without one, funds are looked up in the list of instruments, and where that has no funds at
    all, told by prefix. Names come from the list, else they are the symbol. The list is broadcast by Spark's own threshold only.
    """
    asked = F.col("asset_type") if "asset_type" in symbols.columns else F.lit("auto")
    s = F.upper(F.trim("symbol"))
    listed = instruments.select(F.upper("code").alias("code"), "name", F.col("asset_type").isin("etf", "cn_etf").alias("fund")).groupBy("code").agg(F.max("name").alias("name"), F.max("fund").alias("fund"))
    any_fund = instruments.select(F.max(F.col("asset_type").isin("etf", "cn_etf"))).first()[0]
    rows = symbols.select(s.alias("symbol"), asked.alias("asked")).join(listed, F.col("symbol") == F.col("code"), "left")
    fund = F.coalesce("fund", F.lit(False)) if any_fund else F.substring("symbol", 1, 2).isin(*FUND_PREFIXES)
    kind = (
        F.when(F.col("asked") == "us_stock", F.when(F.col("code").isNotNull() | F.col("symbol").rlike("^[A-Za-z0-9][A-Za-z0-9.-]{0,15}$"), "us_stock"))
        .when(F.col("asked") == "us_index", F.when(F.col("symbol").isin(*INDEXES), "us_index"))
        .when(F.col("asked") == "global_future", F.when(F.col("symbol").isin(*FUTURES), "global_future"))
        .when(F.col("asked").isin("etf", "cn_etf", "stock", "cn_stock"), F.col("asked")).when(fund, "etf").otherwise("stock")
    )
    method = F.when(F.col("asked") != "auto", "asked").when(F.lit(bool(any_fund)), "list").otherwise("prefix")
    return rows.select("symbol", kind.alias("asset_type"), F.coalesce("name", "symbol").alias("name"), method.alias("method"))


def search(instruments: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Instruments whose code or name holds the query, those whose code begins with it first."""
    q = F.upper(F.trim(F.lit(query)))
    hit = F.upper("code").contains(q) | F.upper("name").contains(q)
    return instruments.filter(hit).orderBy(~F.upper("code").startswith(q), "code").limit(min(20, max(1, limit)))


def market_status(ts: Column, market: str = "cn") -> Column:
    """``closed`` (weekend), ``open``, ``before`` or ``after`` at a UTC time, by the local clock; the bounds of sessions belong to them."""
    zone, first, spans = {
        "cn": ("Asia/Shanghai", "09:30:00", (("09:30:00", "11:30:00"), ("13:00:00", "15:00:00"))),
        "us": ("America/New_York", "09:30:00", (("09:30:00", "16:00:00"),)),
    }[market]
    local = F.from_utc_timestamp(ts, zone)
    clock = F.date_format(local, "HH:mm:ss.SSSSSS")
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | clock.between(a, f"{b}.000000")
    return F.when(~F.dayofweek(local).between(2, 6), "closed").when(inside, "open").when(clock < first, "before").otherwise("after")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def cache_get(cache: DataFrame, keys: DataFrame, now: Column, allow_expired: bool = False) -> DataFrame:
    """Entries of ``keys`` that have not expired."""
    live = cache if allow_expired else cache.filter(F.col("expires_at") > now)
    return live.join(keys, "key", "left_semi")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with the entries of ``new`` in place of those of the same key."""
    return cache.join(new, "key", "left_anti").unionByName(new)


def purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests (symbol, asset_type, period, adjust, start, end) with the symbol trimmed and in capitals, and a column problem, null where they may run."""
    s, kind, period = F.upper(F.trim("symbol")), F.col("asset_type"), F.col("period")
    minute = ~period.isin("daily", "weekly", "monthly")
    home = kind.isin("auto", "stock", "etf", "cn_stock", "cn_etf")
    form = F.when(home, s.rlike("^[0-9]{6}$")).when(kind == "us_index", s.isin(*INDEXES)).otherwise(s.rlike("^[A-Z0-9][A-Z0-9.-]{0,15}$"))
    problem = (
        F.when(~F.coalesce(home | kind.isin("us_stock", "us_index", "global_future"), F.lit(False)), "asset_type")
        .when(~F.coalesce(period.isin("daily", "weekly", "monthly", "1m", "5m", "15m", "30m", "60m"), F.lit(False)), "period")
        .when(~F.coalesce(F.col("adjust").isin("none", "qfq", "hfq"), F.lit(False)), "adjust").when(~F.coalesce(form, F.lit(False)), "symbol")
        .when(F.col("start") > F.col("end"), "range").when(F.datediff("end", "start") > 365 * 15, "span")
        .when(kind.isin("us_index", "global_future") & ((F.col("adjust") != "none") | minute), "unsupported")
        .when((kind == "us_stock") & minute & ((period != "1m") | (F.col("adjust") != "none")), "unsupported")
    )
    return requests.withColumns({"symbol": s, "problem": problem})


#: The names under which a futures snapshot delivers each field.
SNAPSHOT = {
    "latest": ("最新价", "current_price"),
    "pct_change": ("涨跌幅", "pct_change"),
    "change": ("涨跌额", "change"),
    "open": ("开盘价", "open"),
    "high": ("最高价", "high"),
    "low": ("最低价", "low"),
    "settlement": ("昨结算", "last_settle_price"),
    "open_interest": ("持仓量", "hold"),
}


def future_snapshots(raw: DataFrame) -> DataFrame:
    """symbol, the snapshot's fields (of each, the first name with a value) and source_timestamp (date and time, where given)."""
    value = lambda names, kind: F.coalesce(*[F.col(f"`{n}`").cast("string").try_cast(kind) for n in names if n in raw.columns], F.lit(None).cast(kind))
    time = F.concat_ws(" ", value(("日期", "date"), "string"), value(("行情时间", "time"), "string"))
    return raw.select("symbol", *[value(n, "double").alias(k) for k, n in SNAPSHOT.items()], F.nullif(time, F.lit("")).alias("source_timestamp"))


def with_snapshot(bars: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each symbol's last bar beside its snapshot, null where there is none."""
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in bars.columns if c != "symbol"]), "datetime").alias("bar"))
    snap = snapshots.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "symbol"]), F.coalesce("source_timestamp", F.lit(""))).alias("snapshot"))
    return last.join(snap, "symbol", "left").select("symbol", "bar.*", "snapshot")
