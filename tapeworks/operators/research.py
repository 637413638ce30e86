"""Splits, sweeps and bucket studies."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def time_split(bars: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``bars`` with set: train, validation or test, by each symbol's own length."""
    if not 0 < train < 1 or not 0 < validation < 1 or train + validation >= 1:
        raise ValueError("the parts must be positive and leave a rest")
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"))
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * (train + validation))
    return bars.join(n, "symbol").withColumn("set", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test")).drop("__n")


def walk_forward(bars: DataFrame, train: int, validation: int, test: int, step: int | None = None) -> DataFrame:
    """(symbol, split, train_end, validation_end, test_end): training always starts at 0 and grows by ``step`` bars."""
    step = step or test
    if min(train, validation, test, step) <= 0:
        raise ValueError("all sizes must be positive")
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= train + validation + test)
    ends = F.posexplode(F.sequence(F.lit(train).cast("long"), F.col("n") - validation - test, F.lit(step).cast("long")))
    out = n.select("symbol", ends.alias("split", "train_end"))
    return out.withColumns({"validation_end": F.col("train_end") + validation, "test_end": F.col("train_end") + validation + test})


def bucket_study(rows: DataFrame, factor: str, outcome: str, buckets: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Outcome by quantile bucket of a factor: edges by exact linear quantiles, equal edges dropped, right-closed, the lowest included."""
    clean = rows.filter(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    edges = clean.groupBy(*keys).agg(F.array_distinct(F.percentile(factor, [i / buckets for i in range(buckets + 1)])).alias("edges"))
    # a row of buckets + 1 numbers per key: many keys make a large table, whose size Spark checks; without keys it is one row
    met = clean.join(edges, list(keys)) if keys else clean.crossJoin(F.broadcast(edges))
    no = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(factor))), F.lit(1))
    met = met.withColumns({"bucket": no, "lower": F.element_at("edges", no), "upper": F.element_at("edges", F.least(no + 1, F.size("edges")))})
    return met.groupBy(*keys, "bucket", "lower", "upper").agg(F.count(F.lit(1)).alias("samples"), F.avg((F.col(outcome) > 0).cast("double")).alias("win_rate"), F.avg(outcome).alias("mean_outcome"))


def parameter_sweep(spark: SparkSession, values: Iterable, evaluate: Callable[[object], DataFrame], name: str = "parameter") -> DataFrame:
    """The evaluator's rows for each value, with the value; one plan, so the runs share the scheduler."""
    out = None
    for v in values:
        part = evaluate(v).withColumn(name, F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{name} double")


def select_best(results: DataFrame, key: str, name: str = "parameter", keys: tuple[str, ...] = ()) -> DataFrame:
    """The value with the largest ``key``, the smaller value on a tie."""
    return results.filter(F.col(key).isNotNull()).groupBy(*keys).agg(F.max_by(name, F.struct(key, -F.col(name))).alias(name), F.max(key).alias(key))


def summarize_r(rows: DataFrame, c: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample, win rate, mean and profit factor of finite outcomes."""
    r = F.col(c)
    ok = rows.filter(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))
    loss = F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_r"), F.when(loss > 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / loss).alias("profit_factor")
    )
