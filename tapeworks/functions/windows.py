"""Window helpers. A bar table has columns symbol, datetime and pos (0 for a symbol's first bar)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SYMBOL = "symbol"


def ordered() -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy("datetime")


def trailing(n: int, ago: int = 0) -> WindowSpec:
    """The ``n`` bars that end ``ago`` bars before the current one."""
    return ordered().rowsBetween(-(n - 1) - ago, -ago)


def full(agg, c: Column, n: int, ago: int = 0) -> Column:
    """``agg`` of the last ``n`` values; null unless there are as many."""
    w = trailing(n, ago)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(ordered())


def lead(c: Column | str, n: int = 1) -> Column:
    return F.lead(c, n).over(ordered())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def swing(c: Column, width: int, high: bool) -> Column:
    """Whether a value is the only extreme of the bars ``width`` before to ``width`` after it."""
    w = ordered().rowsBetween(-width, width)
    around = F.collect_list(c).over(w)
    best = (F.max if high else F.min)(c).over(w)
    return flag((F.size(around) == 2 * width + 1) & (c == best) & (F.size(F.filter(around, lambda x: x == best)) == 1))
