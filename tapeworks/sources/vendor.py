"""Vendors' bars: a Spark data source over one file per symbol, and dispatch over several sources with fallback.

The data source plans a partition per symbol file. Filters on the symbol choose files before any is opened, filters on
time are applied while a file is read; both are what Spark pushes down (``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tapeworks.sources.bars import ALIASES, normalize

COMPARE = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class SymbolFile(InputPartition):
    symbol: str
    path: str


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class VendorBars(DataSource):
    """Folder of ``<symbol>.csv`` files under a vendor's own column names; option ``path``. Times are timestamps, all else is text."""

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def _files(self) -> list[SymbolFile]:
        fs, root = _open(self.options["path"])
        found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".csv")]
        return [SymbolFile(f.base_name.removesuffix(".csv"), f.path) for f in sorted(found, key=lambda f: f.base_name)]

    def schema(self) -> str:
        files = self._files()
        names: list[str] = []
        if files:
            fs, _ = _open(self.options["path"])
            with fs.open_input_stream(files[0].path) as f:
                names = pacsv.open_csv(f).schema.names
        at = next((a for a in ALIASES["datetime"] if a in names), None)
        return ", ".join(["symbol string", *[f"`{n}` {'timestamp_ntz' if n == at else 'string'}" for n in names if n != "symbol"]])

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options["path"], self._files(), schema)


class VendorReader(DataSourceReader):
    def __init__(self, path: str, files: list[SymbolFile], schema):
        self.path, self.files, self.names = path, files, schema.names
        self.time = next((f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"), None)
        self.bounds: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("symbol",):
                self.files = [x for x in self.files if x.symbol == f.value]
            elif isinstance(f, In) and f.attribute == ("symbol",):
                self.files = [x for x in self.files if x.symbol in f.value]
            elif type(f) in COMPARE and f.attribute == (self.time,):
                self.bounds.append((COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.files or [SymbolFile("", "")]

    def read(self, partition: SymbolFile) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        if not partition.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_stream(partition.path) as f:
            header = pacsv.open_csv(f).schema.names
        with fs.open_input_stream(partition.path) as f:
            as_text = pacsv.ConvertOptions(column_types={n: pa.string() for n in header}, strings_can_be_null=True)
            for batch in pacsv.open_csv(f, convert_options=as_text):
                out = batch.to_pandas().reindex(columns=[n for n in self.names if n != "symbol"])
                if self.time:
                    out[self.time] = pd.to_datetime(out[self.time], errors="coerce").astype("datetime64[us]")
                    for test, value in self.bounds:
                        out = out[getattr(out[self.time], test)(pd.Timestamp(value))]
                out.insert(self.names.index("symbol"), "symbol", partition.symbol)
                schema = pa.schema([(n, pa.timestamp("us") if n == self.time else pa.string()) for n in self.names])
                yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)


def vendor_bars(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)
    return spark.read.format("vendor_bars").option("path", path).load()


def _same(raw: DataFrame) -> DataFrame:
    return raw


@dataclass(frozen=True)
class Source:
    """A source of bars: what it serves, how its rows are read, and how its units become the common ones."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    asset_types: tuple[str, ...]
    periods: tuple[str, ...]
    adjusts: tuple[str, ...] = ("none",)
    units: Callable[[DataFrame], DataFrame] = field(default=_same)

    def serves(self) -> Column:
        """Whether a request (asset_type, period, adjust) is one of its capabilities."""
        return F.col("asset_type").isin(*self.asset_types) & F.col("period").isin(*self.periods) & F.col("adjust").isin(*self.adjusts)


def capabilities(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(asset_type, period, adjust, sources in order) of all that any source serves."""
    rows: dict[tuple[str, str, str], list[str]] = {}
    for s in sources:
        for key in [(a, p, j) for a in s.asset_types for p in s.periods for j in s.adjusts]:
            rows.setdefault(key, []).append(s.name)
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "asset_type string, period string, adjust string, sources array<string>")


def fetch(spark: SparkSession, wanted: DataFrame, sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """Bars for ``wanted`` (symbol, asset_type, period, adjust, start, end) and what no source gave.

    A symbol comes whole from the first source, in order, that serves such requests and has valid bars of its range;
    the bars name it in ``source``. The next source is asked only for what is left: an anti join on the symbols that
    were served, so that its scan keeps few rows. The rest has the reason ``unsupported`` or ``empty``.
    """
    left, out = wanted, None
    for s in sources:
        asked = left.filter(s.serves()).select("symbol", "start", "end")
        bars = normalize(s.units(s.read(spark)).join(asked.select("symbol").distinct(), "symbol", "left_semi"))
        day = F.to_date("datetime")
        bars = bars.join(asked, "symbol").filter((day >= F.col("start")) & (day <= F.col("end"))).drop("start", "end").withColumn("source", F.lit(s.name))
        left = left.join(bars.select("symbol").distinct(), "symbol", "left_anti")
        out = bars if out is None else out.unionByName(bars)
    any_serves = F.lit(False)
    for s in sources:
        any_serves = any_serves | s.serves()
    return out, left.withColumn("reason", F.when(any_serves, "empty").otherwise("unsupported"))
