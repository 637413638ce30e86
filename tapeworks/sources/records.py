"""Rows as JSON records and back: for stores of payloads, and for whoever reads results as documents.

Records keep what a table of one schema can't: rows of different kinds side by side. Coming back, each is parsed once as
a variant and its fields are taken with the types of a schema; a record that is no JSON object, or a field that is there
but can't be read as its type, goes to a channel of its own with the reason, and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe(c: Column, kind: T.DataType, digits: int) -> Column:
    """A value as JSON can hold it: doubles rounded, null where not finite; times in ISO form; nested values likewise."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c.cast("double"), digits))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # microseconds where there are any
        return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: safe(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    return c


def export(rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """(keys, payload): all other columns as one JSON object, nulls included."""
    rest = [f for f in rows.schema.fields if f.name not in keys]
    body = F.struct(*[safe(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in rest])
    return rows.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def rebuild(records: DataFrame, schema: str | T.StructType, keys: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the records' fields with the types of ``schema``, and (keys, payload, reason) of those that can't be read.

    Absent and null fields are null; fields that the schema doesn't name are left aside. Repeated records stay repeated.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    # one pass: parsed once, each field taken once; both channels are filters on it
    v = records.select(*keys, payload, F.try_parse_json(payload).alias("__v"))
    path = lambda f: f"$['{f.name}']"
    raw = [F.try_variant_get("__v", path(f), "variant").alias(f"__raw_{i}") for i, f in enumerate(fields)]
    taken = [F.try_variant_get("__v", path(f), f.dataType.simpleString()).alias(f"__of_{i}") for i, f in enumerate(fields)]
    v = v.select("*", *raw, *taken)
    wrong = F.array_compact(F.array(*[F.when(F.col(f"__of_{i}").isNull() & F.col(f"__raw_{i}").isNotNull() & ~F.is_variant_null(F.col(f"__raw_{i}")), F.lit(f.name)) for i, f in enumerate(fields)]))
    is_object = F.schema_of_variant("__v").startswith("OBJECT")
    reason = F.when(F.col("__v").isNull() | ~is_object, "no object").when(F.size(wrong) > 0, F.concat(F.lit("unreadable: "), F.array_join(wrong, ", ")))
    v = v.withColumn("__reason", reason)
    rows = v.filter("__reason is null").select(*keys, *[F.col(f"__of_{i}").alias(f.name) for i, f in enumerate(fields)])
    return rows, v.filter("__reason is not null").select(*keys, payload, F.col("__reason").alias("reason"))
