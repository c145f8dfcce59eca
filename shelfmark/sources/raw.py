"""The raw layer: schemas, partition columns and column notes of the six tables, and readers for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    schema: T.StructType
    partition: str | None
    notes: dict[str, str]


def _source(partition: str | None, *columns: tuple[str, T.DataType, bool, str]) -> Source:
    return Source(T.StructType([T.StructField(n, t, null) for n, t, null, _ in columns]), partition, {n: note for n, _, _, note in columns})


_I, _L, _S, _D, _TS = T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.TimestampNTZType()
_PRICE, _MONEY = T.DecimalType(10, 2), T.DecimalType(12, 2)

#: No keys and no uniqueness: duplicated exports must load.
SOURCES: dict[str, Source] = {
    "stores": _source(None, ("store_id", _I, False, "store"), ("store_code", _S, False, "short code"), ("city", _S, False, "city"), ("store_format", _S, False, "small, medium or large"), ("opened_on", _D, False, "first trading day")),
    "orders": _source("order_date", ("order_id", _L, False, "order"), ("store_id", _I, False, "store that sold"), ("order_ts", _TS, False, "moment of purchase"), ("order_date", _D, False, "day of purchase"), ("channel", _S, False, "offline, web or app"), ("status", _S, False, "placed or cancelled"), ("customer_id", _L, True, "known customer, if any")),
    "order_items": _source("order_date", ("order_id", _L, False, "order"), ("order_date", _D, False, "day of purchase, repeated here"), ("line_no", _I, False, "line in the order"), ("sku", _S, False, "article"), ("quantity", _I, False, "units"), ("unit_price", _PRICE, False, "price of a unit"), ("line_amount", _MONEY, False, "amount of the line")),
    "returns": _source("returned_date", ("return_id", _L, False, "return"), ("order_id", _L, False, "order"), ("order_date", _D, False, "day of purchase"), ("line_no", _I, False, "line in the order"), ("returned_date", _D, False, "day the return came in"), ("quantity", _I, False, "units"), ("returned_amount", _MONEY, False, "amount paid back")),
    "cancellations": _source("cancelled_date", ("cancellation_id", _L, False, "cancellation"), ("order_id", _L, False, "order"), ("order_date", _D, False, "day of purchase"), ("cancelled_date", _D, False, "day of cancellation"), ("reason", _S, False, "stated reason")),
    "store_traffic": _source("traffic_date", ("store_id", _I, False, "store"), ("traffic_date", _D, False, "day"), ("visitors", _I, False, "people counted at the door")),
}


def read(spark: SparkSession, root: str, name: str, window=None) -> DataFrame:
    """A raw table; window (a DateWindow) becomes a partition filter on the table's date column."""
    source = SOURCES[name]
    df = spark.read.schema(source.schema).parquet(f"{root}/{name}")
    return df if window is None or source.partition is None else window.cut(df, source.partition)


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A raw table from CSV text with a header: typed by the registry, `t` and `f` read as booleans, empty fields as null."""
    schema = SOURCES[name].schema
    text = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    value = {T.BooleanType(): lambda c: F.when(F.col(c) == "t", True).when(F.col(c) == "f", False)}
    return text.select(*[value.get(f.dataType, lambda c, t=f.dataType: F.col(c).cast(t))(f.name).alias(f.name) for f in schema])


def undocumented(tables: dict[str, DataFrame], notes: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """(table, column) pairs that no note describes."""
    return [(t, c) for t, df in tables.items() for c in df.columns if not notes.get(t, {}).get(c)]


def dictionary(tables: dict[str, DataFrame], notes: dict[str, dict[str, str]]) -> str:
    """A Markdown dictionary of the tables; fails if a column is not described."""
    if gaps := undocumented(tables, notes):
        raise ValueError(f"not described: {gaps}")
    parts = []
    for name, df in tables.items():
        parts += [f"## {name}\n", "| column | type | note |", "|---|---|---|"]
        parts += [f"| {f.name} | {f.dataType.simpleString()} | {notes[name][f.name]} |" for f in df.schema]
        parts.append("")
    return "\n".join(parts)
