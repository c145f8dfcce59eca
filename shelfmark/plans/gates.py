"""Gates: queries that return offending rows. A stop gate with rows ends the run before anything is published; a warning never does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.dates import DateWindow, cut
from ..operators.grain import duplicate_keys, mismatches
from ..operators.watch import Watch
from .layers import LINE_GRAIN, LINE_ORDER


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique_grain(df: DataFrame, columns: list[str]) -> DataFrame:
    return duplicate_keys(df, columns)


def unique(df: DataFrame, column: str) -> DataFrame:
    """Null keys are not duplicates."""
    return duplicate_keys(df.filter(F.col(column).isNotNull()), [column])


def not_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values outside the closed list, with their number of rows."""
    return df.filter(~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def freshness(orders: DataFrame, traffic: DataFrame, run_date: date | None = None) -> DataFrame:
    """(table_name, day) for each of the two tables with no row on the run date (or on the latest day that either has)."""
    spans = orders.agg(F.max("order_date").alias("a")).crossJoin(traffic.agg(F.max("traffic_date").alias("b")))  # one row
    target = spans.select(F.lit(run_date).cast("date").alias("day") if run_date else F.greatest("a", "b").alias("day"))
    missing = []
    for name, df, column in (("orders", orders, "order_date"), ("store_traffic", traffic, "traffic_date")):
        days = df.select(F.col(column).alias("day")).distinct()
        missing.append(target.join(days, "day", "left_anti").select(F.lit(name).alias("table_name"), "day"))
    return missing[0].unionByName(missing[1])


def lines_match_raw(raw_items: DataFrame, raw_orders: DataFrame, lines: DataFrame, window: DateWindow | None) -> DataFrame:
    """Live lines and amounts by store and day, once from the raw layer by a way of their own and once from the intermediate layer."""
    copies = W.partitionBy(*LINE_GRAIN).orderBy(*LINE_ORDER)
    again = raw_items.withColumn("copy", F.row_number().over(copies)).filter("copy = 1").select("order_id", "line_amount")
    live = cut(raw_orders, "order_date", window).filter("status <> 'cancelled'").select("order_id", "store_id", "order_date")
    key = ["store_id", "order_date"]
    totals = [F.count("*").alias("n_lines"), F.sum("line_amount").alias("gross")]
    raw = again.join(live, "order_id").groupBy(*key).agg(*totals)
    built = cut(lines, "order_date", window).filter(~F.col("is_cancelled")).groupBy(*key).agg(*totals)
    return mismatches(raw, built, key, ["n_lines", "gross"])


def status_agreement(orders: DataFrame, cancellations: DataFrame, settle_days: int = 2) -> DataFrame:
    """Cancelled orders without a cancellation (only once they had time to settle), and cancellations of live orders."""
    edge = orders.agg(F.date_sub(F.max("order_date"), settle_days).alias("edge"))
    due = orders.filter("is_cancelled").crossJoin(F.broadcast(edge)).filter("order_date <= edge")  # one row
    lone = due.join(cancellations.select("order_id"), "order_id", "left_anti").select("order_id", F.lit("cancelled without a row").alias("violation"))
    alive = cancellations.join(orders.filter(~F.col("is_cancelled")).select("order_id"), "order_id", "left_semi").select("order_id", F.lit("row of a live order").alias("violation"))
    return lone.unionByName(alive)


def line_dates(items: DataFrame, orders: DataFrame) -> DataFrame:
    heads = orders.select("order_id", F.col("order_date").alias("head_date"))
    return items.join(heads, "order_id").filter("order_date <> head_date").select("order_id", "line_no", "order_date", "head_date")


def live_returns(returns: DataFrame) -> DataFrame:
    return returns.filter("is_cancelled").select("return_id", "order_id", "order_date")


@dataclass(frozen=True)
class Gate:
    name: str
    rows: Callable[[], DataFrame]
    stops: bool = True


class GateFailed(Exception):
    pass


def enforce(gates: list[Gate]) -> dict[str, int]:
    """Run gates; raise on the first stop gate with rows. Returns the rows of each, so that a warning can be shown."""
    found = {}
    for gate in gates:
        found[gate.name] = gate.rows().count()
        if gate.stops and found[gate.name]:
            raise GateFailed(f"{gate.name}: {found[gate.name]} rows")
    return found


@dataclass(frozen=True)
class Shape:
    """The generic gates of one table; parents maps a column to the table that must hold its values in a column of that name."""

    not_null: tuple[str, ...] = ()
    not_negative: tuple[str, ...] = ()
    values: dict[str, list[str]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    grain: tuple[str, ...] = ()
    parents: dict[str, str] = field(default_factory=dict)


#: The 87 generic gates of SURVEY section 2.11.
DECLARED: dict[str, Shape] = {
    "stg_stores": Shape(not_null=("store_id", "opened_on"), unique=("store_id",)),
    "stg_orders": Shape(
        not_null=("order_id", "store_id", "order_date", "is_cancelled", "is_offline"), unique=("order_id",), parents={"store_id": "stg_stores"},
        values={"channel": ["offline", "web", "app"], "status": ["placed", "cancelled"]},
    ),
    "stg_order_items": Shape(
        not_null=("order_id", "line_no", "sku", "quantity", "line_amount", "source_copies"), not_negative=("quantity",), grain=("order_id", "line_no"), parents={"order_id": "stg_orders"},
    ),
    "stg_returns": Shape(not_null=("return_id", "order_id", "order_date", "returned_date", "delay_days"), not_negative=("delay_days",), unique=("return_id",), parents={"order_id": "stg_orders"}),
    "stg_cancellations": Shape(not_null=("cancellation_id", "order_id", "cancelled_date", "reason"), unique=("cancellation_id",), parents={"order_id": "stg_orders"}),
    "stg_store_traffic": Shape(not_null=("store_id", "traffic_date", "visitors"), not_negative=("visitors",), grain=("store_id", "traffic_date"), parents={"store_id": "stg_stores"}),
    "order_lines": Shape(not_null=("order_date", "store_id", "is_cancelled", "quantity", "line_amount"), not_negative=("quantity",), grain=("order_id", "line_no")),
    "returns": Shape(not_null=("return_id", "store_id", "is_cancelled", "order_date", "returned_date", "delay_days"), not_negative=("delay_days",), unique=("return_id",)),
    "spine": Shape(not_null=("store_id", "calendar_date"), grain=("store_id", "calendar_date")),
    "sales": Shape(not_null=("store_id", "order_date", "has_orders", "returns_arrived_amount"), not_negative=("returns_arrived_amount",), grain=("store_id", "order_date")),
    "conversion": Shape(not_null=("store_id", "traffic_date", "has_traffic"), not_negative=("visitors", "orders_offline"), grain=("store_id", "traffic_date")),
    "trend": Shape(not_null=("store_id", "order_date"), grain=("store_id", "order_date")),
    "quality": Shape(
        not_null=("store_id", "flag_date", "check_name", "reason"), grain=("store_id", "flag_date", "check_name"),
        values={"check_name": ["conversion_above_threshold", "return_outside_window", "orders_partition_missing", "traffic_partition_missing"]},
    ),
    "revisions": Shape(
        not_null=("store_id", "order_date", "revised_at", "version_no", "reason"), grain=("store_id", "order_date", "version_no"),
        values={"reason": ["late return", "raw layer rebuilt", "order mix changed", "other"]},
    ),
}


def single_row(table: str) -> dict[str, Column]:
    """The declared gates of a table that look at one row at a time, with the condition of a bad row."""
    shape = DECLARED[table]
    bad = {f"{table}.{c} not_null": F.col(c).isNull() for c in shape.not_null}
    bad |= {f"{table}.{c} not_negative": F.col(c) < 0 for c in shape.not_negative}
    return bad | {f"{table}.{c} accepted_values": ~F.col(c).isin(v) for c, v in shape.values.items()}


@dataclass(frozen=True)
class Measured:
    """A written table and the counts of its single-row gates, which were taken while it was written."""

    df: DataFrame
    counts: dict[str, int]


def measure(table: str, df: DataFrame | Measured, known: dict[str, DataFrame]) -> dict[str, int]:
    """Rows that break each declared gate of a table, from one pass over it.

    A parent's keys are joined as a flag, so that a missing parent is seen in the row like a null; all that can be seen in a row is counted by
    metrics that ride on the grouping by key. (If an executor is lost under that grouping, its rows may be counted twice; none stays none.)
    A table that was measured while being written is only grouped. A gate on a column that the table lacks is an error."""
    shape, counts = DECLARED[table], {}
    if isinstance(df, Measured):
        df, counts = df.df, df.counts
    named = {*shape.not_null, *shape.not_negative, *shape.values, *shape.unique, *shape.grain, *shape.parents}
    if lacking := sorted(named - set(df.columns)):
        raise ValueError(f"{table} lacks {lacking}, which its gates look at")
    watch = {} if counts else single_row(table)
    for c, parent in shape.parents.items():
        keys = known[parent].select(F.col(c).alias(f"_{c}"), F.lit(True).alias(f"_known_{c}")).distinct()
        df = df.join(keys, F.col(c) == F.col(f"_{c}"), "left")
        watch[f"{table}.{c} relationship"] = F.col(c).isNotNull() & F.col(f"_known_{c}").isNull()
    seen = Watch(watch)
    df = seen.on(df)
    keyed = {f"{table}.{c} unique": unique(df, c) for c in shape.unique} | ({f"{table} unique_grain": unique_grain(df, list(shape.grain))} if shape.grain else {})
    found = {name: rows.count() for name, rows in keyed.items()}
    return counts | seen.counts() | found


def count_declared(tables: dict[str, DataFrame | Measured], known: dict[str, DataFrame] | None = None) -> DataFrame:
    """(gate, n_rows) of the declared gates of these tables, none of them a stop; parents are looked up in tables and known."""
    known = {**(known or {}), **{n: t.df if isinstance(t, Measured) else t for n, t in tables.items()}}
    found = [row for name, df in tables.items() for row in measure(name, df, known).items()]
    return next(iter(known.values())).sparkSession.createDataFrame(found, "gate string, n_rows long")


def enforce_declared(tables: dict[str, DataFrame | Measured]) -> dict[str, int]:
    """Run the declared gates of these tables (parents must be among them), all of them stops, with one pass a table."""
    found, known = {}, {n: t.df if isinstance(t, Measured) else t for n, t in tables.items()}
    for table, df in tables.items():
        found |= (counts := measure(table, df, known))
        for name, n in counts.items():
            if n:
                raise GateFailed(f"{name}: {n} rows")
    return found
