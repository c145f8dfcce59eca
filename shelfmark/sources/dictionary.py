"""The data dictionary: what every table and column means, entered in Spark's catalogue, checked there and written as Markdown.

Entering a table copies nothing: the catalogue learns where its files lie, each partition with its own folder, so a version of the built
tables can be asked for by name. What the catalogue says is compared with what is declared here, and a column that no note
describes stops the dictionary. Only names, types and notes pass through the driver; how far columns are filled is counted on Spark,
in one pass a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import raw, store
from .versions import View


class Column(NamedTuple):
    name: str
    type: str
    note: str


class Table(NamedTuple):
    layer: str
    note: str
    columns: tuple[Column, ...]


class Drift(NamedTuple):
    """A column that is missing, extra, of another type, or not described."""

    table: str
    column: str
    kind: str
    declared: str | None
    found: str | None


#: Columns that mean the same in every table.
COMMON = {
    "store_id": "store", "order_id": "order", "line_no": "line in the order", "order_date": "day of purchase", "traffic_date": "day", "calendar_date": "day", "returned_date": "day the return came in",
    "channel": "offline, web or app", "is_cancelled": "the order was cancelled", "is_offline": "sold in the shop", "sku": "article", "quantity": "units", "unit_price": "price of a unit", "line_amount": "amount of the line",
    "source_copies": "rows of the raw layer that stand behind this one", "return_id": "return", "returned_amount": "amount paid back", "delay_days": "days from purchase on",
    "has_orders": "the export of orders has this day; false is not the same as no sales", "has_traffic": "the counters have this day", "visitors": "people counted at the door; null without a reading",
    "orders_offline": "orders in the shop that stand; null without an export", "conversion": "orders in the shop by visitors; null where either is missing or nobody came",
    "orders_count": "orders that stand", "orders_cancelled_count": "orders that were cancelled", "lines_count": "lines of orders that stand", "units_sold": "units of orders that stand",
    "revenue_gross": "amount of the lines of orders that stand", "returns_amount": "amount paid back for purchases of this day, whenever it came back", "returns_arrived_amount": "amount paid back on this day, whenever it was bought",
    "revenue_net": "gross less what came back for purchases of this day", "revenue_net_avg_7d": "mean of seven days up to this one; null if one of them has no figure",
    "flag_date": "day that is marked", "check_name": "check that marks it", "reason": "why", "measured_value": "figure that was found", "threshold_value": "figure that it is held against, if any",
    "scd_id": "version", "updated_at": "when the version was made", "valid_from": "first moment it was the published one", "valid_to": "moment another took its place; null while it stands", "closed_on": "day it was closed",
    "revised_at": "when the published figure moved", "version_no": "which version of this store and day, from 2 on", "revenue_net_was": "net revenue published before", "revenue_net_became": "net revenue published since",
    "revenue_net_delta": "by how much it moved", "returns_amount_was": "returns published before", "returns_amount_became": "returns published since",
}


def _table(layer: str, note: str, columns: str, **own: str) -> Table:
    """Columns as "name type, name type"; own notes go before the common ones."""
    pairs = [c.strip().split(" ") for c in columns.split(";")]
    return Table(layer, note, tuple(Column(n, t, own.get(n) or COMMON.get(n, "")) for n, t in pairs))


def _staged(name: str, note: str, **added: str) -> Table:
    """A staging table: the raw one's columns, and those it adds as name="type"."""
    source = raw.SOURCES[name]
    had = [Column(f.name, f.dataType.simpleString(), source.notes[f.name]) for f in source.schema]
    return Table("staging", note, (*had, *(Column(n, t, COMMON[n]) for n, t in added.items())))


RAW_NOTES = {
    "stores": "the shops", "orders": "heads of orders as exported", "order_items": "lines of orders as exported, some of them more than once", "returns": "returns as they came in",
    "cancellations": "cancelled orders", "store_traffic": "readings of the counters at the doors",
}
_VERSION = "store_id int; order_date date; orders_count bigint; revenue_gross decimal(22,2); returns_amount decimal(22,2); revenue_net decimal(22,2); scd_id string; updated_at timestamp_ntz; valid_from timestamp_ntz; valid_to timestamp_ntz"

DECLARED: dict[str, Table] = {
    **{f"raw_{name}": Table("raw", RAW_NOTES[name], tuple(Column(f.name, f.dataType.simpleString(), source.notes[f.name]) for f in source.schema)) for name, source in raw.SOURCES.items()},
    "stg_stores": _staged("stores", "the shops"),
    "stg_orders": _staged("orders", "heads of orders with their state", is_cancelled="boolean", is_offline="boolean"),
    "stg_order_items": _staged("order_items", "one row a line, however often it was exported", source_copies="bigint"),
    "stg_returns": _staged("returns", "returns with their delay", delay_days="int"),
    "stg_cancellations": _staged("cancellations", "cancelled orders with their delay", delay_days="int"),
    "stg_store_traffic": _staged("store_traffic", "readings of the counters"),
    "order_lines": _table("intermediate", "lines with store and state of their order; a line without an order stays, with nulls", "order_id bigint; line_no int; order_date date; store_id int; channel string; is_cancelled boolean; is_offline boolean; sku string; quantity int; unit_price decimal(10,2); line_amount decimal(12,2); source_copies bigint"),
    "returns": _table("intermediate", "returns with the store of their order; they belong to the day of purchase", "return_id bigint; order_id bigint; line_no int; store_id int; is_cancelled boolean; order_date date; returned_date date; delay_days int; quantity int; returned_amount decimal(12,2)"),
    "spine": _table("intermediate", "every store on every day from its opening on", "store_id int; calendar_date date"),
    "sales": _table("marts", "revenue of a store and day", "store_id int; order_date date; has_orders boolean; orders_count bigint; orders_cancelled_count bigint; lines_count bigint; units_sold bigint; revenue_gross decimal(22,2); returns_amount decimal(22,2); returns_arrived_amount decimal(22,2); revenue_net decimal(22,2)"),
    "conversion": _table("marts", "visitors and orders in the shop of a store and day", "store_id int; traffic_date date; has_traffic boolean; has_orders boolean; visitors int; orders_offline bigint; conversion double"),
    "trend": _table("marts", "net revenue and its mean of seven days", "store_id int; order_date date; revenue_net decimal(22,2); revenue_net_avg_7d double"),
    "quality": _table("marts", "marks on numbers that are published all the same", "store_id int; flag_date date; check_name string; reason string; measured_value double; threshold_value double"),
    "open_versions": _table("snapshots", "the figures that stand", _VERSION),
    "closed_versions": _table("snapshots", "figures that others took the place of", f"{_VERSION}; closed_on date"),
    "revisions": _table("marts", "every published figure that moved", "store_id int; order_date date; revised_at timestamp_ntz; version_no bigint; revenue_net_was decimal(22,2); revenue_net_became decimal(22,2); revenue_net_delta decimal(23,2); returns_amount_was decimal(22,2); returns_amount_became decimal(22,2); reason string"),
}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def enter(spark: SparkSession, database: str, name: str, schema: T.StructType, folders: Mapping[str, str], partition: str | None = None, declared: Mapping[str, Table] = DECLARED) -> None:
    """Make files known to the catalogue as database.name, with notes. Folders are {"": path}, or {"column=value": path} of a partitioned table.

    A table of this name is replaced in the catalogue; its files stay."""
    told = declared.get(name, Table("", "", ()))
    notes = {c.name: c.note for c in told.columns}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()} COMMENT {quoted(notes.get(f.name, ''))}" for f in schema)
    by, at = (f" PARTITIONED BY (`{partition}`)", None) if partition else ("", folders.get(""))
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    # a partitioned table has no files of its own: its location is a name under its parts' table, and each part says where it lies
    home = at or f"{next(iter(folders.values())).rpartition('/')[0]}/_entered" if folders else store.scratch(spark, "entered")
    spark.sql(f"CREATE TABLE `{database}`.`{name}` ({columns}) USING parquet{by} COMMENT {quoted(told.note)} LOCATION {quoted(home)}")
    parts = [(part.partition("=")[2], path) for part, path in folders.items()] if partition else []
    for low in range(0, len(parts), 500):
        some = " ".join(f"PARTITION (`{partition}` = {quoted(value)}) LOCATION {quoted(path)}" for value, path in parts[low : low + 500])
        spark.sql(f"ALTER TABLE `{database}`.`{name}` ADD {some}")


def enter_version(view: View, database: str, declared: Mapping[str, Table] = DECLARED) -> list[str]:
    """All tables of a version, by their folders."""
    for name in view.tables:
        folders = view.folders(name)
        partition = next((part.partition("=")[0] for part in folders if part), None)
        enter(view.spark, database, name, view.read(name).schema, folders, partition, declared)
    return list(view.tables)


def entered(spark: SparkSession, database: str) -> dict[str, Table]:
    """What the catalogue says of a database's tables: notes, columns and types. Temporary views are not part of it."""
    found = {}
    for table in spark.catalog.listTables(database):
        if not table.isTemporary:
            columns = spark.catalog.listColumns(f"`{database}`.`{table.name}`")
            found[table.name] = Table("", table.description or "", tuple(Column(c.name, c.dataType, c.description or "") for c in columns))
    return found


def shape(df: DataFrame, name: str, declared: Mapping[str, Table] = DECLARED) -> Table:
    """A DataFrame as the dictionary sees it, with the notes declared for it."""
    told = declared.get(name, Table("", "", ()))
    notes = {c.name: c.note for c in told.columns}
    return Table(told.layer, told.note, tuple(Column(f.name, f.dataType.simpleString(), notes.get(f.name, "")) for f in df.schema))


def drift(found: Mapping[str, Table], declared: Mapping[str, Table] = DECLARED) -> list[Drift]:
    """Where tables differ from what is declared, by table and column. Only tables that were found are looked at."""
    out = []
    for name, table in found.items():
        want = {c.name: c for c in declared[name].columns} if name in declared else {}
        have = {c.name: c for c in table.columns}
        out += [Drift(name, c, "missing", want[c].type, None) for c in want.keys() - have.keys()]
        for c, column in have.items():
            if c not in want:
                out.append(Drift(name, c, "extra", None, column.type))
            elif column.type != want[c].type:
                out.append(Drift(name, c, "type", want[c].type, column.type))
            elif not column.note:
                out.append(Drift(name, c, "not described", want[c].type, column.type))
    return sorted(out, key=lambda d: (d.table, d.column))


def markdown(found: Mapping[str, Table], declared: Mapping[str, Table] = DECLARED) -> str:
    """The dictionary as Markdown, layer by layer; fails if a table or a column is not described."""
    gaps = [name for name, table in found.items() if not table.note] + [f"{name}.{c.name}" for name, table in found.items() for c in table.columns if not c.note]
    if gaps:
        raise ValueError(f"not described: {', '.join(sorted(gaps))}")
    layer = {name: table.layer or (declared[name].layer if name in declared else "") for name, table in found.items()}
    order = list(dict.fromkeys(t.layer for t in declared.values()))
    parts, last = [f"# Dictionary\n\n{len(found)} tables, {sum(len(t.columns) for t in found.values())} columns.\n"], None
    for name in sorted(found, key=lambda n: (order.index(layer[n]) if layer[n] in order else len(order), n)):
        if layer[name] != last:
            parts.append(f"## {layer[name] or 'other'}\n")
            last = layer[name]
        parts += [f"### {name}\n", f"{found[name].note}\n", "| column | type | note |", "|---|---|---|"]
        parts += [f"| {c.name} | {c.type} | {c.note.replace('|', chr(92) + '|')} |" for c in found[name].columns] + [""]
    return "\n".join(parts)


def filled(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row a column: column, n_rows, n_filled (rows in which it is not null). One pass, combined before the shuffle."""
    names = list(columns) if columns is not None else df.columns
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n_filled")) for c in names]).alias("each"))
    return counted.select("n_rows", F.inline("each")).select("column", "n_rows", "n_filled")
