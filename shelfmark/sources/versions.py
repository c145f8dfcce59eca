"""Versions of a set of tables: what one run writes appears at once, or not at all.

Written files are never changed. A write of a table, or of some of its partitions, goes to a folder of its own, `<table>/write=<id>`; a
manifest lists, for each table of a version, the folders that make it up. A change collects writes beside the last version and ends by
renaming its manifest to the next number, which no other change can take as well: that one rename is the pointer, and everything before it
can be cut off without a trace for readers. A reader holds a version and goes on reading its files while the next is written; `expire`
removes what no kept version lists, leftovers of broken runs included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from types import TracebackType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.watch import Watch
from . import store


#: Thousands of small folders are listed by so many tasks instead of one each.
LISTING_TASKS = "64"


class Conflict(Exception):
    """Another change was committed since this one began."""


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class View:
    """The tables of one version. Version 0 is empty."""

    def __init__(self, spark: SparkSession, root: str, version: int, tables: dict[str, dict]):
        self.spark, self.root, self.version, self.tables = spark, root, version, tables

    def has(self, name: str) -> bool:
        return name in self.tables

    def folders(self, name: str) -> dict[str, str]:
        """Partition folder (the empty string without partitions) -> the path that holds it."""
        return {part: f"{self.root}/{name}/{write}/{part}".rstrip("/") for part, write in self.tables[name]["parts"].items()}

    def dates(self, name: str) -> list[date]:
        """The partitions of a table partitioned by date, from the manifest alone."""
        return sorted(date.fromisoformat(part.partition("=")[2]) for part in self.tables[name]["parts"] if part)

    def read(self, name: str) -> DataFrame:
        entry = self.tables[name]
        schema = T.StructType.fromJson(entry["schema"])
        paths = list(self.folders(name).values())
        if not paths:
            return self.spark.createDataFrame([], schema)
        with _set(self.spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING_TASKS):
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)


class Change(View):
    """A version in the making: reads see its own writes over the version it began from."""

    def __init__(self, base: View):
        super().__init__(base.spark, base.root, base.version, {n: dict(t) for n, t in base.tables.items()})
        self.written: list[str] = []
        self.done = False

    def _write(self, name: str, df: DataFrame, partition: str | None, watch: dict[str, Column] | None) -> tuple[str, list[str], dict[str, int]]:
        """Write df to a folder of its own: the folder, its partitions, and for each condition of watch the rows that met it, counted while writing."""
        write = f"write={uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{write}"
        self.written.append(path)
        seen = Watch(watch)
        df = seen.on(df)
        # tasks may put files in place themselves, as no reader knows the folder before the manifest is there
        writer = df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return write, [f for f in store.children(self.spark, path) if f.startswith(f"{partition}=")] if partition else [""], seen.counts()

    def put(self, name: str, df: DataFrame, partition: str | None = None, watch: dict[str, Column] | None = None, shares: int = 1) -> dict[str, int]:
        """The whole table becomes df. Rows are dealt out by partition, each of which `shares` tasks write; all tasks of a shuffle take part, however
        small the partitions are."""
        dealt = df
        if partition:
            share = [F.pmod(F.xxhash64(*df.columns), F.lit(shares))] if shares > 1 else []
            dealt = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")) * shares, partition, *share)
        write, parts, counts = self._write(name, dealt, partition, watch)
        self.tables[name] = {"schema": json.loads(df.schema.json()), "partition": partition, "parts": dict.fromkeys(parts, write)}
        return counts

    def put_dates(self, name: str, df: DataFrame, partition: str, dates: list[date], watch: dict[str, Column] | None = None) -> dict[str, int]:
        """The partitions of these dates become what df has for them, and are gone where it has nothing; rows of other dates are refused.

        Rows are brought together by date and rebalanced: a small date is one file, a large one is written by as many tasks as its size needs."""
        if not self.has(name):
            self.put(name, df.limit(0), partition)
        write, parts, counts = self._write(name, df.hint("rebalance", partition), partition, watch)
        allowed = {f"{partition}={d}" for d in dates}
        if odd := sorted(set(parts) - allowed):
            raise ValueError(f"dates outside the replacement: {odd}")
        kept = {part: w for part, w in self.tables[name]["parts"].items() if part not in allowed}
        self.tables[name] = {**self.tables[name], "parts": {**kept, **dict.fromkeys(parts, write)}}
        return counts

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)

    def commit(self) -> int:
        number = self.version + 1
        text = json.dumps({"version": number, "tables": self.tables}, indent=1)
        fresh = f"{self.root}/_versions/.{uuid.uuid4().hex}.json"
        store.write_text(self.spark, fresh, text)
        if not store.move_to_new(self.spark, fresh, f"{self.root}/_versions/{number:012d}.json"):
            store.remove(self.spark, fresh)
            raise Conflict(f"version {number} was committed by another change")
        self.done = True
        return number

    def abort(self) -> None:
        for path in self.written:
            store.remove(self.spark, path)
        self.done = True

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None:
            try:
                self.commit()
            except Conflict:
                self.abort()
                raise
        elif not self.done:
            self.abort()


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        return sorted(int(f[:12]) for f in store.children(self.spark, f"{self.root}/_versions") if f.endswith(".json") and f[:12].isdigit())

    def at(self, version: int | None = None) -> View:
        """A version, the last one if no number is given."""
        if version is None:
            version = max(self.numbers(), default=0)
        if version == 0:
            return View(self.spark, self.root, 0, {})
        return View(self.spark, self.root, version, json.loads(store.read_text(self.spark, f"{self.root}/_versions/{version:012d}.json"))["tables"])

    def change(self) -> Change:
        """To be used with `with`: leaving it commits, an exception leaves the last version as it is."""
        return Change(self.at())

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all but the last versions and every written folder that none of them lists. No change may be under way."""
        numbers = self.numbers()
        views = [self.at(n) for n in numbers[-keep:]]
        listed = {f"{name}/{write}" for v in views for name, entry in v.tables.items() for write in entry["parts"].values()}
        for n in numbers[:-keep]:
            store.remove(self.spark, f"{self.root}/_versions/{n:012d}.json")
        gone = []
        for name in store.children(self.spark, self.root):
            if name != "_versions":
                gone += [f"{name}/{w}" for w in store.children(self.spark, f"{self.root}/{name}") if w.startswith("write=") and f"{name}/{w}" not in listed]
        for folder in gone:
            store.remove(self.spark, f"{self.root}/{folder}")
        return gone
