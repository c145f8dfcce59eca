"""Sinks: full reload, replacement of date partitions and of keys, deletes. All are safe to run again.

Parquet has no transactions and no MERGE, so a replacement is written beside its target first and then swapped in partition
by partition; an empty replacement drops the partition, which dynamic overwrite alone would leave in place. In a swap the old
folder steps aside under a hidden name and goes last: if the driver is lost in between, `restore` puts it back, and every
write to the table starts with that. Changes of rows rewrite only the partitions that hold them.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written to scratch once and read back, for what several parts of a plan share."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that one query writes: in spark.checkpoint.dir, or under a local master without one in a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move_to_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file to a name that must be free; False if it is taken."""
    jvm = spark._jvm
    fs, p = _fs(spark, source)
    _, t = _fs(spark, target)
    p, t = fs.makeQualified(p), fs.makeQualified(t)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, t, options)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" in failure.java_exception.getClass().getName():
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    _, t = _fs(spark, target)
    fs.mkdirs(t.getParent())
    if not fs.rename(p, t):
        raise OSError(f"cannot move {source} to {target}")


def _aside(path: str) -> str:
    """Where a folder waits while its successor takes its place; readers pass over names with a leading dot."""
    parent, _, name = path.rpartition("/")
    return f"{parent}/.{name.replace('=', '-')}.before"


def restore(spark: SparkSession, path: str) -> None:
    """Finish a swap that was cut off: without a new folder the old one comes back, with it the old one goes."""
    if exists(spark, _aside(path)):
        if exists(spark, path):
            remove(spark, _aside(path))
        else:
            move(spark, _aside(path), path)


def swap(spark: SparkSession, fresh: str | None, path: str) -> None:
    """Put a written folder (None: nothing) in the place of another."""
    restore(spark, path)
    if exists(spark, path):
        move(spark, path, _aside(path))
    if fresh:
        move(spark, fresh, path)
    remove(spark, _aside(path))


def reload(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a whole table by way of a new folder, so that df may read the old one."""
    spark, fresh = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(fresh)
    swap(spark, fresh, path)


def truncate(spark: SparkSession, path: str) -> None:
    schema = spark.read.parquet(path).schema
    reload(spark.createDataFrame([], schema), path)


def replace_dates(df: DataFrame, path: str, partition: str, dates: list[date]) -> None:
    """The partitions of these dates become what df has for them; a date that df lacks is cleared. Rows of other dates are refused.

    Rows are brought together by date and rebalanced, so a date is written by as many tasks as its size needs."""
    spark, fresh = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.hint("rebalance", partition).write.partitionBy(partition).parquet(fresh)
    written = {n for n in children(spark, fresh) if n.startswith(f"{partition}=")}
    if odd := sorted(written - {f"{partition}={day}" for day in dates}):
        remove(spark, fresh)
        raise ValueError(f"dates outside the replacement: {odd}")
    for day in dates:
        name = f"{partition}={day}"
        swap(spark, f"{fresh}/{name}" if name in written else None, f"{path}/{name}")
    remove(spark, fresh)


def partition_dates(spark: SparkSession, path: str, partition: str) -> list[date]:
    """The dates for which a table has a folder with data, from names alone."""
    names = [n for n in children(spark, path) if n.startswith(f"{partition}=")]
    return sorted(date.fromisoformat(n.partition("=")[2]) for n in names if any(f.endswith(".parquet") for f in children(spark, f"{path}/{n}")))


def partition_bounds(spark: SparkSession, *tables: tuple[str, str]) -> DataFrame:
    """One row, first_day and last_day over several (path, partition column); only names of folders are read. Null without any."""
    found = [day for path, partition in tables for day in partition_dates(spark, path, partition)]
    return spark.createDataFrame([(min(found, default=None), max(found, default=None))], "first_day date, last_day date")


def edge_bounds(spark: SparkSession, path: str, partition: str, column: str) -> DataFrame:
    """first_day and last_day of a date column in a table laid out by a coarser date of it (its month, say): only the first and the last partition are read."""
    found = partition_dates(spark, path, partition)
    edges = spark.read.parquet(path).filter(F.col(partition).isin([*found[:1], *found[-1:]])) if found else spark.createDataFrame([], f"{column} date")
    return edges.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day"))


def _dates(df: DataFrame, partition: str) -> list[date]:
    return sorted(r[0] for r in df.select(F.col(partition).cast("date")).distinct().collect())


def replace_keys(df: DataFrame, path: str, keys: list[str], partition: str | None = None) -> None:
    """Delete the rows whose keys df has, then add df."""
    spark = df.sparkSession
    old, names = spark.read.parquet(path), df.select(*keys).distinct()
    if partition is None:
        reload(old.join(names, keys, "left_anti").unionByName(df), path)
        return
    touched = sorted({*_dates(old.join(names, keys, "left_semi"), partition), *_dates(df, partition)})
    kept = old.filter(F.col(partition).isin(touched)).join(names, keys, "left_anti")
    replace_dates(kept.unionByName(df), path, partition, touched)


def delete_where(spark: SparkSession, path: str, condition, partition: str | None = None) -> None:
    """Drop the rows for which condition holds; rows where it is null stay."""
    old = spark.read.parquet(path)
    if partition is None:
        reload(old.filter(~F.coalesce(condition, F.lit(False))), path)
    elif touched := _dates(old.filter(condition), partition):
        replace_dates(old.filter(F.col(partition).isin(touched) & ~F.coalesce(condition, F.lit(False))), path, partition, touched)
