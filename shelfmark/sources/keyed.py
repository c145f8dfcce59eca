"""Tables laid out by a key: rows of a key lie in one of a fixed number of buckets, so that joins and groupings on the key need no shuffle.

Tables that are to be joined take the same number of buckets. A note beside the files (`_layout.json`) holds key, buckets and schema, so any
session can open the table; Spark's catalogue is only used to tell the reader about the buckets, under a name that is dropped again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.grain import ROWS_A_TASK, parts_for
from . import store

LAYOUT = "_layout.json"


def buckets_for(rows: int, rows_a_bucket: int = ROWS_A_TASK, least: int = 8) -> int:
    """As many buckets as `spread` makes parts, each of which one task reads."""
    return parts_for(rows, rows_a_bucket, least)


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write df in buckets of key, one file a bucket, and open it. The one shuffle of its rows is paid here."""
    spark, name = df.sparkSession, f"keyed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    store.write_text(spark, f"{path}/{LAYOUT}", json.dumps({"key": key, "buckets": buckets, "schema": json.loads(df.schema.json())}))
    return open_keyed(spark, path)


def open_keyed(spark: SparkSession, path: str) -> DataFrame:
    layout = json.loads(store.read_text(spark, f"{path}/{LAYOUT}"))
    name, schema = f"keyed_{uuid.uuid4().hex}", T.StructType.fromJson(layout["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
