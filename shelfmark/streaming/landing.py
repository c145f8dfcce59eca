"""A streaming front end of the raw layer: micro-batches of new rows rebuild the date partitions that they touch.

The batch pipeline does not need it. A partition's rows are read back, joined by the new ones and swapped in, so a batch
that runs again after a failure must not add its rows twice: rows that are already there (all columns equal, null being
equal to null) are not added again. True duplicates of an export inside one batch stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store
from ..sources.raw import SOURCES


def land_batch(batch: DataFrame, root: str, name: str) -> None:
    spark, source, path = batch.sparkSession, SOURCES[name], f"{root}/raw/{name}"
    columns = source.schema.names
    batch = batch.select(*columns).persist()
    try:
        days = [r[0] for r in batch.select(source.partition).distinct().collect()]
        if not days:
            return
        fresh = batch
        if store.exists(spark, path):
            old = spark.read.schema(source.schema).parquet(path).filter(F.col(source.partition).isin(days)).select(*columns)
            same = [batch[c].eqNullSafe(old[c]) for c in columns]
            fresh = old.unionByName(batch.join(old, same, "left_anti"))
        store.replace_dates(fresh, path, source.partition, days)
    finally:
        batch.unpersist()


def land_stream(stream: DataFrame, root: str, name: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda batch, _: land_batch(batch, root, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
