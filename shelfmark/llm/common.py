"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master may go without one; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a cut in the lineage that outlives executors. Options are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    root = scratch_root(spark)
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
                path.getFileSystem(conf).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> Column:
    """64 bits of a row's identity: rows with equal id and text share it, and every answer depends on these two only."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def row_identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of it, for joins over a whole corpus."""
    return F.struct(row_key(doc_id, text).alias("a"), row_key(doc_id, text, 2).alias("b"))


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, marked for broadcast if a count proves it to hold at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def chunk_bytes(total: int) -> int:
    """Text of a chunk of documents: 8 MB up to 100 GB of text, then growing with its square root, 128 MB at most."""
    return min(128 << 20, max(8 << 20, int((640 * (total or 0)) ** 0.5)))


def relaxed(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, as Arrow functions return it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relaxed(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(relaxed(kind.keyType), relaxed(kind.valueType))
    return kind


def packed(docs: DataFrame, columns: list[str]) -> Column:
    """These columns as one struct, so that their names can't clash with an operator's own."""
    whole = F.struct(*[docs[c].alias(c) for c in columns])
    return whole.cast(relaxed(T.StructType([docs.schema[c] for c in columns])))


def schema_of(docs: DataFrame, columns: list[str], more: str) -> T.StructType:
    """Schema of an Arrow function that hands columns of docs on and adds others (given as DDL)."""
    return T.StructType([T.StructField(c, relaxed(docs.schema[c].dataType)) for c in columns] + T.StructType.fromDDL(more).fields)
