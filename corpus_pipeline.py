"""A training corpus from `documents` in five stages; each one's rows are written as Parquet before the next one reads them.

1. quality: documents that the quality rules reject go.
2. line_dedup: later copies of runs of lines are cut from the texts (n_chars follows); a document of which every line
   with a word was a copy goes.
3. near_duplicates: of each group linked by n-gram similarity the document with the smallest id stays.
4. decontamination: documents that contain a benchmark window go.
5. packing: what is left is tokenised and packed into windows; one row a piece.

Defined cases, in all stages: a null or empty text has no words; quality rejects it, line_dedup, near_duplicates and
decontamination keep it and packing gives its end id. Very long texts are handled whole. A null id is an id like others in stages 1, 4
and 5; it comes first in text order in stage 2; in stage 3 such a row can't be the smallest of a group, goes if its group has
a row with an id, and stays otherwise. Of repeated rows line_dedup keeps the lines of the first; in stage 3, of rows with equal
id and text one stays, the least by its other columns. Ties are those of the operators. An empty table passes through. Extra
columns, whatever their names, are handed on as they are by all stages but packing, which returns pieces.
The packing of pieces into windows has no counterpart in SQL, so ORACLE_SQL is None and the tests hold run() against a plain
version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, few, materialize, row_identity, table
from shelfmark.llm.decontamination import decontaminate
from shelfmark.llm.line_dedup import dedup_lines
from shelfmark.llm.ngram_join import similar_groups
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.quality_rules import score_quality


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose identity is in keys(_key); the keys are broadcast only if a count proves them few."""
    key = "_key_of_row"
    return docs.withColumn(key, row_identity()).join(few(keys.select(F.col("_key").alias(key)).distinct()), key, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_quality(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.select("doc_id", "text", row_identity().alias("_key"))
    groups = materialize(similar_groups(named).select("_key", F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull()).alias("goes")))
    kept = _without(docs, groups.filter("goes").select("_key"))
    twice = groups.filter("not goes").groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_key_of_row"))
    if twice.isEmpty():
        return kept
    keyed = kept.withColumn("_key_of_row", row_identity())
    whole = F.struct(*[keyed[c].alias(c) for c in docs.columns])
    once = keyed.join(few(twice), "_key_of_row", "left_semi").groupBy("_key_of_row").agg(F.min_by(whole, F.to_json(whole)).alias("_least"))
    return keyed.join(few(twice), "_key_of_row", "left_anti").select(*docs.columns).unionByName(once.select(*[F.col("_least")[c].alias(c) for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs.select(row_identity().alias("_key"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated").select("_key"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(spark, *written)
        written = [docs]
    return docs
