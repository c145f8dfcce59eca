"""Benchmark decontamination: prefix-filtered containment join of item windows, in DataFrame operations only.

An item's windows are its runs of `size` words (one window of all its words if it has fewer). For a document to contain
a window it must contain every word of it, the rarest too. So the words of the benchmark are counted over all documents, and each
window is indexed under its rarest word only (containment of all words needs a prefix of one); windows with a word
that no document has are dropped. A document's words that are such prefix words are its candidates. The place of the word
in the window gives the only possible start, which must lie in the document with the whole window (positional and length bounds), and the
candidate counts if the words there equal the window's.

Prefix words go into the scan as a literal set if a count proves that there are at most `literal_words`; otherwise
the documents' words are joined by shuffling. The windows are broadcast under a checked bound or shuffled. Rows of one document are
combined in the task that reads it, so what is shuffled is one row a document.

Defined cases: null text and null items have no words, hits or windows; words are lower-cased in A-Z only; items with equal
windows are all reported; items with a null id are matched but not listed in the digest; of equally rare words of a window the
first in order is its prefix, which changes no result; very long texts are split whole; equal rows are judged each; an empty
benchmark leaves every document clean, an empty table gives no rows; other columns of the documents are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, table

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(window, item): the distinct windows of each item."""
    listed = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("window")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, literal_words: int = 20_000, broadcast_rows: int = 50_000) -> DataFrame:
    """_doc (a struct of docs' columns but the text), n_words, hits (array of start and length) and items (array of item ids)."""
    keep = [c for c in docs.columns if c != text]
    windows = item_windows(items, item_id, item_text, size)
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    if vocabulary.limit(broadcast_rows + 1).count() <= broadcast_rows:
        vocabulary = F.broadcast(vocabulary)
    counts = docs.select(F.explode(words(docs[text])).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    # the rarest word of each window; a window with an unseen word is gone
    numbered = windows.select(F.xxhash64("window").alias("_h"), "window").distinct().select("_h", "window", F.posexplode("window").alias("at", "word"))
    rarest = numbered.join(counts, "word", "left").groupBy("_h", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("rare"))
    rarest = rarest.filter("rare.n > 0").select("window", F.col("rare.word").alias("prefix"), F.col("rare.at").alias("offset"))
    index = materialize(rarest.join(windows, "window"))
    prefixes = index.select("prefix").distinct().limit(literal_words + 1).collect()
    base = docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs, keep).alias("_doc"), words(docs[text]).alias("_words")).withColumn("n_words", F.size("_words"))
    if len(prefixes) <= literal_words:
        rare = [r[0] for r in prefixes] or [""]
        places = F.filter(F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1)), lambda i: F.get("_words", i).isin(rare))
    else:
        places = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1))
    first = F.greatest(F.col("_place") - size + 1, F.lit(0))
    found = base.withColumn("_place", F.explode_outer(places)).select(
        "_row", "_doc", "n_words", "_place", F.get("_words", F.col("_place")).alias("_word"), first.alias("_first"), F.slice("_words", first + 1, 2 * size - 1).alias("_near")
    )
    side = F.broadcast(index) if index.limit(broadcast_rows + 1).count() <= broadcast_rows else index
    start = F.col("_place") - F.col("offset")
    within = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice("_near", start - F.col("_first") + 1, F.size("window")) == F.col("window")
    joined = found.join(side, (F.col("_word") == F.col("prefix")) & within & F.when(within, same), "left")
    return joined.groupBy("_row").agg(
        F.first("_doc").alias("_doc"), F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), F.size("window").alias("length")))).alias("hits"), F.collect_set("item").alias("items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """docs without the text, with n_words, n_hit, n_items, items_sha256 and contaminated in place of columns of these names."""
    found = find_hits(docs, items, **names)
    spots = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    hit = F.size(F.array_distinct(spots))
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return found.select(
        *[F.col("_doc")[c].alias(c) for c in found.schema["_doc"].dataType.names if c not in made], F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)
), hits AS (
  SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots s ON d.doc_id = s.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
