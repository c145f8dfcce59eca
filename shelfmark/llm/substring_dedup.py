"""Substring dedup: word windows that occur twice or more, by super-k-mer partitioning.

Words are cut by white space and left as they are. Every window of `k` words travels, inside a packed run of windows with
the same minimiser, to a bucket, where all windows are hashed (128 bits), sorted and counted with the number of places
of their runs. A window with two or more places is repeated, and every word that a repeated window covers is removed, at every place.
A run that a task holds twice is cut by that task at all its places; the bucket gets its count only.

Rows are known by 128 bits of their id and text.

Defined cases: null text has no words; a text shorter than k words has no window and keeps all; very long texts are cut into
runs like others; repeats inside one document count; equal rows repeat each other, so there is no tie to break; an empty table
gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import packed, row_key, schema_of, table
from .superkmers import CUTS, Runs, Scheme, bucket_runs, judged, spread, stretches

K_WORDS, M_WORDS = 35, 3


def _second(buf: np.ndarray) -> np.ndarray:
    """Byte values that are independent of those of B.byte_values."""
    return B.mix(B.byte_values(buf) ^ np.uint64(0x5851F42D4C957F2D))


def _count_windows(k: int):
    def judge(runs: Runs) -> pa.Table:
        one, two, sizes = [], [], []
        low = 0
        while low < len(runs.bounds) - 1:  # hash about a megabyte of runs at a time
            high = max(low + 1, int(np.searchsorted(runs.bounds, runs.bounds[low] + B.BLOCK_BYTES, "right")) - 1)
            buf = runs.data[runs.bounds[low] : runs.bounds[high]]
            starts, ends, first = B.word_spans(buf, runs.bounds[low : high + 1] - runs.bounds[low])
            row = np.repeat(np.arange(high - low), np.diff(first))
            inside = row[k - 1 :] == row[: len(row) - k + 1]
            one.append(B.windows_hash(B.spans_hash(B.byte_values(buf), starts, ends), k)[inside])
            two.append(B.windows_hash(B.spans_hash(_second(buf), starts, ends, 0xA0761D6478BD642F), k, 0xE7037ED1A0B428DB)[inside])
            sizes.append(np.diff(first) - k + 1)
            low = high
        h1, h2, size = np.concatenate(one), np.concatenate(two), np.concatenate(sizes)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.repeat(runs.times, size)[order])
        many = np.empty(len(order), bool)
        many[order] = total[group] >= 2
        row, a, b = stretches(many, np.concatenate([[0], np.cumsum(size)]))
        return spread(runs, row, a, b - 1 + k)

    return lambda part: judged(part, judge)


def join_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """docs(key, id, ...) with _cuts, the distinct (a, b) of each key and id, or null."""
    merged = cuts.groupBy("key", "id").agg(F.collect_set(F.struct("a", "b")).alias("_cuts"))
    return docs.join(merged, ["key", "id"], "left")


def cut_places(cuts: pa.StructScalar | None, n: int) -> np.ndarray:
    """Which of n places some cut covers."""
    if cuts is None or not len(cuts):
        return np.zeros(n, bool)
    flat = cuts.field(0).to_numpy(), cuts.field(1).to_numpy()
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, flat[0], 1)
    np.subtract.at(edge, flat[1], 1)
    return np.cumsum(edge[:n]) > 0


def _finish(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = batch.column(len(keep)), batch.column(len(keep) + 1)
        counts, removed, kept, sums = [], [], [], []
        for low, _, buf, bounds in B.text_blocks(texts):
            starts, ends, first = B.word_spans(buf, bounds)
            data = buf.tobytes()
            for i in range(len(bounds) - 1):
                n = int(first[i + 1] - first[i])
                gone = cut_places(cuts[low + i].values, n)
                at = np.flatnonzero(~gone) + first[i]
                text = b" ".join([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                counts.append(n)
                removed.append(int(gone.sum()))
                kept.append(text)
                sums.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())], names=[*keep, "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K_WORDS, m: int = M_WORDS) -> DataFrame:
    """docs without the text, with n_words, n_removed, kept_text and kept_sha256 in place of columns of these names."""
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_text", "kept_sha256")]
    keyed = docs.select(row_key(doc_id, text).alias("key"), row_key(doc_id, text, 2).alias("id"), packed(docs, keep).alias("_doc"), docs[text].alias("text"))
    cuts = bucket_runs(keyed.select("key", "id", "text"), Scheme(True, k, min(m, k))).groupBy("bucket").applyInArrow(_count_windows(k), CUTS)
    joined = join_cuts(keyed.select("key", "id", "_doc", "text"), cuts)
    fields = schema_of(docs, keep, "n_words long, n_removed long, kept_text string, kept_sha256 string")
    return joined.select(*[F.col("_doc")[c].alias(c) for c in keep], F.col("text").alias("__text__"), F.col("_cuts").alias("__cuts__")).mapInArrow(lambda batches: _finish(batches, keep), fields)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), many AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN many USING (win)
), places AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT places.doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY places.doc_id
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
"""
