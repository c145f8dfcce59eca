"""Suffix-array dedup: byte strings of `k` or more that also start in an earlier document, by a logarithmic index family.

Most text has no copy. So the minimisers of all windows are counted first, as compressed 32-bit fingerprints, and only
runs of windows whose minimiser occurs again take part: equal windows have equal minimisers, so none is lost. These
windows are dealt out by super-k-mers, so that all suffixes with equal first k bytes meet in one bucket.
A bucket takes its documents in the order of their ids, in batches. Each batch gets a suffix array (its suffixes
sorted by their first k bytes, with the smallest id that has each) and is merge-scanned against every level of the
index; suffixes that no level has become a level of their own, and as long as the level before is not larger, the two are merged,
so there are logarithmically many levels and a suffix is moved logarithmically often. Suffixes whose 64-bit
hash is alone in the bucket have no match and stay out. A byte is removed if a window over it also starts in a document with a
smaller id; windows are judged on the input, not on what is left.

Rows are known by their id and 64 bits of id and text.

Defined cases: null text counts as empty; a text shorter than k bytes keeps all; very long texts are read in blocks and cut into
runs like others; repeats inside one document and in rows of equal id (ties) are not removed, and repeated rows lose the same
bytes; ids are cast to long, and rows whose id is null or no whole number neither lose bytes nor make others lose any; an empty
table gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import chunk_bytes, packed, row_key, schema_of, table
from .superkmers import CUTS, SEEDS, WIRE, Runs, Scheme, Sender, chosen_seeds, judged, pack_seeds, plan, repeated_seeds, seeds_of, spread, stretches

#: Bytes of a match, bytes of a minimiser, suffixes of a batch.
K_BYTES, M_BYTES, BATCH = 50, 16, 1 << 15


class IndexFamily:
    """Levels of (sorted distinct suffixes, smallest document of each), sizes falling."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch (documents ascending, none before those of earlier batches); the smallest document of each suffix so far."""
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        keys, least = ranked[new], docs[order][new]
        fresh = np.ones(len(keys), bool)
        for level, first in self.levels:
            # both are sorted: merged, a match is two neighbours, the level's first
            both, at = _merged(level, keys)
            same = np.flatnonzero(both[1:] == both[:-1])
            found = at[same + 1] - len(level)
            least[found] = np.minimum(least[found], first[at[same]])
            fresh[found] = False
        if fresh.any():
            self.levels.append((keys[fresh], least[fresh]))
            while len(self.levels) > 1 and len(self.levels[-2][0]) <= len(self.levels[-1][0]):
                (a, da), (b, db) = self.levels.pop(), self.levels.pop()
                both, at = _merged(b, a)
                self.levels.append((both, np.concatenate([db, da])[at]))
        out = np.empty(len(suffixes), np.int64)
        out[order] = least[np.cumsum(new) - 1]
        return out


def _merged(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays as one, and where each entry was in their concatenation; the sort finds the two runs and merges them."""
    both = np.concatenate([one, two])
    at = np.argsort(both, kind="stable")
    return both[at], at


def _scan(k: int, batch: int):
    def judge(runs: Runs) -> pa.Table:
        owner = runs.ids[np.cumsum(runs.held) - runs.held]  # all places that came with a run are in the smallest document that its task saw
        size = np.diff(runs.bounds) - k + 1
        limits = np.concatenate([[0], np.cumsum(size)])
        hashes = []
        low = 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(runs.bounds, runs.bounds[low] + B.BLOCK_BYTES, "right")) - 1)
            buf = runs.data[runs.bounds[low] : runs.bounds[high]]
            row = np.repeat(np.arange(high - low), np.diff(runs.bounds[low : high + 1]))
            hashes.append(B.windows_hash(B.byte_values(buf), k)[row[k - 1 :] == row[: len(row) - k + 1]])
            low = high
        maybe = np.flatnonzero(B.repeated(np.concatenate(hashes)))
        of = B.row_of(limits, maybe)
        first = owner[of]
        by_doc = np.argsort(first, kind="stable")
        family, windows = IndexFamily(), np.lib.stride_tricks.sliding_window_view(runs.data, k)
        flags = np.zeros(limits[-1], bool)
        for at in range(0, len(by_doc), batch):
            pick = by_doc[at : at + batch]
            place = runs.bounds[of[pick]] + maybe[pick] - limits[of[pick]]
            suffixes = np.ascontiguousarray(windows[place]).view(f"S{k}").ravel()
            flags[maybe[pick]] = family.add(suffixes, first[pick]) < first[pick]
        row, a, b = stretches(flags, limits)
        return spread(runs, row, a, b - 1 + k)

    return lambda part: judged(part, judge)


def _seeds(scheme: Scheme, buckets: int):
    def run(part: pa.Table) -> pa.Table:
        known = part.filter(part.column("id").is_valid())
        return pack_seeds(part.column("chunk")[0].as_py(), *seeds_of(known.column("text"), scheme, buckets))

    return run


def _candidate_runs(scheme: Scheme, buckets: int, hot: np.ndarray):
    def run(part: pa.Table, replies: pa.Table) -> pa.Table:
        sender = Sender(scheme, buckets, hot, chosen_seeds(replies)[0], ordered=True)
        known = part.filter(part.column("id").is_valid())
        keys, ids = (known.column(c).to_numpy() for c in ("key", "id"))
        return pa.Table.from_batches([*sender.add(keys, ids, known.column("text")), sender.flush()])

    return run


def _finish(keep: list[str], with_bytes: bool):
    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_bytes]

    def run(part: pa.Table, cuts: pa.Table) -> pa.Table:
        cuts = cuts.group_by(["key", "id", "a", "b"]).aggregate([]).sort_by([("key", "ascending"), ("id", "ascending")])  # equal rows have sent the same
        key, owner, a, b = (cuts.column(c).to_numpy() for c in ("key", "id", "a", "b"))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]), [True]])) if len(key) else np.zeros(0, int)
        at_rows = {(int(key[i]), int(owner[i])): slice(i, j) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        names_of = list(zip(part.column("key").to_pylist(), part.column("id").to_pylist(), strict=True))
        rows: list[tuple] = []
        for low, _, buf, bounds in B.text_blocks(part.column("text")):
            for i in range(len(bounds) - 1):
                text, at = buf[bounds[i] : bounds[i + 1]], at_rows.get(names_of[low + i], slice(0, 0))
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, a[at], 1)
                np.subtract.at(edge, b[at], 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        docs = part.column("_doc").combine_chunks()
        return pa.table([*(docs.field(c) for c in keep), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    return run


def remove_earlier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K_BYTES, m: int = M_BYTES, batch: int = BATCH, with_bytes: bool = True) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept_bytes (a cut may fall inside a character)."""
    made = (text, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
    keep = [c for c in docs.columns if c not in made]
    scheme = Scheme(False, k, min(m, k))
    keyed = docs.select(row_key(doc_id, text).alias("key"), docs[doc_id].cast("string").try_cast("long").alias("id"), packed(docs, keep).alias("_doc"), docs[text].alias("text"))
    total, _, hot = plan(keyed.select("key", "text"), scheme)
    chunks = max(4, total // chunk_bytes(total))
    chunk = F.pmod(F.xxhash64("key", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk")
    # the texts are shuffled once: all three readers take the same exchange
    dealt = keyed.select(chunk, "key", "id", "_doc", "text").repartition(chunks, "chunk")
    seed_buckets = max(8, total // chunk_bytes(total))
    seeds = dealt.groupBy("chunk").applyInArrow(_seeds(scheme, seed_buckets), SEEDS)
    replies = seeds.repartition(max(4, seed_buckets // 2), "bucket").groupBy("bucket").applyInArrow(repeated_seeds, SEEDS)
    runs = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_candidate_runs(scheme, seed_buckets, hot), WIRE)
    cuts = runs.repartition(max(4, seed_buckets // 2), "bucket").groupBy("bucket").applyInArrow(_scan(k, batch), CUTS)
    fields = schema_of(docs, keep, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
    return dealt.groupBy("chunk").cogroup(cuts.select(chunk, "key", "id", "a", "b").groupBy("chunk")).applyInArrow(_finish(keep, with_bytes), fields)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)


OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, low, substr(h, 2 * low + 1, 598) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 250)) AS low FROM d)
), windows AS (
  SELECT doc_id, low + j AS i, substr(part, 2 * j + 1, 100) AS win
  FROM (SELECT doc_id, low, part, unnest(range(0, least(250, length(part) // 2 - 49))) AS j FROM blocks)
), firsts AS (
  SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN firsts USING (win) WHERE first < doc_id
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, count(*) FILTER (WHERE before IS NULL OR i - before > 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits)
  GROUP BY doc_id, run
), parts AS (
  SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(run) + 1, max(b), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT parts.doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY run) AS h
  FROM parts JOIN d USING (doc_id) GROUP BY parts.doc_id
), sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(s.n, 0) AS n_removed, coalesce(s.spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
