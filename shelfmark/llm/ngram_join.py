"""N-gram Jaccard join: documents whose sets of word n-grams are similar, and the groups that these links make.

The join is the product of the sparse document by n-gram matrix with its transpose. Documents with equal sets are one row of
the matrix; its columns, the n-grams, are ordered by the number of documents that have them. Bounds from set sizes say
which entries of the product can matter, and only these are computed; for a similarity of t they lose nothing:
 - an n-gram that only one document has adds to no overlap. A first exchange of compressed 32-bit fingerprints tells every
   document which of its n-grams occur again, and in how many documents (a logarithmic class). A row of size n with fewer than
   ceil(t n) of them has no partner and is out;
 - a similar pair has an overlap of at least t / (1 + t) times its summed sizes. Let i and j be the places, in column order, of
   the first n-gram that both rows have: the overlap is at most the lesser of n - i and m - j. So an entry (row, column) at
   place i only meets rows up to the size `top` for which n - i is enough, and a row has no entries from place
   n - ceil(t n) + 1 on. As rare n-grams come first, two rows that first meet in a common column have few n-grams of
   their own before it: both then resemble what they were copied from;
 - for the entries of the product that are left, overlaps are accumulated by blocks of columns: each block adds its part
   to the sum of the pair, map-side first, and pairs below the bound are discarded.

Groups of near copies don't emit all pairs. First every entry of a column is held against the column's most central row of its size
class only, and the links found are joined to components. Then, in columns with several components, only rows outside the
component of the column's most central row are held against others, and only those entries of either side that the sizes of the other side admit.
Every similar pair is thus in one component through others or computed exactly.

Skew: a hot column, row or set is a key of joins whose other side has one row a key, which adaptive execution splits; a hot
row of the product is salted. Sets are of 64-bit hashes, where two would have to collide inside one pair to matter; rows are known
by 128 bits of their set.

Defined cases: null and word-less texts have no n-grams and link with nothing; texts of fewer than n words have one, their
whole sequence; a very long text is one row, its n-grams travel in `BLOCKS` parts; equal rows are one group; ties of size, place or
centrality are broken by row numbers and don't change groups; a group whose ids are all null has a null component; an empty table
gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import chunk_bytes, discard, few, materialize, packed, row_key, schema_of, table
from .components import components
from .superkmers import SEEDS, chosen_seeds, pack_seeds, repeated_seeds, seed_of

N, TENTHS = 5, 8
#: Blocks of columns (a power of two), and rows of the product that meet one row in one task.
BLOCKS, SALT_ROWS = 8, 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def gram_sets(buf: np.ndarray, bounds: np.ndarray, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row of a block."""
    buf = _FOLD[buf]
    starts, ends, first = B.word_spans(buf, bounds)
    words = B.spans_hash(B.byte_values(buf), starts, ends)
    grams = B.windows_hash(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield B.windows_hash(words[a:b], b - a, 0x8EBC6AF09C88C6E3)
        else:
            yield np.zeros(0, np.uint64)


def set_print(grams: np.ndarray) -> bytes:
    """128-bit fingerprint of a set."""
    one = B.mix(grams ^ np.uint64(0x9E3779B97F4A7C15))
    return np.array([one.sum(dtype=np.uint64), B.mix(one ^ np.uint64(len(grams))).sum(dtype=np.uint64)], "<u8").tobytes()


def needed(size: np.ndarray | int, tenths: int) -> np.ndarray | int:
    """Smallest overlap that a row of this size needs with any row: ceil(size * tenths / 10)."""
    return -(-size * tenths // 10)


def _gram_seeds(n: int, buckets: int):
    """A chunk's n-grams as seeds, with the number of its distinct sets that have each."""

    def run(part: pa.Table) -> pa.Table:
        sets = {set_print(g): g for _, _, buf, bounds in B.text_blocks(part.column("text")) for g in gram_sets(buf, bounds, n)}
        grams = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
        return pack_seeds(part.column("chunk")[0].as_py(), *np.unique(seed_of(grams, buckets), return_counts=True))

    return run


def _rows_of_chunk(n: int, tenths: int, buckets: int):
    """Every document with its set's size and fingerprint; if it may have a partner, also the number of its columns that no other
    document has, the mean weight of its columns, the columns that it can meet a partner in first (rarest first), and its
    shared columns by block."""
    edges = np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(65 - BLOCKS.bit_length())

    def run(part: pa.Table, replies: pa.Table) -> pa.Table:
        again, weights = chosen_seeds(replies)
        rows: list[tuple] = []
        for _, _, buf, bounds in B.text_blocks(part.column("text")):
            for grams in gram_sets(buf, bounds, n):
                size, weight = len(grams), np.zeros(len(grams), np.uint8)
                if len(again) and size:
                    seeds = seed_of(grams, buckets)
                    at = np.minimum(np.searchsorted(again, seeds), len(again) - 1)
                    weight = np.where(again[at] == seeds, weights[at], 0)
                shared = weight > 0
                alone = size - int(shared.sum())
                if size and size - alone >= needed(size, tenths):
                    mine, weight = grams[shared], weight[shared]
                    head = mine[np.lexsort((mine, weight))][: max(0, size - needed(size, tenths) + 1 - alone)]
                    cells = [x.view(np.int64) for x in np.split(mine, np.searchsorted(mine, edges))]
                    rows.append((size, set_print(grams), alone, float(weight.sum()) / size, head.view(np.int64), cells))
                else:
                    rows.append((size, set_print(grams), None, None, None, None))
        kinds = {"n": pa.int64(), "f": pa.binary(), "alone": pa.int64(), "centre": pa.float64(), "head": pa.list_(pa.int64()), "cells": pa.list_(pa.list_(pa.int64()))}
        made = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}
        return pa.table({"id": part.column("id"), "_doc": part.column("_doc"), **made})

    return run


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) of rows whose overlap, summed over the blocks of columns, reaches the bound."""
    cells = sets.select("node", "n", F.posexplode("cells").alias("block", "cell")).filter(F.size("cell") > 0)
    one = cells.select(F.col("node").alias("a"), "n", "block", F.col("cell").alias("x"))
    # a row that meets very many others is held once for every SALT_ROWS of them
    salted = pairs.join(pairs.groupBy("b").agg(F.floor(F.count("*") / SALT_ROWS).alias("salts")), "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts") + 1))
    homes = salted.select("b", "salt").distinct().join(cells.select(F.col("node").alias("b"), F.col("n").alias("m"), "block", F.col("cell").alias("y")), "b")
    met = salted.select("a", "b", "salt").join(one, "a").join(homes, ["b", "salt", "block"])
    sums = met.groupBy("a", "b", "n", "m").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("both"))
    return materialize(sums.filter(F.col("both") * (10 + tenths) >= tenths * (F.col("n") + F.col("m"))).select("a", "b"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs, the smaller row first."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _star_pairs(entries: DataFrame, tenths: int) -> DataFrame:
    """Every entry with the most central row of its column and size class, and these rows with those of the next class."""
    classed = entries.withColumn("c", F.floor(F.log("n") / log(10 / tenths) + 1e-9))
    least = classed.groupBy("gram", "c").agg(F.max(F.struct("centre", "node", "n", "top")).alias("hub"))
    hubs = least.select("gram", "c", F.col("hub.node").alias("g"), F.col("hub.n").alias("m"), F.col("hub.top").alias("top2"))
    steps = hubs.select("gram", F.col("g").alias("node"), F.col("m").alias("n"), F.col("top2").alias("top"), (F.col("c") + 1).alias("c"))
    met = classed.select("gram", "node", "n", "top", "c").unionByName(steps).join(hubs, ["gram", "c"])
    return _ordered(met.filter("node <> g and m <= top and n <= top2"), "node", "g")


def _cross_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of rows of a column that are in different components and of sizes that their places in the column admit."""
    marked = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    column = marked.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", F.struct("centre", "node")).alias("home"), F.min("n").alias("least"), F.max("top").alias("most"))
    near = materialize(marked.join(column.filter("low <> high"), "gram").filter("least <= top and n <= most").select("gram", "node", "n", "top", "root", "home"))
    minor = near.filter("root <> home")
    reach = minor.groupBy("gram").agg(F.min("n").alias("least"), F.max("top").alias("most"))
    other = near.join(reach, "gram").filter("least <= top and n <= most").select("gram", F.col("node").alias("g"), F.col("n").alias("m"), F.col("top").alias("top2"), F.col("root").alias("root2"), "home")
    bound = other.groupBy("gram").agg(F.min("m").alias("least"), F.max("top2").alias("most"))
    left = minor.drop("home").join(bound, "gram").filter("least <= top and n <= most").select("gram", "node", "n", "top", "root")
    apart = "root <> root2 and m <= top and n <= top2 and (root2 = home or node < g)"
    return _ordered(left.join(other, "gram").filter(apart), "node", "g")


def _groups(sets: DataFrame, tenths: int) -> DataFrame:
    """(node, root): the component of every row that is similar to another."""
    spark = sets.sparkSession
    # the sizes that an entry's place admits: (10 + tenths) * (n - place) >= tenths * (n + m)
    top = F.floor(((10 + tenths) * (F.col("n") - F.col("alone") - F.col("at"))) / tenths) - F.col("n")
    heads = sets.select("node", "n", "alone", "centre", F.posexplode("head").alias("at", "gram")).withColumn("top", top)
    entries = materialize(heads.filter(10 * F.col("top") >= tenths * F.col("n")).select("gram", "node", "n", "top", "centre"))
    tried = materialize(_star_pairs(entries, tenths))
    links = _similar(tried, sets, tenths)
    roots = materialize(components(links))
    more = _similar(materialize(_cross_pairs(entries, roots).join(tried, ["a", "b"], "left_anti")), sets, tenths)
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)))
    discard(spark, entries, tried, links, more)
    return roots


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, tenths: int = TENTHS) -> DataFrame:
    """docs without the text, with n_shingles and component_id in place of columns of these names."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (text, "n_shingles", "component_id")]
    keyed = docs.select(row_key(doc_id, text).alias("key"), docs[doc_id].alias("id"), packed(docs, keep).alias("_doc"), docs[text].alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = buckets = max(4, total // chunk_bytes(total))
    # the texts are shuffled once: both readers take the same exchange
    dealt = keyed.select(F.pmod("key", F.lit(chunks)).cast("int").alias("chunk"), "id", "_doc", "text").repartition(chunks, "chunk")
    seeds = dealt.groupBy("chunk").applyInArrow(_gram_seeds(n, buckets), SEEDS)
    replies = seeds.repartition(max(4, buckets // 2), "bucket").groupBy("bucket").applyInArrow(repeated_seeds, SEEDS)
    fields = schema_of(keyed, ["id", "_doc"], "n long, f binary, alone long, centre double, head array<long>, cells array<array<long>>")
    found = materialize(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_rows_of_chunk(n, tenths, buckets), fields))
    rows = found.select("id", "_doc", "n", "f", F.col("alone").isNotNull().alias("active"))
    sets = materialize(found.filter("alone is not null").select("f", "n", "alone", "centre", "head", "cells").dropDuplicates(["f"]).withColumn("node", F.monotonically_increasing_id()))
    roots = _groups(sets, tenths)
    # sets that several documents have, or that are linked to others, with their smallest id
    firsts = rows.filter("n > 0").groupBy("f").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("active").alias("active"))
    linked = firsts.filter("copies > 1 or active").join(sets.select("f", "node").join(roots, "node").select("f", "root"), "f", "left")
    smallest = linked.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = materialize(linked.join(smallest, "root", "left").select("f", F.coalesce("least", "first").alias("component_id")))
    discard(spark, roots, sets)
    out = rows.join(few(named), "f", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(*[F.col("_doc")[c].alias(c) for c in keep], F.col("n").alias("n_shingles"), component.alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * n_both >= 80 * (s.n + t.n - n_both)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.first AS component_id
FROM d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS first FROM reach GROUP BY doc_id) r USING (doc_id)
"""
