"""Target-distribution importance resampling with a dictionary of distinct features.

A document's features are its runs of 1 to `order` words. Tasks find the distinct features of a chunk of documents, with the documents
that hold each and how often, and send them to parts by a hash of the feature's text. A part has every occurrence of its
features in the whole corpus: it unifies equal strings, counts them, hashes each distinct string once to its bucket, and gives the
counts by bucket and, for each document, the buckets of its features. Spark adds up the buckets of the corpus and of the target texts,
makes the gains (one number a bucket, the only thing that is broadcast), joins them to the per-document counts and sums them up to weights.
Weights with a reproducible Gumbel noise, and the highest scores drawn, are a sample without replacement in proportion to importance.

Ranks are given without putting rows in one order in one task: scores are whole numbers of a bounded range, so the rows of each score
are counted, the counts are summed from above over at most that many scores, and rows of equal score are numbered by id within their score.

Defined cases: null text has no words and no features, weight 0, and is never drawn; very long texts are one document of a chunk of their own
size; equal rows are documents each, with equal weights; if their ids are equal too their scores tie and they follow one another in any order;
a null id counts as the empty string in the noise and comes last among ties; without target texts every t is 0; an empty table gives no rows;
other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks as B
from .common import materialize, row_identity, table

ORDER, BUCKETS, LEAST_WORDS, SHARE, SEED = 2, 10_000, 20, 25, 7
#: Text of a chunk and of a part; neither changes a result.
CHUNK_BYTES, PART_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20, 3 << 17
#: Documents of a chunk at most; a batch from Spark holds fewer.
MOST_ROWS = 1 << 16
MADE = ["n_features", "weight", "score", "rank"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: In place of a bucket: the two halves of a document's identity, and its words. In place of a row: the whole table.
KEY_A, KEY_B, N_WORDS, ALL = -1, -2, -3, -1
#: Rows of a batch that a part gives back at once.
BATCH_ROWS = 1 << 16


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    size = ends - starts
    shift = np.repeat(starts - (np.cumsum(size) - size), size)
    shift += np.arange(len(shift))
    return buf[shift]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def block_features(buf: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """The words of a block in lower case, each followed by one space, and its features in them: (bytes, starts, ends, row, hash, words of each row)."""
    buf = _LOWER[buf]
    starts, ends, first = B.word_spans(buf, bounds, _GAP)
    words, size = np.diff(first), ends - starts
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[runs(at, size)] = gather(buf, starts, ends)
    row = np.repeat(np.arange(len(words)), words)
    spans = [(at, at + size, row)]
    for k in range(2, order + 1):
        same = np.flatnonzero(row[: 1 - k] == row[k - 1 :])
        spans.append((at[same], (at + size)[same + k - 1], row[same]))
    a, b, row = (np.concatenate(x) for x in zip(*spans, strict=True))
    return out, a.astype(np.int32), b.astype(np.int32), row.astype(np.int32), B.spans_hash(B.byte_values(out), a, b), words


def chunk_features(a: np.ndarray, b: np.ndarray, row: np.ndarray, hashed: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """Distinct features of a chunk by part and place, and who has them: (start, end, part, documents) of each feature, then (document, times)
    of the documents of the first, of the second and so on.

    Features are sorted by 48 bits of their hash and the document, and told apart by all 64. Of two strings that share the 48, one may come
    more than once; the part that gets them unifies equal strings."""
    key = hashed & ~np.uint64(MOST_ROWS - 1)
    key |= row.astype(np.uint64)
    by = np.argsort(key).astype(np.int32)
    del key
    hashed, row = hashed[by], row[by]
    new = np.ones(len(by), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    own = new.copy()
    own[1:] |= row[1:] != row[:-1]
    entry = np.flatnonzero(own).astype(np.int32)
    head = np.flatnonzero(new)
    times, holder = np.diff(np.append(entry, np.int32(len(by)))), row[entry]
    del own, new, row
    first_entry = np.searchsorted(entry, head)
    holders = np.diff(np.append(first_entry, len(entry)))
    del entry
    part = (hashed[head] % np.uint64(parts)).astype(np.int64)
    a, b = a[by[head]].astype(np.int64), b[by[head]].astype(np.int64)
    del by, hashed, head
    rank = np.argsort((part << 40) | a)
    at = runs(first_entry[rank], holders[rank])
    return a[rank], b[rank], part[rank], holders[rank], holder[at], times[at]


def pack(lengths: np.ndarray, holders: np.ndarray, doc: np.ndarray, times: np.ndarray, text: np.ndarray) -> bytes:
    """Numbers go by byte planes, as most fit in one."""
    head = np.concatenate([lengths, holders, np.diff(doc, prepend=0), times]).astype("<i4")
    planes = np.ascontiguousarray(head.view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(np.array([len(lengths), len(doc)], "<i4").tobytes() + planes.tobytes() + text.tobytes(), 3)


def unpack(packet: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packet), np.uint8)
    n, m = (int(x) for x in raw[:8].view("<i4"))
    size = 2 * (n + m)
    head = np.ascontiguousarray(raw[8 : 8 + 4 * size].reshape(4, -1).T).view("<i4").ravel()
    lengths, holders, doc, times = np.split(head, [n, 2 * n, 2 * n + m])
    return lengths, holders, np.cumsum(doc, dtype=np.int64), times, raw[8 + 4 * size :]


def _send(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size, rows = TaskContext.get().partitionId() << 40, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, size, rows
            shift, below = (np.cumsum([0, *[len(h[i]) for h in held[:-1]]]) for i in (0, 5))
            columns = [list(x) for x in zip(*held, strict=True)]
            held = []

            def joined(i: int, shifts: np.ndarray | None = None) -> np.ndarray:
                """A column of the chunk; its blocks are given up, so that no column is held twice."""
                blocks, columns[i] = columns[i], []
                for at, s in enumerate(shifts if shifts is not None else []):
                    blocks[at] += np.int32(s)
                return np.concatenate(blocks)

            buf, words, key_a, key_b = (joined(i) for i in (0, 5, 6, 7))
            # the arrays are named in there only, so each goes when it is sorted
            a, b, part, holders, doc, times = chunk_features(joined(1, shift), joined(2, shift), joined(3, below), joined(4), parts)
            edge = np.searchsorted(part, np.arange(parts + 1))
            entry_edge = np.concatenate([[0], np.cumsum(holders)])[edge]
            numbers = np.flatnonzero(np.diff(edge))
            packets = []
            for p in numbers:
                x, e = slice(edge[p], edge[p + 1]), slice(entry_edge[p], entry_edge[p + 1])
                packets.append(pack(b[x] - a[x], holders[x], doc[e], times[e], gather(buf, a[x], b[x])))
            n, own = len(packets), np.arange(base, base + rows)
            made = {
                "part": pa.array(np.concatenate([own % parts, numbers]), pa.int32()), "row": pa.array(np.concatenate([own, np.full(n, base)])),
                **{name: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(n, pa.int64())]) for name, x in (("a", key_a), ("b", key_b), ("n_words", words))},
                "packet": pa.array([None] * rows + packets, pa.binary()),
            }
            base, held, size, rows = base + rows, [], 0, 0
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for low, high, buf, bounds in B.text_blocks(batch.column(2), BLOCK_BYTES):
                if held and (size + len(buf) > CHUNK_BYTES or rows + high - low > MOST_ROWS):
                    yield flush()
                held.append((*block_features(buf, bounds, order), keys[0][low:high], keys[1][low:high]))
                size, rows = size + len(buf), rows + high - low
        if held:
            yield flush()

    return run


def _count(buckets: int):
    def run(part: pa.Table) -> pa.Table:
        """Unify and count the strings of a part, and give the bucket of each entry."""
        rows = part.filter(pa.compute.is_valid(part["a"]))
        sent = part.filter(pa.compute.is_valid(part["packet"]))
        out = [(rows["row"].to_numpy(), np.full(len(rows), code, np.int32), rows[name].to_numpy()) for code, name in ((KEY_A, "a"), (KEY_B, "b"), (N_WORDS, "n_words"))]
        read = [unpack(x.as_py()) for x in sent["packet"]]
        if read:
            lengths, holders, _, times, text = (np.concatenate(x) for x in zip(*read, strict=True))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
            distinct, entry = strings.dictionary, np.repeat(strings.indices.to_numpy(), holders)
            ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
            data = memoryview(distinct.buffers()[2]) if len(distinct) else b""
            bucket = np.fromiter((zlib.crc32(data[i:j]) % buckets for i, j in zip(ends, ends[1:], strict=False)), np.int32, len(distinct))
            counts = np.bincount(entry, times, len(distinct)).astype(np.int64)  # of each distinct string, in the whole corpus
            total = np.bincount(bucket, counts, buckets).astype(np.int64)
            doc = np.concatenate([first + d for first, (_, _, d, _, _) in zip(sent["row"].to_pylist(), read, strict=True)])
            by = np.argsort(doc, kind="stable")
            used = np.flatnonzero(total)
            out += [(doc[by], bucket[entry[by]], times[by].astype(np.int64)), (np.full(len(used), ALL), used.astype(np.int32), total[used])]
        made = [pa.table({"row": row, "bucket": code, "n": n}) for row, code, n in out]
        return pa.Table.from_batches([x for t in made for x in t.to_batches(max_chunksize=BATCH_ROWS)], made[0].schema)

    return run


def feature_buckets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(row, bucket, n): for each document its distinct features by bucket, and its identity and words under KEY_A, KEY_B and N_WORDS; and under the row ALL
    the counts of the whole table by bucket, added up over the distinct features of a part."""
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    parts, key = max(1, size // PART_BYTES), row_identity(doc_id, text)
    sent = docs.select(key["a"].alias("a"), key["b"].alias("b"), docs[text].alias("t")).mapInArrow(_send(parts, order), "part int, row long, a long, b long, n_words long, packet binary")
    return sent.groupBy("part").applyInArrow(_count(buckets), "row long, bucket int, n long")


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), one row a bucket: 1000 times the logarithm of how much commoner it is in the target, with one added to every bucket."""
    spark = source.sparkSession
    sums = [x.filter(F.col("row") == ALL).groupBy("bucket").agg(F.sum("n").alias(name)) for x, name in ((source, "s"), (target, "t"))]
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums[0], "bucket", "left").join(sums[1], "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    totals = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return each.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # totals are one row


def importance_weights(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", target_id: str = "item_id", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """docs without the text, with n_words, n_features and weight."""
    source = materialize(feature_buckets(docs, text, doc_id, order, buckets), compression="zstd")
    gained = materialize(gains(source, feature_buckets(target, target_text, target_id, order, buckets), buckets))
    total = source.filter((F.col("bucket") >= 0) & (F.col("row") != ALL)).join(F.broadcast(gained), "bucket").groupBy("row").agg(F.sum("n").alias("n_features"), F.sum(F.col("n") * F.col("gain")).alias("total"))
    parts = {name: F.max(F.when(F.col("bucket") == code, F.col("n"))) for name, code in (("a", KEY_A), ("b", KEY_B), ("n_words", N_WORDS))}
    known = source.filter("bucket < 0").groupBy("row").agg(*[c.alias(name) for name, c in parts.items()]).select("row", F.struct("a", "b").alias("_key"), "n_words").join(total, "row", "left")
    n = F.coalesce("n_features", F.lit(0))
    one = known.groupBy("_key").agg(F.first("n_words").alias("_n_words"), F.first(n).alias("_n_features"), F.first(F.when(n > 0, F.floor(F.col("total") / n)).otherwise(0)).cast("long").alias("_weight"))
    made = ["n_words", "n_features", "weight"]
    keep = [c for c in docs.columns if c != text and c not in made]
    whole = docs.select(row_identity(doc_id, text).alias("_key"), F.struct(*[docs[c].alias(c) for c in keep]).alias("_doc"))
    return whole.join(one, "_key").select(*[F.col("_doc")[c].alias(c) for c in keep], *[F.col(f"_{c}").alias(c) for c in made])


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel value that the id and the seed fix, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, doc_id: str = "doc_id", seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed (with n_words and weight) with score and rank; rank is null for documents that are not among the share (percent) drawn."""
    scored = weighed.select(*[c for c in weighed.columns if c not in ("score", "rank")], (F.col("weight") + gumbel(F.col(doc_id), seed)).cast("long").alias("score"))
    fit = F.col("n_words") >= least_words
    counts = scored.filter(fit).groupBy("score").agg(F.count("*").alias("_n"))
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # at most one row a score
    numbered = scored.filter(fit).join(offsets, "score").withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last(doc_id))))
    drawn = F.when(100 * F.col("_at") <= share * F.col("_all") - (share * F.col("_all")) % 100, F.col("_at")).cast("long").alias("rank")
    rest = scored.filter(~fit).select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    return numbered.select(*scored.columns, drawn).unionByName(rest)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance_weights(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return draw(materialize(weighed)).select("doc_id", *MADE)


# A byte's step of the reflected CRC-32 with polynomial 0xEDB88320 (fixed value of the standard), as SQL over a list of bytes.
_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x))"
OP12_SQL = f"""
WITH texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts
), f AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM w
), per_doc AS (SELECT side, r, feature, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT {_CRC_TABLE} AS t),
dictionary AS (
  SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT feature FROM per_doc), crc
), sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t
  FROM (SELECT range AS bucket FROM range({BUCKETS})) b LEFT JOIN (SELECT * FROM per_doc JOIN dictionary USING (feature)) x ON x.bucket = b.bucket GROUP BY b.bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM per_doc JOIN dictionary USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON w.r = weights.r WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS every FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= ({SHARE} * every) // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
