"""Line dedup: a suffix array over line sequences by prefix doubling, in DataFrame operations only.

The text of a corpus is the sequence of its lines that hold a word, documents in the order of their ids; no match crosses a document.
A maximal repeated run is a run of such lines that also starts at an earlier place and that no line before or after it
extends there. If it holds `min_words` words or more, it is a copy: its lines are deleted, with the blank lines between
them, and the first copy stays. So a line of `min_words` words goes wherever it was seen before, and shorter lines
go if together with their neighbours they were: of `A B C`, after `A B` and `B C` at two other places, all three
go if both pairs have the words, and none does if only the three together have them.

Prefix doubling: every line has a rank that orders lines by their fingerprints. Given ranks by the first h lines, the
pair of the rank at a place and the rank h lines on orders suffixes by their first 2h lines; sorting the distinct pairs
over the cluster (range partitions) and numbering them gives the next ranks. Suffixes whose rank is theirs alone are sorted
for good and leave. Every line holds a word, so runs of `min_words` lines are copies whatever follows; the windows of longer
runs cover them, and doubling stops there: nothing deeper is decided.

Longest-common-prefix intervals: suffixes of equal rank share 2**j lines, their true common length is found by adding the
powers of two below, from large to small. Where part of an interval agrees on so many lines more, that part becomes an
interval of its own and leaves its first suffix behind, for the others to be compared with. In the end every interval has its common
length, exact up to the bound at which doubling stops (12 lines for ten words) and at least the bound beyond, and every suffix that is not
the first of all is in one interval as another than its first: that is its longest run with an earlier copy up to the bound, as (target, source, length).
A longer run is covered by those that start at its places, so the lines deleted are those of whole maximal runs.

Skew: all rounds group by rank with map-side aggregation, and the joins that hand ranks back have a side with one row
a group and are left to adaptive execution, which splits hot keys; no group is collected anywhere. Only fingerprints (128
bits) of lines are shuffled, never their text. Tables between rounds are written to the shared scratch folder.

Defined cases: a null text has no lines and stays null; an empty text stays empty; lines are split at \\n only and compared
whole, white space included (by 128 bits); a text whose lines all go becomes empty; very long texts are one row each, whose lines
are dealt out like others; of rows with equal ids the one read first counts as earlier, so repeated rows are copies of the first; rows
with a null id come first in text order; an empty table gives no rows; other columns are kept, and columns with the names
of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, packed, table

MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"
PLACE = ["_id", "_row", "_at"]


def _said(text: Column) -> Column:
    """Array of (line number, line) of the lines with a word."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(numbered, lambda x: F.rlike(x["line"], F.lit(WORD)))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving numbers of the keys that occur twice or more, with the first place of each."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*PLACE)).alias("_first")).filter("_n > 1").drop("_n")
    return materialize(groups.orderBy(*keys).withColumn("_new", F.monotonically_increasing_id()))


def _suffix_ranks(lines: DataFrame, depths: int) -> DataFrame:
    """Places of repeated lines with their words; r0, r1, ...: their ranks by the first 1, 2, 4, ... lines, null where they are
    alone; f0, f1, ...: whether they are the first of their rank."""
    spark = lines.sparkSession
    words = F.regexp_count("line", F.lit(WORD)).alias("words")
    prints = lines.select(*PLACE, words, F.xxhash64(F.lit(1), "line").alias("_h"), F.xxhash64(F.lit(2), "line").alias("_g"))
    ranks = _ranked(prints, ["_h", "_g"])
    first = F.coalesce(F.struct(*PLACE) == F.col("_first"), F.lit(False))
    known = materialize(prints.join(ranks, ["_h", "_g"]).select(*PLACE, "words", F.col("_new").alias("r0"), first.alias("f0")))
    discard(spark, ranks)
    for j in range(1, depths):
        on = W.partitionBy("_row").orderBy("_at").rangeBetween(1 << (j - 1), 1 << (j - 1))
        pairs = known.withColumn("_next", F.first(f"r{j - 1}").over(on))
        ranks = _ranked(pairs.filter(f"r{j - 1} is not null and _next is not null"), [f"r{j - 1}", "_next"])
        deeper = pairs.join(ranks, [f"r{j - 1}", "_next"], "left")
        previous, known = known, materialize(deeper.select(*known.columns, F.col("_new").alias(f"r{j}"), first.alias(f"f{j}")))
        discard(spark, previous, ranks)
    return known


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, _at, length, words, source): of every place with an earlier copy, the longest run of lines that also starts earlier, up
    to min_words of them at least, its words (of its first min_words lines) and the first place that it starts at.

    lines has _id, _row, _at and line, one row a line with a word; earlier means a smaller (_id, _row, _at).
    """
    spark = lines.sparkSession
    depths = max(1, (min_words - 1).bit_length() + (min_words & (min_words - 1) == 0))
    top = depths - 1
    known = _suffix_ranks(lines, depths)
    # the ranks that the rounds below look up: by 2**k lines, from a common length on that the powers above k add up to
    order = W.partitionBy("_row").orderBy("_at")
    sought = {(k, length): f"s{k}_{length}" for k in range(top) for length in range(2 << k, min_words, 2 << k)}
    ahead = F.collect_list("words").over(order.rangeBetween(0, min_words - 1)).alias("ahead")
    looked = known.select("*", ahead, *[F.first(f"r{k}").over(order.rangeBetween(length, length)).alias(name) for (k, length), name in sought.items()])
    # intervals by depth: a suffix is in the deepest one it shares with another, and the first one of a deeper one also in that above
    kept = ["length", "a", "b", *PLACE, "ahead", *sought.values()]
    member = [F.when(F.col(f"r{j}").isNotNull() & (F.lit(True) if j == top else F.col(f"r{j + 1}").isNull() | F.col(f"f{j + 1}")), F.lit(1 << j)) for j in range(depths)]
    spread = looked.withColumn("length", F.explode(F.array_compact(F.array(*member))))
    own = F.coalesce(*[F.when(F.col("length") == 1 << j, F.col(f"r{j}")) for j in range(depths)])
    entries = materialize(spread.withColumn("a", own).withColumn("b", F.lit(-1)).select(*kept))
    discard(spark, known)
    for k in range(top - 1, -1, -1):
        lengths = [length for (bit, length) in sought if bit == k]
        if not lengths:
            continue
        key = F.coalesce(*[F.when(F.col("length") == length, F.col(sought[k, length])) for length in lengths])
        tried = entries.withColumn("_key", key)
        parts = tried.filter("_key is not null").groupBy("length", "a", "b", "_key").agg(F.count("*").alias("_n"), F.min(F.struct(*PLACE)).alias("_first")).filter("_n > 1").drop("_n")
        split = tried.join(parts, ["length", "a", "b", "_key"], "left")
        into = F.struct((F.col("length") + (1 << k)).alias("length"), F.col("_first._row").alias("a"), F.col("_first._at").alias("b"))
        here = F.struct("length", "a", "b")
        stays = F.when(F.col("_first").isNull() | (F.struct(*PLACE) == F.col("_first")), here)
        both = split.withColumn("_to", F.explode(F.array_compact(F.array(F.when(F.col("_first").isNotNull(), into), stays))))
        previous, entries = entries, materialize(both.select("_to.length", "_to.a", "_to.b", *PLACE, "ahead", *sought.values()))
        discard(spark, previous)
    firsts = entries.groupBy("length", "a", "b").agg(F.count("*").alias("_n"), F.min(F.struct(*PLACE)).alias("source")).filter("_n > 1").drop("_n")
    found = entries.join(firsts, ["length", "a", "b"]).filter(F.struct(*PLACE) > F.col("source"))
    # all lines of a run are repeated ones, so the words ahead of its start are those of its own lines
    words = F.aggregate(F.slice("ahead", F.lit(1), F.col("length")), F.lit(0), lambda s, n: s + n).alias("words")
    out = materialize(found.select("_row", "_at", "length", words, "source"))
    discard(spark, entries)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text cut, and n_lines (with a word), n_removed (of these) and n_runs in place of columns of these names."""
    made = ("n_lines", "n_removed", "n_runs")
    keep = [c for c in docs.columns if c not in made]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs, keep).alias("_doc")))
    body = F.col("_doc")[text]
    lines = rows.select(F.col("_doc")[doc_id].alias("_id"), "_row", F.posexplode(_said(body)).alias("_at", "_line")).select("_id", "_row", "_at", F.col("_line.line").alias("line"))
    runs = repeated_runs(lines, min_words).filter(F.col("words") >= min_words).groupBy("_row").agg(F.collect_list(F.struct("_at", "length")).alias("_runs"))
    gone = runs.select("_row", F.array_distinct(F.flatten(F.transform("_runs", lambda x: F.sequence(x["_at"], x["_at"] + x["length"] - 1)))).alias("_gone"))
    # the deleted lines as runs from a to b
    opens = F.array_sort(F.array_except("_gone", F.transform("_gone", lambda x: x + 1)))
    ends = F.array_sort(F.array_except(F.transform("_gone", lambda x: x + 1), F.col("_gone")))
    cuts = materialize(gone.select("_row", F.size("_gone").alias("_removed"), F.arrays_zip(opens.alias("a"), ends.alias("b")).alias("_cut")))
    # one plan at every size: a broadcast of the cuts would hold for small tables only
    cut = rows.join(cuts.hint("merge"), "_row", "left").withColumn("_said", _said(body)).withColumn("_all", F.split(body, "\n", -1))
    # what is kept lies between them: from the line after each run's last to the next one's first
    after = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda x: F.element_at("_said", x["b"])["i"] + 1))
    until = F.concat(F.transform("_cut", lambda x: F.element_at("_said", x["a"] + 1)["i"]), F.array(F.size("_all")))
    parts = F.filter(F.arrays_zip(after.alias("a"), until.alias("b")), lambda x: x["b"] > x["a"])
    left = F.array_join(F.flatten(F.transform(parts, lambda x: F.slice("_all", x["a"] + 1, x["b"] - x["a"]))), "\n")
    columns = [(F.when(F.col("_cut").isNull(), body).otherwise(left) if c == text else F.col("_doc")[c]).alias(c) for c in keep]
    count = F.when(body.isNull(), 0).otherwise(F.size("_said"))
    removed = F.coalesce("_removed", F.lit(0))
    return cut.select(*columns, count.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).cast("long").alias("n_runs"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), lines AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n_words
  FROM every WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), pairs AS (
  SELECT b.doc_id, b.place, b.n_words, a.doc_id AS source, b.place - a.place AS apart
  FROM lines a JOIN lines b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.place < b.place)
), chained AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, source, apart ORDER BY place) AS chain FROM pairs
), runs AS (
  SELECT doc_id, min(place) AS first, max(place) AS last FROM chained
  GROUP BY doc_id, source, apart, chain HAVING sum(n_words) >= 10
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS place FROM (SELECT DISTINCT doc_id, first, last FROM runs)
), marked AS (
  SELECT l.doc_id, l.i, g.place IS NOT NULL AS cut,
         g.place IS NOT NULL AND lag(g.place) OVER (PARTITION BY l.doc_id ORDER BY l.place) IS NULL AS opens
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place
), around AS (
  SELECT e.doc_id, e.i, e.line, m.cut, m.opens,
         last_value(m.cut IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS UNBOUNDED PRECEDING) AS cut_before,
         first_value(m.cut IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cut_after
  FROM every e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.i = m.i
), summed AS (
  SELECT doc_id, count(cut) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (coalesce(cut_before, false) AND coalesce(cut_after, false))), '') AS kept
  FROM around GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_runs, 0) AS n_runs,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
