"""Quality rules: weak supervision over voting rules.

Every rule looks at counts of the whole text and votes good (1), bad (0) or abstains (-1): six look for one kind of
fault and else abstain, one looks for prose. No rule decides alone:
expectation-maximisation (Dawid and Skene's model, two classes) estimates from the votes of all documents how often
each rule votes each way on good and on bad documents, and a document stays if its posterior probability of being good
is at least `threshold`. The vote patterns are counted by Spark over all documents; the driver only sees one row a
pattern (at most 3**7, whatever the number of documents) and runs EM on these counts.

Defined cases: null text counts as empty; a text without words has no votes and fails the base
test; very long texts are counted whole; equal rows get equal verdicts; a posterior equal to the threshold (a tie) keeps the document; an
empty table gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialize, schema_of, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_shouts", "n_stops", "n_bare"]
RULES = ["repetition", "symbols", "lines", "capitals", "word_size", "bare_words", "sentences"]


def text_counts(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a block."""
    rows = len(bounds) - 1
    starts, ends, first = B.word_spans(buf, bounds)
    words = np.diff(first)
    letter, capital = _LETTERS[buf], _CAPITALS[buf]
    out = {"n_words": words, "word_chars": B.row_sums(~B.WHITE[buf] & ((buf & 0xC0) != 0x80), bounds), "n_symbols": B.row_sums(SYMBOLS[buf], bounds)}
    out |= {"n_letters": B.row_sums(letter, bounds), "n_capitals": B.row_sums(capital, bounds)}

    # lines that hold a word and equal an earlier line of the row
    feed = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], feed + 1]))
    line_start = line_start[line_start < len(buf)]
    next_feed = np.concatenate([feed, [len(buf)]])[np.searchsorted(feed, line_start)]
    line_end = np.minimum(next_feed, bounds[B.row_of(bounds, line_start) + 1])
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    values = B.byte_values(buf)
    line_row = B.row_of(bounds, line_start)
    key = B.mix(B.spans_hash(values, line_start, line_end) + line_row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    lines = np.bincount(line_row, minlength=rows)
    distinct = np.bincount(line_row[np.unique(key, return_index=True)[1]], minlength=rows)
    out |= {"n_lines": lines, "n_dup_lines": lines - distinct}

    # words in three-word windows that the row holds twice or more
    row = np.repeat(np.arange(rows), words)
    hit = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        window = B.windows_hash(B.spans_hash(values, starts, ends), 3)
        same_row = row[2:] == row[:-2]
        at = np.flatnonzero(same_row)
        key = B.mix(window[at] + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = at[B.repeated(key)]
        for k in range(3):
            hit[at + k] = True
    out["n_repeat_words"] = np.bincount(row[hit], minlength=rows)
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    letters_before = np.concatenate([[0], np.cumsum(letter)])
    bare = letters_before[ends] == letters_before[starts]
    out["n_shouts"] = np.bincount(row[last == ord("!")], minlength=rows)
    out["n_stops"] = np.bincount(row[(last == ord(".")) | (last == ord("?"))], minlength=rows)
    out["n_bare"] = np.bincount(row[bare], minlength=rows)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [text_counts(buf, bounds) for _, _, buf, bounds in B.text_blocks(batch.column(batch.num_columns - 1))]
        if parts:
            counts = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=[*batch.schema.names[:-1], *COUNTS])


def with_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep and the counts of the texts; the scan's partitions stay as they are."""
    fields = schema_of(docs, keep, ", ".join(f"{c} long" for c in COUNTS))
    return docs.select(*keep, docs[text].alias("__text__")).mapInArrow(_count_batches, fields)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> Column:
    """The seven votes as an array of -1 (abstain), 0 (bad) and 1 (good)."""
    n = F.greatest("n_words", F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, -1).when(bad, 0).when(good, 1).otherwise(-1)

    c, never = F.col, F.lit(False)
    return F.array(
        vote(20 * c("n_repeat_words") > 7 * n, never),
        vote(5 * c("n_symbols") > n, never),
        vote((c("n_dup_lines") >= 2) & (2 * c("n_dup_lines") > c("n_lines")), never),
        vote(5 * c("n_capitals") > 2 * c("n_letters"), never),
        vote((c("word_chars") < 2 * n) | (c("word_chars") > 12 * n), never),
        vote(10 * c("n_bare") > 2 * n, never),
        vote(10 * c("n_shouts") > 3 * n, (100 * c("n_stops") >= 2 * n) & (10 * c("n_stops") <= 4 * n)),
    ).cast("array<int>")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """EM over distinct vote patterns. Returns the share of good documents and table[rule, class, vote + 1].

    The classes are told apart by the start (bad votes make a document suspect) and by one constraint: a bad vote is
    never likelier, and a good vote never less likely, on good documents than on bad ones.
    """
    bad, good = (patterns == 0).sum(1), (patterns == 1).sum(1)
    belief = 1 / (1 + np.exp(np.clip(4.0 * bad - 2.0 * good - 1.0, -30, 30)))
    table_, prior = np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - belief), counts * belief])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        for j in range(patterns.shape[1]):
            for y in (0, 1):
                seen = np.array([weight[y][patterns[:, j] == v].sum() for v in (-1, 0, 1)]) + 0.5
                table_[j, y] = seen / seen.sum()
            low, high = table_[j, 0], table_[j, 1]
            high[1], low[2] = min(high[1], low[1]), min(low[2], high[2])
            table_[j] /= table_[j].sum(1, keepdims=True)
        belief = posterior(patterns, prior, table_)
    return prior, table_


def posterior(patterns: np.ndarray, prior: float, table_: np.ndarray) -> np.ndarray:
    odds = np.full(len(patterns), np.log(prior / (1 - prior)))
    for j in range(patterns.shape[1]):
        odds += np.log(table_[j, 1, patterns[:, j] + 1]) - np.log(table_[j, 0, patterns[:, j] + 1])
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with the counts, `base_failed`, `quality` (posterior) and `kept` in place of columns of these names.

    The counted table is written to the shared scratch folder once: texts are scanned a single time.
    """
    made = {*COUNTS, "base_failed", "quality", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = materialize(with_counts(docs, text, keep).withColumn("_votes", votes()))
    # documents that fail the base test are decided; the model learns from the others and scores all
    seen = rows.groupBy("_votes").agg(F.count_if(~base_failed())).collect()
    if not seen:
        verdicts = rows.sparkSession.createDataFrame([], "_votes array<int>, quality double")
    else:
        patterns = np.array([r[0] for r in seen])
        counts = np.array([r[1] for r in seen], float)
        belief = posterior(patterns, *fit(patterns, counts))
        verdicts = rows.sparkSession.createDataFrame([(p.tolist(), float(b)) for p, b in zip(patterns, belief, strict=True)], "_votes array<int>, quality double")
    joined = rows.join(F.broadcast(verdicts), "_votes", "left")  # at most 3**7 rows
    return joined.select(*keep, *COUNTS, base_failed().alias("base_failed"), "quality", (~base_failed() & (F.coalesce("quality", F.lit(0.0)) >= threshold)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )
