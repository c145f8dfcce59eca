"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi.

A block's features are its ancestor tags, the words of their class, id and role, and its text (length, links, stops,
signs). The two labels are article and furniture. The field is trained by stochastic gradient ascent on the exact
log-likelihood (forward-backward; the step of the label pairs is shortened to 1 at most, so that a very long page counts like others) from two sets of labelled pages: those of html_pages (a fixed seed), and a bounded
sample of the table's own pages that mark their article, at most `train_pages` of them, whole, by a hash of their URL, whose
labels are read from these marks. Each is seen twice, once with the tags that mark an article left out, so that text and
furniture alone must do. Training runs on the driver over a few hundred short sequences; pages are parsed, scored and
decoded in Spark tasks, whole, with no shuffle.

Defined cases: null or empty html, and pages without text or without an article block, give an empty text; broken markup
is read as browsers do in the main (unclosed tags end with their parents); very long and very deeply nested pages are read
whole, at a cost that grows with their length; equal rows are extracted each; pages with equal hashes are drawn in order
of their html, and of two equally likely label sequences the one with less text wins; an empty table gives no rows (the made pages are
training enough); other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema_of, table
from .html_blocks import MARKS, WIDTH, Block, feature, leaf_blocks
from .html_pages import labelled_pages

TRAIN_PAGES = 200


def block_features(blocks: list[Block], blind: bool = False) -> Iterator[list[int]]:
    """Feature numbers of each block; blind leaves out the tags and marks that tell an article."""
    for at, block in enumerate(blocks):
        text, n = block.text, len(block.text)
        names = {"bias", f"parent {(block.plain_parent if blind else block.parent) or ''}", f"length {int(math.log2(n))}"}
        if block.link_chars * 2 > n:
            names.add("mostly links")
        elif block.link_chars:
            names.add("some links")
        stops = text.count(". ") + text.endswith((".", "!", "?"))
        names.add(f"stops {min(stops, 3)}")
        if text.startswith("©") or "©" in text[:40]:
            names.add("copyright")
        names.add("first" if at == 0 else "last" if at == len(blocks) - 1 else "middle")
        own = {feature(x) for x in names}
        yield sorted(own.union(block.tags) if blind else own.union(block.tags, block.marks))


def page_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks under a marking tag and under no furniture inside it; None if no block is marked."""
    labels = [int(block.in_mark and not block.in_furniture) for block in blocks]
    return labels if any(labels) else None


class Field:
    """Weights of features by label and of label pairs."""

    def __init__(self):
        self.unary = np.zeros((WIDTH, 2))
        self.pair = np.zeros((2, 2))

    def scores(self, features: Iterable[list[int]]) -> np.ndarray:
        return np.array([self.unary[f].sum(0) for f in features])

    def decode(self, features: Iterable[list[int]]) -> list[int]:
        """The likeliest label sequence (Viterbi)."""
        rows = self.scores(features).tolist()
        if not rows:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = rows[0]
        back = []
        for s0, s1 in rows[1:]:
            from0, from1 = a + p00 < b + p10, a + p01 < b + p11
            back.append((int(from0), int(from1)))
            a, b = (b + p10 if from0 else a + p00) + s0, (b + p11 if from1 else a + p01) + s1
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def step(self, features: list[list[int]], labels: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood of a page."""
        s = self.scores(features)
        n = len(s)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = s[0]
        for t in range(1, n):
            forward[t] = s[t] + np.logaddexp(forward[t - 1, 0] + self.pair[0], forward[t - 1, 1] + self.pair[1])
        for t in range(n - 2, -1, -1):
            onward = s[t + 1] + backward[t + 1]
            backward[t] = np.logaddexp(self.pair[:, 0] + onward[0], self.pair[:, 1] + onward[1])
        total = np.logaddexp(*forward[-1])
        belief = np.exp(forward + backward - total)
        pairs = np.zeros((2, 2))
        for t in range(n):
            gap = -belief[t]
            gap[labels[t]] += 1
            self.unary[features[t]] += rate * gap
            if t:
                both = np.exp(forward[t - 1][:, None] + self.pair + s[t] + backward[t] - total)
                pairs -= both
                pairs[labels[t - 1], labels[t]] += 1
        change = rate * 0.2 * pairs
        self.pair += change / max(1.0, float(np.abs(change).max()))  # a very long page is one step like others


def train_field(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 6, rate: float = 0.1) -> Field:
    field, rng = Field(), random.Random(3)
    for k in range(rounds):
        rng.shuffle(sequences)
        for features, labels in sequences:
            field.step(features, labels, rate / (1 + k))
        field.unary *= 0.999
    return field


def _both_views(html: str, marked: frozenset[str]) -> list[tuple[list[list[int]], list[int]]]:
    """(features, labels) of a page, as it is and blind; made pages, of which no tag marks the article, tell it by a tag of its own."""
    blocks = leaf_blocks(html)
    labels = page_labels(blocks) if marked else [int(b.in_label) for b in blocks]
    return [(list(block_features(blocks, blind)), labels) for blind in (False, True)] if labels else []


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for html in batch.column(0).to_pylist() for x in _both_views(html or "", MARKS)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([y for _, y in found], pa.list_(pa.int32()))], names=["features", "labels"])


def train(pages: DataFrame, url: str = "url", html: str = "html", train_pages: int = TRAIN_PAGES) -> Field:
    sequences = [x for page in labelled_pages() for x in _both_views(page, frozenset())]
    marked = pages.filter(F.contains(F.col(html), F.lit("<article")) | F.contains(F.col(html), F.lit("<main")))
    hashed = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.lit("train"))
    # the pages with the smallest hashes: the same ones however the table is laid out
    sample = marked.select(F.col(html)).orderBy(hashed, F.xxhash64(html)).limit(train_pages)
    sequences += [([list(f) for f in r.features], list(r.labels)) for r in sample.mapInArrow(_label_batches, "features array<array<int>>, labels array<int>").collect()]
    return train_field(sequences)


def extract_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return " ".join(b.text for b, y in zip(blocks, field.decode(block_features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """pages with text and n_chars in place of columns of these names; the html column goes."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fields = schema_of(pages, keep, "text string, n_chars long")
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [extract_text(x or "", shared.value) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, pages[html].alias("__html__")).mapInArrow(run, fields)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), train(pages))
