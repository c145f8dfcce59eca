"""Language identification with error-correcting output codes.

Each language has a codeword of bits (+1 or -1). For every bit a binary classifier over hashed byte n-grams of one to
three bytes tells the languages with +1 from those with -1 (naive Bayes log odds). Decoding is loss-weighted: the
distance of a text to a codeword is the sum over bits of log(1 + exp(-codeword bit * margin)), weighted by how well that
bit's classifier did on training texts of that language; the nearest codeword wins. A text whose two nearest codewords
are about as far is flagged `ambiguous`.

Codewords: up to CODE_EXHAUSTIVE languages get all 2**(n-1) - 1 splits; more get random balanced bits, about 10 log2(n),
from a fixed seed.

Learning sees a bounded sample (documented): about `train_per_language` labelled rows of each language, taken by a hash of
their id. Spark sums the n-gram counts by language; the driver gets one vector of FEATURES counts a language and the
success counts (languages x bits). Labels are languages, so there may be `max_languages` of them at most: a column with more is
not one of languages, and training raises instead of dropping any. Prediction is one pass over all texts, whole, with no shuffle.

Defined cases: null text or one without a letter gives `und` with score 0; with no labelled row every text gets `und`; a single
known language is predicted with score 1; equal texts get equal answers; of equally near codewords that of the first label in
sorted order wins; very long texts are read whole, in one block of their own; a language label that is rarer than the sample
bound is learnt from all its rows; an empty table gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import schema_of, table

FEATURES = 1 << 14
CODE_EXHAUSTIVE = 5
TRAIN_PER_LANGUAGE = 20_000
MAX_LANGUAGES = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Bytes that tell nothing about a language (digits, ASCII punctuation, control) count as one space.
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(buf: np.ndarray) -> np.ndarray:
    """Feature numbers of all 1-, 2- and 3-byte grams of a folded text, runs of spaces taken as one."""
    text = _FOLD[buf]
    if len(text):
        text = text[np.concatenate([[True], (text[1:] != 32) | (text[:-1] != 32)])]
    one = text.astype(np.uint32)
    two = one[:-1] * 257 + one[1:] + 1000
    three = (one[:-2] * 66_049 + one[1:-1] * 257 + one[2:]) * np.uint32(2_654_435_761) >> np.uint32(18)
    return np.concatenate([one, two * np.uint32(2_654_435_761) >> np.uint32(18), three]) & np.uint32(FEATURES - 1)


def histogram(buf: np.ndarray) -> np.ndarray:
    return np.bincount(grams(buf), minlength=FEATURES)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; no column is constant."""
    if n <= CODE_EXHAUSTIVE:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng = np.random.Generator(np.random.PCG64(7))
    width = int(np.ceil(10 * np.log2(n)))
    columns = []
    while len(columns) < width:
        column = rng.permutation(np.where(np.arange(n) % 2 == 0, 1, -1))
        columns.append(column * rng.choice([-1, 1]))
    return np.array(columns, np.int8).T


class Model:
    """Languages, code, one weight vector and one offset a bit, and the weights of the decoding."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # each language weighs the same
        self.weights = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        for j in range(self.code.shape[1]):
            plus, minus = share[self.code[:, j] > 0].mean(0), share[self.code[:, j] < 0].mean(0)
            self.weights[:, j] = np.log(plus) - np.log(minus)
        self.trust = np.ones(self.code.shape)

    def margins(self, buf: np.ndarray) -> np.ndarray:
        """One margin a bit: the log odds, damped so that a long text doesn't drive all bits to infinity."""
        counts = histogram(buf)
        used = np.flatnonzero(counts)
        if not len(used):
            return np.zeros(self.weights.shape[1])
        return counts[used] @ self.weights[used] / np.sqrt(counts.sum())

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.log1p(np.exp(np.clip(-self.code * margins, -60, 60)))
        distance = (self.trust * loss).sum(1) / self.trust.sum(1)
        best = int(distance.argmin())
        belief = np.exp(-8 * (distance - distance[best]))
        score = float(belief[best] / belief.sum())
        return self.languages[best], score, score < 0.6


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _lang_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, _, buf, bounds in B.text_blocks(batch.column(1)):
            for i in range(len(bounds) - 1):
                seen = histogram(buf[bounds[i] : bounds[i + 1]])
                lang = langs[low + i]
                total[lang] = total[lang] + seen if lang in total else seen
    for lang, seen in total.items():
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(seen[used].astype(np.int64))], names=["lang", "feature", "n"])


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """A model from labelled rows; None if there are none. More than max_languages labels are an error."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"{lang} has more than {max_languages} labels")
    if not sizes:
        return None
    languages = sorted(sizes)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, per_language / sizes[k])) for k in languages], "_lang string, _share double")
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.join(F.broadcast(shares), rows[lang] == F.col("_lang")).filter(draw < F.col("_share")).select(F.col("_lang").alias("lang"), F.col(text).alias("text"))
    counts = np.zeros((len(languages), FEATURES))
    place = {k: i for i, k in enumerate(languages)}
    for r in sample.mapInArrow(_lang_counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow().to_batches():
        np.add.at(counts, ([place[k] for k in r.column(0).to_pylist()], r.column(1).to_numpy()), r.column(2).to_numpy())
    model = Model(languages, counts)
    if len(languages) == 1:
        return model
    shared = spark.sparkContext.broadcast(model)

    def successes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, seen = np.zeros(m.code.shape, np.int64), np.zeros(len(m.languages), np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for low, _, buf, bounds in B.text_blocks(batch.column(1)):
                for i in range(len(bounds) - 1):
                    at = place[langs[low + i]]
                    right[at] += np.sign(m.margins(buf[bounds[i] : bounds[i + 1]])) == m.code[at]
                    seen[at] += 1
        at, bit = np.indices(right.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bit.astype(np.int32)), pa.array(right.ravel()), pa.array(np.repeat(seen, right.shape[1]))], names=["at", "bit", "good", "n"])

    trust = np.zeros(model.code.shape)
    for r in sample.mapInArrow(successes, "at int, bit int, good long, n long").groupBy("at", "bit").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("w")).collect():
        trust[r.at, r.bit] = r.w
    model.trust = np.maximum(trust, 1e-3)
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous in place of columns of these names; the text column goes."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score", "ambiguous")]
    fields = schema_of(docs, keep, "lang_pred string, score double, ambiguous boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            out: list[tuple[str, float, bool]] = []
            for low, _, buf, bounds in B.text_blocks(texts):
                for i in range(len(bounds) - 1):
                    if m is None or not _has_letter(texts[low + i].as_py() or ""):
                        out.append(("und", 0.0, False))
                    else:
                        out.append(m.decode(m.margins(buf[bounds[i] : bounds[i + 1]])))
            pred, score, doubt = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, docs[text].alias("__text__")).mapInArrow(run, fields)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
