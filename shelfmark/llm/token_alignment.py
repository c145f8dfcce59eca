"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in the corpus.

Every text is encoded by both tokenizers. A two-pointer merge of the cumulative token ends, inside `mapInPandas`, gives the groups (runs
of tokens between byte offsets at which both end) and the links (pairs of token occurrences whose byte ranges overlap). Both
encodings fall apart at a space that follows a character other than white space: the byte-level splitting pattern starts a new
piece there, and no piece of the other vocabulary holds a space after another character (checked when it is loaded; without that, texts
are one piece). So each distinct piece is encoded and merged once a worker, and a text is the run of its pieces (tested against whole texts).

Tasks work on chunks of texts and give, one row a chunk, the distinct pairs of the chunk with their numbers of documents, and the
pairs of each document packed as indexes into them. Spark counts the pairs over all chunks, finds each side's maximum, joins
counts and maxima back to the pairs of the chunks, and each chunk sums them up for its documents. What is shuffled by pair is one row a chunk and
pair, however many documents hold it; nothing is broadcast and no group grows with the corpus.

Defined cases: texts that are null, empty, or not given back byte for byte by one of the tokenizers have no tokens: all zeros and an empty
digest; they count for no pair; very long texts are one document of a chunk of their own size; equal rows count as documents each and get
equal results; a null id is kept; of counts that tie for the maximum all are best; an empty table gives no rows; other columns are
kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_identity, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a chunk, text that is aligned at once, documents of either, and pieces that a worker remembers; none changes a result.
CHUNK_BYTES, STEP_BYTES, MOST_ROWS, CACHED_PIECES = 6 << 20, 1 << 19, 1 << 15, 300_000
MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u0131\u0134-\u024f]*")
_TWO, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S) ")

_aligners: dict[tuple[str, str], Aligner] = {}


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sequences of tokens given by their cumulative ends (equal at the end): the common ends, and the links as tokens of a and of b.

    The merge of the two sorted lists, for all steps at once: every end of either side is a step, at which the pointers stand on the first
    tokens that end there or later; where both end, both move on and a group is closed."""
    last = int(a[-1]) + 1 if len(a) else 0
    here = np.zeros((2, last), bool)
    here[0, a] = True
    here[1, b] = True
    steps = np.flatnonzero(here[0] | here[1])
    at_a, at_b = (np.cumsum(h)[steps] - h[steps] for h in here)
    return np.flatnonzero(here[0] & here[1]), at_a, at_b


class Aligner:
    def __init__(self, first: str, second: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(first)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level alphabet
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else None
        self.size_b = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else None if self.b.is_control(i) or self.b.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # both must be known to break before a space that follows another character
        known = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.breaks = known and not any("▁" in n.lstrip("▁") for n in names)
        # if ids are in the order of the merges, a rank encoder gives the same ids; it is asked about plain Latin characters
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
        plain = known and merged == list(range(256, 256 + len(merged)))
        ranks = {t: i for i, t in enumerate(self.a_bytes[: 256 + len(merged)])}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if plain else None
        self.lengths = [np.array([len(x or b"") for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), self.size_b))]
        self.pool, self.digits = np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits], np.int64)
        self.digit_at = np.cumsum(self.digits) - self.digits
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.spans = np.zeros((0, 4), np.int64)  # start and number of the ids of each side; numbers of -1 if the bytes differ

    def pieces(self, text: str) -> list[str]:
        """The pieces of space + text, each without its leading space."""
        if not self.breaks:
            return [text]
        return _CUT.split(text) if text[0] == " " or _TWO.search(text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode pieces. Those that end in a character other than white space break from what follows, so they are encoded in one go."""
        solid = [p for p in new if p and not p[-1].isspace()] if self.breaks else []
        rest = [p for p in new if not p or p[-1].isspace()] if self.breaks else new
        plain = [p for p in solid if _PLAIN.fullmatch(p)] if self.quick else []
        other = [p for p in solid if not _PLAIN.fullmatch(p)] if self.quick else solid
        for group, encode in ((plain, self.quick), (other, lambda text: self.a.encode(text, add_special_tokens=False).ids)):
            if group and not self._learn_joined(group, encode):
                rest = rest + group
        if not rest:
            return
        a, b = [x.ids for x in self.a.encode_batch([" " + p for p in rest], add_special_tokens=False)], [x if p else [self.space] for p, x in zip(rest, self.b.encode(rest, num_threads=1), strict=True)]
        counts = []
        for piece, x, y in zip(rest, a, b, strict=True):
            want = b" " + piece.encode()
            try:
                fits = b"".join([self.a_bytes[i] for i in x]) == want == b"".join([self.b_bytes[i] for i in y])
            except TypeError:  # a token without bytes
                fits = False
            counts.append((len(x), len(y)) if fits else (-1, -1))
        kept = [[x if n[0] >= 0 else [] for x, n in zip(side, counts, strict=True)] for side in (a, b)]
        self._store(rest, [np.fromiter(chain.from_iterable(side), np.int32) for side in kept], np.array(counts, np.int64))

    def _learn_joined(self, pieces: list[str], encode: Callable[[str], list[int]]) -> bool:
        text = " ".join(pieces)
        want = (" " + text).encode()
        sides = [np.array(x, np.int32) for x in (encode(" " + text), self.b.encode(text, num_threads=1))]
        edge = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        counts = []
        for own, lengths, known in zip(sides, self.lengths, (self.a_bytes, self.b_bytes), strict=True):
            ends = np.cumsum(lengths[own])
            at = np.searchsorted(ends, edge)
            if ends[-1] != edge[-1] or (ends[at] != edge).any() or b"".join([known[x] or b"" for x in own.tolist()]) != want:
                return False
            counts.append(np.diff(at + 1, prepend=0))
        self._store(pieces, sides, np.stack(counts, 1))
        return True

    def _store(self, pieces: list[str], ids: list[np.ndarray], counts: np.ndarray) -> None:
        """Remember pieces with their ids, one after another, and how many each has on either side."""
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        used = np.maximum(counts, 0)
        start = np.cumsum(used, 0) - used + np.array([len(x) for x in self.ids])
        self.spans = np.concatenate([self.spans, np.stack([start[:, 0], counts[:, 0], start[:, 1], counts[:, 1]], 1)])
        self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """sizes (documents x n_a, n_b, n_groups, n_links), digests, and of all links the document and the pair (as one number)."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.forget()
        known = self.known
        if new := [p for p in set(chain.from_iterable(split)) if p not in known]:
            self.learn(new)
        count = np.array([len(s) for s in split], np.int64)
        piece = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        spans = self.spans[piece]
        doc = np.repeat(np.arange(len(texts)), count)
        bad = np.zeros(len(texts), bool)
        bad[doc[spans[:, 1] < 0]] = True
        spans, doc = spans[~bad[doc]], doc[~bad[doc]]
        ids = [self.ids[side][runs(spans[:, 2 * side], spans[:, 2 * side + 1])].astype(np.int64) for side in (0, 1)]
        holder = [np.repeat(doc, spans[:, 2 * side + 1]) for side in (0, 1)]
        ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids, strict=True)]
        common, at_a, at_b = merge_ends(*ends)
        pairs, of = ids[0][at_a] * self.size_b + ids[1][at_b], holder[0][at_a]
        group = [np.searchsorted(common, e) for e in ends]
        group_of = np.zeros(len(common), np.int64)
        group_of[group[0]] = holder[0]
        sizes = np.stack([np.bincount(x, minlength=len(texts)) for x in (*holder, group_of, of)], 1).astype(np.int64)
        return sizes, self._digests(ids, group, len(common), sizes), of, pairs

    def _digests(self, ids: list[np.ndarray], group: list[np.ndarray], groups: int, sizes: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups, written out as decimal ids: commas within a side, a bar between the sides, semicolons between groups."""
        held = [np.bincount(g, minlength=groups) for g in group]
        start = np.cumsum(held[0] + held[1]) - held[0] - held[1]
        place = [start[group[0]] + np.arange(len(ids[0])) - (np.cumsum(held[0]) - held[0])[group[0]], start[group[1]] + held[0][group[1]] + np.arange(len(ids[1])) - (np.cumsum(held[1]) - held[1])[group[1]]]
        token = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        after = np.full(len(token), ord(","), np.uint8)
        for side in (0, 1):
            token[place[side]] = ids[side]
        after[start + held[0] - 1] = ord("|")
        after[start + held[0] + held[1] - 1] = ord(";")
        width = self.digits[token] + 1
        end = np.cumsum(width)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[runs(end - width, width - 1)] = self.pool[runs(self.digit_at[token], width - 1)]
        out[end - 1] = after
        tokens = np.cumsum(sizes[:, 0] + sizes[:, 1])
        edge = np.concatenate([[0], end])[np.concatenate([[0], tokens])]
        view = memoryview(out)
        return [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


_CHUNK = "chunk long, key_a array<long>, key_b array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, pairs array<long>, n_docs array<long>, held binary"


class _Chunk:
    """Documents of one chunk, aligned a megabyte at a time."""

    def __init__(self, tool: Aligner):
        self.tool, self.keys, self.sizes, self.digests, self.held, self.rows, self.size = tool, [], [], [], [], 0, 0

    def add(self, keys: list[tuple[int, int]], texts: list[str | None]) -> None:
        sizes, digests, doc, pairs = self.tool.align(texts)
        self.held.append(np.unique((doc + self.rows) << 47 | pairs, return_counts=True))
        self.keys += keys
        self.sizes.append(sizes)
        self.digests += digests
        self.rows, self.size = self.rows + len(texts), self.size + sum(len(t or "") for t in texts)

    def row(self, number: int) -> dict:
        both, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
        doc, pair = both >> 47, both & ((1 << 47) - 1)
        pairs, place, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
        per_doc = np.bincount(doc, minlength=self.rows)
        begin = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
        step = np.diff(place, prepend=0)
        step[begin] = place[begin]  # each document starts anew
        held = zstandard.compress(np.concatenate([[self.rows], per_doc, step, times]).astype("<i4").tobytes(), 3)
        keys, sizes = np.array(self.keys, np.int64), np.concatenate(self.sizes)
        return {"chunk": number, "key_a": keys[:, 0], "key_b": keys[:, 1], **{n: sizes[:, i] for i, n in enumerate(MADE[:4])}, "digest": self.digests, "pairs": pairs, "n_docs": n_docs, "held": held}


def held_pairs(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document and distinct pair: the document, the pair's place among those of the chunk, and the number of links."""
    raw = np.frombuffer(zstandard.decompress(held), "<i4").astype(np.int64)
    rows, n = int(raw[0]), (len(raw) - 1 - int(raw[0])) // 2
    per_doc, step, times = raw[1 : 1 + rows], raw[1 + rows : 1 + rows + n], raw[1 + rows + n :]
    doc = np.repeat(np.arange(rows), per_doc)
    total = np.cumsum(step)
    begin = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    base = np.repeat(total[begin] - step[begin], per_doc[per_doc > 0]) if n else total
    return doc, total - base, times


def token_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row a chunk of documents, with both tokenizers' groups and links; documents are known by 128 bits of id and text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, number = aligner(first, second), TaskContext.get().partitionId() << 33
        chunk, keys, texts, size = _Chunk(tool), [], [], 0
        for frame in frames:
            for a, b, t in zip(frame["a"].tolist(), frame["b"].tolist(), frame["t"], strict=True):
                keys.append((a, b))
                texts.append(t)
                size += len(t or "")
                if size >= STEP_BYTES or len(texts) >= MOST_ROWS:
                    chunk.add(keys, texts)
                    keys, texts, size = [], [], 0
                    if chunk.size >= CHUNK_BYTES or chunk.rows >= MOST_ROWS:
                        yield pd.DataFrame([chunk.row(number)])
                        chunk, number = _Chunk(tool), number + 1
        if texts:
            chunk.add(keys, texts)
        if chunk.rows:
            yield pd.DataFrame([chunk.row(number)])

    key = row_identity(doc_id, text)
    return docs.select(key["a"].alias("a"), key["b"].alias("b"), docs[text].alias("t")).mapInPandas(run, _CHUNK)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best_a, best_b): the documents that hold each pair, and whether that is the highest number of its a and of its b."""
    counts = links.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n"))
    counts = counts.select("pair", F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "n")
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
        counts = counts.join(most, side)
    return counts.select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def _sum_up(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    row = chunk.iloc[0]
    doc, place, times = held_pairs(row["held"])
    answers = answers.sort_values("pair")
    n, best, mutual = (answers[c].to_numpy(np.int64) for c in ("n", "best_a", "mutual"))
    out = {"a": row["key_a"], "b": row["key_b"], **{c: row[c] for c in MADE[:4]}, "groups_sha256": row["digest"]}
    for name, value in (("n_best", best), ("count_sum", n), ("n_mutual", mutual)):
        total = np.zeros(len(row["key_a"]), np.int64)
        np.add.at(total, doc, times * value[place])
        out[name] = total
    return pd.DataFrame(out)


def align_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_mutual (links best on both sides)."""
    size_b = aligner(first, second).size_b
    links = materialize(token_links(docs, text, doc_id, first, second))
    known = pair_counts(links, size_b).select("pair", "n", F.col("best_a").cast("int").alias("best_a"), (F.col("best_a") & F.col("best_b")).cast("int").alias("mutual"))
    answers = links.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair")
    schema = "a long, b long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, n_mutual long"
    sums = links.drop("pairs", "n_docs").groupBy("chunk").cogroup(answers.groupBy("of")).applyInPandas(_sum_up, schema)
    made = [*MADE, "n_mutual"]
    one = sums.groupBy(F.struct("a", "b").alias("_key")).agg(*[F.first(c).alias(f"_{c}") for c in made])  # equal rows have equal results
    keep = [c for c in docs.columns if c != text and c not in made]
    whole = docs.select(row_identity(doc_id, text).alias("_key"), F.struct(*[docs[c].alias(c) for c in keep]).alias("_doc"))
    return whole.join(one, "_key").select(*[F.col("_doc")[c].alias(c) for c in keep], *[F.col(f"_{c}").alias(c) for c in made])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
