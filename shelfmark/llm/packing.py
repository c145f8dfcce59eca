"""Packing: sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its own scan partition, in order, with no shuffle. A document that fills whole windows
gives them at once; its rest is placed online. The state is a level array: open[h] is the number of partially filled
windows with h tokens in them. A rest of s tokens goes to the level h (0: a new window) that makes the sum over all
levels of open[h]**2 smallest, which keeps complementary levels in stock (ties: the fullest level). While `max_open` windows are open, no new one is
opened: a rest that fits in none is cut, its start fills a window of the commonest level (the choice that lowers the sum most), and
what is left of it is placed in turn. Windows that are still open at the end of a task are closed by cutting: the
fullest are filled up from the emptiest, and the last one is cut to lengths that are powers of two, which need no
padding. Memory is bounded by max_open windows and one batch of texts.

The ids are those of the named tokenizer. If its file names the normalisation and splitting that `Encoder` knows, texts of plain
Latin characters are split at white space, which no piece crosses, and each distinct word is split by the file's own pattern and looked up once per
worker; any other text, and every text of another tokenizer, is encoded whole by the library. Both ways give the same ids (tested).

Defined cases: null text counts as empty and gives only the end id; a very long text is encoded whole and cut into windows; equal
rows are packed each; a null id is kept; an empty table gives no pieces; columns other than id and text are not handed on.
Pieces depend on how the scan is split, but a task run again gives the same pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import schema_of, table

WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Words and pieces that a worker remembers; changes no result.
CACHED_WORDS, CACHED_PIECES = 300_000, 100_000
MAX_OPEN = 2048
# What the fast way knows, as vocabulary files state it (fixed values); the pattern is the file's.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Characters whose normalisation and case mapping are one to one: printable ASCII, Latin-1 and Latin Extended letters.
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ɏ]*")

_encoders: dict[str, Encoder] = {}


def split_pattern(spec: dict) -> str | None:
    """The pattern that a vocabulary file splits texts by, if the rest of its way is the known one."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if spec.get("normalizer") != KNOWN_NORMALIZER or len(parts) != 2 or parts[1] != KNOWN_BYTES:
        return None
    pattern = parts[0].get("pattern", {}).get("Regex")
    return pattern if {k: v for k, v in parts[0].items() if k != "pattern"} == KNOWN_SPLIT else None


class Encoder(dict):
    """Word between white space -> its ids as little-endian bytes; encode() gives the bytes of a text."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        pattern = split_pattern(spec)
        self.pieces = regex.compile(pattern).findall if pattern else None
        self.known: dict[str, bytes] = {}
        self.added = [t["content"].lower() for t in spec.get("added_tokens") or []]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level alphabet
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.piece, self.pieces(word)))
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        if (ids := self.known.get(piece)) is None:
            shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
            if len(self.known) < CACHED_PIECES:
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.pieces and _PLAIN.fullmatch(text):
            low = text.lower()
            if not any(t in low for t in self.added):
                return b"".join(map(self.__getitem__, low.split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Packer:
    """The online state of one task. A piece is (document, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int, max_open: int, first_id: int):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.open = np.zeros(window + 1, np.int64)
        self.n_open = 0
        self.stock: dict[int, list[list[tuple]]] = defaultdict(list)
        self.closed: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.closed.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        tokens, step = len(ids) // 4, 4 * self.window
        whole = tokens // self.window
        for k in range(whole):
            self.close([(doc, k * self.window, ids[k * step : (k + 1) * step], tokens)])
        if rest := ids[whole * step :]:
            self.place((doc, whole * self.window, rest, tokens), len(rest) // 4)

    def level_for(self, size: int) -> tuple[int, bool]:
        """The level that makes the sum of squares smallest, and whether size tokens fit there; 0 is a new window."""
        may_open = self.n_open < self.max_open
        at = np.flatnonzero(self.open[1 : self.window - size + 1]) + 1
        if len(at):
            full = at + size == self.window  # a full window leaves the array
            change = 1 - 2 * self.open[at] + np.where(full, 0, 1 + 2 * self.open[at + size])
            best = len(at) - 1 - int(np.argmin(change[::-1]))
            if not may_open or change[best] <= 2 * self.open[size] + 1:
                return int(at[best]), True
        return (0, True) if may_open else (int(np.argmax(self.open)), False)

    def place(self, piece: tuple, size: int) -> None:
        level, fits = self.level_for(size)
        while not fits:
            doc, start, ids, tokens = piece
            room = self.window - level
            self.close([*self.take(level), (doc, start, ids[: 4 * room], tokens)])
            piece, size = (doc, start + room, ids[4 * room :], tokens), size - room
            level, fits = self.level_for(size)
        pieces = self.take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
        else:
            self.stock[level + size].append(pieces)
            self.open[level + size] += 1
            self.n_open += 1

    def take(self, level: int) -> list[tuple]:
        self.open[level] -= 1
        self.n_open -= 1
        return self.stock[level].pop()

    def finish(self) -> None:
        """Close every open window by cutting."""
        left = [(h, p) for h in range(1, self.window) for p in self.stock[h]]
        self.open[:] = 0
        self.n_open = 0
        self.stock.clear()
        low, high = 0, len(left) - 1
        spare: list[tuple] = []
        while low <= high:
            need, pieces = self.window - left[high][0], left[high][1]
            high -= 1
            while need:
                if not spare:
                    if low > high:
                        break
                    spare = left[low][1]
                    low += 1
                doc, start, ids, tokens = spare.pop()
                pieces.append((doc, start, ids[: 4 * need], tokens))
                if len(ids) > 4 * need:
                    spare.append((doc, start + need, ids[4 * need :], tokens))
                need -= len(pieces[-1][2]) // 4
            self.settle(pieces)
        while spare:
            self.settle(spare)
            spare = []

    def settle(self, pieces: list[tuple]) -> None:
        """Close pieces as one full window, or as windows whose lengths are powers of two."""
        pieces = pieces[::-1]
        left = sum(len(p[2]) for p in pieces) // 4
        while left:
            need = 1 << (min(left, self.window).bit_length() - 1) if left < self.window else self.window
            left -= need
            part = []
            while need:
                doc, start, ids, tokens = pieces.pop()
                part.append((doc, start, ids[: 4 * need], tokens))
                if len(ids) > 4 * need:
                    pieces.append((doc, start + need, ids[4 * need :], tokens))
                need -= len(part[-1][2]) // 4
            self.close(part)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand its ids."""
    fields = schema_of(docs, [doc_id], "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    names = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 33)
        id_type = None

        def out() -> pa.RecordBatch:
            rows, packer.closed = packer.closed, []
            columns = [pa.array([r[0] for r in rows], id_type), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7))]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[7], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                packer.add(batch.column(0)[i].as_py(), encode(batch.column(1)[i].as_py() or "") + end)
                if len(packer.closed) >= 2000:
                    yield out()
        packer.finish()
        if packer.closed:
            yield out()

    return docs.select(doc_id, text).mapInArrow(run, fields)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
