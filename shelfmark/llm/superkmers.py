"""Super-k-mer partitioning: texts are cut into runs of windows that share a minimiser, and each run goes to its bucket.

A window is k consecutive elements (words or bytes) of one document; its minimiser is the smallest hash among its m-grams.
Equal windows have equal minimisers, so all copies of a window meet in one bucket. A task sends each distinct run
once. Runs travel packed: all runs of one task and bucket are one compressed string.

What a task's own runs decide is settled before the shuffle: of a run that it holds at several places, those that are copies whatever
the bucket finds are cut there and then, and dealt out evenly as ready verdicts. Only the places that wait for a verdict go
with the run: none if all are cut, those of the smallest document if a copy is what has an earlier one. So a bucket gets of a passage
that any number of documents share one run a flush (16 MB of runs) with the places of one document at most.

A minimiser that very many different runs share would make one bucket large. Such minimisers are found on a sample of
documents beforehand; their windows travel one by one to buckets chosen by the window's own hash. That only decides where
a window goes: results are the same whatever the sample says.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

FLUSH_BYTES = 16 << 20
#: Ready verdicts of a packet.
CUT_ROWS = 1 << 16
#: Expected growth of text by the overlap of runs, and raw bytes of runs in a bucket.
EXPANSION, BUCKET_BYTES = 3.5, 8 << 20
SAMPLE_DOCS, HOT_SHARE = 20_000, 0.001
#: A packet of runs and their places or, where runs is null, of ready cuts.
WIRE = "bucket int, runs binary, places binary"
CUTS = "key long, id long, a int, b int"


class Scheme(NamedTuple):
    """What a window is made of: words or bytes, k of them, with minimisers of m."""

    words: bool
    k: int
    m: int


def runs_of(elements: np.ndarray, bounds: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, minimiser) of each run; rows of elements are bounds[r]:bounds[r + 1]."""
    n = len(elements) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = B.windows_hash(elements, m)
    width, done = k - m + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    row = B.row_of(bounds, np.arange(n))
    whole = np.arange(n) + k <= bounds[row + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return first, last + 1, least[first]


def elements_of(buf: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row bounds, packed bytes, first byte, end byte of each element); packed words are one space apart."""
    if not words:
        at = np.arange(len(buf))
        return B.byte_values(buf), bounds, buf, at, at + 1
    starts, ends, first = B.word_spans(buf, bounds)
    hashes = B.spans_hash(B.byte_values(buf), starts, ends)
    white = B.WHITE[buf]
    keep = ~white
    keep[1:] |= ~white[:-1]  # the first white byte after a word
    place = np.concatenate([[0], np.cumsum(keep)])
    packed = np.where(white, np.uint8(32), buf)[keep]
    return hashes, first, packed, place[starts], place[ends - 1] + 1 if len(ends) else place[ends]


class Sender:
    """Gathers the distinct runs of one task and packs them by bucket; `only` holds the seeds to send, all if None.

    ordered: a place is a copy if the run also starts in a document of smaller id; otherwise, if it also starts anywhere else.
    """

    def __init__(self, scheme: Scheme, buckets: int, hot: np.ndarray, only: np.ndarray | None = None, ordered: bool = False):
        self.scheme, self.buckets, self.hot, self.only, self.ordered = scheme, buckets, hot, only, ordered
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.homes: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        k = self.scheme.k
        for low, high, buf, bounds in B.text_blocks(texts):
            hashes, limits, packed, start, end = elements_of(buf, bounds, self.scheme.words)
            first, after, least = runs_of(hashes, limits, k, self.scheme.m)
            if self.only is not None and len(first):
                wanted = in_sorted(seed_of(least, self.buckets), self.only)
                first, after, least = first[wanted], after[wanted], least[wanted]
            if not len(first):
                continue
            is_hot = np.isin(least, self.hot)
            if is_hot.any():  # one run a window, sent by the window's own hash
                sizes = np.where(is_hot, after - first, 1)
                again = np.repeat(np.arange(len(first)), sizes)
                step = np.arange(len(again)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = B.windows_hash(hashes, k)
                first, after = first[again] + step, np.where(is_hot[again], first[again] + step + 1, after[again])
                least = np.where(is_hot[again], own[first], least[again])
            a, b = start[first].tolist(), end[after - 2 + k].tolist()
            data, known = packed.tobytes(), self.known
            self.numbers.append(np.array([known.setdefault(data[i:j], len(known)) for i, j in zip(a, b, strict=True)], np.int64))
            row = B.row_of(limits, first)
            self.homes.append((B.mix(least.copy()) % np.uint64(self.buckets)).astype(np.int64))
            self.rows.append(np.stack([keys[low:high][row], ids[low:high][row], first - limits[row], after - 1 + k - limits[row]], 1).astype("<i8"))
            self.held += sum(b) - sum(a)
            if self.held >= FLUSH_BYTES:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        runs = list(self.known)
        number, place = (np.concatenate(x) if x else np.zeros(shape, np.int64) for x, shape in ((self.numbers, 0), (self.rows, (0, 4))))
        home = np.empty(len(runs), np.int64)
        home[number] = np.concatenate(self.homes) if self.homes else 0
        order = np.argsort(home, kind="stable")
        new_number = np.empty(len(runs), np.int64)
        new_number[order] = np.arange(len(runs))
        number = new_number[number]
        times = np.bincount(number, minlength=len(runs))
        if self.ordered:
            least = np.full(len(runs), np.iinfo(np.int64).max)
            np.minimum.at(least, number, place[:, 1])
            waits = place[:, 1] == least[number]
        else:
            waits = times[number] == 1
        cuts, place, number = place[~waits], place[waits], number[waits]
        place = place[np.argsort(number, kind="stable")]
        held = np.bincount(number, minlength=len(runs))
        upto = np.concatenate([[0], np.cumsum(held)])
        ranked = home[order]
        out: list[tuple] = []
        for a, b in _groups(ranked):
            part = [runs[i] for i in order[a:b]]
            spots = place[upto[a] : upto[b]]
            numbers = [np.array([len(x) for x in part], "<i4"), times[a:b].astype("<i4"), held[a:b].astype("<i4")]
            meta = np.array([b - a, len(spots)], "<i8").tobytes() + b"".join(x.tobytes() for x in numbers) + b"".join(np.ascontiguousarray(spots[:, i]).tobytes() for i in range(3))
            out.append((int(ranked[a]), self.pack(b"".join(part)), self.pack(meta)))
        for at in range(0, len(cuts), CUT_ROWS):
            ready = np.ascontiguousarray(cuts[at : at + CUT_ROWS].T).tobytes()
            out.append((zlib.crc32(ready) % self.buckets, None, self.pack(ready)))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "runs", "places"])


def _groups(ranked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of equal values."""
    if len(ranked):
        cut = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]]).tolist()
        yield from zip(cut[:-1], cut[1:], strict=True)


def in_sorted(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ranked, values)
    at[at == len(ranked)] = 0
    return ranked[at] == values


def seed_of(least: np.ndarray, buckets: int) -> np.ndarray:
    """A minimiser's bucket and 32 more bits of its hash, as one number: enough to tell it from the few others of its bucket."""
    h = B.mix(least.copy())
    return (h % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32)


def seeds_of(texts: pa.Array, scheme: Scheme, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct seeds of the texts, number of runs of each)."""
    found = []
    for _, _, buf, bounds in B.text_blocks(texts):
        hashes, limits, _, _, _ = elements_of(buf, bounds, scheme.words)
        found.append(seed_of(runs_of(hashes, limits, scheme.k, scheme.m)[2], buckets))
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


SEEDS = "bucket int, chunk int, seeds binary"


def pack_seeds(chunk: int, seeds: np.ndarray, times: np.ndarray) -> pa.Table:
    """Rows of SEEDS: gaps between the 32-bit parts of a bucket's sorted seeds, and a byte each (a count, 255 at most)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    home = (seeds >> np.uint64(32)).astype(np.int64)
    low = (seeds & np.uint64(0xFFFFFFFF)).astype("<u4")
    times = np.minimum(times, 255).astype(np.uint8)
    rows = [(int(home[a]), pack(np.diff(low[a:b], prepend=low[a : a + 1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + times[a:b].tobytes())) for a, b in _groups(home)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "seeds": pa.array([r[1] for r in rows], pa.binary())})


def unpack_seeds(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 5
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32), np.frombuffer(raw, np.uint8, n, 4 * n)


def repeated_seeds(part: pa.Table) -> pa.Table:
    """Of a bucket's seeds, back to each chunk those that occur twice or more in all, each with 8 * log2 of its count."""
    chunks, bucket = part.column("chunk").to_pylist(), part.column("bucket")[0].as_py()
    opened = [unpack_seeds(b.as_py()) for b in part.column("seeds")]
    _, of = np.unique(np.concatenate([s for s, _ in opened]), return_inverse=True)
    total = np.bincount(of, np.concatenate([t for _, t in opened]))[of]
    out, at = [], 0
    for chunk, (seeds, _) in zip(chunks, opened, strict=True):
        mine = total[at : at + len(seeds)]
        at += len(seeds)
        many = mine >= 2
        if many.any():
            out.append(pack_seeds(chunk, seeds[many].astype(np.uint64) | np.uint64(bucket << 32), 8 * np.log2(mine[many])))
    return pa.concat_tables(out) if out else pack_seeds(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def chosen_seeds(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted seeds, weight of each) of the replies to a chunk."""
    opened = [(bucket, *unpack_seeds(blob.as_py())) for bucket, blob in zip(replies.column("bucket").to_pylist(), replies.column("seeds"), strict=True)]
    seeds = np.concatenate([np.zeros(0, np.uint64), *(low.astype(np.uint64) | np.uint64(bucket << 32) for bucket, low, _ in opened)])
    weights = np.concatenate([np.zeros(0, np.uint8), *(w for _, _, w in opened)])
    order = np.argsort(seeds)
    return seeds[order], weights[order]


def _sender(scheme: Scheme, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(scheme, buckets, hot)
        for batch in batches:
            yield from sender.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2))
        if sender.known:
            yield sender.flush()

    return run


def _minimisers(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, bounds in B.text_blocks(batch.column(0)):
                hashes, limits, packed, start, end = elements_of(buf, bounds, scheme.words)
                first, after, least = runs_of(hashes, limits, scheme.k, scheme.m)
                if len(first):
                    whole = B.spans_hash(hashes, first, after - 1 + scheme.k)
                    _, keep = np.unique(whole, return_index=True)
                    value, times = np.unique(least[keep], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["least", "n"])

    return run


def plan(docs: DataFrame, scheme: Scheme) -> tuple[int, int, np.ndarray]:
    """(bytes of text, rows, minimisers that many runs share) of docs(key, text)."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    sample = docs.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_003)) < F.lit(int(1_000_003 * share) + 1)).select("text")
    counts = sample.mapInArrow(_minimisers(scheme), "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).cache()
    everything = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(200, int(HOT_SHARE * everything))  # at most 1 / HOT_SHARE minimisers can reach it
    hot = np.array([r[0] for r in counts.filter(F.col("n") >= floor).select("least").collect()], np.int64).view(np.uint64)
    counts.unpersist()
    return total or 0, rows, hot


def bucket_runs(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows of WIRE from docs(key long, id long, text), dealt out by bucket."""
    total, _, hot = plan(docs, scheme)
    buckets = max(8, int(total * EXPANSION / BUCKET_BYTES))
    sent = docs.select("key", "id", "text").mapInArrow(_sender(scheme, buckets, hot), WIRE)
    return sent.repartition(max(4, buckets // 4), "bucket")


class Runs(NamedTuple):
    """The runs of a bucket: bytes, bounds, how often each occurred, and its places that wait for a verdict (how many; key, id, first window)."""

    data: np.ndarray
    bounds: np.ndarray
    times: np.ndarray
    held: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    starts: np.ndarray


def open_runs(table: pa.Table) -> Runs:
    unpack = zstandard.ZstdDecompressor().decompress
    data, lengths, times, held, places = [], [], [], [], ([], [], [])
    for runs, meta in zip(table.column("runs"), table.column("places"), strict=True):
        data.append(unpack(runs.as_py()))
        raw = unpack(meta.as_py())
        n, m = np.frombuffer(raw, "<i8", 2)
        lengths.append(np.frombuffer(raw, "<i4", n, 16))
        times.append(np.frombuffer(raw, "<i4", n, 16 + 4 * n))
        held.append(np.frombuffer(raw, "<i4", n, 16 + 8 * n))
        for i in range(3):
            places[i].append(np.frombuffer(raw, "<i8", m, 16 + 12 * n + 8 * m * i))
    joined = np.frombuffer(b"".join(data), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    return Runs(joined, bounds, *(np.concatenate(x).astype(np.int64) for x in (times, held)), *(np.concatenate(p) for p in places))


def _cuts(keys: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"key": pa.array(keys), "id": pa.array(ids), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})


def judged(part: pa.Table, judge: Callable[[Runs], pa.Table]) -> pa.Table:
    """CUTS of a bucket: those that came ready, and those that judge finds in its runs."""
    unpack = zstandard.ZstdDecompressor().decompress
    is_run = part.column("runs").is_valid()
    ready = [_cuts(*np.frombuffer(unpack(blob.as_py()), "<i8").reshape(4, -1)) for blob in part.filter(pc.invert(is_run)).column("places")]
    runs = part.filter(is_run)
    return pa.concat_tables([*ready, judge(open_runs(runs))] if runs.num_rows else ready)


def spread(runs: Runs, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """CUTS: each cut of a run at every place of it that waits for one."""
    upto = np.concatenate([[0], np.cumsum(runs.held)])
    times = runs.held[row]
    at = np.repeat(np.arange(len(row)), times)
    place = np.repeat(upto[row] - (np.cumsum(times) - times), times) + np.arange(len(at))
    start = runs.starts[place]
    return _cuts(runs.keys[place], runs.ids[place], start + a[at], start + b[at])


def stretches(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the maximal runs of set flags within each row, counted from the row's start."""
    if not len(flags):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], flags[:-1]]) & ~edge[:-1]
    after = np.concatenate([flags[1:], [False]]) & ~edge[1:]
    first, end = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    row = B.row_of(bounds, first)
    return row, first - bounds[row], end - bounds[row]
