"""Properties of the vectorised primitives."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import blocks as B
from shelfmark.llm import superkmers as S

TEXT = st.text(alphabet="ab \t\n\x0bé中 ", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 64))
def test_words_of_blocks_equal_the_pattern(texts, limit):
    got = []
    for _, _, buf, bounds in B.text_blocks(pa.array(texts, pa.string()), limit):
        starts, ends, first = B.word_spans(buf, bounds)
        data = buf.tobytes()
        for a, b in zip(first[:-1], first[1:], strict=True):
            got.append([data[i:j].decode() for i, j in zip(starts[a:b], ends[a:b], strict=True)])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 9))
def test_equal_windows_have_equal_hashes_wherever_they_are(data, k):
    for shift in (b"", b"xyz"):
        buf = np.frombuffer(shift + data, np.uint8)
        hashes = B.windows_hash(B.byte_values(buf), k)
        seen = {}
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(bytes(buf[i : i + k]), h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30), min_size=1, max_size=5), st.integers(2, 8), st.integers(1, 4))
def test_every_window_is_in_one_run_and_copies_share_the_minimiser(texts, k, m):
    m = min(m, k)
    home = {}
    for _, _, buf, bounds in B.text_blocks(pa.array(texts)):
        hashes, limits, packed, start, end = S.elements_of(buf, bounds, False)
        first, after, least = S.runs_of(hashes, limits, k, m)
        windows = [i for a, b in zip(first, after, strict=True) for i in range(a, b)]
        assert windows == [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - k + 1)]
        for a, b, x in zip(first, after, least, strict=True):
            for i in range(a, b):
                assert home.setdefault(bytes(packed[i : i + k]), x) == x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**34 - 1), unique=True, max_size=50))
def test_seeds_survive_packing(values):
    seeds = np.sort(np.array(values, np.uint64))
    many = np.arange(len(seeds)) % 3 == 0
    table = S.pack_seeds(7, seeds, many)
    back = [(int(s) | b << 32, bool(f)) for b, blob in zip(table.column("bucket").to_pylist(), table.column("seeds").to_pylist(), strict=True) for s, f in zip(*S.unpack_seeds(blob), strict=True)]
    assert back == list(zip(seeds.tolist(), many.tolist(), strict=True))


@pytest.mark.parametrize("ordered", [False, True])
def test_a_bucket_gets_few_places_of_a_hot_run(ordered):
    scheme = S.Scheme(True, 5, 2)
    text = " ".join(f"w{i}" for i in range(40))
    sender = S.Sender(scheme, 8, np.zeros(0, np.uint64), ordered=ordered)
    ids = np.arange(1000, dtype=np.int64)
    packets = [*sender.add(ids + 7, ids, pa.array([text] * 1000)), sender.flush()]
    part = pa.Table.from_batches(packets)
    of_runs = S.open_runs(part.filter(part.column("runs").is_valid()))
    assert set(of_runs.times.tolist()) == {1000} and of_runs.held.tolist() == [int(ordered)] * len(of_runs.held)
    ready = S.judged(part.filter(part.column("runs").is_null()), None).to_pylist()
    assert len(ready) == len(of_runs.held) * (1000 - ordered)
    covered = {i: set() for i in range(1000)}
    for cut in ready:
        assert cut["key"] == cut["id"] + 7
        covered[cut["id"]] |= set(range(cut["a"], cut["b"]))
    assert all(covered[i] == set(range(40)) for i in range(int(ordered), 1000))
