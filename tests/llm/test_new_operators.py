"""Alignment, resampling and personal data: against brute force on hard rows, and the cases that their docstrings define."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import importance_resampling, personal_data, token_alignment
from tests.llm.test_cases import ROWS, frame, got, want

HARD = [
    *[(d, t if t is None else t[:20000]) for d, t in ROWS], (40, " leading"), (41, "trailing "), (42, " "), (43, "two  spaces\n and\t tabs \r\n x"), (44, "a b 　c"), (45, "lower ▁ block"), (46, "x▁y"),
    (47, "<|endoftext|> and <s> </s> <unk>"), (48, "naïve café 数据 🙂 👩‍👩‍👧 don't we'll"), (49, "\x1c \x1d  \x00end"), (50, "same words same words"), (51, "line\n\n\nline  "), (52, "<0x0A> 1234567 12-34"), (53, "é" * 500),
]


@pytest.fixture(scope="module")
def tool():
    return token_alignment.aligner(token_alignment.FIRST, token_alignment.SECOND)


def plain_alignment(tool, text):
    """(A ids, B ids, groups, links) of a whole text from sets of ends and overlaps; None without tokens."""
    if not text:
        return None
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text, num_threads=1)
    parts = [tool.a_bytes[x] for x in a], [tool.b_bytes[x] for x in b]
    if any(None in p or b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for high in common:
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, own, strict=True) if low < e <= high) for ids, own in zip((a, b), ends, strict=True)))
        low = high
    begin = [[0, *e[:-1]] for e in ends]
    links, j = [], 0
    for i, x in enumerate(a):
        while j and begin[1][j] > begin[0][i]:
            j -= 1
        k = j
        while k < len(b) and begin[1][k] < ends[0][i]:
            if ends[1][k] > begin[0][i]:
                links.append((x, b[k]))
            k += 1
        j = max(k - 1, 0)
    return a, b, groups, links


def test_alignment_equals_whole_texts(spark, tool):
    assert tool.breaks and tool.quick
    plain = [plain_alignment(tool, t) for _, t in HARD]
    assert sum(p is None for p in plain) >= 4
    count = Counter(x for p in plain if p for x in set(p[3]))
    most_a, most_b = Counter(), Counter()
    for (a, b), n in count.items():
        most_a[a], most_b[b] = max(most_a[a], n), max(most_b[b], n)
    expected = []
    for p in plain:
        if p is None:
            expected.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, links = p
        best = [count[x] == most_a[x[0]] for x in links]
        both = [count[x] == most_a[x[0]] == most_b[x[1]] for x in links]
        expected.append((len(a), len(b), len(groups), len(links), sum(best), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest(), sum(both)))
    df = token_alignment.align_tokens(frame(spark, HARD))
    assert got(df, *token_alignment.MADE, "n_mutual") == want(expected, HARD)
    assert {"key", "window", "root"} <= set(df.columns)


def test_alignment_over_many_chunks_and_forgotten_pieces(spark, monkeypatch):
    rows = [(i, f"tokens of document {i % 7} are few, {'word ' * (i % 5)}end") for i in range(60)]
    whole = got(token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string")), *token_alignment.MADE)
    monkeypatch.setattr(token_alignment, "CACHED_PIECES", 5)
    small = token_alignment.Aligner(token_alignment.FIRST, token_alignment.SECOND)
    texts = [t for _, t in rows]
    parts = [small.align(texts[i : i + 3]) for i in range(0, 60, 3)]
    assert [tuple(s) for p in parts for s in p[0].tolist()] == [r[1:5] for r in sorted(whole)]
    assert [d for p in parts for d in p[1]] == [r[7] for r in sorted(whole)]


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align_tokens(frame(spark, [])).count() == 0


def test_the_merge_of_ends():
    def merged(a, b):
        return [x.tolist() for x in token_alignment.merge_ends(np.array(a, np.int64), np.array(b, np.int64))]

    assert merged([2, 3, 7], [3, 5, 7]) == [[3, 7], [0, 1, 2, 2], [0, 0, 1, 2]]
    assert merged([], []) == [[], [], []]


def test_held_pairs_come_back(tool):
    chunk = token_alignment._Chunk(tool)
    for keys, texts in (([(1, 2), (3, 4)], ["a b a", None]), ([(5, 6), (7, 8)], ["", "b a c"])):
        chunk.add(keys, texts)
    row = chunk.row(0)
    doc, place, times = token_alignment.held_pairs(row["held"])
    assert Counter(doc.tolist()).keys() == {0, 3} and times.sum() == row["n_links"].sum() and row["key_a"].tolist() == [1, 3, 5, 7]
    assert row["n_docs"].sum() == len(doc) and np.bincount(place).tolist() == row["n_docs"].tolist()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_weights(rows, targets, buckets):
    def count(texts):
        out = np.zeros(buckets)
        for t in texts:
            for f in plain_features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in rows), count(targets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for _, text in rows:
        words, features = plain_features(text)
        total = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features)
        out.append((len(words), len(features), total // len(features) if features else 0))
    return out


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_weights_equal_plain(spark, rows):
    targets = ["word1 word2 same same", None, "", "é ü"]
    items = spark.createDataFrame(list(enumerate(targets)), "item_id long, text string")
    df = importance_resampling.importance_weights(frame(spark, rows), items, buckets=97)
    assert got(df, "n_words", "n_features", "weight") == want(plain_weights(rows, targets, 97), rows)
    assert importance_resampling.importance_weights(frame(spark, rows), items.limit(0), buckets=97).count() == len(rows)


def test_weights_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "PART_BYTES", 500)
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(40)]
    items = spark.createDataFrame([(0, "w1 w2 w3")], "item_id long, text string")
    df = importance_resampling.importance_weights(spark.createDataFrame(rows, "doc_id long, text string"), items, buckets=31)
    assert got(df, "n_words", "n_features", "weight") == want(plain_weights(rows, ["w1 w2 w3"], 31), rows)


def test_chunks_unify_their_features():
    texts = ["a b a b", "b a", "", "a"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    norm, a, b, row, hashed, words = importance_resampling.block_features(buf, bounds, 2)
    assert words.tolist() == [4, 2, 0, 1]
    a, b, part, holders, doc, times = importance_resampling.chunk_features(a, b, row, hashed, 3)
    assert part.tolist() == sorted(part.tolist())
    data, found, at = norm.tobytes(), {}, 0
    for x, y, n in zip(a, b, holders, strict=True):
        found[data[x:y].decode()] = list(zip(doc[at : at + n].tolist(), times[at : at + n].tolist(), strict=True))
        at += n
    assert found == {"a": [(0, 2), (1, 1), (3, 1)], "b": [(0, 2), (1, 1)], "a b": [(0, 2)], "b a": [(0, 1), (1, 1)]}
    packet = importance_resampling.pack(b - a, holders, doc, times, importance_resampling.gather(norm, a, b))
    again = importance_resampling.unpack(packet)
    assert [x.tolist() for x in again[:4]] == [(b - a).tolist(), holders.tolist(), doc.tolist(), times.tolist()]


def test_ranks_equal_one_sort_and_ties_go_by_id(spark):
    rows = [(i, 30 if i % 9 else 5, (i * 37) % 4) for i in range(200)] + [(None, 30, 2), (7, 30, 3)]
    weighed = spark.createDataFrame(rows, "doc_id long, n_words long, weight long")
    out = importance_resampling.draw(weighed).collect()
    fit = sorted((r for r in out if r.n_words >= 20), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in out if r.rank is not None)
    assert [x[0] for x in drawn] == list(range(1, 25 * len(fit) // 100 + 1))
    assert [x[1:] for x in drawn] == [(-r.score, r.doc_id) for r in fit[: len(drawn)]]
    flat = importance_resampling.draw(weighed.withColumn("weight", F.lit(0)), share=100).filter("rank is not null")
    assert flat.count() == len(fit) and flat.agg(F.max("rank")).first()[0] == len(fit)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    """The base kinds by Python's own expressions."""
    text, out = text or "", []
    for rank, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


PERSONAL = [
    *ROWS[:9], (60, "a@b.c_d@e.f x@y@z.com a.b@c..d@e.f .@-.- a@b"), (61, "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3 9.9.9.9."), (62, "4432507379035540 4432-5073 7903 5540 44325073790355401 4432507379035541 0000 0000 0000 00 1 2 3"),
    (63, "+1 (555) 123-4567, +12 34, ++4912345678901 +1234567890123456"), (64, "é🙂 mail: x.y@z.co.uk, é 10.0.0.255 🙂+44 20 7946 0958"), (65, "7" * 5000), (66, "x" * 30000 + "@y.z " + "a." * 3000), (67, "1-" * 3000 + "1"), (68, "a@b.c" * 200),
    (69, "4432507379035540" + " " + "4432507379035540"), (70, "1.1.1." * 900), (71, "+1" * 500 + "2345678901"), (72, "card 4432 5073 7903 5540 then 5105105105105100"),
]


@pytest.mark.parametrize("rows", [PERSONAL, []], ids=["rows", "empty"])
def test_base_spans_equal_plain(spark, rows):
    found = personal_data.find_personal(frame(spark, rows)).select("doc_id", F.filter("personal", lambda s: s["kind"].isin("email", "ip", "card", "phone")).alias("p"))
    have = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.p]) for r in found.collect()), key=repr)
    assert have == sorted(((d, plain_spans(t)) for d, t in rows), key=repr)


def spans(spark, text):
    return [(s.kind, s.value, s.score) for s in personal_data.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().personal]


def test_checksums_confirm_and_context_decides(spark):
    assert spans(spark, "pay GB82 WEST 1234 5698 7654 32 or DE89370400440532013000 not DE89370400440532013001") == [("iban", "GB82 WEST 1234 5698 7654 32", 0.8), ("iban", "DE89370400440532013000", 0.8)]
    assert spans(spark, "Social Security: 123-45-6789, order 123-45-6780, ssn 000-12-3456") == [("ssn", "123-45-6789", 0.7)]
    assert spans(spark, "call 555-123-4567 or see part 555-123-4568") == [("local_phone", "555-123-4567", 0.7)]
    assert spans(spark, "version 1.2.3.4, host 1.2.3.4") == [("ip", "1.2.3.4", 0.3), ("ip", "1.2.3.4", 1.0)]


def test_redaction_covers_overlaps(spark):
    rows = [(1, "to a@10.0.0.1.com now"), (2, None), (3, "nothing"), (4, "+4432507379035540")]
    found = personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.text for r in personal_data.redact(found).orderBy("doc_id").collect()] == ["to <email> now", None, "nothing", "+<card>"]


def test_no_python_in_the_plan_of_personal_data(spark):
    plan = personal_data.op13_personal_data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
