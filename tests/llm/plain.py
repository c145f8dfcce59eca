"""Plain single-threaded versions of the corpus operators, to hold the distributed ones against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return WORD.findall((text or "").encode())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(docs, k=35):
    """(n_words, n_removed, kept_sha256) of each document."""
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def earlier(docs, k=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    first: dict[bytes, int] = {}
    for i, t in docs:
        if i is not None:
            b = (t or "").encode()
            for j in range(len(b) - k + 1):
                first[b[j : j + k]] = min(first.get(b[j : j + k], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if i is not None and first[b[j : j + k]] < i:
                gone[j : j + k] = b"\1" * k
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def gram_set(text, n=5):
    w = WORD.findall((text or "").encode().translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(docs, tenths=8):
    """(set size, smallest id of the group) of each document."""
    sets = [gram_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j > i).items():
            if 10 * both >= tenths * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    best: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [(len(s), best.get(find(i)) if s else docs[i][0]) for i, s in enumerate(sets)]


def cut_lines(docs, min_words=10):
    """The text of each document without later copies of maximal repeated runs of lines with min_words words or more, and the
    numbers of lines and of removed ones. Every pair of equal lines that no equal lines precede is followed to its end."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    split = {i: (docs[i][1] or "").split("\n") for i in order}
    said = {i: [j for j, line in enumerate(split[i]) if words(line)] for i in order}
    told = {i: [split[i][j] for j in said[i]] for i in order}
    seen, gone = defaultdict(list), {i: set() for i in order}
    for i in order:
        for p, line in enumerate(told[i]):
            for o, q in seen[line]:
                if p and q and told[o][q - 1] == told[i][p - 1]:
                    continue
                n = 1
                while p + n < len(told[i]) and q + n < len(told[o]) and told[o][q + n] == told[i][p + n]:
                    n += 1
                if sum(len(words(x)) for x in told[i][p : p + n]) >= min_words:
                    gone[i].update(range(p, p + n))
            seen[line].append((i, p))
    out = {}
    for i in order:
        lost = set()
        for p in gone[i]:  # with the blank lines before the next one if that goes too
            lost.update(range(said[i][p], said[i][p + 1] if p + 1 in gone[i] else said[i][p] + 1))
        kept = "\n".join(line for j, line in enumerate(split[i]) if j not in lost)
        out[i] = (kept if lost else docs[i][1], len(said[i]), len(gone[i]))
    return [out[i] for i in range(len(docs))]


def bench_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(FOLD))


def contaminated(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for a in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[a : a + size])].add(str(i) if i is not None else None)
    sizes = {len(w) for w in windows}
    out = []
    for _, t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= who - {None}
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    in_repeat = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(in_repeat)
