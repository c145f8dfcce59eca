"""Models against plain versions of their own: error-correcting decoding, expectation-maximisation, and the ties of both and of the URL rules."""

import math
import re

import numpy as np
import pytest

from shelfmark.llm import language_id, quality_rules, url_filters

TEXTS = {
    "en": ["the cat sat on the mat and the dog ran", "Where is the house of my friend?", "this is what they thought, 12 times"],
    "de": ["die katze sitzt auf der matte und schläft", "Wo ist das Haus von meinem Freund?", "das ist nicht was sie dachten"],
    "fr": ["le chat est assis sur le tapis", "où est la maison de mon ami?", "ce n'est pas ce qu'ils pensaient"],
}


def plain_grams(text):
    folded = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in text.encode()).translate({i: i + 32 for i in range(65, 91)})
    codes = [ord(c) for c in re.sub(" +", " ", folded)]
    out = [c % language_id.FEATURES for c in codes]
    for a, b in zip(codes, codes[1:]):
        out.append(((a * 257 + b + 1000) * 2_654_435_761 % 2**32 >> 18) % language_id.FEATURES)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        out.append(((a * 66_049 + b * 257 + c) * 2_654_435_761 % 2**32 >> 18) % language_id.FEATURES)
    return out


def plain_languages(labelled, asked):
    """One-to-three byte grams, naive Bayes a bit, loss-weighted distances, all in loops."""
    names = sorted(labelled)
    code = [[1, *(1 if k >> i & 1 else -1 for i in range(len(names) - 1))] for k in range(2 ** (len(names) - 1) - 1)]
    bits = [[column[i] for column in code] for i in range(len(names))]
    counts = {n: [0.5] * language_id.FEATURES for n in names}
    for n in names:
        for text in labelled[n]:
            for g in plain_grams(text):
                counts[n][g] += 1
    share = {n: [c / sum(counts[n]) for c in counts[n]] for n in names}

    def margins(text):
        grams, out = plain_grams(text), []
        for j in range(len(code)):
            plus, minus = ([share[n] for i, n in enumerate(names) if bits[i][j] == s] for s in (1, -1))
            odds = sum(math.log(sum(s[g] for s in plus) / len(plus)) - math.log(sum(s[g] for s in minus) / len(minus)) for g in grams)
            out.append(odds / math.sqrt(len(grams)))
        return out

    trust = []
    for i, n in enumerate(names):
        told = [margins(t) for t in labelled[n]]
        trust.append([(sum((m[j] > 0) == (bits[i][j] > 0) for m in told) + 1) / (len(told) + 2) for j in range(len(code))])
    found = []
    for text in asked:
        at = margins(text)
        distance = [sum(w * math.log1p(math.exp(-b * m)) for w, b, m in zip(trust[i], bits[i], at)) / sum(trust[i]) for i in range(len(names))]
        best = min(range(len(names)), key=distance.__getitem__)
        found.append((names[best], 1 / sum(math.exp(-8 * (d - distance[best])) for d in distance)))
    return found


def test_language_decoding_equals_a_plain_version(spark):
    rows = [(i, t, n) for i, (n, t) in enumerate((n, t) for n, texts in TEXTS.items() for t in texts)]
    asked = ["the dog and the house", "das Haus und die Katze", "la maison et le chat", "a", "été 99 straße", "mon Freund is le cat " * 40]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    want = plain_languages(TEXTS, asked)
    assert [r.lang_pred for r in got] == [n for n, _ in want] and [n for n, _ in want[:3]] == ["en", "de", "fr"]
    assert [r.score for r in got] == pytest.approx([s for _, s in want], rel=1e-3)


def test_equally_near_codewords_give_the_first_label():
    model = language_id.Model(["aa", "bb"], np.ones((2, language_id.FEATURES)))
    assert model.decode(model.margins(np.frombuffer(b"any text", np.uint8))) == ("aa", 0.5, True)


def test_more_labels_than_languages_are_an_error(spark):
    rows = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(7)], "doc_id long, text string, lang string")
    assert len(language_id.train(rows, max_languages=7).languages) == 7
    with pytest.raises(ValueError, match="lang has more than 6 labels"):
        language_id.train(rows, max_languages=6)


def plain_em(rows, rounds=60):
    """EM over single documents instead of patterns."""
    n, k = len(rows), len(rows[0])
    belief = [1 / (1 + math.exp(4 * r.count(0) - 2 * r.count(1) - 1)) for r in rows]
    for _ in range(rounds):
        prior = min(max((sum(belief) + 1) / (n + 2), 0.02), 0.98)
        tables = []
        for j in range(k):
            share = []
            for y in (0, 1):
                seen = {v: 0.5 + sum((b if y else 1 - b) for r, b in zip(rows, belief) if r[j] == v) for v in (-1, 0, 1)}
                share.append({v: seen[v] / sum(seen.values()) for v in seen})
            low, high = share
            high[0] = min(high[0], low[0])
            low[1] = min(low[1], high[1])
            tables.append([{v: s[v] / sum(s.values()) for v in s} for s in share])
        belief = []
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[j][1][v]) - math.log(tables[j][0][v]) for j, v in enumerate(r))
            belief.append(1 / (1 + math.exp(-min(max(odds, -60), 60))))
    return belief


def test_expectation_maximisation_equals_a_plain_version():
    rng = np.random.default_rng(5)
    good = rng.random(400) < 0.7
    rows = []
    for is_good in good.tolist():
        bad = rng.random(4) < (0.03 if is_good else 0.6)
        prose = 1 if rng.random() < (0.8 if is_good else 0.15) else (0 if rng.random() < (0.02 if is_good else 0.4) else -1)
        rows.append([0 if b else -1 for b in bad] + [prose])
    patterns, place, counts = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    got = quality_rules.posterior(patterns, *quality_rules.fit(patterns, counts.astype(float)))[place.ravel()]
    assert got.tolist() == pytest.approx(plain_em(rows), rel=1e-6, abs=1e-9)
    assert ((got >= 0.5) == good).mean() > 0.9


def test_rules_of_equal_host_and_path_block(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/x/y")], "page_id long, url string")
    for verdicts in (("allow", "block"), ("block", "allow")):
        rules = url_filters.rules_frame(spark, [("example.org", "/x", v) for v in verdicts])
        assert [tuple(r) for r in url_filters.filter_urls(pages, rules, "url").select("rule", "verdict").collect()] == [("example.org/x", "block")]
    even = url_filters.rules_frame(spark, [("a.example.org", "/x", "allow"), ("example.org", "/x/y", "block")])  # equally long: the longer host
    assert url_filters.filter_urls(pages, even, "url").first().verdict == "allow"
