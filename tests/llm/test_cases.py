"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest

import corpus_pipeline
from shelfmark.llm import decontamination, html_extraction, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, url_filters
from shelfmark.llm.components import components
from tests.llm import plain

BODY = " ".join(f"word{i}" for i in range(120))
LONG = "\n".join(" ".join(f"w{(i * 7919 + j) % 50021}" for j in range(40)) for i in range(2500))
ROWS = [
    (1, BODY), (2, BODY), (3, f"first line\nsecond line\n{BODY}"), (4, f"first line\nsecond line\nother"), (5, None), (6, ""), (7, " \n\t \n"), (8, "a b c"), (9, "A  b\tC"), (9, "A  b\tC"),
    (None, BODY), (10, "é ü " * 60), (11, LONG), (12, LONG[: len(LONG) // 2]), (13, "same " * 300), (14, "\n\nx\n\n\nx\n\ny\nx\n\ny"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=ROWS):
    """With columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: 0 for c in ("key", "id", "chunk", "n", "f", "n_words", "kept", "start", "_row", "hits", "window", "a", "b", "root")}
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(c) for c, v in extra.items()])


def pairs(rows=ROWS):
    return sorted(rows, key=repr)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def want(values, rows=ROWS):
    return sorted(((d, *v) for (d, _), v in zip(rows, values, strict=True)), key=repr)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_line_dedup(spark, rows):
    expected = [(t, n, r) for t, n, r in plain.cut_lines(rows)]
    assert got(line_dedup.dedup_lines(frame(spark, rows)), "text", "n_lines", "n_removed") == want(expected, rows)


@pytest.mark.parametrize("k", [1, 3, 5, 8, 13])
def test_line_dedup_of_other_depths(spark, k):
    rows = [(i, "\n".join("abcabcab"[i:] + "xyz"[: i % 3])) for i in range(8)] + [(20, "a\nb\nc\na\nb\nc\na\nb\nc\na\nb\nc"), (21, "x\n\ny\nq r\n\n\nz a\nb")]
    rows += [(30 + i, "\n".join(f"{c} {c}" if j % 3 else c for j, c in enumerate("hijklmnopq"[i % 4 : 4 + i]))) for i in range(7)]
    assert got(line_dedup.dedup_lines(frame(spark, rows), min_words=k), "text", "n_lines", "n_removed") == want(plain.cut_lines(rows, k), rows)


def test_line_runs_are_as_long_as_their_words_need(spark):
    """Three lines of four words go if they were seen together, and stay if only their pairs were: the depth decides."""
    a, b, c, long = "a1 a2 a3 a4", "b1 b2 b3 b4", "c1 c2 c3 c4", " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{a}\n{b}\nend one"), (2, f"start two\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}\nown three"), (4, f"own four\n{a}\n\n{b}\n{c}\nmore"), (5, f"five\n{long}\nv"), (6, f"six\n{long}\nvi"), (7, long)]
    cut = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert cut[3] == (rows[2][1], 0, 0)
    assert cut[4] == ("own four\nmore", 3, 1)
    assert cut[6] == ("six\nvi", 1, 1) and cut[7] == ("", 1, 1)
    lines = spark.createDataFrame([(d, d, i, x) for d, t in rows for i, x in enumerate(y for y in t.split("\n") if y)], "_id long, _row long, _at int, line string")
    runs = {(r._row, r._at): (r.length, r.source._row, r.source._at) for r in line_dedup.repeated_runs(lines).collect()}
    assert runs[3, 0] == (2, 1, 0) and runs[3, 1] == (2, 2, 1) and runs[4, 1] == (3, 3, 0) and runs[4, 2] == (2, 2, 1) and runs[4, 3] == (1, 2, 2) and runs[7, 0] == (1, 5, 1)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_substring_dedup(spark, rows):
    df = substring_dedup.remove_repeats(frame(spark, rows))
    assert got(df, "n_words", "n_removed", "kept_sha256") == want(plain.repeats(rows), rows)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_suffix_dedup(spark, rows):
    df = suffix_dedup.remove_earlier(frame(spark, rows))
    assert got(df, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(plain.earlier(rows), rows)


def test_suffix_dedup_leaves_rows_alone_whose_ids_are_no_numbers(spark):
    """They lose no bytes and make no other row lose any, and 1.2 and 1.7 are not both 1."""
    rows = [("1", BODY), ("2", BODY), ("x", BODY), ("1.2", BODY), (None, BODY), ("0", "short")]
    out = suffix_dedup.remove_earlier(spark.createDataFrame(rows, "doc_id string, text string"), with_bytes=False).collect()
    assert {r.doc_id: r.n_removed for r in out} == {"1": 0, "2": len(BODY.encode()), "x": 0, "1.2": 0, None: 0, "0": 0}


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_ngram_join(spark, rows):
    assert got(ngram_join.similar_groups(frame(spark, rows)), "n_shingles", "component_id") == want(plain.groups(rows), rows)


def test_ngram_join_links_through_others_and_at_the_threshold(spark):
    """Chains of texts that differ by a few n-grams each, so that the ends are far apart; sizes around the bound."""
    base = [f"t{i}" for i in range(300)]
    rows = [(100 - i, " ".join(base[: 3 * i] and [f"c{j}" for j in range(3 * i)] + base[3 * i :] or base)) for i in range(40)]
    rows += [(200 + n, " ".join(f"s{i}" for i in range(40 + n))) for n in range(0, 14)]
    assert got(ngram_join.similar_groups(frame(spark, rows)), "n_shingles", "component_id") == want(plain.groups(rows), rows)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_index_family_against_a_dictionary(size):
    """Batches of any size give every suffix its smallest document so far; levels are sorted, disjoint and fall geometrically."""
    import numpy as np

    rng = np.random.default_rng(size)
    family, first = suffix_dedup.IndexFamily(), {}
    docs = np.sort(rng.integers(0, 80, 300))
    suffixes = np.array([bytes(rng.integers(97, 100, 4).tolist()) for _ in docs], "S4")
    for at in range(0, len(docs), size):
        mine, who = suffixes[at : at + size], docs[at : at + size]
        for s, d in zip(mine.tolist(), who.tolist(), strict=True):
            first[s] = min(first.get(s, d), d)
        assert family.add(mine, who).tolist() == [first[s] for s in mine.tolist()]
        sizes = [len(level) for level, _ in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(first)
        assert all((level[1:] > level[:-1]).all() for level, _ in family.levels)
    assert {s: d for level, least in family.levels for s, d in zip(level.tolist(), least.tolist(), strict=True)} == first


def test_suffix_dedup_is_the_same_for_any_batch(spark):
    df = suffix_dedup.remove_earlier(frame(spark), batch=5)
    assert got(df, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(plain.earlier(ROWS), ROWS)


def test_decontamination(spark):
    items = [(1, BODY[:200]), (2, BODY[:200]), (3, "A b, c!"), (4, None), (5, ""), (None, "other"), (7, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = want(plain.contaminated(ROWS, items))
    for literal, broadcast in ((20_000, 50_000), (0, 0)):  # with small sides, and with both sides shuffled
        df = decontamination.decontaminate(frame(spark), bench, literal_words=literal, broadcast_rows=broadcast)
        assert got(df, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    clean = decontamination.decontaminate(frame(spark), bench.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(ROWS)
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0


def test_quality(spark):
    df = quality_rules.score_quality(frame(spark))
    assert got(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want([plain.counts(t) for _, t in ROWS])
    assert not df.filter("base_failed and kept").count() and df.columns.count("kept") == 1
    assert quality_rules.score_quality(frame(spark, [])).count() == 0


def test_language(spark):
    texts = [("the cat and the dog are in the house with them " * 3, "en"), ("der hund und die katze sind nicht in dem haus " * 3, "de"), ("le chien et le chat ne sont pas dans la maison " * 3, "fr")]
    labelled = spark.createDataFrame([(i, *texts[i % 3]) for i in range(60)] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    asked = spark.createDataFrame([(1, "the dog with the cat"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "123 %&! 45"), (6, "le chat et la maison" * 5000), (6, "le chat et la maison")], SCHEMA)
    rows = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(asked, model).collect())
    assert rows == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (6, "fr")]
    assert {r.lang_pred for r in language_id.identify(asked, language_id.train(labelled.limit(0))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(asked, language_id.train(labelled.filter("lang = 'en'"))).collect()} == {"und", "en"}
    assert language_id.identify(asked.limit(0), model).count() == 0
    assert language_id.codewords(9).shape[0] == 9 and len({tuple(c) for c in language_id.codewords(9)}) == 9


def test_packing(spark):
    rows = [*ROWS, (30, "special <|endoftext|> word"), (31, "ΑΣ İ ﬁ e\u0301 汉字 \u00a0x²½"), (32, "don't we'll 12ab_c")]
    pieces = packing.pack_documents(frame(spark, rows), with_ids=True).collect()
    encode = packing.Encoder(packing.TOKENIZER)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for d, lists in ids.items():
        mine = [p for p in pieces if p.doc_id == d]
        assert sum(p.length for p in mine) == sum(map(len, lists))
        if len(lists) == 1:
            assert [x for p in sorted(mine, key=lambda p: p.start) for x in p.ids] == lists[0]
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packer_keeps_every_token_whatever_the_limit():
    import numpy as np

    rng = np.random.default_rng(1)
    for max_open in (1, 3, 50):
        packer = packing.Packer(64, max_open, 0)
        sizes = rng.integers(1, 150, 400).tolist()
        for d, n in enumerate(sizes):
            packer.add(d, np.full(n, d, "<u4").tobytes())
        packer.finish()
        total = {}
        for doc, _, length, _, _, _, _, ids in packer.closed:
            assert set(np.frombuffer(ids, "<u4").tolist()) == {doc}
            total[doc] = total.get(doc, 0) + length
        assert total == dict(enumerate(sizes))


def test_packer_takes_the_level_of_the_least_sum_of_squares():
    """Against all levels tried one by one, for random states; ties go to the fullest level."""
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(400):
        packer = packing.Packer(32, 10**9, 0)
        packer.open[1:32] = rng.integers(0, 4, 31) * (rng.random(31) < 0.4)
        size, sums = int(rng.integers(1, 32)), {}
        for level in range(32 - size + 1):
            after = packer.open.copy()
            if level and not after[level]:
                continue
            after[level] -= level > 0
            after[level + size] += level + size < 32
            sums[level] = int((after**2).sum())
        least = min(sums.values())
        level, fits = packer.level_for(size)
        assert fits and level == max(k for k, v in sums.items() if v == least)


def test_packer_cuts_instead_of_opening_too_many_windows():
    packer = packing.Packer(100, 3, 0)
    for d in range(50):
        packer.add(d, bytes(4 * 60))
        assert packer.n_open == packer.open.sum() <= 3
    assert len(packer.closed) > 50


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    import numpy as np

    encode = packing.Encoder(name)
    assert bool(encode.pieces) == (name == packing.TOKENIZER)
    for text in ["Plain text, isn't it?", "  Two  spaces\tand\nlines ", "ÄÖÜ straße é", "a<|endoftext|>b", "<|ENDOFTEXT|>", "İıſK 汉字 \u0301", ""] + [t for _, t in ROWS if t][:6]:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_urls(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1?x#y", "http://www.example.org/en/19", "http://www.example.org/en/2", "http://notexample.org/es/", "ftp://x.com/fr/", "http://x.com/de/#a", "http://com/de/", "http://x.com", "no scheme", "", None, "http://", "http:///p", "x://y://org/", "http://net/", "http://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("page_id", "rule_id")
    df = url_filters.filter_urls(pages, url_filters.rules_frame(spark, url_filters.RULES))
    shuffled = url_filters.filter_urls(pages, url_filters.rules_frame(spark, url_filters.RULES), broadcast_rules=0)
    rows = {r.rule_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert rows == {r.rule_id: (r.host, r.path, r.rule, r.verdict) for r in shuffled.collect()} and len(rows) == len(urls)
    assert [rows[i][2:] for i in range(9)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "block"), (None, "allow")]
    assert rows[9] == rows[10] == rows[11] == ("", "", None, "allow") and rows[1][:2] == ("example.org", "/es/1") and rows[14][:2] == ("y:", "//org/")
    assert url_filters.filter_urls(pages, url_filters.rules_frame(spark, [("a", "/", "block")]).limit(0)).filter("rule is not null").count() == 0


def test_long_hosts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    urls = [f"http://{'a.' * 16000}example.org/es/x", "http://" + "b" * 5000 + ".com/de/" + "p" * 100_000, "http://x.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "_row", "_host", "rule_path", "_digest")])
    rows = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.rules_frame(spark, url_filters.RULES)).collect()}
    assert rows == {0: ("example.org/es/", "block"), 1: ("com/de/", "block"), 2: (None, "allow")}
    texts = [(i, ("the cat sat on the mat " if i % 2 else "die katze sitzt auf der matte ") * 3, "en" if i % 2 else "de") for i in range(40)]
    labelled = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    clash = labelled.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("lang_pred", "score", "ambiguous", "margin")])
    told = language_id.identify(clash, model)
    assert len(set(told.columns)) == len(told.columns) and {(r.doc_id % 2, r.lang_pred) for r in told.collect()} == {(1, "en"), (0, "de")}


def test_deep_and_wide_pages_and_clashing_columns(spark):
    """Nesting of any depth is read whole, in time that grows with the length; the sample does not depend on the layout."""
    from pyspark.sql import functions as F

    deep = "<article>" + "<div>" * 20_000 + "<p>Words in the deep.</p>"
    wide = "<article>" + "".join(f"<p>Sentence {i} of the text.</p>" for i in range(5000)) + "</article>"
    marks = "".join(f'<div class="c{i}">' for i in range(3000)) + "<article><p>Under many marks.</p></article>"
    pages = [(i, f"http://x/{i % 3}", h) for i, h in enumerate([deep, wide, marks] + [f"<nav>menu</nav><article><p>Body {i}.</p></article><footer>end</footer>" for i in range(30)])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one = html_extraction.train(df, train_pages=12)
    other = html_extraction.train(df.repartition(7, "page_id"), train_pages=12)
    assert (one.unary == other.unary).all() and (one.pair == other.pair).all()
    out = html_extraction.extract(df.select("*", F.lit(0).alias("text"), F.lit(0).alias("n_chars")), one)
    texts = {r.page_id: r.text for r in out.select("page_id", "text").collect()}
    assert texts[0] == "Words in the deep." and texts[2] == "Under many marks." and texts[1].count("Sentence") == 5000


def test_viterbi_and_gradient_against_all_label_sequences():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        field = html_extraction.Field()
        field.unary[:6] = rng.normal(size=(6, 2))
        field.pair = rng.normal(size=(2, 2))
        features = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(n)]
        score = lambda y, f=field, x=features: sum(f.unary[x[t], y[t]].sum() for t in range(len(y))) + sum(f.pair[y[t - 1], y[t]] for t in range(1, len(y)))
        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(field.decode(features)) == max(every, key=score)
        gold = [int(x) for x in rng.integers(0, 2, n)]
        weights = np.exp([score(y) for y in every])
        weights /= weights.sum()
        want_unary, want_pair = np.zeros((6, 2)), np.zeros((2, 2))
        for y, w in [(gold, 1.0), *((y, -w) for y, w in zip(every, weights, strict=True))]:
            for t in range(n):
                want_unary[features[t], y[t]] += w
                if t:
                    want_pair[y[t - 1], y[t]] += w
        before = field.unary.copy(), field.pair.copy()
        field.step(features, gold, 0.01)
        assert np.allclose((field.unary - before[0])[:6], 0.01 * want_unary) and np.allclose(field.pair - before[1], 0.002 * want_pair)


def test_html(spark):
    pages = [
        ("<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><main><h1>Title &amp; more</h1><p>First para.<p>Second  <b>bold</b>text.</main><div class='comments'><p>Nice one.</p></div><footer>&copy; x</footer>", "Title & more First para. Second boldtext."),
        ("<article><p>One.</p><script>var a='<p>x</p>'</script><!-- no --><div class='ad'>Buy now.</div><p>Two&nbsp;three.</p></article><aside class='sidebar'>See also</aside>", "One. Two three."),
        (None, ""), ("", ""), ("<p", ""), ("<style>p{}</style>", ""),
    ]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    field = html_extraction.train(df)
    assert [r.text for r in html_extraction.extract(df, field).orderBy("page_id").collect()] == [t for _, t in pages]
    assert html_extraction.extract(df.limit(0), field).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(-5, -9), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 120)}, -5: -9, -9: -9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_stages(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert out.count() <= max(len(rows), 0) if name != "packing" else out.count() >= len(rows)


def test_near_duplicates_keeps_one_of_each_group(spark):
    rows = [(5, BODY), (3, BODY), (3, BODY), (9, "unique text of its own"), (4, BODY + " more")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA + ", lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [3, 9]
