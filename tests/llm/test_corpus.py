"""Every corpus operator over the small tables, against SQL or a plain version."""

import html as html_module
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import registry
from shelfmark.llm.common import materialize
from tests.conftest import same_rows
from tests.llm import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name, columns):
    return {r[0]: tuple(r[1:]) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()}


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, SF), SF, registry.ORACLE_SQL[name])


def test_language_on_held_out_rows(spark):
    got = registry.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 200
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op2_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_line_dedup_equals_plain(spark, docs):
    got = result(spark, "op3_line_dedup", ["doc_id", "n_lines", "n_removed", "kept_sha256"])
    assert got == {d[0]: (n, r, plain.sha((t or "").encode())) for d, (t, n, r) in zip(docs, plain.cut_lines(docs), strict=True)}


def test_substring_dedup_equals_plain(spark, docs):
    got = result(spark, "op4_substring_dedup", ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got == {d[0]: x for d, x in zip(docs, plain.repeats(docs), strict=True)}


def test_ngram_join_equals_plain(spark, docs):
    got = result(spark, "op5_ngram_join", ["doc_id", "n_shingles", "component_id"])
    assert got == {d[0]: x for d, x in zip(docs, plain.groups(docs), strict=True)}


def test_suffix_dedup_equals_plain(spark, docs):
    got = result(spark, "op7_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == {d[0]: x for d, x in zip(docs, plain.earlier(docs), strict=True)}


def test_quality_counts_equal_plain_and_verdicts_fit_labels(spark, docs):
    rows = registry.QUERIES["op9_quality_rules"](spark, SF).collect()
    got = {r.doc_id: tuple(r[1:6]) for r in rows}
    assert got == {i: plain.counts(t) for i, t in docs}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, label[r.doc_id]) for r in rows if r.doc_id in label and not r.base_failed]
    assert sum(k for k, q in judged if q) >= 0.98 * sum(q for _, q in judged)
    assert sum(not k for k, q in judged if not q) >= 0.98 * sum(not q for _, q in judged)


def test_html_equals_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.QUERIES["op10_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        want = html_module.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner)))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


def test_pipeline_equals_plain_stages(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, kept = read.columns, read, {}
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SF))
        kept[name] = {r.doc_id: r.text for r in at.collect()} if name != "packing" else at.collect()
        assert name == "packing" or at.columns == columns
    verdict = {r.doc_id for r in registry.QUERIES["op9_quality_rules"](spark, SF).filter("kept").collect()}
    assert kept["quality"] == {r.doc_id: r.text for r in read.collect() if r.doc_id in verdict}
    before = list(kept["quality"].items())
    cut = {d: t for (d, _), (t, n, gone) in zip(before, plain.cut_lines(before), strict=True) if not n or gone < n}
    assert kept["line_dedup"] == cut
    near = {d: t for (d, t), (_, first) in zip(cut.items(), plain.groups(list(cut.items())), strict=True) if d == first}
    assert kept["near_duplicates"] == near
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: t for (d, t), x in zip(near.items(), plain.contaminated(list(near.items()), items), strict=True) if not x[-1]}
    assert kept["decontamination"] == clean
    tokens = {r.doc_id: r.doc_tokens for r in kept["packing"]}
    assert tokens.keys() == clean.keys() and sum(r.length for r in kept["packing"]) == sum(tokens.values())
