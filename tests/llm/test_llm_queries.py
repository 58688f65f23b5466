"""Registered queries of the operators against SQL, and the pipeline against brute force, at the smallest scale."""

import collections
import hashlib
import os

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyhue.llm import bpe
from skyhue.llm.queries import QUERIES, SQL
from tests.llm import cases
from tests.llm.test_text_operators import WORD, brute_components, brute_repeats
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert not compare(QUERIES[name](spark, SF), connect(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


def test_pipeline_against_brute_force(spark):
    rows = list(cases.ROWS)
    for k in range(12):
        rows.append((50 + k, cases.prose(700 + k, 80) + " " + (cases.prose(9, 120) if k < 4 else cases.prose(800 + k, 120)), "en", "abc"[k % 3]))
    docs, kept = cases.documents(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        kept[name] = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    # quality: no text under ten words, or mostly made of repeated windows
    first = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept[names[0]])
    assert all(len(WORD.findall(t)) >= 10 for _, _, t in first) and not any(r[1] is None for r in first)
    # near copies: one row of each component
    pairs = [(r.doc_id, r.text) for r in kept[names[0]]]
    groups = {c for *_, c in brute_components([(i, t) for i, (_, t) in enumerate(pairs)], 5, 80)}
    assert len(kept[names[1]]) == len(groups) and {r.doc_id for r in kept[names[1]]} == {c for *_, c in brute_components(pairs, 5, 80)}
    # repeats
    before = [r.text for r in kept[names[1]]]
    spans, want = brute_repeats([t.encode() for t in before], corpus_pipeline.PASSAGE), []
    for t, runs in zip(before, spans):
        raw, at, left = t.encode(), 0, b""
        for s, e in runs:
            left, at = left + raw[at:s], e
        want.append((left + raw[at:]).decode(errors="ignore"))
    assert sorted(r.text for r in kept[names[2]]) == sorted(want) and sum(bool(s) for s in spans) >= 4
    # mix: half as many words again, at most two of each document
    size = sum(len(WORD.findall(r.text)) for r in kept[names[2]])
    assert abs(sum(len(WORD.findall(r.text)) for r in kept[names[3]]) - 1.5 * size) <= 8
    assert max(collections.Counter(r.doc_id for r in kept[names[3]] if r.doc_id != 9).values()) <= 2  # two documents have that id
    # tokens decode to the texts
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.codec(f.read(), public_tokenizers.PATTERN)
    assert sorted(own.decode(list(r.ids)).decode() for r in kept[names[4]]) == sorted(r.text for r in kept[names[3]])
    assert all(r.decoded_sha256 == hashlib.sha256(own.decode(list(r.ids))).hexdigest() for r in kept[names[4]])


def test_pipeline_takes_out_passages_of_just_over_50_words(spark):
    """Documents that share one passage of 51 to 65 words and are different otherwise."""
    lengths = range(51, 66, 2)
    shared = [cases.prose(2000 + n, n) for n in lengths]
    assert all(corpus_pipeline.PASSAGE <= len(p) < 400 for p in shared)
    rows = [(10 * n + k, f"{cases.prose(3000 + 10 * n + k, 90)} {p} {cases.prose(4000 + 10 * n + k, 90)}", "en", "ab"[k]) for n, p in zip(lengths, shared) for k in (0, 1)]
    docs = cases.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(left) == len(rows)
    for n, p in zip(lengths, shared):
        assert all(p not in left[10 * n + k] and len(WORD.findall(left[10 * n + k])) <= 181 for k in (0, 1)), n


def test_pipeline_of_no_rows(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
    assert docs.count() == 0
