"""Registered queries over a whole small table, against plain Python on the same rows."""

import hashlib
import os
import re
import statistics
import zlib

import pytest

from test_llm_text import plain_spans, similar
from taskscope.llm import pii, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: queries.QUERIES[name](spark, SF).collect()


def test_shards(result, texts):
    got = result("op2_histogram_sort")
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()} and len(got) == len(texts)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # whole texts: a shard is off by half of the text at each end
    bytes_ = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    largest = max(r.size for r in got)
    assert max(abs(b - statistics.mean(bytes_)) for b in bytes_) <= 1.01 * largest


def test_toxicity(result, texts, spark):
    got = {r.doc_id: r for r in result("op3_toxicity")}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)


def test_personal_data(result, texts):
    got = {r.doc_id: r for r in result("op4_pii")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = plain_spans(t)
        counts = [sum(k == kind for _, _, k in spans) for kind in range(4)]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts
        assert got[i].base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert {s for s in pii.written(spans).split(",") if s} <= set(got[i].spans.split(","))


def test_decontamination(result, texts, spark):
    items = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    want = set()
    for i, t in texts.items():
        w = words(t)
        held = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else set()
        for j, item in items.items():
            x = words(item)
            if len(x) < 5 or not held & set(zip(*(x[k:] for k in range(5)))):
                continue  # no shingle in common: similarity 0
            n = min(len(x), len(w))
            if max(similar(w[k:k + n], x) for k in range(len(w) - n + 1)) >= 0.8:
                want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in result("op5_decontamination")}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_tokens_and_round_trip(result, texts):
    import base64

    import public_tokenizers
    import tiktoken

    def library(name):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    multi, plain = library("byte_bpe_multi_50k.tiktoken"), library("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in result("op10_byte_bpe")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = multi.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    counts = dict.fromkeys(texts, 0)
    for r in result("op6_token_counts"):
        counts[r.doc_id] += r.n_tokens
    assert counts == {i: len(plain.encode_ordinary(t)) for i, t in texts.items()}


def test_archives(result, spark):
    pages = {r.page_id: (r.html or "").encode() for r in queries.table(spark, SF, "pages").collect()}
    first = {}
    for i, body in pages.items():
        if len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = set()
    for i, body in pages.items():
        home = first.get(body, i)
        want.add((i, len(body), hashlib.sha256(body).hexdigest(), "response" if home == i else "revisit", None if home == i else home))
    got = result("op8_warc")
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)


def test_licences(result, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in result("op9_licence_scan")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k:k + len(p)]) == p]
        at, labels = [k for k, _ in places], sorted({label for _, label in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
