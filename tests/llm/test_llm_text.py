"""Operators on single documents, against plain Python on small fixtures."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest

from taskscope.llm import bpe, decontaminate, licences, pii, quality, sharding, tokens, toxicity
from taskscope.llm.queries import vocabulary

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c"), (5, "x" * 30000),
       (6, "é 中文 😀 don't 12 a1 \r\n  b"), (7, "a b c d " * 400), (-8, "A\nA\nB\n\nA")]
SCHEMA = "doc_id long, text string, n_words string, score string, shard string, spans string, kept int, w int, t int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the results."""
    return spark.createDataFrame([(*r, "x", "y", "z", "s", 1, 2, 3) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    syllables = "an the in er ou st bre lo ki ma".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(80)]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    held = collections.defaultdict(list)
    for i in range(len(w) - 2):
        held[tuple(w[i:i + 3])].append(i)
    covered = {i + k for at in held.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_measures_and_order(spark, odd, none, prose):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(quality.cascade(odd), *names) == sorted(((i, *plain_measures(t)) for i, t in ODD), key=repr)
    assert quality.cascade(none).collect() == []
    docs = spark.createDataFrame([(i, (t + " ") * 2 if i % 3 else t.replace(" ", " ## ")) for i, t in enumerate(prose)],
                                 "doc_id long, text string")
    one = quality.cascade(docs, quality.RULES)
    other = quality.cascade(docs, dict(reversed(quality.RULES.items())))
    assert rows_of(one, *names, "kept") == rows_of(other, *names, "kept")  # the order decides no verdict
    found = quality.ordered_rules(docs)
    assert {r[0] for r in found} == set(quality.RULES)
    rates = [share / seconds for _, share, seconds in found]
    assert rates == sorted(rates, reverse=True)


def test_shards_are_even_and_slots_have_no_gaps(spark, odd, none):
    rng = random.Random(1)
    many = [(i, "same text" if i % 3 == 0 else "x" * rng.randint(0, 400)) for i in range(6000)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    for frame, rows in ((docs, many), (odd, ODD)):
        got = sharding.shard(frame, 40).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
            ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
        slots = collections.defaultdict(list)
        for r in got:
            assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = collections.Counter()
    for r in sharding.shard(docs, 40).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 416 + 0.01 * sum(sizes.values()) / 40
    assert sharding.shard(none).collect() == []
    named = spark.createDataFrame([(None if i == 7 else f"doc-{i % 5000}", t) for i, t in many], "doc_id string, text string")
    got = sharding.shard(named, 40).collect()
    assert sorted((r.doc_id or "", r.size) for r in got) == sorted((r.doc_id or "", len(r.text) + 16) for r in named.collect())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_do_not_need_python(odd):
    plan = sharding.shard(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_grammar():
    insult = (toxicity.INSULT, 4.0)
    words = {c: (c, 0.0) for c in "HMTNRQO"}
    assert toxicity.clause_score([insult]) == 4.0
    assert toxicity.clause_score([words["N"], insult]) < 4.0 < toxicity.clause_score([words["T"], insult])
    assert toxicity.clause_score([words["R"], insult]) == toxicity.clause_score([words["Q"], insult]) == 2.0
    assert toxicity.clause_score([words["Q"], words["O"], words["Q"], insult]) == 4.0
    assert toxicity.clause_score([words["M"], words["H"], words["T"]]) == toxicity.THREAT_WEIGHT
    assert toxicity.clause_score([words["H"], words["T"]]) == 0.0


def test_toxicity_learns_words_and_stems_and_finds_held_out_texts(spark, prose, odd, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(prose).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgblat", "krumpf" + rng.choice("aeiou") + "x"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(none, marks)).filter("predicted = 1").count() == 0


def plain_spans(text):
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), 0) for m in mail.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("ab1.@-+_ 23é()") for _ in range(rng.randint(0, 60)))
        assert pii.patterns(text) == plain_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_field_ties_distant_tokens(spark, odd, none):
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"call {number()} or mail bob.{i}@mail{i % 9}.example.com from 10.2.{i % 250}.7 in version 2.0"
             for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii.fit(docs)
    text = "call +1 (518) 555-0532 today. " + "words without any data. " * 50 + "again 555-0532 please, version 2.0"
    base, every = pii.spans_of(text, field)
    assert base == plain_spans(text) and set(base) < set(every)
    assert [text[a:b] for a, b, _ in every] == ["+1 (518) 555-0532", "555-0532"]
    found = {r.doc_id: r for r in pii.find(docs, field).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        assert found[i].base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert set(pii.written(spans).split(",")) <= set(found[i].spans.split(","))
        assert (found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) == (1, 1, 0, 1)
    assert pii.find(odd, field).count() == len(ODD) and pii.find(none, pii.fit(none)).count() == 0
    masked = {r.doc_id: r.text for r in pii.masked(docs, field).collect()}
    assert masked[0] == "call [phone] or mail [email] from [ip] in version 2.0"
    assert rows_of(pii.masked(odd, field), "doc_id", "text", "shard") == sorted(
        ((i, t, "z") for i, t in ODD), key=repr)


def test_pii_field_ties_repeats_over_any_number_of_places():
    import numpy as np

    kinds = pii.NONE + 1
    neutral = np.zeros(kinds)
    field = pii.Field({"shape 93-94": neutral, "shape 97": neutral}, np.full(kinds, 1 / kinds), np.zeros((kinds, kinds)))
    for repeat in ("555-0532", "5550532"):
        gap = " words without any data. again "
        for times in (50, 400):
            for first in (0, times // 2, times):  # the observed one stands before, between or after
                text = gap.join([repeat] * first + ["+1 (518) 555-0532, " + repeat] + [repeat] * (times - first))
                base, every = pii.spans_of(text, field)
                assert len(base) == 1 and len(every) == 1 + times + 1
                assert {text[a:b] for a, b, _ in set(every) - set(base)} == {repeat}
                assert {k for _, _, k in every} == {3}
    other = "version 555-9999 and 555-9999 and 555-0532 after +1 (518) 555-0532"
    assert "555-9999" not in {other[a:b] for a, b, _ in pii.spans_of(other, field)[1]}


def test_pii_counts_all_documents_however_they_are_dealt(spark):
    rng = random.Random(15)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGH23456789") for _ in range(16))
    texts = [f"in the year {rng.randint(1000, 2500)} version {rng.randint(1, 9)}.{rng.randint(0, 9)}" for _ in range(12000)]
    for i in (1700, 5200, 8800):  # one of 4,000 holds a seed
        texts[i] = f"the access key is {key()} now"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fields = [pii.fit(d) for d in (docs.repartition(2), docs.repartition(7), docs.orderBy(docs.doc_id.desc()))]
    assert all(f.single.keys() == fields[0].single.keys() for f in fields)
    assert all((f.single[x] == fields[0].single[x]).all() for f in fields for x in f.single)
    assert all((f.prior == fields[0].prior).all() and (f.chain == fields[0].chain).all() for f in fields)
    assert fields[0].prior[4] / fields[0].prior.min() == 4  # three seeds and one at least, against none and one
    assert fields[0].single["head AKIA"].argmax() == 4
    text = f"the access key is {key()} now, in the year 1999"
    assert [k for _, _, k in pii.spans_of(text, fields[0])[1]] == [4]


def test_pii_ties_over_a_hub_are_as_strong_as_one_edge():
    import numpy as np

    for strength in (pii.SAME, pii.ALIKE):
        hub = np.exp(pii._over_hub(strength) * np.eye(pii.NONE + 1))
        pair = hub @ hub
        assert pair[0, 0] / pair[0, 1] == pytest.approx(np.exp(strength))


def similar(window, item):
    size = min(5, len(item))
    sets = [{tuple(x[k:k + size]) for k in range(len(x) - size + 1)} for x in (window, item)]
    weigh = lambda s: sum(len("".join(x).encode()) for x in s)
    return weigh(sets[0] & sets[1]) / weigh(sets[0] | sets[1])


def test_decontamination(spark, prose, odd, none):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(prose).split()[:rng.choice([2, 4, 5, 12, 20, 33])])) for i in range(25)]
    docs = []
    for i in range(120):
        words = rng.choice(prose).split()
        if i % 2:
            passage = rng.choice(items)[1].split()
            if rng.random() < 0.6 and len(passage) > 6:
                passage[rng.choice([0, -1])] = "changed"
            k = rng.randrange(len(words))
            words = words[:k] + ["É" if rng.random() < 0.1 else passage[0].upper(), *passage[1:]] + words[k:]
        docs.append((i, ", ".join(words)))
    norm = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = set()
    for d, text in docs:
        w = norm(text)
        for k, item in items:
            x = norm(item)
            if any(similar(w[a:a + len(x)], x) >= 0.8 for a in range(len(w) - len(x) + 1)):
                want.add((d, k))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = decontaminate.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by_doc, by_item = dict(docs), dict(items)
    for r in got:
        window = norm(by_doc[r.doc_id])[r.first_word:r.first_word + r.n_words]
        assert abs(similar(window, norm(by_item[r.item_id])) - r.similarity) < 1e-9 and r.hamming <= 15
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == \
        {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(frame, none.selectExpr(
        "doc_id AS item_id", "text")).count() == 0


def test_copies_of_items_that_repeat_phrases(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items, docs = [], []
    for i, (plain, phrase, times) in enumerate([(30, 6, 6), (60, 10, 8), (20, 5, 10), (0, 6, 20), (25, 1, 12)] * 6):
        refrain = [word() for _ in range(phrase)]
        items.append((i, " ".join([word() for _ in range(plain)] + refrain * times)))
        near = items[-1][1].split()
        near[0] = "changed"
        for copy in (items[-1][1].split(), near, refrain * (times + 3)):
            docs.append((len(docs), " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)])))
    want = set()
    for d, text in docs:
        w = text.split()
        for k, item in items:
            x = item.split()
            if set(w) & set(x) and any(similar(w[a:a + len(x)], x) >= 0.8 for a in range(len(w) - len(x) + 1)):
                want.add((d, k))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(3 * i, i) for i in range(len(items))} <= want
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.hamming == 0 for r in got if r.similarity == 1.0)


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 5, 6, 12, 30, 45, 100, 4] * 4)]
    docs = []
    for _, item in items:
        x = item.split()
        for text in (x[:-1], x[3:], x[:-len(x) // 5 or None], x[2:-3], x[:len(x) // 2], x[:-3] + [word()], x):
            docs.append((len(docs), " ".join(text)))
    want = {}
    for d, text in docs:
        w = text.split()
        for k, item in items:
            x = item.split()
            n = min(len(w), len(x))
            if set(w) & set(x) and n >= min(5, len(x)):
                best = max(similar(w[a:a + n], x) for a in range(len(w) - n + 1))
                if best >= 0.8:
                    want[d, k] = (pytest.approx(best), n)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in got} == want
    assert (1, 0) in want and docs[1][1] == " ".join(items[0][1].split()[3:])
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == \
        {d for d, _ in docs} - {d for d, _ in want}


def test_fingerprint_index_finds_all_within_the_radius():
    import numpy as np
    rng = np.random.default_rng(1)
    index = decontaminate.Index(5)
    for row in range(40):
        index.add(row, 9, rng.integers(0, 1 << 63, 5).astype(np.uint64), np.full(5, 10))
    index.finish()
    prints = index.prints[rng.integers(0, 40, 500)]
    for i in range(500):
        for b in rng.choice(64, i % 20, replace=False):
            prints[i] ^= np.uint64(1 << int(b))
    got = set(zip(*(x.tolist() for x in index.near(prints, np.full(500, 5)))))
    want = {(i, j) for i in range(500) for j in range(40)
            if int(prints[i] ^ index.prints[j]).bit_count() <= decontaminate.RADIUS}
    assert got == want


def test_licences(spark, odd, none):
    texts = [(1, "MIT License mit license"), (2, None), (3, "Licensed under the Apache License, Version 2.0."),
             (4, "Licensed under CC BY-NC 4.0."), (5, "gnu license public general"), (6, "gnu"),
             (7, "x" * 500 + " This work is licenced under the GNU General Public License, version 3."),
             (8, "the general public license"), *((10 + i, f"plain words in the text number {i}") for i in range(30))]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 0, 2, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[3].labels == "apache,apache-2.0" and got[3].score == pytest.approx(1.0)
    assert got[4].base_labels == "" and got[4].labels == "cc-by-nc-4.0"
    assert got[5].labels == got[6].labels == got[12].labels == ""
    assert got[7].labels == "gpl,gpl-3.0" and 0.6 < got[7].score < 1 and got[7].first_word == 8
    assert got[8].labels == "gpl" and got[8].score == 0.0
    for r in licences.scan(odd).collect():
        text = next(t for i, t in ODD if i == r.doc_id) or ""
        assert r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) and r.n_base == 0
    assert licences.scan(none).count() == 0


def test_licence_scores_are_the_best_of_every_start(spark):
    rng = random.Random(21)
    texts = [f"plain words in the text number {i} of any kind" for i in range(300)]
    for label, (notice, phrase) in licences.TEMPLATES.items():
        words, key = notice.split(), phrase.split()
        first = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        free = [i for i in range(len(words)) if not first <= i < first + len(key)]
        for k in range(12):  # words changed, left out, put in; never those of the key phrase
            w, changed = list(words), rng.sample(free, min(len(free), rng.randint(0, 6)))
            for i in sorted(changed, reverse=True):
                w[i:i + 1] = {0: ["altered"], 1: [], 2: [w[i], "inserted"]}[rng.choice([0, 0, 0, 1, 2])]
            cut = rng.choice([0, 0, first])
            texts.append(" ".join(["the", "work"] * (k % 3) + w[cut:] + ["of", "this"] * (k % 2)))
        texts.append(f"the terms {phrase} and {phrase}")
    mit = "permission is hereby granted free of {} to any person obtaining a copy of this software and {} documentation files"
    texts.append(mit.format("cost", "related"))
    texts.append(mit.format("", "all"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    weights = licences.idf(docs)
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, text in enumerate(texts):
        w, scores = text.split(), {}
        for label, (notice, phrase) in licences.TEMPLATES.items():
            x = notice.split()
            if f" {phrase} " in f" {text} ":
                scores[label] = max(sum(weights[b] for j, b in enumerate(x) if 0 <= s + j < len(w) and w[s + j] == b)
                                    for s in range(-len(x), len(w))) / sum(weights[b] for b in x)
        base = {label for phrase, label in licences.BASE.items() if f" {phrase} " in f" {text} "}
        assert got[i].score == pytest.approx(max(scores.values(), default=0.0)), text
        assert got[i].labels == ",".join(sorted(base | {k for k, x in scores.items() if x >= licences.SCORE})), text
    assert got[len(texts) - 2].labels == "mit-text"


def test_licence_index_where_one_word_is_nearly_all_of_a_template():
    weights = {w: 1.0 for text, _ in licences.TEMPLATES.values() for w in text.split()} | {"affero": 30.0}
    places, agree = licences.index(weights)["agpl-3.0"]
    assert agree == 1 and places[0][0] == "affero"
    assert all(n == 2 for k, (_, n) in licences.index(weights).items() if k != "agpl-3.0")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(library):
    import pyarrow as pa

    path, own = library
    rng = random.Random(9)
    letters = "'stmdrevl aA9 \n\t !.é　中😀\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["'" * 300 + "s", "ab" * 4000, " " * 1000 + "x", "", "I'll we've don't 'sup"]
    texts += [f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    codec = bpe.codec(path)
    got = codec.encode(pa.array(texts))
    for k, text in enumerate(texts):
        ids = got.ids[got.first[k]:got.first[k + 1]]
        assert ids.tolist() == own.encode_ordinary(text)
        assert codec.decode(ids).tobytes().decode() == text
    with pytest.raises(ValueError):
        codec.decode(got.ids[:1] * 0 + 50256)


def test_scan_equals_one_step_after_the_other():
    import numpy as np

    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2 * bpe.SYMBOLS, 1000).astype(np.uint8)
    states, now = [], bpe.CLOSED
    for x in symbols.tolist():
        now = bpe._step(bpe.CLOSED if x >= bpe.SYMBOLS else now, x % bpe.SYMBOLS)[0]
        states.append(now)
    assert bpe.FROM_CLOSED[bpe.scan(symbols)].tolist() == states


def test_bpe_round_trip(odd, none, library):
    path, own = library
    want = []
    for i, t in ODD:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(bpe.round_trip(odd, path), *names) == sorted(want, key=repr)
    encoded = bpe.encode(odd, path)
    assert rows_of(bpe.decode(encoded, path), "doc_id", "bytes") == sorted(
        ((i, bytearray((t or "").encode())) for i, t in ODD), key=repr)
    assert all(not r.ends or r.ends[-1] == len(next(t for i, t in ODD if i == r.doc_id)) for r in encoded.collect())
    assert bpe.round_trip(none, path).count() == 0


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_sections(odd, none, library, rule):
    path, own = library
    want = {}
    for i, text in ODD:
        text = text or ""
        begun = [0]
        for b in text.encode():
            begun.append(begun[-1] + ((b & 0xC0) != 0x80))
        spans, at, done = [], 0, 0
        for token in own.encode_ordinary(text):
            at += len(own.decode_single_token_bytes(token))
            spans.append((min(done, begun[at] - 1), begun[at]))
            done = begun[at]
        low = 0
        for k, line in enumerate(text.splitlines(True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text)):
            high = low + len(line)
            meet = [(min(b, high) - max(a, low), a, b) for a, b in spans if min(b, high) > max(a, low)]
            count = {"first": sum(low <= a for _, a, _ in meet), "share": sum(o / (b - a) for o, a, b in meet)}.get(rule)
            want.setdefault((i, k, low, high), []).append((count, sum(o < b - a for o, a, b in meet)))
            low = high
    got = tokens.section_tokens(odd, path, rule=rule).collect()
    assert {(r.doc_id, r.section, r.first_char, r.end_char) for r in got} == set(want)
    for r in got:
        count, crossing = want[r.doc_id, r.section, r.first_char, r.end_char][0]
        assert r.n_crossing == crossing and (count is None or r.n_tokens == pytest.approx(count))
    total = sum(r.n_tokens for r in got)
    assert total == pytest.approx(sum(len(own.encode_ordinary(t or "")) for _, t in ODD))
    assert tokens.section_tokens(none, path, rule=rule).count() == 0
