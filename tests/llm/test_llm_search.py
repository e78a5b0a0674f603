"""Ranked search, top-k search and resampling, against brute force on small fixtures."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from check import rows
from taskscope.llm import queries, ranking, resample, topk
from taskscope.llm.words import ALNUM, words
from taskscope.session import staged

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def texts(seed, n):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(120)] + ["Ärger", "中文", "x" * 70, "É", "a1", "ZEBRA"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return [" ".join(rng.choices(names, weights, k=rng.choice([1, 3, 19, 20, 40, 200]))) for _ in range(n)]


ODD = [None, "", " \n", "...", "w1", "w1 w1 w1", "W1\tw2-w3", "w0 " * 30000, "q" * 5000 + " w1", "\x80ü ß w1"]


# ---- ranked search

def ranked(docs, items, k=10):
    held = [(i, collections.Counter(lowered(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length = len(held), sum(s for _, _, s in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(lowered(text)), []
        for i, c, size in held:
            m = 25 + (75 * size * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("shard, bundle", [(4096, 4096), (17, 40)])
def test_ranked_search(spark, monkeypatch, shard, bundle):
    monkeypatch.setattr(ranking, "SHARD", shard)
    monkeypatch.setattr(ranking, "BUNDLE", bundle)
    own = texts(1, 150)
    docs = list(enumerate(own + own[:20] + ODD)) + [(3, own[3]), (None, own[5]), (None, "Ärger"), (777, own[5])]
    items = [(i, t) for i, t in enumerate(texts(2, 25))] + [(50, None), (51, ""), (52, "nowhere"), (53, "w1 w1 nowhere"),
                                                            (54, own[3]), (None, "ZEBRA"), (55, "w0")]
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, score int, query string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = ranking.rank(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == ranked(docs, items)
    assert ranking.rank(d.limit(0), q).count() == 0 and ranking.rank(d, q.limit(0)).count() == 0
    assert ranking.rank(d.filter("text is null"), q).count() == 0


def test_ranked_search_over_pieces_and_shards(spark, monkeypatch):
    """A piece of rows may end one shard and begin the next: no row is lost between them."""
    monkeypatch.setattr(ranking, "SHARD", 17)
    docs, items = list(enumerate(texts(11, 200))), list(enumerate(texts(12, 6)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        q = spark.createDataFrame(items, "item_id long, text string")
        assert ranking.index(d, spark.sql("SELECT 1L AS term")).agg({"full": "sum"}).first()[0] == 200
        assert collections.Counter(tuple(r) for r in ranking.rank(d, q).collect()) == ranked(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranked_search_text_ids_and_ties(spark):
    docs = [(f"d{i:03}", "alpha beta") for i in range(40)] + [("e", "alpha alpha beta"), ("f", "gamma")]
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    q = spark.createDataFrame([("x", "ALPHA"), ("x", "ALPHA"), ("y", "gamma alpha")], "item_id string, text string")
    got = [tuple(r) for r in ranking.rank(d, q, k=3).orderBy("item_id", "rank").collect()]
    assert [(i, r, x) for i, r, x, _ in got if i == "x"] == [(i, r, x) for r, x in ((1, "e"), (2, "d000"), (3, "d001"))
                                                            for i in "xx"]
    assert [x for i, _, x, _ in got if i == "y"] == ["f", "e", "d000"]


# ---- top-k search

def nearest(vectors, k, every):
    held = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(64.0 * x) for x in v]))
    out, asked = collections.Counter(), {(i, tuple(v)) for i, v in vectors if i is not None and v is not None}
    for i, v in asked:
        if i % every or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64.0 * x) for x in v]
        found = [(-min(max(sum(a * b for a, b in zip(q, c)), -(1 << 63) + 1), (1 << 63) - 1), j)
                 for j, c in held if j != i and len(c) == len(q)]
        out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k]))
    return out


@pytest.mark.parametrize("block, shard, fan", [(1024, 1 << 24, 16), (7, 200, 2)])
def test_top_k(spark, monkeypatch, block, shard, fan):
    for name, value in (("BLOCK", block), ("SHARD_BYTES", shard), ("FAN", fan), ("GROUP_BYTES", shard)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.75, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(200)]
    vectors += [(i + 300, vectors[7][1]) for i in range(30)] + [(20, vectors[20][1]), (20, vectors[21][1]), (41, vectors[40][1])]
    vectors += [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (None, [1.0] * 6),
                (920, [1.0, 2.0]), (921, [0.5, 0.5]), (940, []), (941, []), (960, [3e3] * 6), (961, [-4e6] * 6), (980, [1e18] * 6),
                (981, [5e8] * 6), (-20, [0.1] * 6), (982, [1e307] * 6)]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.search(frame, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = nearest([v for v in vectors if v[0] != 982], 5, 20)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert topk.search(frame.limit(0)).count() == 0 and topk.search(frame.filter("vec_id = 20")).count() == 0


@pytest.mark.parametrize("most", [3, 90, 3000, 1 << 20, 1 << 28, 1 << 40])
def test_products_are_exact(most):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-most, most + 1, (4, 33)) for _ in range(2))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -(1 << 63) + 1), (1 << 63) - 1) for q in b] for p in a]
    assert topk.product(a.astype(np.float64), b.astype(np.float64), most, most).tolist() == want


# ---- resampling

def resampled(docs, target, percent=25, least=20):
    def runs(text):
        w = lowered(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for x in side for f in runs(x)) for side in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, text in docs:
        f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= 2 * least - 1), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for place, x in enumerate(able[:percent * len(able) // 100]):
        x.append(place + 1)
    return collections.Counter(tuple(x) if len(x) == 5 else (*x, None) for x in out)


def test_feature_buckets():
    own = [*texts(4, 30), *ODD]
    w = words(pa.array(own, pa.string()), ALNUM)
    one, two, at = resample.features(w)
    want_one = [zlib.crc32(x.encode()) % 10000 for t in own for x in lowered(t)]
    want_two = [zlib.crc32(f"{a} {b}".encode()) % 10000 for t in own for a, b in zip(lowered(t), lowered(t)[1:])]
    assert one.tolist() == want_one and two.tolist() == want_two and len(at) == len(two)


@pytest.mark.parametrize("small", [1000, 0])
def test_resample(spark, small):
    own = texts(5, 300)
    docs = list(enumerate(own + ODD)) + [(7, own[7]), (7, own[7]), (8, own[9]), (None, own[2]), (None, own[2] + " w1"), (None, None)]
    target = texts(6, 20)[5:] + [None, ""]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score int, rank int").repartition(5)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    want = resampled(docs, target)
    got = resample.drawn(resample.scores(d, t), small=small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == want
    if small:
        assert collections.Counter(map(tuple, resample.resample(d, t.limit(0)).collect())) == resampled(docs, [])
        assert resample.resample(d.limit(0), t).count() == 0
        few = resample.resample(d.filter("doc_id = 0"), t).collect()
        assert [r.rank for r in few] == [None]


@pytest.mark.parametrize("n, want", [(1, 1), (50, 1), (50, 50), (3000, 750), (3000, 2999)])
def test_cutoff(spark, n, want):
    rng = random.Random(n + want)
    keys = [(rng.randrange(40), False, f"d{rng.randrange(n)}", rng.randrange(3), r) for r in range(n)]
    frame = spark.createDataFrame(keys, "_low long, _none boolean, doc_id string, n_features long, _row long").repartition(6)
    assert resample.cutoff(staged(frame, "keys"), want, small=0) == sorted(keys)[want - 1]


def test_weighted_median_leaves_a_quarter_on_each_side():
    rng = random.Random(8)
    for _ in range(200):
        parts = [[rng.randrange(1000) for _ in range(rng.choice([1, 2, 9, 60]))] for _ in range(rng.randint(1, 12))]
        medians = [((sorted(p)[(len(p) - 1) // 2],), len(p)) for p in parts]
        pivot = resample.weighted_median(medians)[0]
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) * 4 >= len(every) and sum(x >= pivot for x in every) * 4 >= len(every)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_exact_top_k", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())
