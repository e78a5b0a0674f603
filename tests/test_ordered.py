import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.operators import ordered as o


def rows(seed=1, n=600, hot=0.4):
    """Keys with one that has a large share of the rows."""
    r = random.Random(seed)
    order = list(range(n))
    r.shuffle(order)
    return [("hot" if r.random() < hot else f"k{r.randrange(20)}", t, r.choice([None, *range(-5, 9)])) for t in order]


def brute(data):
    out, by = [], {}
    for k, t, v in sorted(data, key=lambda x: (x[0], x[1])):
        past = by.setdefault(k, [])
        known = [x for x in past if x is not None]
        now = known + ([v] if v is not None else [])
        out.append((k, t, sum(now) if now else None, max(now, default=None), past[-1] if past else None,
                    max(known, default=None), len(past) + 1))
        past.append(v)
    return sorted(out, key=repr)


@pytest.mark.parametrize("joined", ["true", "false"])
def test_running_equals_brute_force(spark, joined):
    data = rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
    try:
        df = spark.createDataFrame(data, "k string, t long, v long").repartition(7)
        got = o.running(df, ["k"], ["t"], sums={"s": F.col("v")}, maxs={"m": F.col("v")}, lags={"l": F.col("v")},
                        past_maxs={"pm": F.col("v")}, number="n")
        assert tuples(got, "k", "t", "s", "m", "l", "pm", "n") == brute(data)
        assert got.columns == ["k", "t", "v", "s", "m", "l", "pm", "n"] or set(got.columns) == {
            "k", "t", "v", "s", "m", "l", "pm", "n"}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_large_key_is_split(spark, many_ranges):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("t")).repartition(4)
    runs = o.in_runs(df, ["k"], ["t"]).groupBy(o.RUN).count().collect()
    assert len(runs) > 1 and max(r["count"] for r in runs) < 20000


def test_global_index_and_sum(spark):
    df = spark.createDataFrame([(f"u{i:04d}", i % 5) for i in range(500)], "uid string, v long").repartition(5)
    got = tuples(o.global_index(df, ["uid"]), "uid", "idx")
    assert got == [(f"u{i:04d}", i) for i in range(500)]
    sums = tuples(o.global_running_sum(df, ["uid"], F.col("v"), "s"), "uid", "s")
    assert [s for _, s in sums] == [sum(j % 5 for j in range(i + 1)) for i in range(500)]


def test_lists_are_chunked_and_whole(spark, many_ranges):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = o.listed(df, ["k"], ["id"], F.col("id"), "ids", 100)
    for row in got.collect():
        assert len(row.ids) <= 100 and row.ids == sorted(row.ids)
    assert sorted(i for r in got.collect() for i in r.ids) == list(range(1000))
