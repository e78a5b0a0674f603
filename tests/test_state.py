import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope import schema
from taskscope.operators import state as m

ALL = {"task": schema.TASK_STATES + schema.FINAL, "pilot": schema.PILOT_STATES + schema.FINAL}


def walk(states, model):
    """The state machine, one update at a time: (changes, rejects)."""
    values = schema.state_values(model)
    known = schema.states(model)
    current, changes, rejects = None, [], []
    for seq, target in states:
        top = -1 if current is None else values[current]
        if target == current:
            continue
        if current in schema.FINAL and target in schema.FINAL:
            free = current == "CANCELED" or (model == "pilot" and current == "FAILED")
            if free:
                current = target
                changes.append((seq, target, ()))
            else:
                rejects.append((seq, target))
            continue
        if values[target] > top:
            changes.append((seq, target, tuple(known[top + 1:values[target]] + [target])))
            current = target
    return changes, rejects


def updates(model, seed):
    r = random.Random(seed)
    data = {}
    for i in range(40):
        n = r.randrange(1, 12)
        data[f"u{i}"] = [(s, r.choice(ALL[model])) for s in range(n)]
    return data


@pytest.mark.parametrize("model,seed", [("task", 1), ("task", 2), ("pilot", 3), ("pilot", 4)])
@pytest.mark.parametrize("limit", ["1", "1000000"])
def test_progress_follows_the_state_machine(spark, model, seed, limit):
    data = updates(model, seed)
    flat = [(u, s, x) for u, l in data.items() for s, x in l]
    random.Random(seed).shuffle(flat)
    df = spark.createDataFrame(flat, "uid string, seq long, state string").repartition(3)
    spark.conf.set("taskscope.group.rows", limit)
    try:
        got = [(u, s, x, tuple(p)) for u, s, x, p in m.progress(df, model).collect()]
    finally:
        spark.conf.unset("taskscope.group.rows")
    want = [(u, *c) for u, l in data.items() for c in walk(l, model)[0]]
    assert sorted(got) == sorted(want)


def test_rejected_updates(spark):
    data = updates("task", 7)
    df = spark.createDataFrame([(u, s, x) for u, l in data.items() for s, x in l], "uid string, seq long, state string")
    want = sorted((u, *r) for u, l in data.items() for r in walk(l, "task")[1])
    assert tuples(m.rejected(df), "uid", "seq", "state") == want


def test_order_of_rows_does_not_matter(spark):
    data = [(u, s, x) for u, l in updates("task", 5).items() for s, x in l]
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "uid string, seq long, state string").repartition(seed + 1)
        results.append((tuples(m.collapse(df)), tuples(m.progress(df), "uid", "seq", "state")))
    assert results[0] == results[1]


@pytest.mark.parametrize("states,model,want", [
    (["NEW", "PMGR_LAUNCHING", "PMGR_ACTIVE", "PMGR_ACTIVE_PENDING"], "pilot", "PMGR_ACTIVE"),
    (["NEW", "DONE", "PMGR_ACTIVE"], "pilot", "DONE"),
    (["NEW", "FAILED", "PMGR_ACTIVE"], "pilot", "FAILED"),
    (["AGENT_STAGING_OUTPUT", "TMGR_STAGING_OUTPUT", "TMGR_STAGING_OUTPUT_PENDING"], "task", "TMGR_STAGING_OUTPUT"),
    (["DONE", "AGENT_EXECUTING", "FAILED"], "task", "DONE"),
    (["CANCELED", "NEW", "AGENT_SCHEDULING"], "task", "CANCELED"),
    ([None], "task", None),
])
def test_collapse(spark, states, model, want):
    df = spark.createDataFrame([("u", x) for x in states], "uid string, state string")
    assert m.collapse(df, model).head().state == want


def test_cancelled_then_done_is_announced_once(spark):
    df = spark.createDataFrame([("u", 1, "NEW"), ("u", 2, "CANCELED"), ("u", 3, "DONE"), ("u", 4, "FAILED")],
                               "uid string, seq long, state string")
    told = tuples(m.announced(m.progress(df, replay_final=False)), "seq", "announced")
    assert told == [(1, "NEW"), (2, "CANCELED"), (3, "DONE")]


def test_latest_documents_keep_non_null_fields(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 3), ("a", 3, "y", None), ("b", 1, "z", 1)],
                               "uid string, seq long, out string, code int")
    known = spark.createDataFrame([("a",)], "uid string")
    assert tuples(m.latest_docs(df, known)) == [("a", 3, "y", 3)]


def test_target_state(spark):
    df = spark.createDataFrame([(0, None), (1, None), (None, None), (0, "FAILED")], "exit_code int, target_state string")
    assert [r.target_state for r in m.target_state(df).collect()] == ["DONE", "FAILED", "FAILED", "FAILED"]


def test_state_dim(spark):
    dim = m.state_dim(spark)
    assert dim.count() == 26 and dim.filter("is_final").select("state").distinct().count() == 3
    low = dim.filter((F.col("model") == "pilot") & (F.col("value") < 0))
    assert low.isEmpty()
