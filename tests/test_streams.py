import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.operators import state as m
from taskscope.session import fresh_path
from taskscope.streaming import hold as h
from taskscope.streaming import messages as msg
from taskscope.streaming import stateful as st


def stream(spark, steps, layout):
    """One file per step, read one after the other."""
    path = fresh_path(spark, "steps")
    for rows in steps:
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("model,steps", [
    ("task", [[("u", 3, "AGENT_SCHEDULING"), ("u", 1, "NEW"), ("v", 2, "NEW")],
              [("u", 4, "NEW"), ("u", 5, "CANCELED"), ("v", 6, "AGENT_EXECUTING")],
              [("u", 7, "DONE"), ("u", 8, "FAILED"), ("v", 9, "odd"), ("v", 10, "FAILED")]]),
    ("pilot", [[("p", 1, "NEW"), ("p", 2, "FAILED")], [("p", 3, "CANCELED"), ("p", 4, "FAILED"), ("p", 5, "FAILED")],
               [("p", 6, "DONE"), ("p", 7, "CANCELED")]])])
def test_progress_stream_equals_batch(spark, model, steps):
    layout = "uid string, seq long, state string"
    got = msg.run_to_end(st.progress_stream(stream(spark, steps, layout), model), fresh_path(spark, "t1"))
    every = spark.createDataFrame([r for s in steps for r in s], layout)
    assert tuples(got) == tuples(m.announced(m.progress(every, model)))


def test_messages(spark):
    rows = [('{"cmd": "update", "arg": {"uid": "a", "type": "task", "state": "NEW"}}',),
            ('{"cmd": "update", "arg": [{"uid": "b", "state": "NEW"}, {"uid": "c", "state": "DONE", "x": 1}]}',),
            ('{"cmd": "cancel_tasks", "arg": {"uids": ["a"]}}',), ("broken",)]
    got = msg.read_updates(spark.createDataFrame(rows, "value string"))
    assert tuples(got, "uid", "state") == [("a", "NEW"), ("b", "NEW"), ("c", "DONE")]


def test_subscriber_per_row(spark, tmp_path):
    place = str(tmp_path / "seen")
    source = stream(spark, [[("a", 1)], [("b", 2), ("a", 3)]], "uid string, n int")

    def fn(row):
        import os
        os.makedirs(place, exist_ok=True)
        open(f"{place}/{row.uid}.{row.n}", "w").close()
        raise RuntimeError("is logged")

    query = msg.foreach_transition(source, fn, uid="a")
    query.awaitTermination()
    import os
    assert sorted(os.listdir(place)) == ["a.1", "a.3"] and query.exception() is None


#: rows at the epoch itself would be late from the start
T0 = 1000.0
LIMITS = "uid string, kind string, time double, startup_timeout double, timeout double"


def test_time_limits(spark):
    steps = [[("a", "submit", 0.0, 10.0, 50.0), ("b", "submit", 0.0, 10.0, 50.0), ("c", "submit", 0.0, 0.0, 0.0),
              ("d", "submit", 0.0, 0.0, 20.0)],
             [("b", "started", 5.0, None, 50.0), ("d", "ended", 19.0, None, None)],
             [("c", "other", 40.0, None, None)], [("c", "other", 100.0, None, None)], [("c", "other", 101.0, None, None)]]
    steps = [[(u, k, T0 + t, a, b) for u, k, t, a, b in rows] for rows in steps]
    got = msg.run_to_end(st.timeout_stream(stream(spark, steps, LIMITS)), fresh_path(spark, "t5"))
    want = [("a", "task_timeout", T0 + 10), ("b", "task_timeout", T0 + 55)]
    assert tuples(got) == want
    every = spark.createDataFrame([r for s in steps for r in s], LIMITS)
    assert tuples(st.timeouts(every, T0 + 101)) == want


def test_lost_workers(spark):
    steps = [[("w1", 0, 0.0), ("w1", 1, 0.0), ("w2", 0, 0.0)], [("w1", 0, 50.0), ("w2", 0, 50.0)], [("w1", 0, 120.0), ("w2", 0, 121.0)],
             [("w1", 0, 122.0)]]
    steps = [[(u, r, T0 + t) for u, r, t in rows] for rows in steps]
    layout = "uid string, rank int, hb double"
    got = msg.run_to_end(st.lost_worker_stream(stream(spark, steps, layout), 100.0), fresh_path(spark, "t4"))
    assert tuples(got) == [("w1", 1, T0)]
    every = spark.createDataFrame([r for s in steps for r in s], layout)
    assert tuples(st.lost_workers(every, T0 + 122, 100.0)) == [("w1", 1, T0)]


def test_info_or_time_limit(spark):
    steps = [[("a", 0, 0.0, "starting"), ("b", 0, 0.0, "starting")], [("a", 2, 3.0, "url: y"), ("a", 1, 3.0, "url: x")],
             [("c", 0, 90.0, "z")], [("c", 1, 91.0, "url: z")], [("a", 3, 92.0, "url: late"), ("b", 1, 92.0, "url: late")]]
    steps = [[(u, n, T0 + t, v) for u, n, t, v in rows] for rows in steps]
    lines = stream(spark, steps, "uid string, pos int, time double, value string")
    got = msg.run_to_end(st.info_stream(lines, r"url: (\S+)", timeout=20.0), fresh_path(spark, "t13"))
    assert tuples(got) == [("a", "x", None), ("b", None, "startup timeout"), ("c", "z", None)]


def test_state_ends_under_the_watermark(spark):
    """By default, and without timers on the clock: the stream ends by itself."""
    day = 86400.0
    steps = [[("u", 1, "DONE", T0), ("v", 2, "NEW", T0), ("w", 3, "NEW", T0)],
             [("x", 4, "NEW", T0 + 2 * day)],  # u has ended, v and w have not
             [("u", 5, "DONE", T0 + 2 * day + 1), ("v", 6, "NEW", T0 + 2 * day + 1), ("v", 7, "DONE", T0 + 2 * day + 2)],
             [("y", 8, "NEW", T0 + 40 * day)], [("y", 9, "AGENT_SCHEDULING", T0 + 40 * day + 1)]]
    source = stream(spark, steps, "uid string, seq long, state string, time double")
    path = fresh_path(spark, "t1")
    got = msg.run_to_end(st.progress_stream(source), path)
    told = lambda uid: [(r.seq, r.announced) for r in got.filter(F.col("uid") == uid).orderBy("seq", "step").collect()]
    whole = told("u")
    assert len(whole) % 2 == 0 and [a for n, a in whole if n == 1] == [a for n, a in whole if n == 5]  # a new life
    assert [n for n, _ in told("v")].count(2) == 1 and told("v")[-1] == (7, "DONE") and not any(n == 6 for n, _ in told("v"))
    left = spark.read.format("statestore").option("stateVarName", "current").load(f"{path}/checkpoint")
    assert tuples(left.select("key.uid")) == [("y",)]
    # without times nothing ends
    bare = stream(spark, [[r[:3] for r in rows] for rows in steps], "uid string, seq long, state string")
    path = fresh_path(spark, "t1")
    msg.run_to_end(st.progress_stream(bare), path)
    assert spark.read.format("statestore").option("stateVarName", "current").load(f"{path}/checkpoint").count() == 5


def test_a_worker_is_lost_each_time(spark):
    """The same alarms, however the heartbeats are dealt to micro-batches."""
    beats = [("w", 0, T0), ("w", 0, T0 + 50), ("w", 0, T0 + 149), ("w", 0, T0 + 260), ("w", 1, T0 + 250), ("w", 0, T0 + 400),
             ("z", None, T0 + 20), ("w", 1, T0 + 401), ("w", 0, T0 + 450)]
    want = sorted([("w", 0, T0 + 149), ("w", 0, T0 + 260), ("w", 1, T0 + 250), ("z", None, T0 + 20)], key=repr)
    layout = "uid string, rank int, hb double"
    ordered = sorted(beats, key=lambda b: b[2])
    for steps in ([ordered], [[b] for b in ordered], [ordered[:4], ordered[4:]]):
        got = msg.run_to_end(st.lost_worker_stream(stream(spark, steps, layout), 100.0), fresh_path(spark, "t4"))
        assert tuples(got) == want


def test_bags_wait_for_all_members(spark):
    steps = [[("a", "x", 2), ("b", "y", 1)], [("c", "x", 2), ("d", "z", 3)], [("e", "z", 3)]]
    released, held = h.hold(stream(spark, steps, "uid string, ns string, size int"), h.complete_bags, fresh_path(spark, "bags"))
    assert tuples(released, "uid", "status") == [("a", "complete"), ("b", "complete"), ("c", "complete")]
    assert tuples(held, "uid") == [("d",), ("e",)]


def test_order_of_bags(spark):
    layout = "kind string, uid string, ns string, bag_order int, size int, n long"
    task = lambda u, o: ("task", u, "ns", o, 2, 1)
    done = lambda u, o: ("done", u, "ns", o, 2, 1)
    steps = [[task("c", 1), task("a", 0)], [task("b", 0), done("a", 0)], [done("b", 0), task("e", 2)]]
    released, held = h.hold(stream(spark, steps, layout), h.ordered_bags, fresh_path(spark, "order"))
    assert tuples(released, "uid") == [("a",), ("b",), ("c",)]
    assert tuples(held, "uid") == [("e",)]


def test_keys_and_cancels_are_remembered(spark):
    layout = "kind string, uid string, needs string"
    steps = [[("task", "a", "env"), ("task", "b", None)], [("key", "env", None)], [("task", "c", "env"), ("task", "d", "other")]]
    released, held = h.hold(stream(spark, steps, layout), h.when_known, fresh_path(spark, "known"))
    assert tuples(released, "uid") == [("a",), ("b",), ("c",)] and tuples(held.filter("kind = 'task'"), "uid") == [("d",)]
    steps = [[("task", "a"), ("task", "b")], [("cancel", "a"), ("cancel", "z")], [("task", "z"), ("task", "c")]]
    out, held = h.hold(stream(spark, steps, "kind string, uid string"), h.cancels, fresh_path(spark, "cancels"))
    assert tuples(out, "uid") == [("a",), ("z",)] and tuples(held.filter("kind = 'task'"), "uid") == [("b",), ("c",)]


def test_first_per_batch_keeps_the_first(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("uid"), F.col("id").alias("seq")).coalesce(1)
    assert tuples(msg.first_per_batch(df, ["uid"], "seq")) == [("0", 0), ("1", 1), ("2", 2)]
    assert tuples(msg.first_per_batch(df, ["uid"], "seq", last=True)) == [("0", 999), ("1", 997), ("2", 998)]


def test_held_rows_are_there_after_a_restart_without_new_rows(spark):
    layout, path, place = "uid string, ns string, size int", fresh_path(spark, "steps"), fresh_path(spark, "restart")
    write = lambda rows: spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(path)
    run = lambda: h.hold(spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path), h.complete_bags, place)
    write([("u0", "x", 3)])
    write([("u1", "x", 3)])
    assert tuples(run()[1], "uid") == [("u0",), ("u1",)]
    assert tuples(run()[1], "uid") == [("u0",), ("u1",)]
    write([("u2", "x", 3)])
    released, held = run()
    assert tuples(released, "uid") == [("u0",), ("u1",), ("u2",)] and held.count() == 0
    assert run()[1].count() == 0


def test_a_repeated_rank_does_not_make_a_task_whole(spark):
    layout = "uid string, rank int, ranks int, stdout string, stderr string, return_value string, exit_code int"
    row = lambda uid, rank: (uid, rank, 2, "o", "e", "v", 0)
    rows = spark.createDataFrame([row("a", 0), row("a", 0), row("b", 0), row("b", 1), row("b", 1)], layout)
    whole, open_ = h.gather_ranks(rows)
    assert [(r.uid, r.stdout) for r in whole.collect()] == [("b", ["o", "o"])]
    assert {r.uid for r in open_.collect()} == {"a"}


def test_a_member_that_comes_after_its_bag_is_one_too_many(spark):
    layout = "uid string, ns string, size int"
    steps = [[("a", "x", 2), ("b", "x", 2)], [("c", "x", 2), ("d", "y", 2)], [("e", "y", 2)]]
    released, held = h.hold(stream(spark, steps, layout), h.complete_bags, fresh_path(spark, "late"))
    assert tuples(released, "uid", "status") == [("a", "complete"), ("b", "complete"), ("c", "over"),
                                                 ("d", "complete"), ("e", "complete")]
    assert held.count() == 0


def rows_of(spark, path):
    return {n: spark.read.parquet(f"{path}/log/0/new/n={n}").count() for n in range(-1, 3)}


def test_a_batch_writes_its_new_rows_only(spark):
    """What waits is not written again, and a batch without marks does not read it."""
    layout = "uid string, ns string, size int"
    many = [(f"u{i}", "big", 1001) for i in range(1000)]
    steps = [many, [("a", "x", 2)], [("b", "x", 2), ("c", "y", 2)]]
    path = fresh_path(spark, "work")
    released, held = h.hold(stream(spark, steps, layout), h.complete_bags, path)
    assert rows_of(spark, path) == {-1: 0, 0: 1000, 1: 1, 2: 1}
    assert tuples(released, "uid") == [("a",), ("b",)] and held.count() == 1001
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{path}/checkpoint")
    assert tuples(state.select("key._key", "value.n")) == [("big", 1000), ("x", 2), ("y", 1)]


def test_generations_keep_what_waits(spark):
    """With a new base every second batch the result is the same, also over restarts."""
    layout, source, place = "uid string, ns string, size int", fresh_path(spark, "steps"), fresh_path(spark, "generations")
    write = lambda rows: spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(source)
    run = lambda: h.hold(spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(source), h.complete_bags,
                         place, every=2)
    steps = [[("a0", "a", 3), ("b0", "b", 2)], [("a1", "a", 3)], [("c0", "c", 2)], [("b1", "b", 2)], [("c1", "c", 2), ("d0", "d", 9)],
             [("a2", "a", 3)], [("a3", "a", 3)]]
    for i, rows in enumerate(steps):
        write(rows)
        if i % 3 == 2:
            run()
    released, held = run()
    assert tuples(released, "uid", "status") == [("a0", "complete"), ("a1", "complete"), ("a2", "complete"), ("a3", "over"),
                                                 ("b0", "complete"), ("b1", "complete"), ("c0", "complete"), ("c1", "complete")]
    assert tuples(held, "uid") == [("d0",)]


def test_what_has_gone_is_forgotten(spark):
    """After `ttl` the state of a bag that has gone ends, and a late member waits in a bag of its own."""
    import time
    layout, source, place = "uid string, ns string, size int", fresh_path(spark, "steps"), fresh_path(spark, "forget")
    write = lambda rows: spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(source)
    run = lambda: h.hold(spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(source), h.complete_bags,
                         place, ttl=1.0)
    write([("a", "x", 1)])
    assert tuples(run()[0], "uid") == [("a",)]
    time.sleep(1.5)
    write([("b", "y", 2)])  # moves time on
    run()
    write([("c", "x", 2), ("d", "y", 2)])
    released, held = run()
    assert tuples(released, "uid") == [("a",), ("b",), ("d",)] and tuples(held, "uid") == [("c",)]


def test_a_rank_that_reports_after_its_task_has_gone(spark):
    layout = "uid string, rank int, ranks int, stdout string, stderr string, return_value string, exit_code int"
    row = lambda uid, rank, ranks=2: (uid, rank, ranks, f"o{rank}", "e", "v", 0)
    steps = [[row("a", 0), row("b", 0), row("c", 5000, 3)], [row("a", 1), row("c", 4096, 3)], [row("a", 0), row("b", 0)],
             [row("c", 0, 3), row("c", 0, 3)]]
    released, held = h.hold(stream(spark, steps, layout), h.gather_ranks, fresh_path(spark, "ranks"))
    assert tuples(released, "uid", "stdout") == [("a", ["o0", "o1"]), ("c", ["o0", "o4096", "o5000"])]
    assert tuples(held, "uid", "rank") == [("b", 0), ("b", 0)]


def test_keys_of_a_bucket_share_one_state(spark, monkeypatch):
    """The state of time limits grows with buckets, not with tasks, and gives the alarms of the batch form."""
    from taskscope.streaming import buckets
    monkeypatch.setattr(buckets, "BUCKETS", 2)
    first = [(f"u{i:03}", "submit", T0, 10.0, 50.0) for i in range(300)]
    second = [(f"u{i:03}", "started", T0 + 5, None, None) for i in range(0, 300, 2)] + [(None, "submit", T0 + 5, 1.0, 0.0)]
    third = [(f"u{i:03}", "ended", T0 + 40 + i / 2, None, None) for i in range(0, 300, 3)]
    steps = [first, second, third, [("x", "other", T0 + 500, None, None)], [("x", "other", T0 + 501, None, None)]]
    path = fresh_path(spark, "t5")
    got = msg.run_to_end(st.timeout_stream(stream(spark, steps, LIMITS)), path)
    every = spark.createDataFrame([r for s in steps for r in s], LIMITS)
    assert tuples(got) == tuples(st.timeouts(every, T0 + 501)) and got.count() > 250
    left = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{path}/checkpoint")
    assert 0 < left.count() <= 2


def test_the_limit_of_infos_keys_of_a_bucket_apart(spark, monkeypatch):
    from taskscope.streaming import buckets
    monkeypatch.setattr(buckets, "BUCKETS", 1)
    steps = [[(f"u{i}", 0, T0 + i % 3, "x") for i in range(60)],
             [(f"u{i}", n, T0 + 5 + i % 7, f"url: {i}.{n}") for i in range(0, 60, 2) for n in (2, 1)],
             [("z", 0, T0 + 200, "-")], [("z", 1, T0 + 201, "-")], [("u0", 9, T0 + 201, "url: again")]]
    lines = stream(spark, steps, "uid string, pos int, time double, value string")
    path = fresh_path(spark, "t13")
    got = msg.run_to_end(st.info_stream(lines, r"url: (\S+)", timeout=9.0), path)
    in_time = {i for i in range(0, 60, 2) if 5 + i % 7 <= i % 3 + 9}
    assert tuples(got) == sorted([(f"u{i}", f"{i}.1", None) if i in in_time else (f"u{i}", None, "startup timeout")
                                  for i in range(60)], key=repr)
    assert spark.read.format("statestore").option("stateVarName", "bucket").load(f"{path}/checkpoint").count() == 1


def test_only_keys_that_are_told_of_have_state(spark):
    """Tasks that no request names leave nothing in the state, and requests outlast their batch."""
    steps = [[("task", f"u{i}") for i in range(200)] + [("cancel", "later")], [("cancel", "u7"), ("task", "later")], [("task", "u7")]]
    path = fresh_path(spark, "told")
    out, held = h.hold(stream(spark, steps, "kind string, uid string"), h.cancels, path)
    assert tuples(out, "uid") == [("later",), ("u7",), ("u7",)] and held.filter("kind = 'task'").count() == 199
    left = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{path}/checkpoint")
    assert 0 < left.count() <= 2  # buckets of the two keys
