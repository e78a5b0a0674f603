import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.functions import slots as sl
from taskscope.functions import text as tx
from taskscope.operators import assign, audit, staging
from taskscope.operators import workload as w


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize("text,source,target", [
    ("a.dat", "a.dat", "a.dat"), ("x/a.dat > b.dat", "x/a.dat", "b.dat"), ("a >> b", "a", "b"),
    ("b < a", "a", "b"), ("b << a", "a", "b"), ("http://h/p/f.txt?q=1", "http://h/p/f.txt?q=1", "f.txt"),
    ("a > b > c", None, None)])
def test_directives(spark, text, source, target):
    got = one(spark, tx.parse_directive(F.lit(text)))
    assert (got.source, got.target) == (source, target)


@pytest.mark.parametrize("url,want,bad", [
    ("task:///x", "file://l/t/x", False), ("task://h/x", None, True), ("x/y", "pwd:///x/y", False), ("/x", "file:///x", False),
    ("file:///x", "file:///x", False), ("ftp://h/x", "ftp://h/x", False)])
def test_urls(spark, url, want, bad):
    context = F.create_map(F.lit("task"), F.lit("file://l/t/"), F.lit("file"), F.lit("file:///nowhere"))
    got = one(spark, tx.complete_url(F.lit(url), context))
    assert got.url == want and (got.error is not None) == bad


def test_text_functions(spark):
    assert one(spark, tx.tail(F.lit("abcdef"), 3)) == "[... CONTENT SHORTENED ...]\ndef"
    assert one(spark, tx.tail(F.lit(None).cast("string"), 3)) == ""
    assert one(spark, tx.default_target(F.lit("file:///a/b.c"), F.lit(" "))) == "task:///b.c"
    assert one(spark, tx.ts_text(F.lit(86400.5), "yyyy-MM-dd HH:mm:ss.SSS")) == "1970-01-02 00:00:00.500"
    assert one(spark, tx.extract_info(F.lit("x url: http://h:1 y"), r"url: (\S+)")) == "http://h:1"
    assert one(spark, tx.extract_info(F.lit("nothing"), r"url: (\S+)")) is None
    assert one(spark, tx.has_flag(F.lit(6), 4)) and not one(spark, tx.has_flag(F.lit(6), 1))


def test_slots_there_and_back(spark):
    old = spark.sql("""SELECT array(named_struct('cores', array(1, 2), 'gpus', cast(array() as array<int>), 'lfs', 0L, 'mem', 0L,
      'node_index', 3, 'node_name', 'n3')) AS slots""")
    new = sl.slots_to_new(old)
    slot = new.head().slots[0]
    assert [tuple(c) for c in slot.cores] == [(1, 1.0), (2, 1.0)] and slot.gpus == [] and slot.version == 1
    assert sl.slots_to_new(new).head().slots[0] == slot
    assert sl.slots_to_old(new).head().slots[0].cores == [[1], [2]]


def fill(sizes, targets, hwm):
    """Targets one after the other, item by item."""
    used = {name: u for name, _, u in targets}
    open_ = [t for t in targets if used[t[0]] < t[1] * hwm / 100]
    out = []
    for n in sizes:
        if not open_:
            out.append(None)
            continue
        name, cores, _ = open_[0]
        out.append(name)
        used[name] += n
        if used[name] >= cores * hwm / 100:
            open_.pop(0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_capacity_equals_filling_in_order(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 2, 3, 7]) for _ in range(120)]
    targets = [(f"p{i}", r.randrange(1, 30), r.randrange(0, 50)) for i in range(5)]
    df = spark.createDataFrame([(f"t{i:04d}", n, 1) for i, n in enumerate(sizes)], "uid string, ranks int, cores_per_rank int")
    got = [p for _, p in tuples(assign.assign_capacity(df.repartition(3), targets), "uid", "pilot")]
    assert got == fill(sizes, targets, 200.0)


def test_jobs_do_not_follow_the_targets(spark, many_ranges):
    """1,000 targets, some of them full, over several ranges; items without size among them."""
    r = random.Random(9)
    sizes = [r.choice([0, 1, 2, 3, 40]) for _ in range(6000)]
    df = spark.createDataFrame([(f"t{i:05d}", n, 1, None) for i, n in enumerate(sizes)],
                               "uid string, ranks int, cores_per_rank int, pilot string").repartition(5)
    jobs = {}
    for many in (10, 1000):
        targets = [(f"p{i}", r.randrange(1, 40), r.randrange(0, 30)) for i in range(many)]
        spark.sparkContext.setJobGroup(f"capacity-{many}", "")
        got = [p for _, p in tuples(assign.assign_capacity(df, targets), "uid", "pilot")]
        jobs[many] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"capacity-{many}"))
        assert got == fill(sizes, targets, 200.0)
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1000] < 40 and jobs[1000] - jobs[10] < 16
    assert assign.assign_capacity(df.limit(0), [("p", 4, 0)]).count() == 0
    assert {p for _, p in tuples(assign.assign_capacity(df, [("p", 1, 9)]), "uid", "pilot")} == {None}


def test_capacity_can_refuse_larger_items(spark):
    df = spark.createDataFrame([("a", 50, 1), ("b", 1, 1)], "uid string, ranks int, cores_per_rank int")
    assert tuples(assign.assign_capacity(df, [("p", 4, 0)], reject_larger=True), "uid", "pilot") == [("a", None), ("b", "p")]


def test_round_robin_is_even(spark):
    df = spark.createDataFrame([(f"t{i:03d}", "own" if i % 10 == 0 else None) for i in range(100)], "uid string, pilot string")
    got = assign.assign_round_robin(df, ["a", "b", "c"])
    assert {r.pilot: r["count"] for r in got.groupBy("pilot").count().collect()} == {"own": 10, "a": 30, "b": 30, "c": 30}
    assert tuples(assign.assign_round_robin(df, [])) == tuples(df)


def test_unknown_ids_are_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, n int")
    assert w.get_by_uid(df, "a").count() == 1 and w.get_by_uid(df).count() == 2
    with pytest.raises(KeyError):
        w.get_by_uid(df, ["a", "x"])


def test_overrides(spark, tmp_path):
    path = tmp_path / "override.json"
    df = spark.createDataFrame([("a", 1, 2)], "uid string, ranks int, cores_per_rank int")
    assert w.read_overrides(spark, str(path)) == {}
    path.write_text('{"cores_per_rank": 8}')
    given = w.read_overrides(spark, str(path))
    assert tuples(w.apply_overrides(df, given)) == [("a", 1, 8)]


def test_commands_as_one_value(spark):
    df = spark.createDataFrame([("a", 2, '"run"'), ("b", 1, '{"0": "x"}'), ("c", 1, "[]")], "uid string, ranks int, pre_exec string")
    assert tuples(w.commands_for_rank(df), "uid", "rank", "command") == [("a", 0, "run"), ("a", 1, "run"), ("b", 0, "x")]


def test_needs_of_modes(spark):
    df = spark.createDataFrame([("a", "task.proc", "", "f", "", "", ""), ("b", None, "x", "", "", "", ""), ("c", "task.method", "", "f", "", "", "env")],
                               "uid string, mode string, executable string, function string, code string, command string, named_env string")
    good, bad = w.validate_tasks(df)
    assert tuples(good, "uid", "mode") == [("b", "task.executable")]
    assert {r.uid: len(r.reasons) for r in bad.collect()} == {"a": 1, "c": 1}


def test_bag_over_full_and_inconsistent(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3), ("c", 2), ("c", 2), ("d", 2)], "ns string, size int")
    assert tuples(audit.bag_status(df), "ns", "status") == [("a", "over"), ("b", "inconsistent"), ("c", "complete"), ("d", "open")]


def test_unknown_phase(spark):
    with pytest.raises(ValueError):
        staging.actionable(spark.range(1), "never")


def test_feasible_floors_per_node(spark):
    tasks = spark.createDataFrame([("a", 3, 0.0, 0, 0, None), ("b", 9, 0.0, 0, 0, None), ("c", 1, 0.5, 0, 0, 1)],
                                  "uid string, cores_per_rank int, gpus_per_rank double, lfs_per_rank int, mem_per_rank int, ranks_per_node int")
    shapes = spark.createDataFrame([("x", 8, 1, 0, 0)], "shape string, cores int, gpus int, lfs int, mem int")
    assert tuples(assign.feasible(tasks, shapes), "uid", "n_shapes", "most_ranks") == [("a", 1, 2), ("b", 0, 0), ("c", 1, 1)]


def test_new_ids_do_not_repeat_old_ones(spark):
    df = spark.createDataFrame([("task.000000", 1), (None, 2), ("", 3), ("task.7", 4), ("other.9", 5)], "uid string, n int")
    got = assign.with_uid(df, ["n"])
    assert tuples(got, "n", "uid") == [(1, "task.000000"), (2, "task.000008"), (3, "task.000009"), (4, "task.7"), (5, "other.9")]


def test_feasible_does_not_compare_all_pairs(spark):
    tasks = spark.createDataFrame([("a", 2, 0.5, 0, 0, None), ("b", 9, 0.0, 0, 0, 3)],
                                  "uid string, cores_per_rank int, gpus_per_rank double, lfs_per_rank int, mem_per_rank int, ranks_per_node int")
    shapes = spark.createDataFrame([(1, 8, 1, 0, 0), (2, 8, 1, 0, 0), (3, 8, 0, 0, 0)],
                                   "shape int, cores int, gpus int, lfs int, mem int")
    got = assign.feasible(tasks, shapes)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuples(got, "uid", "n_shapes", "most_ranks") == [("a", 2, 2), ("b", 0, 0)]


def test_feasible_equals_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(assign, "SHAPES", 150)
    monkeypatch.setattr(assign, "REQUESTS", 40)
    r = random.Random(11)
    pick = lambda top: r.choice([0, 1, r.randrange(top), r.randrange(top)])
    tasks = [(f"t{i}", 1 + r.randrange(20), r.choice([0.0, 0.5, 1.0, 3.0]), pick(50), pick(90), r.choice([None, 0, 2, 5])) for i in range(200)]
    tasks += [("null", None, 0.0, 0, 0, None), ("large", 10**9, 0.0, 0, 0, None)]
    shapes = [(i, 1 + r.randrange(64), r.choice([-1, 0, 1, 4, 8]), pick(60), pick(100)) for i in range(600)]
    asked = spark.createDataFrame(tasks, "uid string, cores_per_rank int, gpus_per_rank double, lfs_per_rank int, mem_per_rank int, ranks_per_node int")
    have = spark.createDataFrame(shapes, "shape int, cores int, gpus int, lfs int, mem int")
    want = []
    for uid, *ask, limit in tasks:
        fits = [s[1:] for s in shapes if s[2] >= 0 and None not in ask and all(h >= a for h, a in zip(s[1:], ask))]
        ranks = [min([h // a for h, a in zip(s, ask) if a] + ([] if limit is None else [limit])) for s in fits]
        want.append((uid, len(fits), int(max(ranks, default=0))))
    assert tuples(assign.feasible(asked, have), "uid", "n_shapes", "most_ranks") == sorted(want, key=repr)
    assert {(r.n_shapes, r.most_ranks) for r in assign.feasible(asked, have.limit(0)).collect()} == {(0, 0)}
    assert assign.feasible(asked.limit(0), have).count() == 0


def test_few_shapes_are_compared():
    import numpy as np

    rng = np.random.default_rng(1)
    have = rng.integers(0, 1000, (40_000, 4)).astype(float)
    groups = assign.buckets(have)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(have))) and max(map(len, groups)) <= assign.BUCKET
    low, high = (np.array([f(have[g], axis=0) for g in groups]) for f in (np.min, np.max))
    compared = 0
    for ask in rng.integers(0, 1000, (50, 4)).astype(float):
        between = (high >= ask).all(axis=1) & ~(low >= ask).all(axis=1)
        compared += sum(len(groups[g]) for g in np.flatnonzero(between))
    assert compared < 0.25 * 50 * len(have)


def test_colocation_audit_reads_tasks_once(spark):
    rows = [("t1", "a", 1, 0.0, True, False), ("t2", "a", 2, 1.0, True, False), ("t3", "b", 2, 0.0, False, True), ("t4", None, 2, 0.0, True, True)]
    tasks = spark.createDataFrame(rows, "uid string, tag string, node int, start double, whole boolean, exclusive boolean")
    got = audit.colocation_audit(tasks.repartition(7))
    assert "RoundRobinPartitioning(7)" not in got._jdf.queryExecution().toString()
    assert tuples(got) == sorted([("moved", "a", "t2", 2), ("spread", "a", None, None), ("shared", "b", None, 2)], key=repr)
