import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.operators import strips as st
from taskscope.operators import usage as u
from taskscope.plans import spec as specs


def test_clusters_keep_single_numbers(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 2, 3)] + [("b", 5)], "k string, idx long")
    assert tuples(u.cluster_ranges(df, ["k"])) == [("a", 0, 0), ("a", 2, 3), ("b", 5, 5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_over_block_edges(spark, seed):
    r = random.Random(seed)
    present = {i for i in range(4 * u.BLOCK) if r.random() < 0.7}
    present |= set(range(u.BLOCK - 3, 3 * u.BLOCK + 3))
    df = spark.createDataFrame([("k", i) for i in present for _ in range(1 + i % 2)], "k string, idx long")
    want, ordered = [], sorted(present)
    for i in ordered:
        if want and want[-1][1] == i - 1:
            want[-1][1] = i
        else:
            want.append([i, i])
    assert [list(x[1:]) for x in sorted(u.cluster_ranges(df, ["k"]).collect())] == want


# two pilots with different nodes; the first has a sub-agent node
PILOTS = [("pilot.0", 4, 1), ("pilot.1", 2, 0)]
NODES = [("pilot.0", 10, 0, False), ("pilot.0", 11, 1, False), ("pilot.0", 99, 2, True), ("pilot.1", 7, 0, False)]
SLOTS = [("task.1", "pilot.0", 10, "cpu", 0), ("task.1", "pilot.0", 10, "cpu", 1), ("task.1", "pilot.0", 11, "cpu", 0),
         ("task.2", "pilot.0", 10, "cpu", 1), ("task.1", "pilot.0", 11, "gpu", 0), ("task.3", "pilot.1", 7, "cpu", 1)]
TIMES = {  # pilots: start, ok, active, cancel, stop
    "pilot.0": [0.0, 1.0, 2.0, 90.0, 100.0], "pilot.1": [0.0, 1.0, 2.0, 40.0, 50.0]}
TASKS = {"task.1": 10.0, "task.2": 40.0, "task.3": 20.0}


@pytest.fixture(scope="module")
def run(spark):
    events = []
    for pid, at in TIMES.items():
        names = [("bootstrap_0_start", "", ""), ("bootstrap_0_ok", "", ""), ("state", "PMGR_ACTIVE", ""),
                 ("cmd", "", "cancel_pilot"), ("bootstrap_0_stop", "", "")]
        events += [(t, n, pid, s, m) for t, (n, s, m) in zip(at, names)]
    marks = [("schedule_ok", ""), ("state", "AGENT_EXECUTING"), ("task_run_start", ""), ("launch_start", ""), ("exec_start", ""),
             ("exec_stop", ""), ("launch_stop", ""), ("task_run_stop", ""), ("unschedule_stop", "")]
    for uid, start in TASKS.items():
        events += [(start + i, n, uid, s, "") for i, (n, s) in enumerate(marks)]
    make = spark.createDataFrame
    return (make(PILOTS, "pid string, cores_per_node int, gpus_per_node int"),
            make(NODES, "pid string, node_index int, pos int, agent boolean"),
            make(SLOTS, "uid string, pid string, node_index int, rtype string, core int"),
            make(events, "time double, event string, uid string, state string, msg string"))


def test_index_is_per_pilot(spark, run):
    pilots, nodes, slots, _ = run
    got = tuples(u.resource_index(slots, pilots, nodes, "cpu"), "uid", "idx")
    assert got == [("task.1", 0), ("task.1", 1), ("task.1", 4), ("task.2", 1), ("task.3", 1)]
    assert tuples(u.resource_index(slots, pilots, nodes, "gpu"), "uid", "idx") == [("task.1", 1)]


def test_warm_drain_idle(spark, run):
    got = tuples(u.warm_drain_idle(*run).filter("pid = 'pilot.0'"), "metric", "t0", "t1", "r0", "r1")
    assert got == sorted([
        ("warm", 0.0, 10.0, 0, 1), ("warm", 0.0, 10.0, 4, 4),
        ("drain", 18.0, 100.0, 0, 0), ("drain", 18.0, 100.0, 4, 4), ("drain", 48.0, 100.0, 1, 1),
        ("idle", 0.0, 100.0, 2, 3), ("idle", 0.0, 100.0, 5, 7)], key=repr)


def test_task_boxes_and_no_overlap(spark, run):
    boxes = u.task_boxes(*run)
    assert boxes.filter("uid = 'task.1' and metric = 'exec_cmd'").select("t0", "t1", "r0", "r1").count() == 2
    assert boxes.filter("uid = 'task.1'").count() == 16
    assert u.overlaps(boxes).isEmpty()
    both = boxes.unionByName(boxes.filter("uid = 'task.2'").withColumn("uid", F.lit("task.9")))
    assert {(r.r0, r.r1) for r in u.overlaps(both).collect()} == {(1, 1)}


def test_no_row_per_resource(spark, run):
    """A machine of 10^5 cores in whole nodes: rows follow the boxes, not the cores."""
    cores, per = 100_352, 64
    many = cores // per
    pilots = spark.createDataFrame([("pilot.0", per, 0)], "pid string, cores_per_node int, gpus_per_node int")
    nodes = spark.range(many).selectExpr("'pilot.0' as pid", "id as node_index", "cast(id as int) as pos", "false as agent")
    boxes = spark.createDataFrame(
        [("cpu", "warm", "pilot.0", "pilot.0", 0.0, 10.0, 0, cores - 1), ("cpu", "drain", "pilot.0", "pilot.0", 20.0, 100.0, 0, cores - 1)]
        + [("cpu", "exec_cmd", f"task.{i}", "pilot.0", 9.0 if i % 100 == 7 else 10.0, 20.0, i * per, (i + 1) * per - 1)
           for i in range(many) if i != 500],
        "rtype string, metric string, uid string, pid string, t0 double, t1 double, r0 long, r1 long")
    found = u.overlaps(boxes)
    hit = [i for i in range(many) if i % 100 == 7]
    assert tuples(found, "uid", "before", "r0", "r1") == sorted(
        [(f"task.{i}", 10.0, i * per, (i + 1) * per - 1) for i in hit], key=repr)
    strips = st.strips_of(boxes, ["rtype", "pid"])
    assert strips.count() == many + 1
    assert st.cut_boxes(boxes, strips, ["rtype", "pid"]).count() == 2 * many + many - 1
    total = u.provided(pilots, nodes, run[3].filter("uid = 'pilot.0'"))
    used = {r.metric: (r.used, r.share) for r in u.attribution(boxes, total).collect()}
    assert used["unused"][0] == 10.0 * per and abs(sum(x for _, x in used.values()) - 1) < 1e-12
    assert used["exec_cmd"][0] == 10.0 * per * (many - 1) + per * len(hit)
    assert used["warm"][0] == 10.0 * cores - per * len(hit)
    slots = spark.range(many).filter("id <> 500").selectExpr(
        "'task.1' as uid", "'pilot.0' as pid", "id as node_index", "'cpu' as rtype", f"explode(sequence(0, {per - 1})) as core")
    idle = u.warm_drain_idle(pilots, nodes, slots, run[3])
    assert "sequence(r0" not in idle._jdf.queryExecution().toString().lower()
    assert tuples(idle, "metric", "r0", "r1") == sorted([
        ("idle", 500 * per, 501 * per - 1), *[(m, a, b) for m in ("warm", "drain")
                                              for a, b in ((0, 500 * per - 1), (501 * per, cores - 1))]], key=repr)


def test_every_instant_counts_once(spark, run):
    pilots, nodes, slots, events = run
    total = u.provided(pilots, nodes, events)
    got = {(r.pid, r.metric): r.used for r in u.attribution(u.consumed(*run), total).collect()}
    # by hand, instant by instant (all times are whole seconds)
    boxes = u.consumed(*run).collect()
    want = {}
    for box in total.collect():
        for r in range(box.r0, box.r1 + 1):
            for t in range(int(box.t0), int(box.t1)):
                own = {b.metric for b in boxes if b.pid == box.pid and b.r0 <= r <= b.r1 and b.t0 <= t < b.t1}
                metric = next((m for m in u.PRECEDENCE if m in own), "unused")
                want[box.pid, metric] = want.get((box.pid, metric), 0) + 1
    assert got == want
    shares = u.attribution(u.consumed(*run), total)
    assert {r.pid: r.whole for r in u.share_check(shares).collect()} == {"pilot.0": False, "pilot.1": True}
    other = u.attribution(u.consumed(*run), total, order=["exec_cmd"])
    assert {r.metric for r in other.collect()} == {"exec_cmd", "other", "unused"}


def test_areas_add_up_to_what_was_provided(spark, run):
    pilots, nodes, slots, events = run
    # without the phases of pilots, which lie over warm, drain and idle
    used = u.task_boxes(*run).unionByName(u.warm_drain_idle(*run))
    area = used.filter("pid = 'pilot.1'").select(F.sum(F.expr("(t1 - t0) * (r1 - r0 + 1)"))).head()[0]
    assert area == 50.0 * 2
    shares = u.core_time(used, u.provided(pilots, nodes, events))
    whole = {r.pid: r.whole for r in u.share_check(shares).collect()}
    assert whole["pilot.1"]
    # pilot.0: the agent's node is not in use, and core 1 idles between two tasks
    left = u.core_time(used, u.provided(pilots, nodes, events)).filter("pid = 'pilot.0'").agg(F.sum("used")).head()[0]
    assert left == 100.0 * 8 - (40 - 18)


def test_agent_nodes_and_phases(spark, run):
    pilots, nodes, _, events = run
    got = tuples(u.pilot_boxes(pilots, nodes, events).filter("pid = 'pilot.0'"), "metric", "t0", "t1", "r0", "r1")
    assert ("agent", 0.0, 100.0, 8, 11) in got and ("boot", 0.0, 1.0, 0, 3) in got
    assert {m for m, *_ in got} == {"agent", "boot", "setup_1", "term"}
    with pytest.raises(ValueError):
        u.consumed(*run, rtype="disk")


def test_timeline_returns_to_zero(spark, run):
    tasks = spark.createDataFrame([("task.1", "pilot.0", 3), ("task.2", "pilot.0", 1), ("task.3", None, 1)],
                                  "uid string, pilot string, amount int")
    line = u.usage_timeline(run[3], tasks, specs.transition_rows("task"))
    last = {r.metric: r.amount for r in line.groupBy("metric").agg(F.max_by("amount", "time").alias("amount")).collect()}
    assert set(last.values()) == {0}
    assert line.filter("metric = 'exec_cmd'").agg(F.max("amount")).head()[0] == 3
    with pytest.raises(ValueError):
        u.usage_timeline(run[3], tasks, [("e", None, None, "a", "b"), ("e", "X", None, "b", "c")])


def test_occupancy(spark):
    uses = spark.createDataFrame([
        ("p", 0, "core", 0, 0.5, 0.0, 10.0), ("p", 0, "core", 0, 0.5, 5.0, 15.0), ("p", 0, "core", 0, 0.5, 8.0, 9.0),
        ("p", 0, "core", 1, 1.0, 0.0, 1.0), ("p", 0, "core", 1, 1.0, 1.0, 2.0),
        ("p", 0, "core", 2, 1.0, 0.0, 1.0), ("p", 3, "core", 0, 1.0, 0.0, 1.0), ("p", 0, "mem", 0, 9.0, 0.0, 1.0)],
        "pid string, node_index int, kind string, idx int, amount double, t0 double, t1 double")
    have = spark.createDataFrame([("p", 0, "core", 0, 1.0), ("p", 0, "core", 1, 1.0), ("p", 0, "core", 2, None), ("p", 0, "mem", 0, 8.0)],
                                 "pid string, node_index int, kind string, idx int, capacity double")
    got = tuples(u.occupancy_audit(uses, have), "node_index", "kind", "idx", "time", "reason")
    assert got == sorted([(0, "core", 0, 8.0, "over"), (0, "core", 2, 0.0, "down"), (3, "core", 0, 0.0, "unknown"),
                          (0, "mem", 0, 0.0, "over")], key=repr)


def test_sweeps_do_not_depend_on_cells(spark, monkeypatch):
    """Boxes swept in many small cells of time, some of them reaching over all cells, give what one cell gives."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, r = rng.randrange(0, 400), rng.randrange(0, 12)
        rows.append(("cpu", rng.choice(["exec_cmd", "boot", "idle"]), f"t{i}", f"p{i % 3 // 2}", float(a),
                     float(a + rng.choice([0, 5, 5, 30, 600])), r, r + rng.randrange(0, 4)))
    boxes = spark.createDataFrame(rows, "rtype string, metric string, uid string, pid string, t0 double, t1 double, r0 long, r1 long")
    total = spark.createDataFrame([("cpu", "total", p, p, 10.0, 700.0, 0, 20) for p in ("p0", "p1")], boxes.schema)

    def swept():
        one = u.overlaps(boxes).withColumn("r", F.explode(F.sequence("r0", "r1"))).select("pid", "r", "metric", "uid", "t0", "t1", "before")
        return tuples(one), tuples(u.attribution(boxes, total), "pid", "metric", "used", "given")

    whole = swept()
    monkeypatch.setattr(st, "CELL", 20)
    monkeypatch.setattr(st, "PACK", 30)
    assert len(st._bounds(boxes, ["rtype", "pid"])[("cpu", "p0")]) > 3
    assert swept() == whole
    held, want = {}, []
    for _, metric, uid, pid, t0, t1, r0, r1 in sorted(rows, key=lambda b: (b[4], b[5], b[1], b[2])):
        for r in range(r0, r1 + 1) if t1 > t0 else ():
            if t0 < held.get((pid, r), t0):
                want.append((pid, r, metric, uid, t0, t1, held[pid, r]))
            held[pid, r] = max(t1, held.get((pid, r), t1))
    assert whole[0] == sorted(want, key=repr) and want
    assert all(sum(x[2] for x in whole[1] if x[0] == p) == 690 * 21 for p in ("p0", "p1"))


def test_short_form_of_boxes():
    """Lists of boxes, nulls and empty texts among them, are read as they were written, in one batch or many."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.choice([0.0, -1.5, 1e300, float("inf")]), rng.random() * 1e9, rng.randrange(-5, 2**40), rng.randrange(9),
             rng.choice(["", "x", "boot", None]), rng.choice(["é" * 40, "task.1", None])) for _ in range(500)]
    table = pa.table(dict(zip(("pid", "t0", "t1", "r0", "r1", "metric", "uid"), map(list, zip(*rows)))))
    lists = list(st._packer(["pid"], ["r0", "r1"], ["metric", "uid"], 100)(iter(table.to_batches(max_chunksize=60))))
    assert 2 < len(lists) < 8 and all(b.num_rows == 3 for b in lists)
    got = []
    for b in [*lists, *pa.Table.from_batches(lists[1:]).combine_chunks().to_batches(), lists[0].slice(1, 1), lists[0].slice(0, 0)]:
        boxes, n = st._Boxes.read(b, ["r0", "r1"], ["metric", "uid"])
        c = boxes.columns()
        got.append(list(zip(np.repeat(b["pid"].to_numpy(zero_copy_only=False), n), *(c[k].tolist() for k in ("t0", "t1", "r0", "r1")),
                            *(c[k].to_pylist() for k in ("metric", "uid")))))
    assert sorted(sum(got[:len(lists)], []), key=repr) == sorted(rows, key=repr) == sorted(got[0] + got[-3], key=repr)
    assert got[-2] == [r for r in got[0] if r[0] == lists[0]["pid"][1].as_py()] and got[-1] == []


def test_sweeps_write_no_row_per_box(spark, monkeypatch):
    """What is written before a sweep are lists of boxes, a few bytes for each phase of a task."""
    written, staged = {}, st.staged
    monkeypatch.setattr(st, "staged", lambda df, name, *a: written.setdefault(name, staged(df, name, *a)))
    phases = spark.range(0, 20000, 1, 2).selectExpr(
        "'cpu' as rtype", "'p' as pid", "concat('task.', lpad(cast(id div 8 as string), 9, '0')) as uid", "concat('phase_', id % 8) as metric",
        "1.6e9 + (id div 8) * 3.0 + id % 8 as t0", "1.6e9 + (id div 8) * 3.0 + id % 8 + 1 as t1", "id div 8 % 2 as r0", "id div 8 % 2 as r1")
    assert u.overlaps(phases).count() == 2 * (2500 - 2)
    assert written["boxes"].count() <= 4
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in written["boxes"].inputFiles())
    assert size < 20000 * 16


def test_clusters_hold_no_lists_of_a_key(spark):
    """Numbers are combined as bits, in a hash aggregate that holds no lists; null numbers give nothing."""
    rows = [(k, i) for k in ("a", None) for i in (-33, -17, -16, 15, 16, 47, 48, 4079, 4080, 4081, None, 48)]
    df = u.cluster_ranges(spark.createDataFrame(rows, "k string, idx int"), ["k"])
    want = [(-33, -33), (-17, -16), (15, 16), (47, 48), (4079, 4081)]
    assert tuples(df) == sorted([(k, *r) for k in ("a", None) for r in want], key=repr)
    plan = df._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_merged_ranges_may_repeat(spark):
    rows = [(k, i, i) for k in ("a", None) for i in (3, 0, 1, 1, 1, 4, 7, 7)] + [("a", 9, 12)] * 2
    got = tuples(st.merge_ranges(spark.createDataFrame(rows, "k string, r0 long, r1 long"), ["k"]))
    assert got == sorted([(k, *r) for k in ("a", None) for r in ((0, 1), (3, 4), (7, 7))] + [("a", 9, 12)], key=repr)


def test_slots_of_tasks_are_shuffled_once(spark, run, tmp_path):
    """Slots move by task once, and so do times; phases become rows after the join of both."""
    frames = []
    for i, df in enumerate(run):
        df.write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    pilots, nodes, slots, events = frames
    once = u.task_boxes(pilots, nodes, slots, events)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(uid") == plan.count("Exchange hashpartitioning") == 2
    twice = u.task_boxes(pilots, nodes, slots.unionByName(slots), events)
    assert tuples(twice) == tuples(once) and len(tuples(once)) > 16
    assert tuples(u.consumed(pilots, nodes, slots.unionByName(slots), events)) == tuples(u.consumed(*run))


def test_slots_with_times_move_once(spark):
    from suite import usage

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = usage.all_uses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # slots and tasks, both by task
