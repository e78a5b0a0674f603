"""Resource boxes: what was provided, what consumed it, and when.

A box is (rtype, metric, uid, pid, t0, t1, r0, r1): resources r0..r1 of a pilot
from t0 to t1.  Resources of a pilot are numbered over all its nodes.

Inputs:
  pilots  pid, cores_per_node, gpus_per_node
  nodes   pid, node_index, pos, agent (true for nodes of sub-agents)
  slots   uid, pid, node_index, rtype, core   (a row per resource used; repeats count once)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskscope.operators import strips as st
from taskscope.operators.durations import durations, of_spec, wide_times
from taskscope.operators.ordered import running
from taskscope.plans.presets import PILOT_AGENT, PILOT_CONSUME, PILOT_PROVIDE, TASK
from taskscope.plans.spec import expand_match, expand_spec, matches, spec_events
from taskscope.session import staged

BOX = ["rtype", "metric", "uid", "pid", "t0", "t1", "r0", "r1"]
PER_NODE = {"cpu": "cores_per_node", "gpu": "gpus_per_node"}

#: numbers of one word of bits, and of the words that one window task joins
WORD, BLOCK = 32, 4096


def cluster_ranges(df: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Maximal runs (keys, r0, r1) of the distinct integers of each key.

    The numbers of a word become the bits of a long, combined before the shuffle, so
    that no list is held for a key; runs of bits are pieces.  Pieces that touch a word's
    edge are joined within blocks of words, which spreads a key with many numbers over
    tasks, and those that touch a block's edge, at most two per block, over blocks.
    """
    # half a word on, so that small numbers from 0 on touch no edge
    place = F.col(idx).cast("long") + WORD // 2
    bit = F.pmod(place, F.lit(WORD))
    words = df.select(*keys, (place - bit - WORD // 2).alias("_b"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit.cast("int")).alias("_w")).groupBy(*keys, "_b").agg(F.bit_or("_w").alias("_w"))
    bits = lambda w: f"if(bit_count({w}) = 1, array(bit_count({w} - 1)), filter(sequence(0, {WORD - 1}), k -> getbit({w}, k) = 1))"
    pieces = (words.select(*keys, "_b", F.expr("_w & ~shiftleft(_w, 1)").alias("_s"), F.expr("_w & ~shiftright(_w, 1)").alias("_e"))
              .select(*keys, "_b", F.explode(F.arrays_zip(F.expr(bits("_s")).alias("r0"), F.expr(bits("_e")).alias("r1"))).alias("p"))
              .select(*keys, (F.col("_b") + F.col("p.r0")).alias("r0"), (F.col("_b") + F.col("p.r1")).alias("r1")))
    touches = lambda size: (F.pmod(F.col("r0") + WORD // 2, F.lit(size)) == 0) | (F.pmod(F.col("r1") + WORD // 2, F.lit(size)) == size - 1)
    block = F.floor((F.col("r0") + WORD // 2) / BLOCK)
    within = st.merge_ranges(pieces.filter(touches(WORD)).withColumn("_b", block), [*keys, "_b"]).drop("_b")
    return (pieces.filter(~touches(WORD)).unionByName(within.filter(~touches(BLOCK)))
            .unionByName(st.merge_ranges(within.filter(touches(BLOCK)), keys)))


def expand_ranges(df: DataFrame, keys: list[str], r0: str = "r0", r1: str = "r1") -> DataFrame:
    """Distinct single indexes of ranges, the opposite of `cluster_ranges`."""
    return df.select(*keys, F.explode(F.sequence(r0, r1)).alias("idx")).distinct()


def _sessions(*frames: DataFrame) -> list[str]:
    """`sid` where all inputs have it: ids are unique within a session only."""
    return ["sid"] if all("sid" in f.columns for f in frames) else []


def node_ranges(pilots: DataFrame, nodes: DataFrame, rtype: str) -> DataFrame:
    """([sid], pid, node_index, agent, r0, r1): resources each node contributes."""
    keys = [*_sessions(pilots, nodes), "pid"]
    per_node = F.col(PER_NODE[rtype]).cast("long")
    first = F.col("pos").cast("long") * per_node
    return (nodes.join(pilots.select(*keys, PER_NODE[rtype]), keys)
            .filter(per_node > 0)
            .select(*keys, "node_index", "agent", first.alias("r0"), (first + per_node - 1).alias("r1")))


def nodes_of(pilots: DataFrame) -> DataFrame:
    """Node table from pilot documents: workload nodes first, then agent nodes."""
    agents = F.coalesce(F.map_values("resource_details.agent_nodes"), F.array())
    listed = lambda nodes, agent: F.transform(
        nodes, lambda n: F.struct(n["index"].alias("node_index"), n["name"].alias("name"), F.lit(agent).alias("agent")))
    both = F.concat(listed(F.col("resource_details.node_list"), False), listed(agents, True))
    keys = _sessions(pilots)
    return pilots.select(*keys, F.col("uid").alias("pid"), F.posexplode(both).alias("pos", "n")) \
                 .select(*keys, "pid", "pos", "n.*")


def resource_index(slots: DataFrame, pilots: DataFrame, nodes: DataFrame, rtype: str) -> DataFrame:
    """Slots with `idx`, the resource's number in its pilot."""
    keys = [*_sessions(slots, pilots, nodes), "pid", "node_index"]
    where = node_ranges(pilots, nodes, rtype).select(*keys, "r0")
    return (slots.filter(F.col("rtype") == rtype).join(where, keys)
            .withColumn("idx", F.col("r0") + F.col("core")).drop("r0"))


def _boxes(df: DataFrame, rtype: str, metric: Column, uid: str = "pid") -> DataFrame:
    named = df.withColumns({"rtype": F.lit(rtype), "metric": metric, "uid": F.col(uid)})
    return named.select(*_sessions(named), *BOX)


def _of_pilots(events: DataFrame) -> DataFrame:
    return events.filter(F.col("uid").startswith("pilot."))


def usage_times(events: DataFrame, keys: list[str], spec="task") -> DataFrame:
    """One row per entity with the times of a spec's boundaries, and u0 and u1, the first
    `schedule_ok` and the last `unschedule_stop`: one aggregation of the events."""
    named = expand_spec(spec)
    needed = sorted({m.event for sides in named.values() for side in sides for m in side} | {"schedule_ok", "unschedule_stop"})
    event = lambda name: F.when(F.col("event") == name, F.col("time"))
    return wide_times(events.filter(F.col("event").isin(needed)), keys, [named],
                      F.min(event("schedule_ok")).alias("u0"), F.max(event("unschedule_stop")).alias("u1"))


def pilot_life(events: DataFrame, keys=()) -> DataFrame:
    """(keys, pid, p_min, p_max): first start, else first PMGR_ACTIVE; first stop,
    else the last event."""
    at = lambda c: F.min(F.when(c, F.col("time")))
    active = (F.col("event") == "state") & (F.col("state") == "PMGR_ACTIVE")
    return _of_pilots(events).groupBy(*keys, F.col("uid").alias("pid")).agg(
        F.coalesce(at(F.col("event") == "bootstrap_0_start"), at(active)).alias("p_min"),
        F.coalesce(at(F.col("event") == "bootstrap_0_stop"), F.max("time")).alias("p_max"))


def provided(pilots: DataFrame, nodes: DataFrame, events: DataFrame, rtype: str = "cpu") -> DataFrame:
    """One box per node over the pilot's life; without both marks, from its
    first to its last event."""
    own = _of_pilots(events)
    sid = _sessions(pilots, nodes, events)
    (first,), (last,) = expand_spec(PILOT_PROVIDE)["total"]
    at = lambda m: F.when(matches([m]), F.col("time"))
    life = own.groupBy(*sid, F.col("uid").alias("pid")).agg(
        F.min(at(first)).alias("a"), F.max(at(last)).alias("b"),
        F.min("time").alias("e0"), F.max("time").alias("e1"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    life = life.select(*sid, "pid", F.when(both, F.col("a")).otherwise(F.col("e0")).alias("t0"),
                       F.when(both, F.col("b")).otherwise(F.col("e1")).alias("t1"))
    return _boxes(node_ranges(pilots, nodes, rtype).join(life, [*sid, "pid"]), rtype, F.lit("total"))


def pilot_boxes(pilots: DataFrame, nodes: DataFrame, events: DataFrame, rtype: str = "cpu") -> DataFrame:
    """Agent nodes for the pilot's whole life, its phases on all other nodes.

    The phase of the sub-agents is named `sub_agent`; idle time is found in
    `warm_drain_idle`.
    """
    sid = _sessions(pilots, nodes, events)
    spec = {"agent": PILOT_AGENT["total"],
            **{("sub_agent" if m == "agent" else m): b for m, b in PILOT_CONSUME.items() if m != "idle"}}
    dur = durations(_of_pilots(events), spec, by=[*sid, "uid"]).withColumnRenamed("uid", "pid")
    fits = (F.col("metric") == "agent") == F.col("agent")
    where = node_ranges(pilots, nodes, rtype)
    return _boxes(where.join(dur, [*sid, "pid"]).filter(fits), rtype, F.col("metric"))


def task_ranges(pilots: DataFrame, nodes: DataFrame, slots: DataFrame, rtype: str = "cpu") -> DataFrame:
    """([sid], uid, pid, r0, r1): the resource ranges each task was placed on.

    One shuffle, by task: a task has no more resources than its pilot.  The ranges stay
    where their task is, so that a join on it moves them no more.
    """
    sid = _sessions(pilots, nodes, slots)
    keys = [*sid, "uid", "pid"]
    index = resource_index(slots, pilots, nodes, rtype).filter("idx is not null").repartition(*sid, "uid")
    return st.merge_ranges(index.select(*keys, F.col("idx").alias("r0"), F.col("idx").alias("r1")), keys)


def task_boxes(pilots: DataFrame, nodes: DataFrame, slots: DataFrame, events: DataFrame,
               rtype: str = "cpu", spec="task") -> DataFrame:
    """The phases of each task on the resource ranges it was placed on."""
    sid = _sessions(pilots, nodes, slots, events)
    keys = [*sid, "uid"]
    times = wide_times(events.filter(F.col("event").isin(spec_events(spec))), keys, [expand_spec(spec)])
    ranges = task_ranges(pilots, nodes, slots, rtype)
    return _task_boxes(ranges.join(times, keys), ranges.columns, spec, rtype)


def _task_boxes(timed: DataFrame, keys: list[str], spec, rtype: str) -> DataFrame:
    """Boxes of ranges that have the times of their task: phases are rows after the join only."""
    return _boxes(of_spec(timed, keys, expand_spec(spec)), rtype, F.col("metric"), "uid")


def warm_drain_idle(pilots: DataFrame, nodes: DataFrame, slots: DataFrame, events: DataFrame,
                    rtype: str = "cpu") -> DataFrame:
    """Per resource: `warm` until a task first takes it, `drain` after the last
    one gave it back, `idle` when none ever did.

    Use is from `schedule_ok` to `unschedule_stop`.  Neighbouring resources
    with the same bound share a box.  Ranges of use are laid over the ranges of
    the nodes, strip by strip: no row stands for a single resource.
    """
    sid = _sessions(pilots, nodes, slots, events)
    one = resource_index(slots, pilots, nodes, rtype).select(*sid, "uid", "pid", F.col("idx").alias("r0"), F.col("idx").alias("r1"))
    keys = [*sid, "uid"]
    return _warm_drain_idle(node_ranges(pilots, nodes, rtype), one.join(usage_times(events, keys, {}), keys), events, sid, rtype)


def _warm_drain_idle(where: DataFrame, timed: DataFrame, events: DataFrame, sid: list[str], rtype: str) -> DataFrame:
    keys = [*sid, "pid"]
    # tasks take the same ranges over and over: one row for each of these, combined before the shuffle
    use = (timed.filter("u0 is not null and u1 is not null")
           .groupBy(*keys, "r0", "r1").agg(F.min("u0").alias("u0"), F.max("u1").alias("u1")))
    both = staged(where.filter("not agent").select(*keys, "r0", "r1", F.lit(True).alias("own"),
                                                   *[F.lit(None).cast("double").alias(c) for c in ("u0", "u1")])
                  .unionByName(use.select(*keys, "r0", "r1", F.lit(False).alias("own"), "u0", "u1")), "usage-ranges")
    strips = st.strips_of(both, keys)
    bounds = (st.cut_boxes(both, strips, keys).groupBy(*keys, "strip")
              .agg(F.max("own").alias("own"), F.min("u0").alias("t_min"), F.max("u1").alias("t_max"))
              .filter("own").join(strips, [*keys, "strip"]))
    bounds = staged(bounds.select(*keys, "t_min", "t_max", "r0", "r1"), "usage-bounds")
    taken = bounds.filter("t_min is not null")

    def part(metric, rows, bound):
        at = F.col(bound) if bound else F.lit(None).cast("double")
        return st.merge_ranges(rows, [*keys, *([bound] if bound else [])]).select(
            *keys, F.lit(metric).alias("metric"), at.alias("at"), "r0", "r1")

    parts = (part("warm", taken, "t_min").unionByName(part("drain", taken, "t_max"))
             .unionByName(part("idle", bounds.filter("t_min is null"), None)))
    timed = parts.join(pilot_life(events, sid), keys).withColumns({
        "t0": F.when(F.col("metric") == "drain", F.col("at")).otherwise(F.col("p_min")),
        "t1": F.when(F.col("metric") == "warm", F.col("at")).otherwise(F.col("p_max"))})
    return _boxes(timed, rtype, F.col("metric"))


def consumed(pilots: DataFrame, nodes: DataFrame, slots: DataFrame, events: DataFrame,
             rtype: str = "cpu", spec="task") -> DataFrame:
    """Everything that used resources: pilot phases, tasks, warm, drain, idle.

    The events of tasks are aggregated once, the slots clustered once, and both joined
    once, for the two that need them.
    """
    if rtype not in PER_NODE:
        raise ValueError(f"unknown resource type: {rtype}")
    sid = _sessions(pilots, nodes, slots, events)
    keys = [*sid, "uid"]
    ranges = task_ranges(pilots, nodes, slots, rtype)
    timed = staged(ranges.join(usage_times(events, keys, spec), keys), "usage-tasks", "zstd")
    return (pilot_boxes(pilots, nodes, events, rtype)
            .unionByName(_task_boxes(timed, ranges.columns, spec, rtype))
            .unionByName(_warm_drain_idle(node_ranges(pilots, nodes, rtype), timed, events, sid, rtype)))


def _box_keys(*boxes: DataFrame) -> list[str]:
    return [*_sessions(*boxes), "rtype", "pid"]


def overlaps(boxes: DataFrame) -> DataFrame:
    """([sid], rtype, pid, r0, r1, metric, uid, t0, t1, before): boxes that begin on
    resources r0..r1 before an earlier box there has ended, at `before`."""
    return st.overlaps(boxes, _box_keys(boxes))


#: whose time it is where boxes overlap: tasks, then the pilot's own phases, then what is left
PRECEDENCE = [*TASK, "agent", "sub_agent", "boot", "setup_1", "term", "warm", "drain", "idle"]


def attribution(boxes: DataFrame, total: DataFrame, order: list[str] = PRECEDENCE) -> DataFrame:
    """([sid], rtype, pid, metric, used, given, share): what was provided, each instant of
    each resource under one metric, `unused` where no box covers it; shares add up to one."""
    return st.attribution(boxes, total, order, _box_keys(boxes, total))


def core_time(boxes: DataFrame, total: DataFrame) -> DataFrame:
    """Resource time per pilot and metric, and its share of what was provided."""
    area = (F.col("t1") - F.col("t0")) * (F.col("r1") - F.col("r0") + 1)
    keys = [*_sessions(boxes, total), "rtype", "pid"]
    used = boxes.groupBy(*keys, "metric").agg(F.sum(area).alias("used"))
    given = total.groupBy(*keys).agg(F.sum(area).alias("given"))
    return used.join(given, keys).withColumn(
        "share", F.col("used") / F.nullif("given", F.lit(0.0)))


def share_check(shares: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per pilot the sum of shares but `unused`, and whether it is one.

    Of `attribution`: whether everything consumed covers what was provided.
    """
    counts = F.when(F.col("metric") != st.UNUSED, F.col("share")).otherwise(0.0)
    return shares.groupBy(*_sessions(shares), "rtype", "pid").agg(F.sum(counts).alias("total")) \
        .withColumn("whole", F.abs(F.col("total") - 1) <= tolerance)


def usage_timeline(events: DataFrame, tasks: DataFrame, rows: list[tuple]) -> DataFrame:
    """(pid, metric, time, amount): resources in each metric after each change.

    `rows` are transitions (event, state, msg, source, target) from
    `taskscope.plans.spec`, `tasks` has uid, pilot and amount.  Changes at the
    same time are summed first; long pilots are split by `running`.
    """
    hits = events.filter(F.col("event").isin(sorted({r[0] for r in rows})))
    changes = hits.withColumn("m", _move(rows)).filter("m is not null")
    sid = _sessions(events, tasks)
    changes = changes.join(tasks.filter("pilot is not null").select(*sid, "uid", "pilot", "amount"), [*sid, "uid"]).select(
        *sid, F.col("pilot").alias("pid"), "time", F.explode(F.array(
            F.struct(F.col("m.source").alias("metric"), (-F.col("amount")).alias("change")),
            F.struct(F.col("m.target").alias("metric"), F.col("amount").alias("change")))).alias("c"))
    keys = [*sid, "pid", "metric"]
    summed = changes.groupBy(*sid, "pid", "c.metric", "time").agg(F.sum("c.change").alias("change"))
    return running(staged(summed, "changes"), keys, ["time"],
                   sums={"amount": F.col("change")}).select(*keys, "time", "amount")


def _move(rows: list[tuple]) -> Column:
    """Struct(source, target) of the transition an event makes; null for none."""
    move = None
    boundaries = [expand_match(_short(r)) for r in rows]
    for i, (m, row) in enumerate(zip(boundaries, rows)):
        for other in boundaries[:i]:
            clash = all(a is None or b is None or a == b for a, b in zip(m, other))
            if clash:
                raise ValueError(f"an event may match two transitions: {other} and {m}")
        pair = F.struct(F.lit(row[3]).alias("source"), F.lit(row[4]).alias("target"))
        move = F.when(matches([m]), pair) if move is None else move.when(matches([m]), pair)
    return move


def _short(row) -> dict:
    return {k: v for k, v in zip(("EVENT", "STATE", "MSG"), row[:3]) if v is not None}


def task_timelines(events: DataFrame, tasks: DataFrame, spec="task") -> DataFrame:
    """(uid, metric, t0, t1) for tasks that were assigned and placed; a missing
    time stays null."""
    keys = [*_sessions(events, tasks), "uid"]
    placed = tasks.filter("pilot is not null and placed").select(*keys).distinct()
    mine = events.join(placed, keys, "left_semi")
    return durations(mine, spec, keep_missing=True, by=keys).select(*keys, "metric", "t0", "t1")


def occupancy_audit(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """Times at which a resource is used beyond what it is.

    `uses`: pid, node_index, kind, idx, amount, t0, t1 - kind is `core` or
    `gpu` (amount is an occupation) or `lfs` or `mem` (idx 0).  `resources`:
    pid, node_index, kind, idx, capacity; null capacity is a resource that is
    down.  Reasons: `unknown`, `down`, `over`.
    """
    where = [*_sessions(uses, resources), "pid", "node_index", "kind", "idx"]
    changes = uses.select(*where, F.explode(F.array(
        F.struct(F.col("t0").alias("time"), F.col("amount").alias("change")),
        F.struct(F.col("t1").alias("time"), (-F.col("amount")).alias("change")))).alias("c")) \
        .groupBy(*where, "c.time").agg(F.sum("c.change").alias("change"))
    level = running(staged(changes, "changes"), where, ["time"], sums={"level": F.col("change")})
    known = level.join(resources.select(*where, "capacity").withColumn("_known", F.lit(True)), where, "left")
    reason = (F.when(F.col("_known").isNull(), F.lit("unknown"))
              .when(F.col("capacity").isNull(), F.lit("down"))
              .when(F.col("level") > F.col("capacity") + 1e-9, F.lit("over")))
    bad = known.withColumn("reason", reason).filter("reason is not null")
    # an unknown or down resource is reported for each use, not for its end
    return bad.filter((F.col("reason") == "over") | (F.col("change") > 0)) \
              .select(*where, "time", "level", "reason")
