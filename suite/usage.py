"""Resource boxes and usage over time."""

from pyspark.sql import functions as F

from suite.durations import found, spec_values, text
from suite.views import slots_in_place, sql, table, view
from taskscope.operators import usage as u
from taskscope.plans import spec as specs
from taskscope.plans.presets import PILOT_AGENT, PILOT_CONSUME, TASK, E

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


def pilots(s, p):
    return view(s, p, "pilots_v").select(F.col("uid").alias("pid"), "cores_per_node", "gpus_per_node")


def placed(s, p):
    """`placed_v` before its DISTINCT: the operators take repeats."""
    return view(s, p, "placed_v", repeats=True)


def parts(s, p):
    return pilots(s, p), view(s, p, "nodes_v"), placed(s, p), view(s, p, "usage_trace_v")


def no_slots(s, p):
    a, b, _, d = parts(s, p)
    return a, b, d


NODES = {r: f"""nr AS (SELECT pid, node_index, agent, pos * {n} AS r0, pos * {n} + {n} - 1 AS r1 FROM nodes_v)"""
         for r, n in (("cpu", 8), ("gpu", 1))}
BOX = "rtype, metric, uid, pid, t0, t1, r0, r1"


def with_(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def islands(source, keys, idx="idx"):
    return f"""SELECT {keys}, min({idx}) AS r0, max({idx}) AS r1 FROM (
  SELECT {keys}, {idx}, {idx} - row_number() OVER (PARTITION BY {keys} ORDER BY {idx}) AS g
  FROM (SELECT DISTINCT {keys}, {idx} FROM {source})) GROUP BY {keys}, g"""


def cores_used(s, p):
    """Cores of `slots_v`, one row per item: `cluster_ranges` takes repeats, and needs no times."""
    return table(s, p, "lineitem").select(
        F.expr("concat('task.', lpad(CAST(l_orderkey AS VARCHAR(20)), 9, '0'))").alias("uid"),
        F.expr("CAST(l_suppkey % 8 AS INT)").alias("node_index"), F.expr("CAST((l_partkey + l_linenumber) % 8 AS INT)").alias("core"))


add("W4_cluster_ranges",
    lambda s, p: u.cluster_ranges(cores_used(s, p), ["uid", "node_index"], "core"),
    islands("slots_v", "uid, node_index", "core"))

# a key with many numbers: all suppliers and parts
add("W4_cluster_large",
    lambda s, p: u.cluster_ranges(view(s, p, "tasks_v").select(
        F.lit("all").alias("k"), F.expr("CAST(t_submit / 86400 AS BIGINT) * 3 + priority").alias("idx")), ["k"]),
    islands("(SELECT 'all' AS k, CAST(t_submit / 86400 AS BIGINT) * 3 + priority AS idx FROM tasks_v)", "k"))

add("U2_distinct_indexes",
    lambda s, p: u.expand_ranges(u.cluster_ranges(cores_used(s, p), ["uid", "node_index"], "core"),
                                 ["uid", "node_index"]),
    "SELECT DISTINCT uid, node_index, core AS idx FROM slots_v")


def indexed(rtype):
    return f"""used AS (SELECT uid, pid, node_index, core, nr.r0 + core AS idx FROM placed_v JOIN nr USING (pid, node_index)
  WHERE rtype = '{rtype}')"""


for _r in ("cpu", "gpu"):
    add(f"J4_resource_index_{_r}",
        lambda s, p, r=_r: u.resource_index(view(s, p, "placed_v"), pilots(s, p), view(s, p, "nodes_v"), r)
        .select("uid", "pid", "node_index", "core", "idx"),
        with_(NODES[_r], indexed(_r)) + "SELECT uid, pid, node_index, core, idx FROM used")

PROVIDED = """life AS (SELECT uid AS pid, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE e0 END AS t0,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE e1 END AS t1
  FROM (SELECT uid, min(time) FILTER (WHERE event = 'bootstrap_0_start') AS a,
    max(time) FILTER (WHERE event = 'bootstrap_0_stop') AS b, min(time) AS e0, max(time) AS e1
    FROM usage_trace_v WHERE starts_with(uid, 'pilot.') GROUP BY uid))"""
for _r in ("cpu", "gpu"):
    add(f"W1_provided_{_r}", lambda s, p, r=_r: u.provided(*no_slots(s, p), r),
        with_(NODES[_r], PROVIDED) + f"""SELECT '{_r}' AS rtype, 'total' AS metric, pid AS uid, pid, t0, t1, r0, r1
FROM nr JOIN life USING (pid)""")

_PSPEC = {"agent": PILOT_AGENT["total"], **{("sub_agent" if m == "agent" else m): b
                                            for m, b in PILOT_CONSUME.items() if m != "idle"}}


def durs(spec, name):
    """CTEs of `found` under other names, so that two specs fit in one query."""
    return (found(spec, "usage_trace_v").removeprefix("WITH ").replace("spec", f"spec_{name}")
            .replace("found", f"found_{name}").replace("dur AS", f"dur_{name} AS"))


PILOT = durs(_PSPEC, "p") + """,
pbox AS (SELECT 'cpu' AS rtype, metric, pid AS uid, pid, t0, t1, r0, r1 FROM nr JOIN dur_p ON dur_p.uid = nr.pid
  WHERE (metric = 'agent') = agent)"""
add("W2_pilot_boxes", lambda s, p: u.pilot_boxes(*no_slots(s, p)),
    with_(NODES["cpu"], PILOT) + f"SELECT {BOX} FROM pbox")

TASKS = durs(TASK, "t") + f""",
rng AS ({islands("used", "uid, pid")}),
tbox AS (SELECT 'cpu' AS rtype, metric, uid, pid, t0, t1, r0, r1 FROM rng JOIN dur_t USING (uid))"""
add("W3_task_boxes", lambda s, p: u.task_boxes(*parts(s, p)),
    with_(NODES["cpu"], indexed("cpu"), TASKS) + f"SELECT {BOX} FROM tbox")

WARM = f"""u0 AS (SELECT uid, min(time) FILTER (WHERE event = 'schedule_ok') AS a,
  max(time) FILTER (WHERE event = 'unschedule_stop') AS b FROM usage_trace_v GROUP BY uid),
use AS (SELECT pid, idx, min(a) AS t_min, max(b) AS t_max FROM used JOIN u0 USING (uid)
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
every AS (SELECT pid, unnest(range(r0, r1 + 1)) AS idx FROM nr WHERE NOT agent),
bound AS (SELECT pid, idx, t_min, t_max FROM every LEFT JOIN use USING (pid, idx)),
plife AS (SELECT uid AS pid, coalesce(min(time) FILTER (WHERE event = 'bootstrap_0_start'),
   min(time) FILTER (WHERE event = 'state' AND state = 'PMGR_ACTIVE')) AS p_min,
  coalesce(min(time) FILTER (WHERE event = 'bootstrap_0_stop'), max(time)) AS p_max
  FROM usage_trace_v WHERE starts_with(uid, 'pilot.') GROUP BY uid),
wbox AS (
SELECT 'warm' AS metric, pid, p_min AS t0, t_min AS t1, r0, r1 FROM (
  {islands("(SELECT * FROM bound WHERE t_min IS NOT NULL)", "pid, t_min")}) JOIN plife USING (pid)
UNION ALL SELECT 'drain', pid, t_max, p_max, r0, r1 FROM (
  {islands("(SELECT * FROM bound WHERE t_min IS NOT NULL)", "pid, t_max")}) JOIN plife USING (pid)
UNION ALL SELECT 'idle', pid, p_min, p_max, r0, r1 FROM (
  {islands("(SELECT * FROM bound WHERE t_min IS NULL)", "pid")}) JOIN plife USING (pid))"""
for _r in ("cpu", "gpu"):
    add(f"W5_warm_drain_idle_{_r}", lambda s, p, r=_r: u.warm_drain_idle(*parts(s, p), r),
        with_(NODES[_r], indexed(_r), WARM)
        + f"SELECT '{_r}' AS rtype, metric, pid AS uid, pid, t0, t1, r0, r1 FROM wbox")

CONSUMED = [NODES["cpu"], indexed("cpu"), PILOT, TASKS, WARM, f"""
box AS (SELECT {BOX} FROM pbox UNION ALL SELECT {BOX} FROM tbox
  UNION ALL SELECT 'cpu', metric, pid, pid, t0, t1, r0, r1 FROM wbox)"""]
add("W6_consumed", lambda s, p: u.consumed(*parts(s, p)), with_(*CONSUMED) + f"SELECT {BOX} FROM box")

add("W6_overlaps",
    lambda s, p: u.overlaps(u.task_boxes(*parts(s, p))).select(
        "pid", F.explode(F.sequence("r0", "r1")).alias("r"), "uid", "metric", "t0", "t1", "before"),
    with_(NODES["cpu"], indexed("cpu"), TASKS) + """, one AS (
  SELECT pid, unnest(range(r0, r1 + 1)) AS r, uid, metric, t0, t1 FROM tbox WHERE t1 > t0),
o AS (SELECT *, max(t1) OVER (PARTITION BY pid, r ORDER BY t0, t1, metric, uid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM one)
SELECT pid, r, uid, metric, t0, t1, before FROM o WHERE t0 < before""")

# over everything consumed: maximal ranges on which a box starts before an earlier one has ended
OVERLAPS = """one AS (
  SELECT pid, unnest(range(r0, r1 + 1)) AS r, uid, metric, t0, t1 FROM box WHERE t1 > t0),
o AS (SELECT *, max(t1) OVER (PARTITION BY pid, r ORDER BY t0, t1, metric, uid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM one)"""
_OVER = "pid, metric, uid, t0, t1, before"
add("W6_overlaps_consumed",
    lambda s, p: u.overlaps(u.consumed(*parts(s, p))).select(*_OVER.split(", "), "r0", "r1"),
    with_(*CONSUMED, OVERLAPS) + islands("(SELECT * FROM o WHERE t0 < before)", _OVER, "r"))


# whose time it is, written down by hand for the other engine
ORDER = ["exec_queue", "exec_prep", "exec_rp", "exec_sh", "exec_cmd", "term_sh", "term_rp", "unschedule",
         "agent", "sub_agent", "boot", "setup_1", "term", "warm", "drain", "idle"]


def attributed(boxes):
    """CTEs that sweep the boxes of a table resource by resource: `used` time per pilot and metric."""
    n = len(ORDER)
    place = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ORDER)) + f" ELSE {n} END"
    sums = ", ".join(f"sum(d) FILTER (place = {i}) AS m{i}" for i in range(-1, n + 1)).replace("m-1", "given")
    levels = ", ".join(f"coalesce(sum({m}) OVER w, 0) AS {m}" for m in ["given", *[f"m{i}" for i in range(n + 1)]])
    first = "CASE " + " ".join(f"WHEN m{i} > 0 THEN '{m}'" for i, m in enumerate([*ORDER, "other"])) + " ELSE 'unused' END"
    return f"""lain AS (SELECT pid, unnest(range(r0, r1 + 1)) AS r, t0, t1, {place} AS place FROM {boxes} WHERE t1 > t0
  UNION ALL SELECT pid, unnest(range(r0, r1 + 1)), t0, t1, -1 FROM nr JOIN life USING (pid) WHERE t1 > t0),
moved AS (SELECT pid, r, t0 AS time, place, 1 AS d FROM lain UNION ALL SELECT pid, r, t1, place, -1 FROM lain),
summed AS (SELECT pid, r, time, {sums} FROM moved GROUP BY pid, r, time),
level AS (SELECT pid, r, time, lead(time) OVER w - time AS dt, {levels} FROM summed WINDOW w AS (PARTITION BY pid, r ORDER BY time)),
spent AS (SELECT pid, {first} AS metric, sum(dt) AS used FROM level WHERE given > 0 AND dt IS NOT NULL GROUP BY 1, 2),
gave AS (SELECT pid, sum(used) AS given FROM spent GROUP BY pid)"""


add("A9_attribution",
    lambda s, p: u.attribution(u.consumed(*parts(s, p)), u.provided(*no_slots(s, p)))
    .select("pid", "metric", "used", "given", F.round("share", 8).alias("share")),
    with_(*CONSUMED, PROVIDED, attributed("box"))
    + "SELECT pid, metric, used, given, round(used / given, 8) AS share FROM spent JOIN gave USING (pid)")


def _checked(boxes, total):
    return u.share_check(u.attribution(boxes, total)).select("pid", F.round("total", 6).alias("total"), "whole")


_WHOLE = """SELECT pid, round(coalesce(sum(used) FILTER (metric <> 'unused'), 0) / any_value(given), 6) AS total,
  abs(coalesce(sum(used) FILTER (metric <> 'unused'), 0) / any_value(given) - 1) <= 1e-6 AS whole
FROM spent JOIN gave USING (pid) GROUP BY pid"""
add("A9_share_consumed", lambda s, p: _checked(u.consumed(*parts(s, p)), u.provided(*no_slots(s, p))),
    with_(*CONSUMED, PROVIDED, attributed("box")) + _WHOLE)


def filled(s, p):
    """Pilots whose resources are in use from their first to their last task; every other
    pilot lacks what comes after."""
    pilots_, nodes, slots, events = parts(s, p)
    at = lambda name: F.when(F.col("event") == name, F.col("time"))
    life = events.groupBy("uid").agg(F.min(at("schedule_ok")).alias("t0"), F.max(at("unschedule_stop")).alias("t1"))
    busy = (u.resource_index(slots, pilots_, nodes, "cpu").join(nodes.filter("not agent"), ["pid", "node_index"])
            .join(life.filter("t0 is not null and t1 is not null"), "uid")
            .groupBy("pid", "idx").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
            .select(F.lit("cpu").alias("rtype"), F.lit("exec_cmd").alias("metric"), F.col("pid").alias("uid"), "pid",
                    "t0", "t1", F.col("idx").alias("r0"), F.col("idx").alias("r1")))
    rest = u.warm_drain_idle(*parts(s, p)).filter("metric <> 'drain' or CAST(right(pid, 4) AS INT) % 2 = 0")
    return u.pilot_boxes(*no_slots(s, p)).filter("metric = 'agent'").unionByName(rest).unionByName(busy)


add("A9_share_filled", lambda s, p: _checked(filled(s, p), u.provided(*no_slots(s, p))),
    with_(NODES["cpu"], indexed("cpu"), PILOT, WARM, PROVIDED, f"""fbox AS (SELECT metric, pid, t0, t1, r0, r1 FROM pbox WHERE metric = 'agent'
  UNION ALL SELECT metric, pid, t0, t1, r0, r1 FROM wbox WHERE metric <> 'drain' OR CAST(right(pid, 4) AS INT) % 2 = 0
  UNION ALL SELECT 'exec_cmd', pid, t_min, t_max, idx, idx FROM bound WHERE t_min IS NOT NULL)""", attributed("fbox")) + _WHOLE)

add("A9_core_time",
    lambda s, p: u.core_time(u.consumed(*parts(s, p)), u.provided(*no_slots(s, p)))
    .select("pid", "metric", "used", "given", F.round("share", 8).alias("share")),
    with_(*CONSUMED, PROVIDED) + """, g AS (SELECT pid, sum((t1 - t0) * (r1 - r0 + 1)) AS given
  FROM nr JOIN life USING (pid) GROUP BY pid),
x AS (SELECT pid, metric, sum((t1 - t0) * (r1 - r0 + 1)) AS used FROM box GROUP BY 1, 2)
SELECT pid, metric, used, given, round(used / given, 8) AS share FROM x JOIN g USING (pid)""")

# warm, drain and idle of one resource never exceed what its pilot gave
add("A9_share_check",
    lambda s, p: u.share_check(u.core_time(
        u.warm_drain_idle(*parts(s, p)), u.provided(*no_slots(s, p))))
    .select("pid", F.round("total", 6).alias("total"), "whole"),
    with_(NODES["cpu"], indexed("cpu"), WARM, PROVIDED) + """,
g AS (SELECT pid, sum((t1 - t0) * (r1 - r0 + 1)) AS given FROM nr JOIN life USING (pid) GROUP BY pid),
x AS (SELECT pid, sum((t1 - t0) * (r1 - r0 + 1)) AS used FROM wbox GROUP BY 1)
SELECT pid, round(used / given, 6) AS total, abs(used / given - 1) <= 1e-6 AS whole FROM x JOIN g USING (pid)""")


# transitions, written down by hand for the other engine
TRANS = [("schedule_ok", None, "idle", "exec_queue"),
         ("state", "AGENT_EXECUTING", "exec_queue", "exec_prep"),
         ("task_run_start", None, "exec_prep", "exec_rp"), ("launch_start", None, "exec_rp", "exec_sh"),
         ("exec_start", None, "exec_sh", "exec_cmd"), ("exec_stop", None, "exec_cmd", "term_sh"),
         ("launch_stop", None, "term_sh", "term_rp"), ("task_run_stop", None, "term_rp", "unschedule"),
         ("unschedule_stop", None, "unschedule", "idle")]
PTRANS = [("bootstrap_0_start", None, None, "system", "boot"), ("bootstrap_0_ok", None, None, "boot", "setup_1"),
          ("state", "PMGR_ACTIVE", None, "setup_1", "idle"), ("cmd", None, "cancel_pilot", "idle", "term"),
          ("bootstrap_0_stop", None, None, "term", "system"),
          ("sub_agent_start", None, None, "setup_1", "agent"), ("sub_agent_stop", None, None, "agent", "term")]


def values(rows):
    return ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows)


def _seen(s, p, table):
    e = view(s, p, "usage_trace_v")
    t = table.withColumnsRenamed({"event": "e", "state": "st", "msg": "m"})
    on = (e.event == t.e) & (t.st.isNull() | (e.state == t.st)) \
        & (t.m.isNull() | specs.message_matches(e.event, e.msg, t.m))
    return e.join(t, on).groupBy("event", "source", "target").agg(F.count(F.lit(1)).alias("n"))


add("W7_transitions", lambda s, p: _seen(s, p, specs.transitions(s, "task")),
    f"""WITH tr(event, state, source, target) AS (VALUES {values(TRANS)})
SELECT event, source, target, count(*) AS n FROM usage_trace_v e JOIN tr USING (event)
WHERE tr.state IS NULL OR tr.state = e.state GROUP BY 1, 2, 3""")
add("W7_pilot_transitions", lambda s, p: _seen(s, p, specs.pilot_transitions(s)),
    f"""WITH tr(event, state, msg, source, target) AS (VALUES {values(PTRANS)})
SELECT event, source, target, count(*) AS n FROM usage_trace_v e JOIN tr USING (event)
WHERE (tr.state IS NULL OR tr.state = e.state) AND (tr.msg IS NULL OR starts_with(e.msg, tr.msg || ' ')) GROUP BY 1, 2, 3""")

add("W8_usage_timeline",
    lambda s, p: u.usage_timeline(
        view(s, p, "usage_trace_v"),
        view(s, p, "tasks_v").select("uid", "pilot", (F.col("ranks") * F.col("cores_per_rank")).alias("amount")),
        specs.transition_rows("task")),
    f"""WITH tr(event, state, source, target) AS (VALUES {values(TRANS)}),
h AS (SELECT t.pilot AS pid, e.time, tr.source, tr.target, t.ranks * t.cores_per_rank AS n
  FROM usage_trace_v e JOIN tr ON tr.event = e.event AND (tr.state IS NULL OR tr.state = e.state)
  JOIN tasks_v t ON t.uid = e.uid),
c AS (SELECT pid, metric, time, sum(n) AS n FROM (SELECT pid, source AS metric, time, -n AS n FROM h
  UNION ALL SELECT pid, target, time, n FROM h) GROUP BY 1, 2, 3)
SELECT pid, metric, time, CAST(sum(n) OVER (PARTITION BY pid, metric ORDER BY time) AS BIGINT) AS amount FROM c""")

add("W9_task_timelines",
    lambda s, p: u.task_timelines(view(s, p, "usage_trace_v"),
                                  view(s, p, "tasks_v").withColumn("placed", F.expr("priority > 1"))),
    f"""WITH {spec_values("task")}, metrics AS (SELECT DISTINCT metric FROM spec),
t AS (SELECT DISTINCT e.uid FROM usage_trace_v e JOIN tasks_v USING (uid) WHERE priority > 1),
f AS (SELECT e.uid, s.metric, min(time) FILTER (WHERE side = 'start') AS t0, max(time) FILTER (WHERE side = 'stop') AS t1
  FROM usage_trace_v e JOIN spec s ON s.event = e.event AND (s.state IS NULL OR s.state = e.state) GROUP BY 1, 2)
SELECT uid, metric, t0, t1 FROM t CROSS JOIN metrics LEFT JOIN f USING (uid, metric)""")


def uses(s, p):
    slots = slots_in_place(s, p).join(view(s, p, "tasks_v").select("uid", "pilot", "priority"), "uid")
    return slots.select(
        F.col("pilot").alias("pid"), "node_index", F.lit("core").alias("kind"), F.col("core").alias("idx"),
        F.when(F.col("priority") < 3, 1.0).otherwise(0.5).alias("amount"), "t0", "t1")


def capacity(s, p):
    return view(s, p, "nodes_v").filter("NOT (node_index = 6 AND pid > 'pilot.0020')").select(
        "pid", "node_index", F.lit("core").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx")) \
        .withColumn("capacity", F.when((F.col("idx") != 5) | (F.col("node_index") != 3), 1.0))


add("W10_occupancy_audit", lambda s, p: u.occupancy_audit(uses(s, p), capacity(s, p)),
    """WITH uses AS (SELECT pilot AS pid, node_index, core AS idx, CASE WHEN priority < 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS amount,
  t0, t1 FROM slots_v JOIN tasks_v USING (uid)),
c AS (SELECT pid, node_index, idx, time, sum(d) AS change FROM (SELECT pid, node_index, idx, t0 AS time, amount AS d FROM uses
  UNION ALL SELECT pid, node_index, idx, t1, -amount FROM uses) GROUP BY 1, 2, 3, 4),
l AS (SELECT *, sum(change) OVER (PARTITION BY pid, node_index, idx ORDER BY time) AS level FROM c),
r AS (SELECT *, CASE WHEN node_index = 6 AND pid > 'pilot.0020' THEN 'unknown'
  WHEN idx = 5 AND node_index = 3 THEN 'down' WHEN level > 1 THEN 'over' END AS reason FROM l)
SELECT pid, node_index, 'core' AS kind, idx, time, level, reason FROM r
WHERE reason = 'over' OR (reason IS NOT NULL AND change > 0)""")



# all kinds of resources: cores, gpus, and file space and memory of a node
def all_uses(s, p):
    rows = slots_in_place(s, p).join(view(s, p, "tasks_v").select("uid", "pilot", "priority", "gpus_per_rank", "ranks"), "uid")
    kind = lambda name, idx, amount: F.struct(F.lit(name).alias("kind"), idx.cast("int").alias("idx"), amount.cast("double").alias("amount"))
    parts_ = F.array(kind("core", F.col("core"), F.when(F.col("priority") < 3, 1.0).otherwise(0.5)),
                     kind("gpu", F.col("core") % 2, F.col("gpus_per_rank") / 2),
                     kind("lfs", F.lit(0), F.col("ranks") * 100), kind("mem", F.lit(0), F.col("priority") * 16))
    return rows.select(F.col("pilot").alias("pid"), "node_index", F.explode(parts_).alias("u"), "t0", "t1") \
        .select("pid", "node_index", "u.*", "t0", "t1").filter("amount > 0")


def all_capacity(s, p):
    nodes = view(s, p, "nodes_v").select("pid", "node_index")
    gpu = nodes.select("*", F.lit("gpu").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("idx")) \
        .withColumn("capacity", F.when((F.col("idx") != 1) | (F.col("node_index") != 2), 1.0))
    pool = lambda name, size: nodes.select("*", F.lit(name).alias("kind"), F.lit(0).alias("idx"), size.alias("capacity"))
    return capacity(s, p).unionByName(gpu).unionByName(pool("lfs", F.lit(500.0))).unionByName(
        pool("mem", F.when(F.col("node_index") == 4, 32.0).otherwise(64.0)).filter("NOT (node_index = 5 AND pid < 'pilot.0003')"))


_KINDS = """SELECT pilot AS pid, node_index, 'core' AS kind, core AS idx, CASE WHEN priority < 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS amount, t0, t1 FROM j
  UNION ALL SELECT pilot, node_index, 'gpu', core % 2, gpus_per_rank / 2, t0, t1 FROM j WHERE gpus_per_rank > 0
  UNION ALL SELECT pilot, node_index, 'lfs', 0, ranks * 100, t0, t1 FROM j
  UNION ALL SELECT pilot, node_index, 'mem', 0, priority * 16, t0, t1 FROM j"""
add("W10_all_resources", lambda s, p: u.occupancy_audit(all_uses(s, p), all_capacity(s, p)),
    f"""WITH j AS (SELECT * FROM slots_v JOIN (SELECT uid, pilot, priority, gpus_per_rank, ranks FROM tasks_v) USING (uid)),
uses AS ({_KINDS}),
c AS (SELECT pid, node_index, kind, idx, time, sum(d) AS change FROM (SELECT pid, node_index, kind, idx, t0 AS time, amount AS d FROM uses
  UNION ALL SELECT pid, node_index, kind, idx, t1, -amount FROM uses) GROUP BY ALL),
l AS (SELECT *, sum(change) OVER (PARTITION BY pid, node_index, kind, idx ORDER BY time) AS level FROM c),
r AS (SELECT *, CASE WHEN kind = 'core' AND node_index = 6 AND pid > 'pilot.0020' OR kind = 'mem' AND node_index = 5 AND pid < 'pilot.0003'
    THEN 'unknown' WHEN kind = 'core' AND idx = 5 AND node_index = 3 OR kind = 'gpu' AND idx = 1 AND node_index = 2 THEN 'down'
  WHEN level > CASE kind WHEN 'lfs' THEN 500 WHEN 'mem' THEN CASE WHEN node_index = 4 THEN 32 ELSE 64 END ELSE 1 END THEN 'over' END AS reason
  FROM l)
SELECT pid, node_index, kind, idx, time, level, reason FROM r WHERE reason = 'over' OR (reason IS NOT NULL AND change > 0)""")

add("J10_ranges_by_durations",
    lambda s, p: u.task_boxes(*parts(s, p), "gpu", {"run": (E("exec_start"), E("exec_stop"))})
    .groupBy("pid", "metric").agg(F.count(F.lit(1)).alias("boxes"), F.sum(F.expr("r1 - r0 + 1")).alias("units")),
    with_(NODES["gpu"], indexed("gpu"), durs({"run": (E("exec_start"), E("exec_stop"))}, "t"),
          f"rng AS ({islands('used', 'uid, pid')})")
    + """SELECT pid, metric, count(*) AS boxes, CAST(sum(r1 - r0 + 1) AS BIGINT) AS units
FROM rng JOIN dur_t USING (uid) GROUP BY 1, 2""")

add("J1_task_pilot",
    lambda s, p: view(s, p, "tasks_v").join(view(s, p, "pilots_v").select(
        F.col("uid").alias("pilot"), "resource"), "pilot").groupBy("resource").agg(F.count(F.lit(1)).alias("n")),
    "SELECT resource, count(*) AS n FROM tasks_v t JOIN pilots_v p ON p.uid = t.pilot GROUP BY 1")


# ---- two sessions with the same ids, the second 1000 s later ---------------
LATER = 1000


def in_two(df, *times):
    """Each row in session s0, and in s1 with its times moved."""
    both = df.withColumn("sid", F.explode(F.array(F.lit("s0"), F.lit("s1"))))
    return both.withColumns({t: F.col(t) + F.when(F.col("sid") == "s1", LATER).otherwise(0) for t in times})


def in_two_sql(oracle, columns, times):
    """The rows of a query for one session, once more for the later one."""
    late = ", ".join(f"{c} + {LATER} AS {c}" if c in times else c for c in columns)
    return f"WITH one AS ({oracle}) SELECT 's0' AS sid, {', '.join(columns)} FROM one UNION ALL SELECT 's1', {late} FROM one"


def two_parts(s, p):
    a, b, c, d = parts(s, p)
    return in_two(a), in_two(b), in_two(c), in_two(d, "time")


def two_without_slots(s, p):
    a, b, _, d = two_parts(s, p)
    return a, b, d


_BOX = BOX.split(", ")
add("W1_provided_sessions", lambda s, p: u.provided(*two_without_slots(s, p)),
    in_two_sql(ORACLES["W1_provided_cpu"], _BOX, ("t0", "t1")))
add("W6_consumed_sessions", lambda s, p: u.consumed(*two_parts(s, p)),
    in_two_sql(ORACLES["W6_consumed"], _BOX, ("t0", "t1")))
add("W6_overlaps_sessions",
    lambda s, p: u.overlaps(u.consumed(*two_parts(s, p))).select("sid", *_OVER.split(", "), "r0", "r1"),
    in_two_sql(ORACLES["W6_overlaps_consumed"], [*_OVER.split(", "), "r0", "r1"], ("t0", "t1", "before")))
add("A9_attribution_sessions",
    lambda s, p: u.attribution(u.consumed(*two_parts(s, p)), u.provided(*two_without_slots(s, p)))
    .select("sid", "pid", "metric", F.round("share", 5).alias("share")),
    in_two_sql(ORACLES["A9_attribution"], ["pid", "metric", "round(share, 5) AS share"], ()))
add("A9_core_time_sessions",
    lambda s, p: u.core_time(u.consumed(*two_parts(s, p)), u.provided(*two_without_slots(s, p)))
    .select("sid", "pid", "metric", F.round("share", 5).alias("share")),
    in_two_sql(ORACLES["A9_core_time"], ["pid", "metric", "round(share, 5) AS share"], ()))
add("W8_usage_timeline_sessions",
    lambda s, p: u.usage_timeline(
        in_two(view(s, p, "usage_trace_v"), "time"),
        in_two(view(s, p, "tasks_v").select("uid", "pilot", (F.col("ranks") * F.col("cores_per_rank")).alias("amount"))),
        specs.transition_rows("task")),
    in_two_sql(ORACLES["W8_usage_timeline"], ["pid", "metric", "time", "amount"], ("time",)))
add("W9_task_timelines_sessions",
    lambda s, p: u.task_timelines(in_two(view(s, p, "usage_trace_v"), "time"),
                                  in_two(view(s, p, "tasks_v").withColumn("placed", F.expr("priority > 1")))),
    in_two_sql(ORACLES["W9_task_timelines"], ["uid", "metric", "t0", "t1"], ("t0", "t1")))
add("W10_occupancy_audit_sessions",
    lambda s, p: u.occupancy_audit(in_two(uses(s, p), "t0", "t1"), in_two(capacity(s, p))),
    in_two_sql(ORACLES["W10_occupancy_audit"], ["pid", "node_index", "kind", "idx", "time", "level", "reason"], ("time",)))
