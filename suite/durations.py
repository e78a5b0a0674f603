"""Durations and the statistics on them."""

from pyspark.sql import functions as F

from suite.views import sql, table, view
from taskscope.operators import durations as d
from taskscope.plans import spec as specs
from taskscope.plans.presets import PILOT_DEBUG, PRESETS, TASK_DEBUG, E, S, EM

QUERIES, ORACLES = {}, {}

SMALL = {"queue": (E("schedule_ok"), E("exec_start")),
         "run": (E("exec_start"), E("exec_stop")),
         "total": (E("schedule_ok"), [S("DONE"), S("FAILED")])}


def text(value):
    return "NULL" if value is None else f"'{value}'"


def spec_values(spec):
    rows = ", ".join(f"({text(m)}, {text(side)}, {text(e)}, {text(s)}, {text(g)})"
                     for m, side, _, e, s, g in specs.spec_rows(spec))
    return f"spec(metric, side, event, state, msg) AS (VALUES {rows})"


def found(spec, trace, where="TRUE"):
    """SQL: first start and last stop per uid and metric, by joining the spec."""
    return f"""WITH {spec_values(spec)},
found AS (
  SELECT t.uid, s.metric, min(t.time) FILTER (WHERE s.side = 'start') AS t0,
         max(t.time) FILTER (WHERE s.side = 'stop') AS t1
  FROM {trace} t JOIN spec s ON s.event = t.event
   AND (s.state IS NULL OR s.state = t.state)
   AND (s.msg IS NULL OR s.msg = t.msg OR (t.event = 'cmd' AND starts_with(t.msg, s.msg || ' ')))
  WHERE {where}
  GROUP BY 1, 2),
dur AS (SELECT uid, metric, t0, t1, t1 - t0 AS dur FROM found WHERE t0 IS NOT NULL AND t1 IS NOT NULL)"""


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


def _shown(df):
    return df.select("uid", "metric", "t0", "t1", "dur")


add("A1_duration", lambda s, p: _shown(d.durations(view(s, p, "trace_v"), SMALL)),
    found(SMALL, "trace_v") + "SELECT uid, metric, t0, t1, dur FROM dur")

add("A1_duration_stats",
    lambda s, p: d.duration_stats(d.durations(view(s, p, "trace_v"), SMALL)).select(
        "metric", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        "least", "most"),
    found(SMALL, "trace_v") + """
SELECT metric, count(*) AS n, round(avg(dur), 4) AS mean, round(stddev_pop(dur), 4) AS std,
       min(dur) AS least, max(dur) AS most FROM dur GROUP BY metric""")

for _id, _preset, _trace in [
        ("A2a_pilot", "pilot", "pilot_trace_v"), ("A2b_task", "task", "task_trace_v"),
        ("A2c_task_app", "task_app", "task_trace_v"),
        ("A2d_pilot_debug", "pilot_debug", "pilot_trace_v"),
        ("A2e_task_debug", "task_debug", "task_trace_v")]:
    add(_id, lambda s, p, preset=_preset, trace=_trace: _shown(d.durations(view(s, p, trace), preset)),
        found(_preset, _trace) + "SELECT uid, metric, t0, t1, dur FROM dur")

# time per tag; for the other engine the tags follow from the names of the metrics
for _id, _preset, _trace, _tags in [
        ("A2d_time_by_tag", "pilot_debug", "pilot_trace_v", """CASE WHEN metric = 'p_agent_runtime' THEN ['provide', 'agent']
  WHEN starts_with(metric, 'p_pmgr_') OR metric = 'p_agent_finalize' THEN ['client'] ELSE ['consume'] END"""),
        ("A2e_time_by_tag", "task_debug", "task_trace_v", """CASE WHEN starts_with(metric, 't_tmgr_')
  OR metric = 't_agent_unschedule' THEN ['client'] ELSE ['consume'] END""")]:
    add(_id, lambda s, p, preset=_preset, trace=_trace: d.time_by_tag(
            d.durations(view(s, p, trace), preset).filter("metric <> 'total'"), preset).select("tag", "n", F.round("total", 1).alias("total")),
        found(_preset, _trace) + f""", tagged AS (SELECT dur, unnest({_tags}) AS tag FROM dur WHERE metric <> 'total')
SELECT tag, count(*) AS n, round(sum(dur), 1) AS total FROM tagged GROUP BY tag""")

# a preset of the user's, in the short form, with "any of" boundaries
USER = {"wait": [{"EVENT": "schedule_ok"}, [{"EVENT": "exec_start"}, {"EVENT": "launch_start"}]],
        "all": [{"STATE": "NEW"}, [{"STATE": "DONE"}, {"STATE": "FAILED"}]],
        "note": [{"EVENT": "schedule_ok"}, {"EVENT": "bootstrap_note", "MSG": "a, b"}]}
add("A2f_user_preset", lambda s, p: _shown(d.durations(view(s, p, "task_trace_v"), USER)),
    found(USER, "task_trace_v") + "SELECT uid, metric, t0, t1, dur FROM dur")

add("J3_spec_table",
    lambda s, p: _shown(d.durations_by_table(view(s, p, "task_trace_v"), specs.spec_table(s, "task_app"))),
    found("task_app", "task_trace_v") + "SELECT uid, metric, t0, t1, dur FROM dur")

# expansion of the short form shows in what the trace rows match
add("P5_expand_spec",
    lambda s, p: (view(s, p, "pilot_trace_v").select(F.explode(F.array(*[
        F.when(specs.matches([m]), F.lit(f"{metric}/{side}/{alt}"))
        for metric, sides in specs.expand_spec("pilot_debug").items()
        for side, alts in zip(("start", "stop"), sides) for alt, m in enumerate(alts)])).alias("boundary"))
        .filter("boundary is not null").groupBy("boundary").agg(F.count(F.lit(1)).alias("n"))),
    f"""WITH spec(boundary, event, state, msg) AS (VALUES {", ".join(
        f"('{m}/{side}/{alt}', {text(e)}, {text(st)}, {text(g)})"
        for m, side, alt, e, st, g in specs.spec_rows("pilot_debug"))})
SELECT s.boundary, count(*) AS n FROM pilot_trace_v t JOIN spec s ON s.event = t.event
 AND (s.state IS NULL OR s.state = t.state) AND (s.msg IS NULL OR s.msg = t.msg) GROUP BY 1""")

add("P4_timestamps",
    lambda s, p: d.timestamps(view(s, p, "trace_v"), E("exec_start"), S("FAILED")).select("uid", "n", "time"),
    """SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY time) AS n, time FROM trace_v
WHERE event = 'exec_start' OR (event = 'state' AND state = 'FAILED')""")

add("L1_event_order",
    lambda s, p: d.timestamps(view(s, p, "trace_v"), E("schedule_ok"), E("exec_start"), E("exec_stop"), E("state"))
    .groupBy("uid").agg(F.max_by("time", "n").alias("last"), F.min_by("time", "n").alias("first"),
                        F.max("n").alias("n")),
    "SELECT uid, max(time) AS last, min(time) AS first, count(*) AS n FROM trace_v GROUP BY uid")


def state_starts(preset):
    """Metric -> state, for metrics that start with a state."""
    return {m: v[0]["STATE"] for m, v in preset.items() if isinstance(v[0], dict) and "STATE" in v[0]}


def _starts(preset):
    return "starts(metric, state) AS (VALUES " + ", ".join(
        f"('{m}', '{st}')" for m, st in state_starts(preset).items()) + ")"


add("A3_pilot_states",
    lambda s, p: d.pilot_state_durations(view(s, p, "pilot_trace_v")).select("uid", "state", "metric", "dur"),
    found(PILOT_DEBUG, "pilot_trace_v") + f""", {_starts(PILOT_DEBUG)}
SELECT uid, starts.state, metric, dur FROM dur JOIN starts USING (metric)""")

_TASK_OF_PILOT = """SELECT concat('task.', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')) AS uid,
 concat('pilot.', CAST(c_nationkey AS VARCHAR(20))) AS pilot FROM customer"""

def two_sessions(events):
    """The same uids in a second session."""
    return events.unionByName(events.withColumn("sid", F.lit("s1")))


add("A4_task_state_stats",
    lambda s, p: d.task_state_stats(
        view(s, p, "task_trace_v"),
        table(s, p, "customer").select(
            F.concat(F.lit("task."), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("uid"),
            F.concat(F.lit("pilot."), F.col("c_nationkey").cast("string")).alias("pilot")))
    .select("pilot", "state", "n", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std")),
    found(TASK_DEBUG, "task_trace_v") + f""", {_starts(TASK_DEBUG)}, tasks AS ({_TASK_OF_PILOT})
SELECT pilot, starts.state, count(*) AS n, round(avg(dur), 4) AS mean, round(stddev_pop(dur), 3) AS std
FROM dur JOIN starts USING (metric) JOIN tasks USING (uid) GROUP BY 1, 2""")

# the second session has the tasks of every second customer, on the same pilots
add("A4_task_state_stats_sessions",
    lambda s, p: d.task_state_stats(
        two_sessions(view(s, p, "task_trace_v")),
        table(s, p, "customer").select(
            F.concat(F.lit("task."), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("uid"),
            F.concat(F.lit("pilot."), F.col("c_nationkey").cast("string")).alias("pilot"),
            F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("s0"), F.lit("s1"))).otherwise(F.array(F.lit("s0")))).alias("sid")))
    .select("sid", "pilot", "state", "n", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std")),
    found(TASK_DEBUG, "task_trace_v") + f""", {_starts(TASK_DEBUG)}, tasks AS ({_TASK_OF_PILOT}),
two AS (SELECT 's0' AS sid, * FROM tasks UNION ALL SELECT 's1', * FROM tasks WHERE CAST(substr(uid, 6) AS BIGINT) % 2 = 0)
SELECT two.sid, pilot, starts.state, count(*) AS n, round(avg(dur), 4) AS mean, round(stddev_pop(dur), 3) AS std
FROM dur JOIN starts USING (metric) JOIN two USING (uid) GROUP BY 1, 2, 3""")

# all tasks and pilots of one session
_BOTH = "(SELECT * FROM task_trace_v UNION ALL SELECT * FROM pilot_trace_v)"
add("A5_session_timing",
    lambda s, p: d.session_timing(view(s, p, "task_trace_v").unionByName(view(s, p, "pilot_trace_v"))),
    f"""WITH e AS (SELECT * FROM {_BOTH} WHERE event = 'state'),
x AS (SELECT sid, uid, min(time) AS x FROM e WHERE state = 'AGENT_EXECUTING' GROUP BY 1, 2),
f AS (SELECT sid, uid, min(time) AS f FROM e WHERE state IN ('DONE', 'FAILED', 'CANCELED')
      AND starts_with(uid, 'task.') GROUP BY 1, 2),
n AS (SELECT sid, min(time) AS t_0 FROM e WHERE state = 'NEW' AND starts_with(uid, 'pilot.') GROUP BY 1)
SELECT sid, t_0, min(x) - t_0 AS t_h, (SELECT max(f) FROM f) - min(x) AS t_x, max(x) - min(x) AS t_xy
FROM n JOIN x USING (sid) GROUP BY sid, t_0""")
