"""State models."""

from pyspark.sql import functions as F

from suite.views import sql, view
from taskscope import schema
from taskscope.operators import state as m

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


def dim(model):
    rows = ", ".join(f"('{s}', {v}, {'true' if s in schema.FINAL else 'false'})"
                     for s, v in schema.state_values(model).items())
    return f"dim(state, value, final) AS (VALUES {rows})"


add("M1_state_dim",
    lambda s, p: view(s, p, "updates_v").join(m.state_dim(s).filter("model = 'task'"), "state")
    .groupBy("state", "value", "is_final").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {dim('task')} SELECT state, value, final AS is_final, count(*) AS n
FROM updates_v JOIN dim USING (state) GROUP BY 1, 2, 3""")


def change_text(df):
    return df.select("uid", "seq", "state", F.concat_ws(",", "passed").alias("passed"))


# accepted changes of tasks: a running maximum with the rule for finals on top
def task_progress(replay):
    between = f"""(SELECT coalesce(string_agg(d.state, ',' ORDER BY d.value), '') FROM dim d
      WHERE NOT d.final AND d.value > r.top AND d.value < r.value)"""
    if not replay:
        between = f"CASE WHEN state IN ('FAILED', 'CANCELED') THEN '' ELSE {between} END"
    return f"""WITH {dim('task')},
r AS (SELECT uid, seq, u.state, dim.value, dim.final,
        coalesce(max(dim.value) OVER w, -1) AS top,
        coalesce(max(CASE WHEN u.state IN ('DONE', 'FAILED') THEN 1 ELSE 0 END) OVER w, 0) AS settled
      FROM updates_v u JOIN dim ON dim.state = u.state
      WINDOW w AS (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT uid, seq, state, value > top AS fresh, {between} AS mid FROM r
      WHERE value > top OR (top = 15 AND settled = 0 AND state IN ('DONE', 'FAILED')))
SELECT uid, seq, state, CASE WHEN NOT fresh THEN '' WHEN mid = '' THEN state
   ELSE mid || ',' || state END AS passed FROM c"""


add("M2_progress_task", lambda s, p: change_text(m.progress(view(s, p, "updates_v"))), task_progress(True))
add("M5_last_state_only",
    lambda s, p: change_text(m.progress(view(s, p, "updates_v"), replay_final=False)),
    task_progress(False))

add("M2_rejected",
    lambda s, p: m.rejected(view(s, p, "updates_v")).select("uid", "seq", "state", "reason"),
    """WITH k AS (SELECT uid, min(seq) AS since, arg_min(state, seq) AS kept FROM updates_v
  WHERE state IN ('DONE', 'FAILED') GROUP BY 1)
SELECT uid, seq, state, concat('invalid transition: ', kept, ' -> ', state) AS reason
FROM updates_v JOIN k USING (uid) WHERE state IN ('DONE', 'FAILED', 'CANCELED') AND seq > since AND state <> kept""")

add("M3_progress_pilot",
    lambda s, p: change_text(m.progress(view(s, p, "pilot_updates_v"), "pilot")),
    f"""WITH {dim('pilot')},
r AS (SELECT uid, seq, u.state, dim.value, dim.final,
        coalesce(max(dim.value) OVER w, -1) AS top,
        coalesce(max(CASE WHEN u.state = 'DONE' THEN 1 ELSE 0 END) OVER w, 0) AS settled,
        last_value(CASE WHEN dim.final THEN u.state END IGNORE NULLS) OVER w AS prev
      FROM pilot_updates_v u JOIN dim ON dim.state = u.state
      WINDOW w AS (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT uid, seq, state, value > top AS fresh,
        (SELECT coalesce(string_agg(d.state, ',' ORDER BY d.value), '') FROM dim d
         WHERE NOT d.final AND d.value > r.top AND d.value < r.value) AS mid FROM r
      WHERE value > top OR (final AND top = 5 AND settled = 0 AND state <> prev))
SELECT uid, seq, state, CASE WHEN NOT fresh THEN '' WHEN mid = '' THEN state
   ELSE mid || ',' || state END AS passed FROM c""")


def collapsed(model, source):
    return f"""WITH {dim(model)}
SELECT uid, CASE WHEN bool_or(state = 'DONE') THEN 'DONE' WHEN bool_or(state = 'FAILED') THEN 'FAILED'
  WHEN bool_or(state = 'CANCELED') THEN 'CANCELED' ELSE arg_max(state, value) END AS state
FROM {source} JOIN dim USING (state) GROUP BY uid"""


add("M4_collapse", lambda s, p: m.collapse(view(s, p, "updates_v")), collapsed("task", "updates_v"))
add("M4_collapse_pilot", lambda s, p: m.collapse(view(s, p, "pilot_updates_v"), "pilot"),
    collapsed("pilot", "pilot_updates_v"))

add("M6_transition_check",
    lambda s, p: m.check_transitions(view(s, p, "steps_v")),
    f"""WITH {dim('task')},
r AS (SELECT uid, seq, steps_v.state, value, lag(steps_v.state) OVER w AS before, lag(value) OVER w AS old
      FROM steps_v JOIN dim USING (state) WINDOW w AS (PARTITION BY uid ORDER BY seq)),
v AS (SELECT *, CASE WHEN before IN ('DONE', 'FAILED') THEN 'frozen'
        WHEN before = 'CANCELED' AND state <> 'DONE' THEN 'cancelled' WHEN before = 'CANCELED' THEN NULL
        WHEN state NOT IN ('FAILED', 'CANCELED') AND value - old <> 1 THEN 'step' END AS reason
      FROM r WHERE before IS NOT NULL)
SELECT uid, seq, before, state, reason FROM v WHERE reason IS NOT NULL""")
add("M6_transition_check_pilot",
    lambda s, p: m.check_transitions(view(s, p, "pilot_updates_v"), "pilot"),
    f"""WITH {dim('pilot')},
r AS (SELECT uid, seq, pilot_updates_v.state, value, lag(pilot_updates_v.state) OVER w AS before,
        lag(value) OVER w AS old
      FROM pilot_updates_v JOIN dim USING (state) WINDOW w AS (PARTITION BY uid ORDER BY seq))
SELECT uid, seq, before, state, 'step' AS reason FROM r
WHERE before IS NOT NULL AND state NOT IN ('FAILED', 'CANCELED') AND value - old > 1""")


# documents: some fields are null in some updates
def docs(s, p):
    from suite.views import table
    e = table(s, p, "events")
    return e.select(
        F.concat(F.lit("task."), F.col("user_id").cast("string")).alias("uid"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("stdout"),
        F.when(F.col("event_type") == "click", F.col("event_id") % 7).alias("exit_code"),
        F.col("props").alias("exception"))


DOCS_SQL = """SELECT concat('task.', CAST(user_id AS VARCHAR(20))) AS uid, event_id AS seq,
  CASE WHEN event_type <> 'view' THEN event_type END AS stdout,
  CASE WHEN event_type = 'click' THEN event_id % 7 END AS exit_code, props AS exception FROM events"""
KNOWN_SQL = "SELECT concat('task.', CAST(c_custkey AS VARCHAR(20))) AS uid, 'none' AS stdout, -1 AS exit_code FROM customer"


def known(s, p):
    from suite.views import table
    return table(s, p, "customer").select(
        F.concat(F.lit("task."), F.col("c_custkey").cast("string")).alias("uid"),
        F.lit("none").alias("stdout"), F.lit(-1).cast("long").alias("exit_code"))


LATEST_SQL = f"""WITH docs AS ({DOCS_SQL}), known AS ({KNOWN_SQL}),
latest AS (SELECT uid, max(seq) AS seq, arg_max(stdout, seq) FILTER (WHERE stdout IS NOT NULL) AS stdout,
  arg_max(exit_code, seq) FILTER (WHERE exit_code IS NOT NULL) AS exit_code, arg_max(exception, seq) AS exception
  FROM docs WHERE uid IN (SELECT uid FROM known) GROUP BY uid)"""
add("M7_latest_docs", lambda s, p: m.latest_docs(docs(s, p), known(s, p)),
    LATEST_SQL + " SELECT uid, seq, stdout, exit_code, exception FROM latest")
add("P18_merge_update",
    lambda s, p: m.merge_update(known(s, p), m.latest_docs(docs(s, p)), ["stdout", "exit_code"]),
    LATEST_SQL + """ SELECT k.uid, coalesce(l.stdout, k.stdout) AS stdout,
  coalesce(l.exit_code, k.exit_code) AS exit_code FROM known k LEFT JOIN latest l USING (uid)""")

add("M8_fail_lost",
    lambda s, p: m.fail_lost(view(s, p, "tasks_v").select("uid", "pilot", "state"), view(s, p, "pilots_v"))
    .select("uid", "pilot", "state"),
    """SELECT t.uid, t.pilot, CASE WHEN p.state IN ('DONE', 'FAILED', 'CANCELED')
  AND t.state NOT IN ('DONE', 'FAILED', 'CANCELED') THEN 'FAILED' ELSE t.state END AS state
FROM tasks_v t LEFT JOIN pilots_v p ON p.uid = t.pilot""")

add("P6_reached",
    lambda s, p: m.reached(view(s, p, "steps_v"), ["AGENT_EXECUTING", "AGENT_STAGING_OUTPUT"])
    .groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {dim('task')} SELECT state, count(*) AS n FROM steps_v JOIN dim USING (state)
WHERE value >= 10 OR final GROUP BY state""")

# fixed values: old names and what each stands for, written out for the other engine
LEGACY = {
    "New": "NEW",
    "AllocatingPending": "TMGR_SCHEDULING_PENDING",
    "Allocating": "TMGR_SCHEDULING",
    "PendingInputStaging": "TMGR_STAGING_INPUT_PENDING",
    "StagingInput": "TMGR_STAGING_INPUT",
    "AgentStagingInputPending": "AGENT_STAGING_INPUT_PENDING",
    "AgentStagingInput": "AGENT_STAGING_INPUT",
    "ExecutingPending": "AGENT_EXECUTING_PENDING",
    "Executing": "AGENT_EXECUTING",
    "AgentStagingOutputPending": "AGENT_STAGING_OUTPUT_PENDING",
    "AgentStagingOutput": "AGENT_STAGING_OUTPUT",
    "PendingOutputStaging": "TMGR_STAGING_OUTPUT_PENDING",
    "StagingOutput": "TMGR_STAGING_OUTPUT",
    "Done": "DONE",
    "Canceled": "CANCELED",
    "Failed": "FAILED",
    "UMGR_SCHEDULING_PENDING": "TMGR_SCHEDULING_PENDING",
    "UMGR_SCHEDULING": "TMGR_SCHEDULING",
    "UMGR_STAGING_INPUT_PENDING": "TMGR_STAGING_INPUT_PENDING",
    "UMGR_STAGING_INPUT": "TMGR_STAGING_INPUT",
    "UMGR_STAGING_OUTPUT_PENDING": "TMGR_STAGING_OUTPUT_PENDING",
    "UMGR_STAGING_OUTPUT": "TMGR_STAGING_OUTPUT",
    "CANCELING": "CANCELED",
    "PENDING": "PMGR_LAUNCHING_PENDING",
    "PENDING_LAUNCH": "PMGR_LAUNCHING_PENDING",
    "LAUNCHING": "PMGR_LAUNCHING",
    "PENDING_ACTIVE": "PMGR_ACTIVE_PENDING",
    "ACTIVE_PENDING": "PMGR_ACTIVE_PENDING",
    "ACTIVE": "PMGR_ACTIVE",
    "UNSCHEDULED": "TMGR_SCHEDULING_PENDING",
    "SCHEDULING": "TMGR_SCHEDULING",
    "PENDING_INPUT_STAGING": "TMGR_STAGING_INPUT_PENDING",
    "STAGING_INPUT": "TMGR_STAGING_INPUT",
    "ALLOCATING_PENDING": "AGENT_SCHEDULING_PENDING",
    "ALLOCATING": "AGENT_SCHEDULING",
    "PENDING_EXECUTION": "AGENT_EXECUTING_PENDING",
    "EXECUTING_PENDING": "AGENT_EXECUTING_PENDING",
    "EXECUTING": "AGENT_EXECUTING",
    "PENDING_OUTPUT_STAGING": "TMGR_STAGING_OUTPUT_PENDING",
    "STAGING_OUTPUT": "TMGR_STAGING_OUTPUT",
}
add("P20_legacy_states",
    lambda s, p: m.map_legacy_states(view(s, p, "updates_v").withColumn(
        "old", F.element_at(F.array(*[F.lit(x) for x in [*LEGACY, "NEW"]]),
                            (F.col("seq") % (len(LEGACY) + 1) + 1).cast("int")))
        .withColumn("state", F.col("old"))).groupBy("old", "state").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH names(i, old, state) AS (VALUES {", ".join(
        f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate([*LEGACY.items(), ("NEW", "NEW")]))})
SELECT old, names.state, count(*) AS n FROM updates_v JOIN names ON i = seq % {len(LEGACY) + 1} GROUP BY 1, 2""")

add("P21_target_state",
    lambda s, p: m.target_state(docs(s, p).withColumn(
        "target_state", F.when(F.col("seq") % 9 == 0, "CANCELED"))).groupBy("target_state", "exit_code")
    .agg(F.count(F.lit(1)).alias("n")),
    f"""WITH docs AS ({DOCS_SQL}) SELECT CASE WHEN seq % 9 = 0 THEN 'CANCELED'
  WHEN coalesce(exit_code, -1) = 0 THEN 'DONE' ELSE 'FAILED' END AS target_state, exit_code, count(*) AS n
FROM docs GROUP BY 1, 2""")

add("A10_state_counts", lambda s, p: m.state_counts(view(s, p, "tasks_v")),
    "SELECT state, count(*) AS n FROM tasks_v GROUP BY state")

add("T3_completion",
    lambda s, p: m.completion(m.collapse(view(s, p, "updates_v")), ["AGENT_EXECUTING", "DONE"]),
    f"""WITH {dim('task')}, s AS (SELECT uid, max(value) AS value FROM updates_v JOIN dim USING (state) GROUP BY uid)
SELECT count(*) AS n, count(*) FILTER (WHERE value >= 10) AS n_reached,
  count(*) = count(*) FILTER (WHERE value >= 10) AS done FROM s""")

add("U4_states_seen",
    lambda s, p: view(s, p, "updates_v").groupBy("uid").agg(F.array_join(
        F.sort_array(F.collect_set("state")), ",").alias("states")),
    "SELECT uid, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM updates_v GROUP BY uid")
