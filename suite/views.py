"""Task-campaign views over the driver's tables.

Each view is one SQL text that both engines run; only the epoch function is
spelled differently in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskscope.plans.presets import PILOT_DEBUG, TASK_APP, TASK_DEBUG
from taskscope.plans.spec import expand_spec
from taskscope.schema import TASK_STATES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def cases(number: str, values) -> str:
    """CASE expression that picks the n-th value, NULL for None."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {number} {whens} END"


def _boundaries(*presets):
    """All distinct (event, state, msg) the presets name."""
    found = {}
    for preset in presets:
        for sides in expand_spec(preset).values():
            for side in sides:
                for m in side:
                    found[(m.event, m.state, m.msg)] = None
    return list(found)


_TASK_MARKS = _boundaries(TASK_APP, TASK_DEBUG) + [("bootstrap_note", None, "a, b")]
_PILOT_MARKS = _boundaries(PILOT_DEBUG) + [
    ("sub_agent_start", None, None), ("sub_agent_stop", None, None),
    ("bootstrap_0_ok", None, None), ("hostname", None, "node01")]


def _marked(marks, uid):
    # user_id moves the cycle, so entities differ in what they miss
    number = f"((event_id + user_id) % {len(marks)})"
    return f"""
SELECT 's0' AS sid, epoch_us(ts)/1e6 AS time, {cases(number, [m[0] for m in marks])} AS event,
       'agent' AS comp, 'MainThread' AS thread, {uid} AS uid,
       {cases(number, [m[1] for m in marks])} AS state, {cases(number, [m[2] for m in marks])} AS msg
FROM events"""


def _uid(prefix, number, width):
    return f"concat('{prefix}.', lpad(CAST({number} AS VARCHAR(20)), {width}, '0'))"


_EVENT_TASK = _uid("task", "CAST(floor(event_id / 5) AS BIGINT)", 6)
_ORDER_TASK = _uid("task", "o_orderkey", 9)
_ORDER_PILOT = _uid("pilot", "o_custkey % 25", 4)

VIEWS = {
    # event trace, one task per five consecutive events
    "trace_v": f"""
SELECT 's0' AS sid, epoch_us(ts)/1e6 AS time,
       CASE event_type WHEN 'signup' THEN 'schedule_ok' WHEN 'view' THEN 'exec_start'
            WHEN 'click' THEN 'exec_stop' ELSE 'state' END AS event,
       'agent' AS comp, 'MainThread' AS thread, {_EVENT_TASK} AS uid,
       CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' END AS state,
       props AS msg
FROM events""",
    # all boundaries of the task presets, 60 events per task
    "task_trace_v": _marked(_TASK_MARKS, _uid("task", "CAST(floor(event_id / 60) AS BIGINT)", 9)),
    # all boundaries of the pilot presets, 40 events per pilot
    "pilot_trace_v": _marked(_PILOT_MARKS, _uid("pilot", "CAST(floor(event_id / 40) AS BIGINT)", 6)),
    # out-of-order state updates, in the order of seq
    "updates_v": f"""
SELECT {_EVENT_TASK} AS uid, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'AGENT_SCHEDULING'
            WHEN 'click' THEN 'AGENT_EXECUTING' WHEN 'purchase' THEN 'DONE' ELSE 'CANCELED' END AS state
FROM events""",
    "pilot_updates_v": f"""
SELECT {_uid("pilot", "user_id", 4)} AS uid, event_id AS seq,
       CASE WHEN value < 4 THEN 'NEW' WHEN event_type = 'signup' THEN 'PMGR_LAUNCHING'
            WHEN event_type = 'view' THEN 'PMGR_ACTIVE' WHEN event_type = 'click' THEN 'FAILED'
            WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'DONE'
            WHEN event_type = 'purchase' THEN 'PMGR_LAUNCHING_PENDING' ELSE 'CANCELED' END AS state
FROM events""",
    # mostly orderly updates with some wrong steps
    "steps_v": f"""
SELECT {_uid("task", "CAST(floor(event_id / 20) AS BIGINT)", 6)} AS uid, event_id AS seq,
       CASE WHEN event_id % 20 = 17 AND event_type = 'click' THEN 'CANCELED'
            WHEN event_id % 20 >= 15 AND event_type = 'error' THEN 'FAILED'
            WHEN event_id % 20 >= 15 THEN 'DONE'
            WHEN event_type = 'purchase' THEN {cases("((event_id + 1) % 15)", TASK_STATES)}
            ELSE {cases("(event_id % 20)", TASK_STATES)} END AS state
FROM events""",
    # pilots: one per nation
    "pilots_v": f"""
SELECT {_uid("pilot", "n_nationkey", 4)} AS uid, n_nationkey AS pos, n_name AS resource,
       8 AS nodes, 8 AS cores_per_node, 1 AS gpus_per_node, 64 AS cores,
       CASE n_nationkey % 3 WHEN 0 THEN 'DONE' ELSE 'PMGR_ACTIVE' END AS state
FROM nation""",
    # tasks: one per order
    "tasks_v": f"""
SELECT {_ORDER_TASK} AS uid, {_ORDER_PILOT} AS pilot,
       CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'AGENT_EXECUTING' ELSE 'FAILED' END AS state,
       CAST(1 + o_orderkey % 4 AS INT) AS ranks, CAST(1 + o_custkey % 3 AS INT) AS cores_per_rank,
       CAST(o_orderkey % 2 AS INT) AS gpus_per_rank,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
       concat('ns.', CAST(o_custkey AS VARCHAR(20))) AS ns, CAST(o_custkey % 5 AS INT) AS bag_order,
       epoch_us(o_orderdate)/1e6 AS t_submit
FROM orders""",
    # core used by a task on a node, and when
    "slots_v": f"""
SELECT {_uid("task", "l_orderkey", 9)} AS uid, CAST(l_suppkey % 8 AS INT) AS node_index,
       CAST((l_partkey + l_linenumber) % 8 AS INT) AS core,
       min(epoch_us(l_shipdate)/1e6) AS t0, max(epoch_us(l_shipdate)/1e6) + 3600 AS t1
FROM lineitem GROUP BY 1, 2, 3""",
    # nodes of a pilot, the last one taken by a sub-agent
    "nodes_v": f"""
SELECT {_uid("pilot", "n_nationkey", 4)} AS pid, k AS node_index, (k * 5 + 2) % 8 AS pos,
       (k * 5 + 2) % 8 = 7 AS agent
FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS n(k)""",
    # cores and gpus taken by tasks of pilots
    "placed_v": f"""
SELECT DISTINCT {_ORDER_TASK} AS uid, {_ORDER_PILOT} AS pid, CAST(l_suppkey % 8 AS INT) AS node_index,
       rtype, CASE rtype WHEN 'cpu' THEN CAST((l_partkey + l_linenumber) % 8 AS INT) ELSE 0 END AS core
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
CROSS JOIN (VALUES ('cpu'), ('gpu')) AS r(rtype)
WHERE rtype = 'cpu' OR o_orderkey % 4 = 1""",
    # events of those tasks and pilots, some missing
    "usage_trace_v": f"""
SELECT epoch_us(o_orderdate)/1e6 + k * 20 + o_custkey % 17 AS time, event, {_ORDER_TASK} AS uid, state,
       '' AS msg
FROM orders CROSS JOIN (VALUES (0, 'schedule_ok', ''), (1, 'state', 'AGENT_EXECUTING'),
  (2, 'task_run_start', ''), (3, 'launch_start', ''), (4, 'exec_start', ''), (5, 'exec_stop', ''),
  (6, 'launch_stop', ''), (7, 'task_run_stop', ''), (8, 'unschedule_stop', '')) AS m(k, event, state)
WHERE (o_orderkey + k) % 13 <> 0
UNION ALL
SELECT 100000000.0 * k + n_nationkey, event, {_uid("pilot", "n_nationkey", 4)}, state, msg
FROM nation CROSS JOIN (VALUES (1, 'bootstrap_0_start', '', ''), (2, 'bootstrap_0_ok', '', ''),
  (3, 'state', 'PMGR_ACTIVE', ''), (4, 'sub_agent_start', '', ''), (16, 'sub_agent_stop', '', ''),
  (17, 'cmd', '', 'cancel_pilot : x'), (18, 'bootstrap_0_stop', '', '')) AS m(k, event, state, msg)
WHERE NOT (k = 18 AND n_nationkey % 5 = 0) AND NOT (k = 1 AND n_nationkey % 7 = 1)""",
    # staging directives
    "directives_v": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
            WHEN 1 THEN concat(url, ' > p', CAST(page_id AS VARCHAR(20)), '.html')
            ELSE concat('p', CAST(page_id AS VARCHAR(20)), '.html << ', url) END AS directive,
       CASE page_id % 6 WHEN 0 THEN 'Transfer' WHEN 1 THEN 'Tarball' WHEN 2 THEN 'Link'
            WHEN 3 THEN 'Copy' WHEN 4 THEN 'Move' ELSE 'Download' END AS action,
       page_id % 8 AS flags,
       concat('task.', CAST(CAST(floor(page_id / 7) AS BIGINT) AS VARCHAR(20))) AS uid
FROM pages""",
    "heartbeats_v": """
SELECT concat('worker.', CAST(user_id % 40 AS VARCHAR(20))) AS uid, user_id % 4 AS rank,
       epoch_us(ts)/1e6 AS hb
FROM events""",
    # descriptions, some of them wrong
    "descriptions_v": f"""
SELECT {_ORDER_TASK} AS uid,
       CASE o_orderkey % 11 {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate([
           'task.executable', 'task.service', 'agent.service', 'task.function', 'task.method',
           'task.eval', 'task.exec', 'task.proc', 'task.shell', 'raptor.master']))} END AS mode,
       CASE WHEN o_custkey % 7 = 0 THEN '' ELSE '/bin/date' END AS executable,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'f' END AS function,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'x + 1' END AS code,
       CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'ls' END AS command,
       CASE WHEN o_custkey % 6 = 0 THEN 'env1' WHEN o_custkey % 6 = 1 THEN 'env9' END AS named_env,
       CAST(1 + o_orderkey % 3 AS INT) AS ranks, CAST(o_custkey % 3 AS INT) AS cpu_processes,
       CAST(1 + o_custkey % 2 AS INT) AS cores_per_rank, CAST(o_orderkey % 5 AS INT) AS cpu_threads,
       CAST(0 AS DOUBLE) AS gpus_per_rank, CAST(o_orderkey % 3 AS INT) AS gpu_processes,
       CASE o_custkey % 3 WHEN 0 THEN 'master.a' WHEN 1 THEN '' END AS scheduler, '' AS raptor_id,
       CASE o_custkey % 2 WHEN 0 THEN 'MyWorker' ELSE '' END AS worker_class, '' AS raptor_class,
       CAST(NULL AS BOOLEAN) AS use_mpi
FROM orders""",
    "pilot_requests_v": """
SELECT concat('pilot.', CAST(c_custkey AS VARCHAR(20))) AS uid,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'local.host' END AS resource,
       CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 + c_custkey % 5 ELSE 0 END AS INT) AS nodes,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS backup_nodes,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 10 + c_custkey % 50 ELSE 0 END AS INT) AS cores,
       CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 17 ELSE 0 END AS INT) AS gpus,
       CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 8 END AS INT) AS cores_per_node,
       CAST(c_nationkey % 3 AS INT) AS gpus_per_node
FROM customer""",
}


def sql(body: str, *names: str) -> str:
    """The query with the views it uses in front, for the other engine."""
    used = [n for n in VIEWS if n in names or re.search(rf"\b{n}\b", body)]
    text = body.strip()
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    if not head:
        return text
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{text[15:]}"
    if text.startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str, repeats: bool = False) -> DataFrame:
    """A view; with `repeats` without its DISTINCT, for operators that take rows more than once."""
    text = VIEWS[name].replace("SELECT DISTINCT", "SELECT") if repeats else VIEWS[name]
    text = re.sub(r"epoch_us\(([^)]*)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
    used = {t: table(spark, sf, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def slots_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """`slots_v`, grouped where all items of a task are: a join by task moves its rows no more."""
    items = table(spark, sf, "lineitem").selectExpr(
        f"{_uid('task', 'l_orderkey', 9)} AS uid", "CAST(l_suppkey % 8 AS INT) AS node_index",
        "CAST((l_partkey + l_linenumber) % 8 AS INT) AS core", "unix_micros(CAST(l_shipdate AS TIMESTAMP))/1e6 AS time")
    return items.repartition("uid").groupBy("uid", "node_index", "core").agg(
        F.min("time").alias("t0"), (F.max("time") + 3600).alias("t1"))
