"""Reading, merging and repairing traces."""

from pyspark.sql import functions as F

from suite.views import sql, table, view
from taskscope.operators import clean as c
from taskscope.plans.presets import NOISE, PAIRS
from taskscope.session import fresh_path
from taskscope.sources import trace as t

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


# trace files as a run leaves them: one folder per component, with a header
def files(s, p, events=None):
    path = fresh_path(s, "trace")
    events = events if events is not None else view(s, p, "trace_v")
    named = events.withColumn("msg", F.concat(F.lit("m, "), F.coalesce("msg", F.lit("")), F.lit(", x")))
    header = s.createDataFrame([("#time,event,comp,thread,uid,state,msg",)], "value string")
    t.write_trace_text(named, path)
    header.coalesce(1).write.mode("append").text(path)
    return path


add("S1_read_trace",
    lambda s, p: t.read_trace(s, files(s, p), "*.txt").select("time", "event", "comp", "thread", "uid", "state", "msg"),
    """SELECT time, event, comp, thread, uid, coalesce(state, '') AS state, concat('m, ', msg, ', x') AS msg FROM trace_v""")


def appended(s, p):
    path = fresh_path(s, "events")
    first = view(s, p, "trace_v")
    t.append_trace(first, path)
    t.append_trace(first.withColumn("sid", F.lit("s1")), path)
    return s.read.parquet(path).groupBy("sid", "event").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first"))


add("S11_append_trace", appended,
    """SELECT sid, event, count(*) AS n, min(time) AS first
FROM (SELECT 's0' AS sid, event, time FROM trace_v UNION ALL SELECT 's1', event, time FROM trace_v) GROUP BY 1, 2""")

# some events under names that carry no information
_NOISY = "CASE WHEN user_id % 4 = 0 THEN 'publish' WHEN user_id % 4 = 1 THEN 'update_pushed' ELSE event_type END"
add("P1_drop_events",
    lambda s, p: c.drop_events(table(s, p, "events").select(
        F.col("event_id"), F.expr(_NOISY).alias("event"))).groupBy("event").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT event, count(*) AS n FROM (SELECT {_NOISY} AS event FROM events) "
    f"WHERE event NOT IN ({', '.join(repr(n) for n in NOISE)}) GROUP BY event")


# clocks: 100 files on 4 hosts, each with a sync row at its start
def clocked(s, p):
    e = table(s, p, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 100).cast("string"), F.lit(".prof")).alias("file"),
        F.col("user_id") % 100 % 4, (F.col("user_id") % 100).alias("k"), "event_id", "event_type",
        (F.expr("unix_micros(CAST(ts AS TIMESTAMP))") / 1e6).alias("time"))
    rows = e.select("file", F.lit("agent").alias("event"), "time", F.lit("").alias("msg"), "event_id")
    base = 1700000000
    sync = e.groupBy("file", "k").agg(F.lit(1).alias("_")).select(
        "file", F.lit("sync_abs").alias("event"),
        (base + F.col("k") * F.col("k") / 64).cast("double").alias("time"),
        F.concat(F.lit("host"), (F.col("k") % 4).cast("string"), F.lit(f":10.0.0.1:{base}:{base}:{base}")).alias("msg"),
        F.lit(-1).cast("long").alias("event_id"))
    return rows.unionByName(sync)


_CLOCKED = """rows AS (SELECT concat('f', CAST(user_id % 100 AS VARCHAR(20)), '.prof') AS file, user_id % 100 AS k,
  epoch_us(ts)/1e6 AS time, event_id FROM events),
err AS (SELECT DISTINCT file, k, concat('host', CAST(k % 4 AS VARCHAR(20)), ':10.0.0.1') AS host,
  (1700000000 + k * k / 64) - 1700000000 AS error FROM rows),
med AS (SELECT host, quantile_disc(error, 0.5) AS typical FROM err GROUP BY host),
off AS (SELECT file, host, error - typical AS shift FROM err JOIN med USING (host))"""
add("C1_combine",
    lambda s, p: c.combine(clocked(s, p))[0].filter("event <> 'sync_abs'")
    .select("event_id", "file", F.round("time", 6).alias("time")),
    f"WITH {_CLOCKED} SELECT event_id, file, round(time - shift, 6) AS time FROM rows JOIN off USING (file)")
add("C1_accuracy",
    lambda s, p: c.combine(clocked(s, p))[1],
    f"WITH {_CLOCKED} SELECT host, count(*) AS files, max(abs(shift)) AS accuracy FROM off GROUP BY host")


# traces with repeated and contradicting states under old names
def raw(s, p):
    return view(s, p, "trace_v").withColumns({
        "event": F.when(F.col("event") == "state", "advance").otherwise(F.col("event")),
        "state": F.when((F.col("event") == "state") & F.col("msg").contains("1"), "CANCELED").otherwise(F.col("state"))})


_RAW = """raw AS (SELECT sid, time, event, comp, thread, uid, msg,
  CASE WHEN event = 'state' AND contains(msg, '1') THEN 'CANCELED' ELSE state END AS state FROM trace_v),
flags AS (SELECT *, row_number() OVER (PARTITION BY uid, event, state ORDER BY time) AS k,
  max(CASE WHEN event = 'state' AND state IN ('DONE', 'FAILED') THEN 1 ELSE 0 END) OVER (PARTITION BY uid) AS other
  FROM raw),
cleaned AS (SELECT time, event, comp, thread, uid, state, msg, 'task' AS etype FROM flags
  WHERE event <> 'state' OR (k = 1 AND NOT (state = 'CANCELED' AND other = 1)))"""
EVENT_COLS = ["time", "event", "comp", "thread", "uid", "state", "msg", "etype"]
add("C2_clean", lambda s, p: c.clean(raw(s, p)).select(EVENT_COLS), f"WITH {_RAW} SELECT * FROM cleaned")

# two sessions with the same uids, the second an hour later
add("C3_hostmap",
    lambda s, p: c.hostmap(view(s, p, "pilot_trace_v").unionByName(view(s, p, "pilot_trace_v").withColumns(
        {"sid": F.lit("s1"), "time": F.col("time") + 3600})).withColumn(
        "msg", F.concat("msg", F.date_format(F.timestamp_seconds("time"), "HH")))),
    """WITH e AS (SELECT * FROM pilot_trace_v UNION ALL SELECT * REPLACE ('s1' AS sid, time + 3600 AS time) FROM pilot_trace_v)
SELECT sid, uid, arg_max(concat(msg, strftime(make_timestamp(CAST(floor(time) AS BIGINT) * 1000000), '%H')), time) AS host
FROM e WHERE event = 'hostname' GROUP BY sid, uid""")


def legacy_files(s, p):
    return view(s, p, "pilot_trace_v").select(
        "time", "uid", "event", "state",
        F.concat(F.lit("x/"), "uid", F.lit("/agent_0.prof")).alias("file"),
        F.lit(0).alias("block"), F.col("time").alias("pos"),
        F.concat(F.lit("n"), F.substring("uid", -3, 3), F.lit(":10.1.1."), F.col("event"), F.lit(":1:1:1")).alias("msg"))


add("C4_hostmap_legacy",
    lambda s, p: c.hostmap_legacy(legacy_files(s, p)),
    """SELECT uid, concat('n', right(uid, 3), ':10.1.1.', arg_min(event, time)) AS host FROM pilot_trace_v
GROUP BY uid HAVING bool_or(event = 'state' AND state = 'PMGR_ACTIVE')""")

add("C5_pilot_stop",
    lambda s, p: c.add_pilot_stop(view(s, p, "pilot_trace_v")).select("time", "event", "comp", "uid", "state", "msg"),
    """SELECT time, event, comp, uid, state, msg FROM pilot_trace_v UNION ALL
SELECT max(time), 'bootstrap_0_stop', 'bootstrap_0', uid, 'pilot_state', '' FROM pilot_trace_v
GROUP BY uid HAVING NOT bool_or(event = 'bootstrap_0_stop')""")


def closed(cleaned):
    parts = " UNION ALL ".join(f"""SELECT ended, '{b}', 'inject', 'MainThread', uid, 'CANCELED', '', 'task' FROM f
  WHERE has_{a} AND NOT has_{b}""" for a, b in PAIRS)
    flags = ", ".join(f"bool_or(event = '{x}') AS has_{x}" for pair in PAIRS for x in pair)
    return f"""f AS (SELECT uid, {flags},
  min(time) FILTER (WHERE event = 'state' AND state IN ('FAILED', 'CANCELED')) AS ended
  FROM {cleaned} GROUP BY uid HAVING bool_or(event = 'schedule_ok')
  AND bool_or(event = 'state' AND state IN ('FAILED', 'CANCELED'))),
closed AS (SELECT * FROM {cleaned} UNION ALL {parts})"""


add("C6_close_pairs",
    lambda s, p: c.close_open_pairs(c.clean(raw(s, p))).select(EVENT_COLS),
    f"WITH {_RAW}, {closed('cleaned')} SELECT * FROM closed")

add("C6_close_pairs_full",
    lambda s, p: c.close_open_pairs(view(s, p, "task_trace_v")).groupBy("event", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.max("time").alias("last")),
    f"""WITH t AS (SELECT time, event, comp, thread, uid, state, msg, 'task' AS etype FROM task_trace_v), {closed('t')}
SELECT event, comp, count(*) AS n, max(time) AS last FROM closed GROUP BY 1, 2""")


def whole(s, p):
    events, _, _ = c.session_trace(s, files(s, p, raw(s, p)), "*.txt")
    return events.groupBy("event", "comp", "state").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first"))


add("C7_session_trace", whole,
    f"""WITH {_RAW}, {closed('cleaned')} SELECT event, comp, coalesce(state, '') AS state, count(*) AS n,
  min(time) AS first FROM closed GROUP BY 1, 2, 3""")



# the whole pipeline with clocks and hosts: one file per component, 8 on 4 hosts, each with a sync row at its start
def hosted(s, p):
    """Trace files of eight components on four hosts, whose clocks differ; tasks report a host."""
    rows = raw(s, p).withColumn("k", F.substring("uid", -6, 6).cast("long") % 8)
    named = rows.withColumn("msg", F.when(F.col("event") == "exec_start", F.concat(F.lit("node"), F.col("k").cast("string")))
                            .otherwise(F.lit("")))
    named = named.withColumn("event", F.when(F.col("event") == "exec_start", "hostname").otherwise(F.col("event")))
    base = 1_700_000_000
    sync = s.range(8).select(
        F.lit("s0").alias("sid"), (base + F.col("id") * F.col("id") / 64).cast("double").alias("time"), F.lit("sync_abs").alias("event"),
        F.concat(F.lit("host"), (F.col("id") % 4).cast("string"), F.lit(f":10.0.0.1:{base}:{base}:{base}")).alias("comp"),
        F.lit("MainThread").alias("thread"), F.lit("").alias("uid"), F.lit("").alias("state"),
        F.concat(F.lit("host"), (F.col("id") % 4).cast("string"), F.lit(f":10.0.0.1:{base}:{base}:{base}")).alias("msg"),
        F.col("id").alias("k"))
    path = fresh_path(s, "hosts")
    both = sync.select(*named.columns).unionByName(named).withColumn("first", (F.col("event") != "sync_abs").cast("int"))
    ordered = both.repartition(8, "k").sortWithinPartitions("k", "first").drop("first")
    t.write_trace_text(ordered, path, by="k")
    return path


_CLOCKS = f"""WITH {_RAW}, err AS (SELECT k, concat('host', CAST(k % 4 AS VARCHAR(20)), ':10.0.0.1') AS host, k * k / 64 AS error FROM range(8) t(k)),
med AS (SELECT host, quantile_disc(error, 0.5) AS typical FROM err GROUP BY host),
off AS (SELECT k, host, error - typical AS shift FROM err JOIN med USING (host))"""
add("C7_trace_accuracy", lambda s, p: c.session_trace(s, hosted(s, p), "*.txt")[1],
    f"{_CLOCKS} SELECT host, count(*) AS files, max(abs(shift)) AS accuracy FROM off GROUP BY host")
add("C7_trace_hosts", lambda s, p: c.session_trace(s, hosted(s, p), "*.txt")[2].select("uid", "host"),
    f"""{_CLOCKS} SELECT DISTINCT uid, concat('node', CAST(CAST(right(uid, 6) AS BIGINT) % 8 AS VARCHAR(20))) AS host
FROM raw WHERE event = 'exec_start'""")
add("C7_trace_on_one_clock",
    lambda s, p: c.session_trace(s, hosted(s, p), "*.txt")[0].filter("event = 'schedule_ok'")
    .groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("time"), 6).alias("first")),
    f"""{_CLOCKS} SELECT uid, count(*) AS n, round(min(time - shift), 6) AS first FROM raw
JOIN off ON off.k = CAST(right(uid, 6) AS BIGINT) % 8 WHERE event = 'schedule_ok' GROUP BY uid""")

add("J9_having_event",
    lambda s, p: c.having_event(view(s, p, "trace_v").select("uid").distinct(), view(s, p, "trace_v"), "schedule_ok"),
    "SELECT DISTINCT uid FROM trace_v WHERE event = 'schedule_ok'")
add("J9_lacking_event",
    lambda s, p: c.lacking_event(view(s, p, "trace_v").select("uid").distinct(), view(s, p, "trace_v"), "schedule_ok"),
    "SELECT uid FROM trace_v GROUP BY uid HAVING NOT bool_or(event = 'schedule_ok')")
add("U1_union_traces",
    lambda s, p: view(s, p, "task_trace_v").unionByName(view(s, p, "pilot_trace_v")).groupBy("event").agg(
        F.count(F.lit(1)).alias("n")),
    """SELECT event, count(*) AS n FROM
(SELECT * FROM task_trace_v UNION ALL SELECT * FROM pilot_trace_v) GROUP BY event""")
