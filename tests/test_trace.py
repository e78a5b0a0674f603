import re

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from taskscope.operators import clean as c
from taskscope.operators import durations as d
from taskscope.plans.presets import E, S
from taskscope.session import fresh_path
from taskscope.sources import trace as t
from taskscope.streaming import messages as msg

HEAD = "#time,event,comp,thread,uid,state,msg"
PILOT_FILE = [
    HEAD,
    "100.000000,sync_abs,bootstrap_0,MainThread,pilot.0000,PMGR_ACTIVE_PENDING,alpha:10.0.0.1:100:100:100",
    "100.000000,bootstrap_0_start,bootstrap_0,MainThread,pilot.0000,pilot_state,",
    "101.000000,virtenv_setup_start,bootstrap_0,MainThread,pilot.0000,pilot_state,",
    "103.500000,virtenv_setup_stop,bootstrap_0,MainThread,pilot.0000,pilot_state,",
    "104.000000,bootstrap_0_ok,bootstrap_0,MainThread,pilot.0000,pilot_state,",
    "",
]
AGENT_FILE = [
    HEAD,
    "112.000000,sync_abs,agent,MainThread,pilot.0000,,alpha:10.0.0.1:110:110:110",
    "113.000000,advance,agent,MainThread,pilot.0000,PMGR_ACTIVE,",
    "113.500000,hostname,agent,MainThread,pilot.0000,,node7",
    "114.000000,schedule_ok,agent,MainThread,task.000001,,a, b, c",
    "115.000000,exec_start,agent,MainThread,task.000001,,",
    "116.000000,publish,agent,MainThread,task.000001,,",
    "117.000000,advance,agent,MainThread,task.000001,FAILED,",
    "118.000000,advance,agent,MainThread,task.000001,CANCELED,",
    "119.000000,advance,agent,MainThread,task.000001,FAILED,",
    "not a line",
]


@pytest.fixture
def folder(tmp_path):
    for name, lines in (("p/bootstrap_0.prof", PILOT_FILE), ("p/agent_0.prof", AGENT_FILE), ("p/other.txt", ["1,x"])):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_read_keeps_commas_and_skips_headers(spark, folder):
    events = t.read_trace(spark, folder)
    assert events.count() == 5 + 9
    assert events.filter("event = 'schedule_ok'").head().msg == "a, b, c"
    assert events.filter("event = 'bootstrap_0_ok'").head().msg == ""


def test_whole_session(spark, folder):
    events, accuracy, hosts = c.session_trace(spark, folder)
    rows = {(r.uid, r.event, r.state): r for r in events.collect()}
    # the agent's clock is 2 s ahead of the typical (lower median) one
    assert rows[("task.000001", "schedule_ok", "")].time == 112.0
    assert tuples(accuracy) == [("alpha:10.0.0.1", 2, 2.0)]
    # a pilot stop at the last pilot event; missing stops of the failed task
    stop = rows[("pilot.0000", "bootstrap_0_stop", "pilot_state")]
    assert stop.time == 111.5 and stop.etype == "pilot"
    for name in ("unschedule_stop", "exec_stop"):
        row = rows[("task.000001", name, "CANCELED")]
        assert (row.time, row.comp, row.msg, row.etype) == (115.0, "inject", "", "task")
    assert ("task.000001", "launch_stop", "CANCELED") not in rows
    # FAILED wins over CANCELED, and is there once
    assert [r.time for r in events.filter("event = 'state' and uid = 'task.000001'").collect()] == [115.0]
    assert tuples(hosts) == [("pilot.0000", "node7")]
    # aliases of newer event names
    assert ("pilot.0000", "ve_setup_start", "pilot_state") in rows
    assert events.filter("event = 'publish'").isEmpty()


def test_legacy_hosts_only_without_host_events(spark, folder):
    events = t.read_trace(spark, folder)
    assert tuples(c.hostmap_legacy(events)) == [("pilot.0000", "alpha:10.0.0.1")]
    assert tuples(c.hosts(events)) == [("pilot.0000", "node7")]
    assert tuples(c.hosts(events.filter("event <> 'hostname'"))) == [("pilot.0000", "alpha:10.0.0.1")]


def test_no_stop_without_schedule(spark):
    rows = [(1.0, "exec_start", "", "", "task.1", "", ""), (2.0, "state", "", "", "task.1", "FAILED", "")]
    events = spark.createDataFrame(rows, "time double, event string, comp string, thread string, uid string, state string, msg string")
    assert c.close_open_pairs(events).count() == 2


def test_durations(spark):
    rows = [("t1", 5.0, "exec_start", None), ("t1", 3.0, "exec_start", None), ("t1", 2.0, "exec_stop", None),
            ("t2", 1.0, "exec_start", None), ("t3", 1.0, "state", "DONE"), ("t3", 4.0, "state", "FAILED")]
    events = spark.createDataFrame(rows, "uid string, time double, event string, state string").withColumn("msg", F.lit(""))
    spec = {"run": (E("exec_start"), E("exec_stop")), "end": ([S("DONE"), S("FAILED")], [S("DONE"), S("FAILED")])}
    assert tuples(d.durations(events, spec)) == [("t1", "run", 3.0, 2.0, -1.0), ("t3", "end", 1.0, 4.0, 3.0)]
    kept = d.durations(events, spec, keep_missing=True)
    assert kept.count() == 6 and kept.filter("t0 is null or t1 is null").count() == 4


def test_messages_match_by_prefix(spark):
    rows = [("p", 1.0, "cmd", "", "cancel_pilot : x"), ("q", 2.0, "cmd", "", "cancel_pilot"), ("r", 3.0, "cmd", "", "cancel_pilots")]
    events = spark.createDataFrame(rows, "uid string, time double, event string, state string, msg string")
    assert tuples(d.first_last(events, {"MSG": "cancel_pilot"}), "uid", "first") == [("p", 1.0), ("q", 2.0)]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark, folder):
    path = fresh_path(spark, "events")
    t.append_trace(t.read_trace(spark, folder), path)
    text = plan(d.durations(spark.read.parquet(path), "task_debug"))
    assert "In(event, [" in text
    assert set(re.search(r"ReadSchema: struct<(.*)>", text).group(1).split(",")) == {
        "time:double", "event:string", "uid:string", "state:string"}
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1


def test_one_shuffle_for_progress(spark):
    from taskscope.operators import state as m
    df = spark.createDataFrame([("u", 1, "NEW")], "uid string, seq long, state string")
    assert len(re.findall(r"^\(\d+\) Exchange", plan(m.progress(df)), re.M)) == 1


def test_stream_of_files_equals_batch(spark, folder):
    spec = {"run": (E("schedule_ok"), E("exec_start"))}
    live = msg.latest_rows(d.durations(t.read_trace_stream(spark, folder, files_per_trigger=1), spec),
                           ["uid", "metric"], fresh_path(spark, "live"))
    assert tuples(live) == tuples(d.durations(t.read_trace(spark, folder), spec)) == [("task.000001", "run", 114.0, 115.0, 1.0)]
