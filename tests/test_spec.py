import pytest

from taskscope import schema
from taskscope.plans import presets as p
from taskscope.plans import spec as s


def test_short_forms():
    assert s.expand_match({"STATE": "NEW"}) == ("state", "NEW", None)
    assert s.expand_match({"EVENT": "exec_start"}) == ("exec_start", None, None)
    assert s.expand_match({"MSG": "cancel_pilot"}) == ("cmd", None, "cancel_pilot")
    assert s.expand_match({"EVENT": "state", "STATE": "NEW"}) == ("state", "NEW", None)


@pytest.mark.parametrize("wrong", [{"NAME": "x"}, {"STATE": "a", "EVENT": "b", "MSG": "c"}, {}])
def test_wrong_short_forms(wrong):
    with pytest.raises(ValueError):
        s.expand_match(wrong)


def test_any_of_boundaries():
    spec = s.expand_spec({"x": [{"STATE": "NEW"}, [{"EVENT": "e"}, {"STATE": "DONE"}]]})
    assert spec["x"][1] == (("e", None, None), ("state", "DONE", None))
    assert len(s.spec_rows({"x": [{"STATE": "NEW"}, [{"EVENT": "e"}, {"STATE": "DONE"}]]})) == 3


def test_presets_have_all_metrics():
    assert {k: len(v) for k, v in p.PRESETS.items()} == {
        "pilot": 6, "task": 8, "task_app": 10, "pilot_debug": 19, "task_debug": 24}
    assert len(p.TAGS["pilot_debug"]["client"]) == 9
    assert len(p.TAGS["pilot_debug"]["consume"]) == 9
    assert len(p.TAGS["task_debug"]["consume"]) == 17
    with pytest.raises(ValueError):
        s.expand_spec("unknown")


def test_state_values():
    task, pilot = schema.state_values("task"), schema.state_values("pilot")
    assert task["NEW"] == 0 and task["AGENT_EXECUTING"] == 10
    assert {task[x] for x in schema.FINAL} == {15} and {pilot[x] for x in schema.FINAL} == {5}
    with pytest.raises(ValueError):
        schema.state_values("other")


def test_transitions_connect_metrics():
    rows = {r[0] if r[0] != "state" else r[1]: r[3:] for r in s.transition_rows("task")}
    assert rows["schedule_ok"] == ("idle", "exec_queue")
    assert rows["exec_start"] == ("exec_sh", "exec_cmd")
    assert rows["unschedule_stop"] == ("unschedule", "idle")
    pilot = {(r[0], r[1]): r[3:] for r in s.transition_rows(p.PILOT_CONSUME, "system", s.AGENT_INNER)}
    assert pilot[("sub_agent_start", None)] == ("setup_1", "agent")
    assert pilot[("sub_agent_stop", None)] == ("agent", "term")
    assert pilot[("bootstrap_0_stop", None)] == ("term", "system")


def test_transitions_clash():
    with pytest.raises(ValueError):
        s.transition_rows({"a": (p.E("x"), p.E("y")), "b": (p.E("x"), p.E("z"))})


def test_events_are_not_dealt_by_their_names(spark):
    from pyspark.sql import functions as F
    events = spark.range(10 ** 9).select(F.concat(F.lit("e"), "id").alias("event"), F.col("id") % 7)
    for table in (s.transitions(spark, "task"), s.pilot_transitions(spark), s.spec_table(spark, "task_app")):
        plan = events.join(table.withColumnRenamed("event", "e"), F.expr("event = e"))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
