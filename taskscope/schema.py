"""Schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("time", T.DoubleType()),
    T.StructField("event", T.StringType()),
    T.StructField("comp", T.StringType()),
    T.StructField("thread", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("msg", T.StringType()),
])

# One rank's placement.  An occupation of NULL marks a resource that is down.
OCCUPATION = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("occupation", T.DoubleType()),
])
SLOT = T.StructType([
    T.StructField("cores", T.ArrayType(OCCUPATION)),
    T.StructField("gpus", T.ArrayType(OCCUPATION)),
    T.StructField("lfs", T.LongType()),
    T.StructField("mem", T.LongType()),
    T.StructField("node_index", T.IntegerType()),
    T.StructField("node_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
])

DIRECTIVE = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("priority", T.IntegerType()),
])

DESCRIPTION = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("executable", T.StringType()),
    T.StructField("arguments", T.ArrayType(T.StringType())),
    T.StructField("code", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("environment", T.MapType(T.StringType(), T.StringType())),
    T.StructField("named_env", T.StringType()),
    T.StructField("ranks", T.IntegerType()),
    T.StructField("ranks_per_node", T.IntegerType()),
    T.StructField("cores_per_rank", T.IntegerType()),
    T.StructField("gpus_per_rank", T.DoubleType()),
    T.StructField("lfs_per_rank", T.LongType()),
    T.StructField("mem_per_rank", T.LongType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("timeout", T.DoubleType()),
    T.StructField("startup_timeout", T.DoubleType()),
    T.StructField("stage_on_error", T.BooleanType()),
    T.StructField("input_staging", T.ArrayType(DIRECTIVE)),
    T.StructField("output_staging", T.ArrayType(DIRECTIVE)),
    T.StructField("tags", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

RESOURCES = T.StructType([
    T.StructField("cpu", T.DoubleType()),
    T.StructField("gpu", T.DoubleType()),
])

TASK = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("etype", T.StringType()),
    T.StructField("tmgr", T.StringType()),
    T.StructField("pilot", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("exception", T.StringType()),
    T.StructField("resources", RESOURCES),
    T.StructField("slots", T.ArrayType(SLOT)),
    T.StructField("description", DESCRIPTION),
])

NODE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("index", T.IntegerType()),
])

RESOURCE_DETAILS = T.StructType([
    T.StructField("cores_per_node", T.IntegerType()),
    T.StructField("gpus_per_node", T.IntegerType()),
    T.StructField("node_list", T.ArrayType(NODE)),
    T.StructField("agent_nodes", T.MapType(T.StringType(), NODE)),
])

PILOT_DESCRIPTION = T.StructType([
    T.StructField("resource", T.StringType()),
    T.StructField("nodes", T.IntegerType()),
    T.StructField("backup_nodes", T.IntegerType()),
    T.StructField("cores", T.IntegerType()),
    T.StructField("gpus", T.IntegerType()),
])

PILOT = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("pmgr", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("resource_details", RESOURCE_DETAILS),
    T.StructField("description", PILOT_DESCRIPTION),
])

RESULT = T.StructType([
    T.StructField("out", T.StringType()),
    T.StructField("err", T.StringType()),
    T.StructField("ret", T.IntegerType()),
    T.StructField("val", T.StringType()),
    T.StructField("exc", T.StringType()),
    T.StructField("detail", T.StringType()),
])

# ---- fixed values: state models, in order of progress ----------------------
TASK_STATES = [
    "NEW",
    "TMGR_SCHEDULING_PENDING", "TMGR_SCHEDULING",
    "TMGR_STAGING_INPUT_PENDING", "TMGR_STAGING_INPUT",
    "AGENT_STAGING_INPUT_PENDING", "AGENT_STAGING_INPUT",
    "AGENT_SCHEDULING_PENDING", "AGENT_SCHEDULING",
    "AGENT_EXECUTING_PENDING", "AGENT_EXECUTING",
    "AGENT_STAGING_OUTPUT_PENDING", "AGENT_STAGING_OUTPUT",
    "TMGR_STAGING_OUTPUT_PENDING", "TMGR_STAGING_OUTPUT",
]
PILOT_STATES = [
    "NEW",
    "PMGR_LAUNCHING_PENDING", "PMGR_LAUNCHING",
    "PMGR_ACTIVE_PENDING", "PMGR_ACTIVE",
]
FINAL = ["DONE", "FAILED", "CANCELED"]

LEGACY_STATES = {
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
}
# names of the same states in older documents: manager prefix, old defines
STATE_ALIASES = {
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

# ---- fixed values: task modes ----------------------------------------------
EXECUTABLE_MODES = ["task.executable", "task.service", "agent.service"]
FUNCTION_MODES = ["task.function", "task.method"]
OVERLAY_MODES = ["raptor.master", "raptor.worker"]
TASK_MODES = EXECUTABLE_MODES + FUNCTION_MODES + [
    "task.eval", "task.exec", "task.proc", "task.shell"] + OVERLAY_MODES

# ---- fixed values: staging -------------------------------------------------
ACTIONS = ["Copy", "Link", "Move", "Download", "Transfer", "Tarball"]
FLAGS = {"recursive": 1, "create_parents": 2, "non_fatal": 4}
DEFAULT_ACTION = "Transfer"
DEFAULT_FLAGS = 2
DEFAULT_PRIORITY = 0
PHASE_ACTIONS = {
    "client_in": ["Transfer", "Tarball"],
    "agent_in": ["Link", "Copy", "Move", "Tarball", "Download"],
    "agent_out": ["Link", "Copy", "Move"],
    "client_out": ["Transfer"],
}


def states(model: str) -> list[str]:
    if model not in ("task", "pilot"):
        raise ValueError(f"unknown state model: {model}")
    return TASK_STATES if model == "task" else PILOT_STATES


def state_values(model: str) -> dict[str, int]:
    """State -> value; all final states share the highest value."""
    known = states(model)
    values = {name: i for i, name in enumerate(known)}
    values.update({name: len(known) for name in FINAL})
    return values
