"""Named duration presets.

Each entry is `metric: (start, stop)`.  A boundary is one match or a list of
matches of which any counts.  The names are fixed values of the trace format.
"""

from __future__ import annotations


def E(event):
    return {"EVENT": event}


def S(state):
    return {"STATE": state}


def M(msg):
    return {"MSG": msg}


def EM(event, msg):
    return {"EVENT": event, "MSG": msg}


ANY_FINAL = [S("DONE"), S("CANCELED"), S("FAILED")]

PILOT_PROVIDE = {
    "total": (E("bootstrap_0_start"), E("bootstrap_0_stop")),
}
PILOT_CONSUME = {
    "boot": (E("bootstrap_0_start"), E("bootstrap_0_ok")),
    "setup_1": (E("bootstrap_0_ok"), S("PMGR_ACTIVE")),
    "idle": (S("PMGR_ACTIVE"), EM("cmd", "cancel_pilot")),
    "term": (EM("cmd", "cancel_pilot"), E("bootstrap_0_stop")),
    "agent": (E("sub_agent_start"), E("sub_agent_stop")),
}
PILOT_AGENT = {
    "total": (E("bootstrap_0_start"), E("bootstrap_0_stop")),
}
PILOT = {**PILOT_PROVIDE, **PILOT_CONSUME}

TASK = {
    "exec_queue": (E("schedule_ok"), S("AGENT_EXECUTING")),
    "exec_prep": (S("AGENT_EXECUTING"), E("task_run_start")),
    "exec_rp": (E("task_run_start"), E("launch_start")),
    "exec_sh": (E("launch_start"), E("exec_start")),
    "exec_cmd": (E("exec_start"), E("exec_stop")),
    "term_sh": (E("exec_stop"), E("launch_stop")),
    "term_rp": (E("launch_stop"), E("task_run_stop")),
    "unschedule": (E("task_run_stop"), E("unschedule_stop")),
}

TASK_APP = {
    "exec_queue": (E("schedule_ok"), S("AGENT_EXECUTING")),
    "exec_prep": (S("AGENT_EXECUTING"), E("task_run_start")),
    "exec_rp": (E("task_run_start"), E("launch_start")),
    "exec_sh": (E("launch_start"), E("exec_start")),
    "init_app": (E("exec_start"), E("rank_start")),
    "exec_cmd": (E("rank_start"), E("rank_stop")),
    "term_app": (E("rank_stop"), E("exec_stop")),
    "term_sh": (E("exec_stop"), E("launch_stop")),
    "term_rp": (E("launch_stop"), E("task_run_stop")),
    "unschedule": (E("task_run_stop"), E("unschedule_stop")),
}

PILOT_DEBUG = {
    "p_pmgr_create": (S("NEW"), S("PMGR_LAUNCHING_PENDING")),
    "p_pmgr_launching_init": (S("PMGR_LAUNCHING_PENDING"), S("PMGR_LAUNCHING")),
    "p_pmgr_launching": (S("PMGR_LAUNCHING"), E("staging_in_start")),
    "p_pmgr_stage_in": (E("staging_in_start"), E("staging_in_stop")),
    "p_pmgr_submission_init": (E("staging_in_stop"), E("submission_start")),
    "p_pmgr_submission": (E("submission_start"), E("submission_stop")),
    "p_pmgr_scheduling_init": (E("submission_stop"), S("PMGR_ACTIVE_PENDING")),
    "p_pmgr_scheduling": (S("PMGR_ACTIVE_PENDING"), E("bootstrap_0_start")),
    "p_agent_ve_setup_init": (E("bootstrap_0_start"), E("ve_setup_start")),
    "p_agent_ve_setup": (E("ve_setup_start"), E("ve_setup_stop")),
    "p_agent_ve_activate_init": (E("ve_setup_stop"), E("ve_activate_start")),
    "p_agent_ve_activate": (E("ve_activate_start"), E("ve_activate_stop")),
    "p_agent_install_init": (E("ve_activate_stop"), E("rp_install_start")),
    "p_agent_install": (E("rp_install_start"), E("rp_install_stop")),
    "p_agent_launching": (E("rp_install_stop"), S("PMGR_ACTIVE")),
    "p_agent_terminate_init": (S("PMGR_ACTIVE"), M("cancel_pilot")),
    "p_agent_terminate": (M("cancel_pilot"), E("bootstrap_0_stop")),
    "p_agent_finalize": (E("bootstrap_0_stop"), ANY_FINAL),
    "p_agent_runtime": (E("bootstrap_0_start"), E("bootstrap_0_stop")),
}

TASK_DEBUG = {
    "t_tmgr_create": (S("NEW"), S("TMGR_SCHEDULING_PENDING")),
    "t_tmgr_schedule_queue": (S("TMGR_SCHEDULING_PENDING"), S("TMGR_SCHEDULING")),
    "t_tmgr_schedule": (S("TMGR_SCHEDULING"), S("TMGR_STAGING_INPUT_PENDING")),
    "t_tmgr_stage_in_queue": (S("TMGR_STAGING_INPUT_PENDING"), S("TMGR_STAGING_INPUT")),
    "t_tmgr_stage_in": (S("TMGR_STAGING_INPUT"), S("AGENT_STAGING_INPUT_PENDING")),
    "t_agent_stage_in_queue": (S("AGENT_STAGING_INPUT_PENDING"), S("AGENT_STAGING_INPUT")),
    "t_agent_stage_in": (S("AGENT_STAGING_INPUT"), S("AGENT_SCHEDULING_PENDING")),
    "t_agent_schedule_queue": (S("AGENT_SCHEDULING_PENDING"), S("AGENT_SCHEDULING")),
    "t_agent_schedule": (S("AGENT_SCHEDULING"), S("AGENT_EXECUTING_PENDING")),
    "t_agent_execute_queue": (S("AGENT_EXECUTING_PENDING"), S("AGENT_EXECUTING")),
    "t_agent_execute_prepare": (S("AGENT_EXECUTING"), E("task_mkdir")),
    "t_agent_execute_mkdir": (E("task_mkdir"), E("task_mkdir_done")),
    "t_agent_execute_layer_start": (E("task_mkdir_done"), E("task_run_start")),
    "t_agent_execute_layer": (E("task_run_start"), E("task_run_ok")),
    "t_agent_lm_start": (E("task_run_start"), E("launch_start")),
    "t_agent_lm_submit": (E("launch_start"), E("exec_start")),
    "t_agent_lm_execute": (E("exec_start"), E("exec_stop")),
    "t_agent_lm_stop": (E("exec_stop"), E("task_run_stop")),
    "t_agent_stage_out_start": (E("task_run_stop"), S("AGENT_STAGING_OUTPUT_PENDING")),
    "t_agent_stage_out_queue": (S("AGENT_STAGING_OUTPUT_PENDING"), S("AGENT_STAGING_OUTPUT")),
    "t_agent_stage_out": (S("AGENT_STAGING_OUTPUT"), S("TMGR_STAGING_OUTPUT_PENDING")),
    "t_agent_push_to_tmgr": (S("TMGR_STAGING_OUTPUT_PENDING"), S("TMGR_STAGING_OUTPUT")),
    "t_tmgr_destroy": (S("TMGR_STAGING_OUTPUT"), ANY_FINAL),
    "t_agent_unschedule": (E("unschedule_start"), E("unschedule_stop")),
}

PRESETS = {
    "pilot": PILOT,
    "task": TASK,
    "task_app": TASK_APP,
    "pilot_debug": PILOT_DEBUG,
    "task_debug": TASK_DEBUG,
}

# which metrics count as provided, consumed, spent by the agent or the client
TAGS = {
    "pilot": {
        "provide": list(PILOT_PROVIDE),
        "consume": list(PILOT_CONSUME),
        "agent": list(PILOT_AGENT),
    },
    "pilot_debug": {
        "provide": ["p_agent_runtime"],
        "client": ["p_pmgr_create", "p_pmgr_launching_init", "p_pmgr_launching", "p_pmgr_stage_in",
                   "p_pmgr_submission_init", "p_pmgr_submission", "p_pmgr_scheduling_init",
                   "p_pmgr_scheduling", "p_agent_finalize"],
        "consume": ["p_agent_ve_setup_init", "p_agent_ve_setup", "p_agent_ve_activate_init",
                    "p_agent_ve_activate", "p_agent_install_init", "p_agent_install", "p_agent_launching",
                    "p_agent_terminate_init", "p_agent_terminate"],
        "agent": ["p_agent_runtime"],
    },
    "task": {"consume": list(TASK)},
    "task_app": {"consume": list(TASK_APP)},
    "task_debug": {
        "client": ["t_tmgr_create", "t_tmgr_schedule_queue", "t_tmgr_schedule",
                   "t_tmgr_stage_in_queue", "t_tmgr_stage_in", "t_tmgr_destroy",
                   "t_agent_unschedule"],
        "consume": ["t_agent_stage_in_queue", "t_agent_stage_in", "t_agent_schedule_queue", "t_agent_schedule",
                    "t_agent_execute_queue", "t_agent_execute_prepare", "t_agent_execute_mkdir",
                    "t_agent_execute_layer_start", "t_agent_execute_layer", "t_agent_lm_start",
                    "t_agent_lm_submit", "t_agent_lm_execute", "t_agent_lm_stop", "t_agent_stage_out_start",
                    "t_agent_stage_out_queue", "t_agent_stage_out", "t_agent_push_to_tmgr"],
    },
}

# frequent events of no interest to the analysis
NOISE = [
    "publish", "schedule_skip", "schedule_fail",
    "staging_stderr_start", "staging_stderr_stop",
    "staging_stdout_start", "staging_stdout_stop",
    "staging_uprof_start", "staging_uprof_stop",
    "update_pushed",
]

# start events that must not stay open when a task ends early
PAIRS = [
    ("schedule_ok", "unschedule_stop"),
    ("task_run_start", "task_run_stop"),
    ("launch_start", "launch_stop"),
    ("exec_start", "exec_stop"),
]

# newer event name -> name used in the presets
EVENT_ALIASES = {
    "virtenv_setup_start": "ve_setup_start",
    "virtenv_setup_stop": "ve_setup_stop",
    "virtenv_activate_start": "ve_activate_start",
    "virtenv_activate_stop": "ve_activate_stop",
}
