"""Timestamps, named durations and the statistics built on them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskscope.operators.clean import session_keys
from taskscope.operators.ordered import running
from taskscope.plans import spec as specs
from taskscope.plans.presets import PILOT_DEBUG, TAGS, TASK_DEBUG


def matching(events: DataFrame, *shorts) -> DataFrame:
    """Events that match any of the short-form boundaries."""
    wanted = [specs.expand_match(s) for s in shorts]
    names = sorted({m.event for m in wanted})
    # the plain name test reaches the Parquet scan
    return events.filter(F.col("event").isin(names)).filter(specs.matches(wanted))


def timestamps(events: DataFrame, *shorts) -> DataFrame:
    """(uid, n, time): matching timestamps, numbered in time order per uid."""
    keys = session_keys(events, "uid")
    found = matching(events, *shorts).groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("_same"))
    total = running(found, keys, ["time"], sums={"_upto": F.col("_same")})
    numbers = F.sequence(F.col("_upto") - F.col("_same") + 1, F.col("_upto"))
    return total.select(*keys, F.explode(numbers).alias("n"), "time")


def first_last(events: DataFrame, *shorts) -> DataFrame:
    """First, last and number of matching timestamps per uid."""
    return matching(events, *shorts).groupBy(*session_keys(events, "uid")).agg(
        F.min("time").alias("first"), F.max("time").alias("last"),
        F.count(F.lit(1)).alias("n"))


def durations(events: DataFrame, spec="task", keep_missing: bool = False,
              by: list[str] | None = None) -> DataFrame:
    """(keys, metric, t0, t1, dur): first start match to last stop match.

    One aggregation serves all metrics: what is shuffled is one row per uid and
    task, not the events.  Rows with a missing side are left out unless
    `keep_missing`; durations may be negative.
    """
    expanded = specs.expand_spec(spec)
    keys = by or session_keys(events, "uid")
    if not keep_missing:
        events = events.filter(F.col("event").isin(specs.spec_events(spec)))
    return of_spec(wide_times(events, keys, [expanded]), keys, expanded, keep_missing)


def _first(boundary) -> str:
    """Column of a boundary's first time."""
    return "first_" + hashlib.md5(repr(boundary).encode()).hexdigest()


def _last(boundary) -> str:
    return "last_" + hashlib.md5(repr(boundary).encode()).hexdigest()


def wide_times(events: DataFrame, keys: list[str], specs_: list[dict], *more: Column) -> DataFrame:
    """One row per key with the first time of each start and the last one of each stop of expanded specs."""
    sides = lambda i: sorted({side[i] for spec in specs_ for side in spec.values()}, key=repr)
    at = lambda m: F.when(specs.matches(m), F.col("time"))
    return events.groupBy(*keys).agg(*[F.min(at(m)).alias(_first(m)) for m in sides(0)],
                                     *[F.max(at(m)).alias(_last(m)) for m in sides(1)], *more)


def of_spec(wide: DataFrame, keys: list[str], expanded: dict, keep_missing: bool = False) -> DataFrame:
    """(keys, metric, t0, t1, dur) of an expanded spec, from `wide_times`."""
    rows = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(_first(a)).alias("t0"), F.col(_last(b)).alias("t1"))
        for metric, (a, b) in expanded.items()])
    found = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    if not keep_missing:  # after the explode: a function of each item of an array is not compiled
        found = found.filter("t0 is not null and t1 is not null")
    return found.withColumn("dur", F.col("t1") - F.col("t0"))


def durations_by_table(events: DataFrame, spec_df: DataFrame) -> DataFrame:
    """As `durations`, for a spec that is itself a table.

    Null state or message in the table matches anything.  The event name is the
    join key, the rest a residual test; Spark broadcasts the table by its size.
    """
    keys = session_keys(events, "uid")
    s = spec_df.select(*[F.col(c).alias(f"s_{c}") for c in ("metric", "side", "event", "state", "msg")])
    on = (F.col("event") == F.col("s_event")) \
        & (F.col("s_state").isNull() | (F.col("state") == F.col("s_state"))) \
        & (F.col("s_msg").isNull()
           | specs.message_matches(F.col("event"), F.col("msg"), F.col("s_msg")))
    found = events.join(s, on).groupBy(*keys, F.col("s_metric").alias("metric")).agg(
        F.min(F.when(F.col("s_side") == "start", F.col("time"))).alias("t0"),
        F.max(F.when(F.col("s_side") == "stop", F.col("time"))).alias("t1"))
    return (found.filter("t0 is not null and t1 is not null")
            .withColumn("dur", F.col("t1") - F.col("t0")))


def duration_stats(dur: DataFrame, by=("metric",)) -> DataFrame:
    return dur.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dur").alias("mean"),
        F.stddev_pop("dur").alias("std"), F.min("dur").alias("least"), F.max("dur").alias("most"))


def time_by_tag(dur: DataFrame, preset: str) -> DataFrame:
    """(tag, n, total): time that was provided, consumed, spent by the agent or the client.

    Tags are those of the preset; a metric may have several, one without a tag does not count.
    """
    tags: dict[str, list[str]] = {}
    for tag, metrics in TAGS[preset].items():
        for metric in metrics:
            tags.setdefault(metric, []).append(tag)
    of = F.create_map(*[x for m, names in tags.items() for x in (F.lit(m), F.array(*map(F.lit, names)))])
    return dur.withColumn("tag", F.explode(of[F.col("metric")])).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dur").alias("total"))


def _state_of_start(spec) -> dict[str, str]:
    """Metric -> the state its start boundary names."""
    named = {}
    for metric, (start, _) in specs.expand_spec(spec).items():
        if len(start) == 1 and start[0].event == "state" and start[0].state:
            named[metric] = start[0].state
    return named


def _start_state(metric: Column, spec) -> Column:
    pairs = [F.lit(x) for item in _state_of_start(spec).items() for x in item]
    return F.create_map(*pairs)[metric]


def pilot_state_durations(events: DataFrame) -> DataFrame:
    """(uid, state, metric, dur) for each state a pilot was seen in."""
    spec = {m: PILOT_DEBUG[m] for m in _state_of_start(PILOT_DEBUG)}
    pilots = events.filter(F.col("uid").startswith("pilot."))
    dur = durations(pilots, spec)
    return dur.select(*session_keys(events, "uid"), _start_state(F.col("metric"), spec).alias("state"),
                      "metric", "dur")


def task_state_stats(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per pilot and task state: number, mean and population std of the duration
    that starts with that state, over the tasks of that pilot."""
    spec = {m: TASK_DEBUG[m] for m in _state_of_start(TASK_DEBUG)}
    dur = durations(events, spec).withColumn("state", _start_state(F.col("metric"), spec))
    keys = [k for k in session_keys(events) if k in tasks.columns]
    placed = tasks.filter("pilot is not null").select(*keys, "uid", "pilot")
    return dur.join(placed, [*keys, "uid"]).groupBy(*keys, "pilot", "state").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dur").alias("mean"), F.stddev_pop("dur").alias("std"))


def session_timing(events: DataFrame) -> DataFrame:
    """Per session: t_0 start, t_h to the first execution, t_x first start to
    last stop, t_xy first to last start of execution."""
    keys = session_keys(events)
    state = lambda *s: (F.col("event") == "state") & F.col("state").isin(*s)
    at = lambda c: F.when(c, F.col("time"))
    relevant = events.filter(F.col("event") == "state")
    per_uid = relevant.groupBy(*keys, "uid").agg(
        F.min(at(state("NEW") & ~F.col("uid").startswith("task."))).alias("new"),
        F.min(at(state("AGENT_EXECUTING"))).alias("start"),
        F.min(at(state("DONE", "FAILED", "CANCELED") & F.col("uid").startswith("task."))).alias("stop"))
    total = per_uid.groupBy(*keys).agg(
        F.min("new").alias("t_0"), F.min("start").alias("x0"),
        F.max("start").alias("y0"), F.max("stop").alias("x1"))
    return total.select(*keys, "t_0", (F.col("x0") - F.col("t_0")).alias("t_h"),
                        (F.col("x1") - F.col("x0")).alias("t_x"),
                        (F.col("y0") - F.col("x0")).alias("t_xy"))
