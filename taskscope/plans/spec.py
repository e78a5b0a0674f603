"""From short duration specs to conditions, tables and transitions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskscope.plans.presets import PRESETS

SPEC_SCHEMA = ("metric string, side string, alt int, "
               "event string, state string, msg string")
TRANSITION_SCHEMA = "event string, state string, msg string, source string, target string"


class Match(NamedTuple):
    """What one trace row must show; None matches anything."""
    event: str | None
    state: str | None = None
    msg: str | None = None


def expand_match(short: Mapping[str, str]) -> Match:
    """STATE alone implies the event `state`, MSG alone the event `cmd`."""
    keys = set(short)
    if len(keys) > 2:
        raise ValueError(f"too many keys in a boundary: {sorted(keys)}")
    unknown = keys - {"EVENT", "STATE", "MSG"}
    if unknown or not keys:
        raise ValueError(f"unknown boundary keys: {sorted(unknown)}")
    event = short.get("EVENT")
    if event is None:
        event = "state" if "STATE" in keys else "cmd"
    return Match(event, short.get("STATE"), short.get("MSG"))


def expand_spec(spec) -> dict[str, tuple[tuple[Match, ...], tuple[Match, ...]]]:
    """Preset name or short form -> metric: (start matches, stop matches)."""
    if isinstance(spec, str):
        if spec not in PRESETS:
            raise ValueError(f"unknown preset: {spec}")
        spec = PRESETS[spec]

    def side(boundary):
        several = boundary if isinstance(boundary, (list, tuple)) else [boundary]
        return tuple(expand_match(m) for m in several)

    expanded = {}
    for metric, boundaries in spec.items():
        if len(boundaries) != 2:
            raise ValueError(f"{metric} needs a start and a stop")
        expanded[metric] = (side(boundaries[0]), side(boundaries[1]))
    return expanded


def spec_rows(spec) -> list[tuple]:
    return [(metric, name, alt, m.event, m.state, m.msg)
            for metric, sides in expand_spec(spec).items()
            for name, matches in zip(("start", "stop"), sides)
            for alt, m in enumerate(matches)]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a spec's rows, which joins broadcast.

    Spark does not know the size of rows from Python; it would deal the events by their
    names, all of a name to one task.
    """
    return F.broadcast(spark.createDataFrame(rows, schema))


def spec_table(spark: SparkSession, spec) -> DataFrame:
    return _small(spark, spec_rows(spec), SPEC_SCHEMA)


def message_matches(event: Column, msg: Column, wanted: Column) -> Column:
    """A command is logged as `<name>` or `<name> : <argument>`."""
    return (msg == wanted) | ((event == "cmd") & msg.startswith(F.concat(wanted, F.lit(" "))))


def matches(alternatives) -> Column:
    """True for trace rows that satisfy any of the matches; never null."""
    def one(m: Match) -> Column:
        parts = []
        if m.event is not None:
            parts.append(F.col("event") == m.event)
        if m.state is not None:
            parts.append(F.col("state") == m.state)
        if m.msg is not None:
            parts.append(message_matches(F.col("event"), F.col("msg"), F.lit(m.msg)))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

    return reduce(lambda a, b: a | b, [one(m) for m in alternatives])


def spec_events(spec) -> list[str]:
    """Event names the spec can match at all."""
    return sorted({m.event for sides in expand_spec(spec).values()
                   for side in sides for m in side})


def transition_rows(spec, outside: str = "idle", inner: Mapping[str, tuple] = {}) -> list[tuple]:
    """At which boundary resources move from one metric to the next.

    A boundary that only ends a metric gives its resources back to `outside`,
    one that only starts a metric takes them from there.  `inner` names other
    donors and receivers: metric -> (donor, receiver).
    """
    source, target = {}, {}
    for metric, (start, stop) in expand_spec(spec).items():
        if start in target or stop in source:
            raise ValueError(f"{metric} shares a boundary with another metric")
        target[start] = metric
        source[stop] = metric
    rows = []
    for boundary in dict.fromkeys([*target, *source]):
        to, frm = target.get(boundary), source.get(boundary)
        donor = inner.get(to, (outside, outside))[0]
        receiver = inner.get(frm, (outside, outside))[1]
        rows += [(m.event, m.state, m.msg, frm or donor, to or receiver) for m in boundary]
    return rows


def transitions(spark: SparkSession, spec, outside="idle", inner={}) -> DataFrame:
    return _small(spark, transition_rows(spec, outside, inner), TRANSITION_SCHEMA)


#: sub-agents take their nodes from a pilot in setup and give them back at its end
AGENT_INNER = {"agent": ("setup_1", "term")}


def pilot_transitions(spark: SparkSession, spec=None) -> DataFrame:
    from taskscope.plans.presets import PILOT_CONSUME
    return transitions(spark, spec or PILOT_CONSUME, "system", AGENT_INNER)
