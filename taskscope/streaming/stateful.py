"""Streams with a small state per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taskscope import schema
from taskscope.streaming.buckets import Bucketed, in_buckets
from taskscope.streaming.messages import first_per_batch

#: A transition: the state's value, and that of the state before it, where those between are passed.
CHANGE = "uid string, seq long, state string, before int, value int"


class Progress(StatefulProcessor):
    """Current state per uid; late or repeated states are dropped.

    State: the highest value so far, the last state, whether it is settled, and
    the time (ms) at which it is forgotten, 0 for never.  That moves on with each
    row of the uid.
    """

    def __init__(self, model: str = "task", replay_final: bool = True, forget_ms: int = 0, idle_ms: int = 0):
        self.values = schema.state_values(model)
        self.top = len(schema.states(model))
        self.settling = ["DONE", "FAILED"] if model == "task" else ["DONE"]
        self.replay_final, self.forget_ms, self.idle_ms = replay_final, forget_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "top int, last string, settled boolean, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a pilot may go back and forth between finals, a task may not: its
        # first row per state is enough, whatever the number of rows
        seen = []
        firsts: dict[str, int] = {}
        latest = 0
        for row in rows:
            seq, state = row.seq, row.state
            latest = max(latest, row.ms or 0)
            if state not in self.values:
                continue
            if self.settling == ["DONE"] and state in schema.FINAL:
                seen.append((seq, state))
            elif state not in firsts or seq < firsts[state]:
                firsts[state] = seq
        seen += [(seq, state) for state, seq in firsts.items()]

        top, last, settled, until = self.current.get() or (-1, None, False, 0)
        if until and until <= timerValues.getCurrentWatermarkInMs():  # its timer comes after this batch's rows
            self.handle.deleteTimer(until)
            top, last, settled, until = -1, None, False, 0
        for seq, state in sorted(seen):
            value = self.values[state]
            if value > top:
                before = value - 1 if state in ("FAILED", "CANCELED") and not self.replay_final else top
            elif value == top == self.top and not settled and state != last \
                    and (state in self.settling or self.settling == ["DONE"]):
                before = value - 1
            else:
                continue
            top, last, settled = value, state, settled or state in self.settling
            yield Row(uid=key[0], seq=seq, state=state, before=before, value=value)
        limit = self.forget_ms if top == self.top else self.idle_ms
        ends = max(latest + limit, until) if limit else 0
        if ends != until:
            if until:
                self.handle.deleteTimer(until)
            if ends:
                self.handle.registerTimer(ends)
        if top >= 0:
            self.current.update((top, last, settled, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.current.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Seconds for which the state of a uid is kept after its last row, when it is final and when it is not.
FORGET, IDLE = 86400.0, 30 * 86400.0


def progress_stream(updates: DataFrame, model: str = "task", replay_final: bool = True,
                    forget: float = FORGET, idle: float = IDLE, delay: str = "0 seconds") -> DataFrame:
    """Each transition of each uid once: (uid, seq, state, step, announced).

    State ends where `updates` have a `time` (epoch seconds): `forget` seconds
    after the last row of a uid in a final state, `idle` seconds after the last
    row of any other; 0 is never.  Time is what the rows say, under a watermark
    of `delay`; a row that comes after the end begins a new life of its uid.
    Without `time` nothing moves time on, and state stays.
    """
    timed = "time" in updates.columns and bool(forget or idle)
    rows = updates.select("uid", "state", "seq", (_ms(F.col("time")) if timed else F.lit(None).cast("long")).alias("ms"),
                          *([F.timestamp_seconds("time").alias("ts")] if timed else []))
    if model == "task":
        rows = first_per_batch(rows, ["uid", "state"], "seq", latest=["ms", *(["ts"] if timed else [])])
    if not timed:
        forget = idle = 0.0
    else:
        rows = rows.withWatermark("ts", delay)
    changes = rows.groupBy("uid").transformWithState(
        Progress(model, replay_final, round(forget * 1000), round(idle * 1000)), CHANGE, "append",
        "eventTime" if timed else "none")
    known = F.array(*[F.lit(name) for name in schema.states(model)])
    passed = F.slice(known, F.col("before") + 2, F.col("value") - F.col("before") - 1)
    return changes.select("uid", "seq", "state", F.posexplode(F.concat(passed, F.array("state"))).alias("step", "announced"))


class Timeouts(Bucketed):
    """A deadline per key: set, moved, or dropped; reported when it passes.

    State: deadline as set and end of a key in ms, 0 for none; whether it has
    started; its run limit.
    """

    layout = pa.schema([("uid", pa.string()), ("deadline", pa.int64()), ("started", pa.bool_()), ("end", pa.int64()),
                        ("run", pa.int64()), ("ends", pa.int64())])

    def seen(self, state: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        first = rows.sort_values("ms", kind="stable").drop_duplicates(["uid", "kind"])
        keys = rows[["uid"]].drop_duplicates().merge(state.drop(columns="ends"), on="uid", how="left")
        for kind in ("submit", "started", "ended"):
            of = first.loc[first["kind"] == kind, ["uid", "ms", "startup_ms", "run_ms"]]
            keys = keys.merge(of.set_axis(["uid", *(f"{kind}_{c}" for c in ("at", "startup", "run"))], axis=1), on="uid", how="left")
        column = lambda c: keys[c].fillna(0).to_numpy().astype(np.int64)
        there = lambda kind: keys[f"{kind}_at"].notna().to_numpy()
        deadline, run, started = column("deadline"), column("run"), column("started") > 0
        limited = lambda at, limit: np.where(limit > 0, at + limit, 0)

        submit = there("submit")
        run = np.where(submit, column("submit_run"), run)
        startup = column("submit_startup")
        deadline = np.where(submit & ~started, limited(column("submit_at"), np.where(startup > 0, startup, run)), deadline)
        starts = there("started") & ~started
        run = np.where(starts & (run == 0), column("started_run"), run)
        deadline = np.where(starts, limited(column("started_at"), run), deadline)
        end, ended = column("end"), column("ended_at")
        end = np.where(there("ended") & ((end == 0) | (ended < end)), ended, end)
        # a task that has ended first has kept its limit
        ends = np.where((end == 0) | (deadline < end), deadline, 0)
        new = pd.DataFrame({"uid": keys["uid"], "deadline": deadline, "started": started | starts, "end": end, "run": run, "ends": ends})
        return pd.concat([state[~state["uid"].isin(new["uid"])], new], ignore_index=True), new.iloc[:0]

    def ended(self, over: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return over.iloc[:0], pd.DataFrame({"uid": over["uid"], "event": "task_timeout", "deadline": over["ends"] / 1e3})


def _ms(seconds):
    return F.round(F.coalesce(seconds, F.lit(0.0)) * 1000).cast("long")


def timeout_stream(updates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(uid, event, deadline) for tasks that ran into a limit.

    `updates`: uid, kind (submit, started, ended), time, startup_timeout and
    timeout in seconds.  Until a task has started the startup limit counts,
    then the run limit; 0 is none.  Time is what the rows say; the watermark
    moves it on.
    """
    rows = updates.select("uid", "kind", _ms(F.col("time")).alias("ms"), _ms(F.col("startup_timeout")).alias("startup_ms"),
                          _ms(F.col("timeout")).alias("run_ms"), F.timestamp_seconds("time").alias("ts"))
    return in_buckets(rows.withWatermark("ts", delay), F.col("uid"), Timeouts(), "uid string, event string, deadline double")


class Heartbeats(StatefulProcessor):
    """The end of the latest session of a worker rank; a session has no gap of the time limit."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = (self.last.get() or (None,))[0]
        end = old
        for first, last in sorted((row.first, row.ms) for row in rows):
            if end is not None and first - end >= self.timeout_ms:
                yield Row(uid=key[0], rank=key[1], last=end / 1e3)  # was lost, and is back
            end = last if end is None else max(end, last)
        if end != old:
            if old is not None:
                self.handle.deleteTimer(old + self.timeout_ms)
            self.handle.registerTimer(end + self.timeout_ms)
            self.last.update((end,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()[0]
        self.last.clear()
        yield Row(uid=key[0], rank=key[1], last=last / 1e3)

    def close(self) -> None:
        pass


def _sessions(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """(uid, rank, first, ms): runs of heartbeats without a gap of the limit, per Arrow batch."""
    def combine(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in ("uid", "rank", "ms")])
            same = [pc.fill_null(pc.equal(t[c][1:].combine_chunks(), t[c][:-1].combine_chunks()), False)
                    for c in ("uid", "rank")]
            ms = t["ms"].to_numpy()
            goes_on = same[0].to_numpy(False) & same[1].to_numpy(False) & (ms[1:] - ms[:-1] < timeout_ms)
            first = np.flatnonzero(np.concatenate([[True], ~goes_on])[:len(ms)])
            last = np.append(first[1:], len(ms))[:len(first)] - 1
            yield from t.take(first).select(["uid", "rank"]).append_column("first", pa.array(ms[first])) \
                .append_column("ms", pa.array(ms[last])).to_batches()

    return beats.mapInArrow(combine, "uid string, rank long, first long, ms long")


def lost_worker_stream(heartbeats: DataFrame, timeout: float, delay: str = "0 seconds") -> DataFrame:
    """(uid, rank, last) each time that no heartbeat of a rank has come for `timeout` seconds.

    A rank that is back may be lost again.  What counts is the time of the
    heartbeats, not how they are dealt to micro-batches.
    """
    limit = round(timeout * 1000)
    beats = heartbeats.filter("hb is not null").select("uid", F.col("rank").cast("long").alias("rank"), _ms(F.col("hb")).alias("ms"))
    rows = _sessions(beats, limit).withColumn("ts", F.timestamp_millis("ms"))
    return (rows.withWatermark("ts", delay).groupBy("uid", "rank")
            .transformWithState(Heartbeats(limit), "uid string, rank long, last double", "append", "eventTime"))


class FirstInfo(Bucketed):
    """The first match per uid, or an error when none comes in time.

    Time is that of the lines: a match after the limit is too late, also when it
    comes in the same micro-batch.
    """

    layout = pa.schema([("uid", pa.string()), ("deadline", pa.int64()), ("done", pa.bool_()), ("ends", pa.int64())])

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def seen(self, state: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        of_key = rows.groupby("uid", dropna=False, sort=False)["ms"]
        keys = of_key.agg(["min", "max"]).reset_index().merge(state.drop(columns="ends"), on="uid", how="left")
        keys = keys[keys["done"].ne(True)]
        deadline = keys["deadline"].fillna(0).to_numpy().astype(np.int64)
        if self.timeout_ms:
            deadline = np.where(deadline == 0, keys["min"] + self.timeout_ms, deadline)
        keys = keys[["uid", "max"]].assign(deadline=deadline)
        matches = rows[rows["info"].notna()].merge(keys, on="uid")
        in_time = matches[(matches["deadline"] == 0) | (matches["ms"] <= matches["deadline"])]
        found = in_time.sort_values(["pos", "info"]).drop_duplicates("uid")[["uid", "info"]]
        late = (keys["deadline"] > 0) & (keys["max"] > keys["deadline"]) & ~keys["uid"].isin(found["uid"])
        done = keys["uid"].isin(found["uid"]) | late
        new = pd.DataFrame({"uid": keys["uid"], "deadline": keys["deadline"], "done": done,
                            "ends": keys["deadline"].where(~done, 0)})
        out = pd.concat([found.assign(error=None), self._errors(keys.loc[late, "uid"])], ignore_index=True)
        return pd.concat([state[~state["uid"].isin(new["uid"])], new], ignore_index=True), out

    def _errors(self, uids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"uid": uids, "info": None, "error": "startup timeout"})

    def ended(self, over: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return over.assign(done=True, ends=0), self._errors(over["uid"])


def info_stream(lines: DataFrame, pattern: str, timeout: float = 0.0, delay: str = "0 seconds") -> DataFrame:
    """(uid, info, error) from log lines (uid, pos, time, value).

    With a `timeout` in seconds, counted from a uid's first line, a uid without a
    match up to then gets an error.
    """
    from taskscope.functions.text import extract_info
    rows = lines.select("uid", "pos", _ms(F.col("time")).alias("ms"), extract_info(F.col("value"), pattern).alias("info"),
                        F.timestamp_seconds("time").alias("ts"))
    if not timeout:
        # lines without a match matter for the time limit only
        rows = rows.filter("info is not null")
    return in_buckets(rows.withWatermark("ts", delay), F.col("uid"), FirstInfo(round(timeout * 1000)),
                      "uid string, info string, error string")


# ---- batch forms -----------------------------------------------------------


def timeouts(updates: DataFrame, now: float) -> DataFrame:
    """The rows `timeout_stream` gives when time has moved on to `now`."""
    first = lambda kind, c: F.min(F.when(F.col("kind") == kind, c))
    known = updates.groupBy("uid").agg(
        first("submit", F.col("time")).alias("_submit"), first("started", F.col("time")).alias("_start"),
        first("ended", F.col("time")).alias("_end"), F.max("startup_timeout").alias("_s"), F.max("timeout").alias("_r"))
    zero = lambda c: F.nullif(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    waits = F.col("_submit") + F.coalesce(zero(F.col("_s")), zero(F.col("_r")))
    runs = F.col("_start") + zero(F.col("_r"))
    deadline = F.round(F.when(F.col("_start").isNull(), waits).otherwise(runs), 3)
    return (known.withColumn("deadline", deadline)
            .filter((F.col("deadline") < now) & (F.col("_end").isNull() | (F.col("deadline") < F.col("_end"))))
            .select("uid", F.lit("task_timeout").alias("event"), "deadline"))


def lost_workers(heartbeats: DataFrame, now: float, timeout: float) -> DataFrame:
    """Workers with a rank whose last heartbeat is older than the timeout."""
    last = heartbeats.groupBy("uid", "rank").agg(F.max("hb").alias("last"))
    return last.filter(F.col("last") < now - timeout).groupBy("uid").agg(
        F.count(F.lit(1)).alias("ranks"), F.min("last").alias("last"))
