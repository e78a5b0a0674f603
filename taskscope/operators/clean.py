"""Merge and repair traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskscope.functions.text import uid_type
from taskscope.operators.ordered import running
from taskscope.plans.presets import EVENT_ALIASES, NOISE, PAIRS
from taskscope.session import cut, staged
from taskscope.sources.trace import read_trace


def session_keys(df: DataFrame, *more: str) -> list[str]:
    """Uids are unique within a session."""
    return (["sid"] if "sid" in df.columns else []) + list(more)


def drop_events(events: DataFrame, names=tuple(NOISE)) -> DataFrame:
    return events.filter(~F.col("event").isin(*names))


def clock_offsets(events: DataFrame) -> DataFrame:
    """(file, host, offset): how far a file's clock is from its host's.

    The `sync_abs` row of a file names host and reference time.  A file's error
    is the row's time minus that time; its offset is the error minus the
    (lower) median error of all files of the host.
    """
    sync = events.filter(F.col("event") == "sync_abs")
    first = sync.groupBy("file").agg(F.min_by(F.struct("time", "msg"), "time").alias("s"))
    parts = F.split("s.msg", ":")
    # one row per file: cut, so the traces are not read again below
    errors = cut(first.select(
        "file", F.concat_ws(":", parts[0], F.get(parts, F.lit(1))).alias("host"),
        (F.col("s.time") - F.get(parts, F.lit(2)).try_cast("double")).alias("error"))
        .filter("error is not null"))
    ranked = running(errors, ["host"], ["error", "file"], number="_n")
    middle = errors.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / 2).alias("_n"))
    typical = ranked.join(middle, ["host", "_n"]).select("host", F.col("error").alias("typical"))
    return errors.join(typical, "host").select(
        "file", "host", (F.col("error") - F.col("typical")).alias("offset"))


def combine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All files on one clock, and the accuracy (largest correction) per host.

    Files without a sync row stay as they are.
    """
    offsets = clock_offsets(events)
    merged = (events.join(offsets.select("file", "offset"), "file", "left")
              .withColumn("time", F.col("time") - F.coalesce("offset", F.lit(0.0)))
              .drop("offset"))
    accuracy = offsets.groupBy("host").agg(
        F.count(F.lit(1)).alias("files"), F.max(F.abs("offset")).alias("accuracy"))
    return merged, accuracy


def canonical_event(event: Column) -> Column:
    names = {**EVENT_ALIASES, "advance": "state"}
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[event], event)


def clean(events: DataFrame) -> DataFrame:
    """Current event names, entity types, and one row per uid and state.

    Of several state rows of a uid the first counts.  CANCELED goes when the
    uid also has another final state.  Only state rows are shuffled, and they
    are combined map-side.
    """
    keys = session_keys(events, "uid")
    # tests on the columns as they are, so they reach a Parquet scan
    is_state = F.col("event").isin("state", "advance") & F.coalesce(F.col("state") != "", F.lit(False))

    def named(df):
        return df.withColumns({"event": canonical_event(F.col("event")), "etype": uid_type(F.col("uid"))})

    plain = named(events.filter(~F.coalesce(is_state, F.lit(False))))
    marks = named(events.filter(is_state))
    rest = [c for c in marks.columns if c not in (*keys, "state")]
    # the other fields break ties, so the choice does not depend on task order
    row = F.struct("time", *[c for c in rest if c != "time"])
    firsts = (marks.groupBy(*keys, "state").agg(F.min(row).alias("_row"))
              .select(*keys, "state", "_row.*"))
    # a uid has at most one row per state here
    other = F.max(F.col("state").isin("DONE", "FAILED")).over(Window.partitionBy(*keys))
    states = (firsts.withColumn("_other", other)
              .filter((F.col("state") != "CANCELED") | ~F.col("_other")).drop("_other"))
    return plain.unionByName(states)


def hostmap(events: DataFrame) -> DataFrame:
    """Last host reported per uid."""
    return (events.filter(F.col("event") == "hostname").groupBy(*session_keys(events, "uid"))
            .agg(F.max_by("msg", F.struct("time", "msg")).alias("host")))


def hostmap_legacy(events: DataFrame) -> DataFrame:
    """Host from a file's first message, for the pilot that file shows as active."""
    active = (events.filter(F.col("file").contains("agent_0.prof")
                            & F.col("event").isin("advance", "state")
                            & (F.col("state") == "PMGR_ACTIVE"))
              .groupBy("file").agg(F.min_by("uid", F.struct("time", "uid")).alias("uid")))
    mine = events.filter(F.col("file").contains("agent_0.prof"))
    first = mine.groupBy("file").agg(F.min_by("msg", F.struct("time", "block", "pos")).alias("msg"))
    parts = F.split("msg", ":")
    return (first.filter(F.col("msg") != "").join(active, "file")
            .select("uid", F.concat_ws(":", parts[0], F.get(parts, F.lit(1))).alias("host")))


def hosts(events: DataFrame) -> DataFrame:
    """Host map; the legacy one only where no host was reported at all."""
    now = hostmap(events)
    any_now = now.select(F.lit(1).alias("_any")).limit(1)
    legacy = hostmap_legacy(events).join(F.broadcast(any_now), F.lit(True), "left_anti")
    return now.unionByName(legacy)


def add_pilot_stop(events: DataFrame) -> DataFrame:
    """Pilots without a `bootstrap_0_stop` get one at their last timestamp."""
    keys = session_keys(events, "uid")
    pilots = events.filter(F.col("uid").contains("pilot."))
    last = pilots.groupBy(*keys).agg(
        F.max("time").alias("time"),
        F.max(F.col("event") == "bootstrap_0_stop").alias("_stopped"))
    return _inject(events, last.filter("not _stopped").select(
        *keys, "time", F.lit("bootstrap_0_stop").alias("event"),
        F.lit("bootstrap_0").alias("comp"), F.lit("pilot_state").alias("state"),
        F.lit("pilot").alias("etype")))


def close_open_pairs(events: DataFrame, pairs=tuple(PAIRS)) -> DataFrame:
    """Failed and cancelled tasks get the stop events they miss.

    The stop takes the time of the first FAILED or CANCELED.  Only uids that
    were scheduled count as tasks.  One aggregation finds all missing stops.
    """
    keys = session_keys(events, "uid")
    names = sorted({name for pair in pairs for name in pair} | {"schedule_ok", "state"})
    ended = (F.col("event") == "state") & F.col("state").isin("FAILED", "CANCELED")
    seen = lambda name: F.max(F.col("event") == name)
    flags = events.filter(F.col("event").isin(names)).groupBy(*keys).agg(
        F.min(F.when(ended, F.col("time"))).alias("time"),
        seen("schedule_ok").alias("_task"),
        *[seen(a).alias(f"_a{i}") for i, (a, _) in enumerate(pairs)],
        *[seen(b).alias(f"_b{i}") for i, (_, b) in enumerate(pairs)])
    missing = F.filter(
        F.array(*[F.when(F.col(f"_a{i}") & ~F.col(f"_b{i}"), F.lit(b))
                  for i, (_, b) in enumerate(pairs)]),
        lambda b: b.isNotNull())
    stops = (flags.filter(F.col("_task") & F.col("time").isNotNull())
             .select(*keys, "time", F.explode(missing).alias("event")))
    return _inject(events, stops.select(
        *keys, "time", "event", F.lit("inject").alias("comp"),
        F.lit("CANCELED").alias("state"), uid_type(F.col("uid")).alias("etype")))


def _inject(events: DataFrame, rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"thread": F.lit("MainThread"), "msg": F.lit("")})
    extra = [c for c in rows.columns if c not in events.columns]
    return events.unionByName(rows.drop(*extra), allowMissingColumns=True)


def having_event(uids: DataFrame, events: DataFrame, event: str) -> DataFrame:
    return uids.join(_with_event(uids, events, event), _keys(uids, events), "left_semi")


def lacking_event(uids: DataFrame, events: DataFrame, event: str) -> DataFrame:
    return uids.join(_with_event(uids, events, event), _keys(uids, events), "left_anti")


def _keys(uids, events):
    return ["sid", "uid"] if "sid" in uids.columns and "sid" in events.columns else ["uid"]


def _with_event(uids, events, event):
    # distinct first: a hot uid then counts once on the right side
    return events.filter(F.col("event") == event).select(*_keys(uids, events)).distinct()


def add_stops(cleaned: DataFrame) -> DataFrame:
    """Missing stops of pilots, then of tasks."""
    return close_open_pairs(add_pilot_stop(cleaned))


def repair(events: DataFrame) -> DataFrame:
    """The steps after reading: filter, one clock, clean, add missing stops.

    Cleaning and the two repairs each need their input twice, once to find what
    is wrong and once to pass rows on.  Staging in between keeps that at two
    columnar scans per step instead of doubling with every step.
    """
    merged, _ = combine(staged(drop_events(events), "trace"))
    return add_stops(staged(clean(merged), "cleaned"))


def session_trace(spark: SparkSession, path: str,
                  glob: str = "*.prof") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read and repair a session: events, accuracy per host, host per uid.

    The text is read once; see `repair`.
    """
    merged, accuracy = combine(staged(drop_events(read_trace(spark, path, glob)), "trace"))
    cleaned = staged(clean(merged), "cleaned")
    return add_stops(cleaned), accuracy, hosts(cleaned)
