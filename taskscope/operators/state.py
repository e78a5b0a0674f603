"""State models: value, collapse, progress, transitions and document updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskscope import schema
from taskscope.operators.ordered import running


def state_dim(spark: SparkSession) -> DataFrame:
    """(model, state, value, is_final): a fixed table of 26 rows."""
    rows = [(model, state, value, state in schema.FINAL)
            for model in ("task", "pilot")
            for state, value in schema.state_values(model).items()]
    return spark.createDataFrame(rows, "model string, state string, value int, is_final boolean")


def value_of(state: Column, model: str = "task") -> Column:
    """State value as an expression; null is -1, an unknown state is null."""
    pairs = [F.lit(x) for item in schema.state_values(model).items() for x in item]
    return F.when(state.isNull(), F.lit(-1)).otherwise(F.create_map(*pairs)[state])


def is_final(state: Column) -> Column:
    return F.coalesce(state.isin(schema.FINAL), F.lit(False))


def reached(df: DataFrame, states: list[str], model: str = "task") -> DataFrame:
    """Rows at or past the smallest of the given states, or in a final one."""
    values = schema.state_values(model)
    least = min(values[s] for s in states)
    return df.filter((value_of(F.col("state"), model) >= least) | is_final(F.col("state")))


def _collapse_rank(state: Column, model: str) -> Column:
    top = len(schema.states(model))
    return (F.when(state == "DONE", top + 3).when(state == "FAILED", top + 2)
            .when(state == "CANCELED", top + 1).otherwise(value_of(state, model)))


def collapse(df: DataFrame, model: str = "task", keys=("uid",)) -> DataFrame:
    """One state per key from any number of observations, in any order."""
    seen = F.when(value_of(F.col("state"), model) >= 0, F.col("state"))
    return df.groupBy(*keys).agg(
        F.max_by(seen, _collapse_rank(seen, model)).alias("state"))


def _first_seen(updates: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """First update per key and state: the only ones that can move a key on.

    One aggregation with a minimum per state: combined map-side, one shuffle,
    and at most one row per state and key afterwards, however many updates a
    key has.  The rows stay where the key is, for the window that follows.
    """
    at = [F.min(F.when(F.col("state") == s, F.col("seq"))).alias(f"_s{i}") for i, s in enumerate(names)]
    seen = F.filter(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"_s{i}").alias("seq"))
                              for i, s in enumerate(names)]), lambda r: r.seq.isNotNull())
    return (updates.filter(F.col("state").isin(names)).groupBy(*keys).agg(*at)
            .select(*keys, F.explode(seen).alias("r")).select(*keys, "r.state", "r.seq"))


def progress(updates: DataFrame, model: str = "task", replay_final: bool = True,
             keys=("uid",)) -> DataFrame:
    """Accepted changes (keys, seq, state, passed) of out-of-order updates.

    A key never goes back.  Skipped states are filled in `passed`, which ends
    with the new state.  After CANCELED a later DONE or FAILED corrects the
    final state and `passed` is empty; pilots may also go from FAILED to any
    final.  With `replay_final=False` only the last state is passed for FAILED
    and CANCELED.  Keys start in no state; a known start is an update with an
    earlier `seq`.
    """
    keys = list(keys)
    if model == "pilot":
        return _progress_pilot(updates, replay_final, keys)
    firsts = (_first_seen(updates, keys, list(schema.state_values(model)))
              .withColumn("value", value_of(F.col("state"), model)))
    # at most one row per state and key from here on
    before = (Window.partitionBy(*keys).orderBy("seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    top = len(schema.states(model))
    marked = firsts.withColumns({
        "_top": F.coalesce(F.max("value").over(before), F.lit(-1)),
        # DONE and FAILED are settled; the first of them wins
        "_settled": F.coalesce(F.max(F.col("state").isin("DONE", "FAILED")).over(before), F.lit(False)),
    })
    fresh = F.col("value") > F.col("_top")
    corrected = ((F.col("_top") == top) & F.col("state").isin("DONE", "FAILED")
                 & ~F.col("_settled"))
    return (marked.filter(fresh | corrected)
            .withColumn("passed", _passed(fresh, replay_final, model))
            .select(*keys, "seq", "state", "passed"))


def _passed(fresh: Column, replay_final: bool, model: str) -> Column:
    """States between `_top` and `state`, the latter included."""
    between = F.slice(F.array(*[F.lit(s) for s in schema.states(model)]),
                      F.col("_top") + 2, F.greatest(F.lit(0), F.col("value") - F.col("_top") - 1))
    passed = F.concat(between, F.array("state"))
    if not replay_final:
        passed = F.when(F.col("state").isin("FAILED", "CANCELED"), F.array("state")).otherwise(passed)
    return F.when(fresh, passed).otherwise(F.array().cast("array<string>"))


def _progress_pilot(updates: DataFrame, replay_final: bool, keys: list[str]) -> DataFrame:
    """Pilots: only DONE settles; CANCELED and FAILED may alternate before it.

    Changes between those two depend on each other, so their updates are put in
    order with `running`, which splits large keys.
    """
    model = "pilot"
    top = len(schema.states(model))
    final = updates.filter(is_final(F.col("state"))).select(*keys, "seq", "state")
    ends = final.groupBy(*keys).agg(
        F.min("seq").alias("_end"),
        F.min(F.when(F.col("state") == "DONE", F.col("seq"))).alias("_done"))

    firsts = (_first_seen(updates, keys, schema.states(model)).join(ends, keys, "left")
              .filter(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
              .withColumn("value", value_of(F.col("state"), model)))
    before = (Window.partitionBy(*keys).orderBy("seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    moves = (firsts.withColumn("_top", F.coalesce(F.max("value").over(before), F.lit(-1)))
             .filter("value > _top"))
    reached_top = moves.groupBy(*keys).agg(F.max("value").alias("_top"))

    counted = running(final, keys, ["seq"], lags={"_prev": F.col("state")})
    changes = (counted.join(ends, keys)
               .filter(F.col("_done").isNull() | (F.col("seq") <= F.col("_done")))
               .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("state")))
               .join(reached_top, keys, "left")
               .withColumns({"_top": F.coalesce("_top", F.lit(-1)), "value": F.lit(top)}))
    shown = [*keys, "seq", "state", "passed"]
    return (moves.withColumn("passed", _passed(F.lit(True), replay_final, model)).select(shown)
            .unionByName(changes.withColumn(
                "passed", _passed(F.col("_prev").isNull(), replay_final, model)).select(shown)))


def rejected(updates: DataFrame, model: str = "task", keys=("uid",)) -> DataFrame:
    """Updates that ask for another final state after a key has settled.

    Tasks settle with DONE or FAILED, pilots with DONE.  The reason names the
    state the key keeps.
    """
    keys = list(keys)
    settling = ["DONE", "FAILED"] if model == "task" else ["DONE"]
    settled = (updates.filter(F.col("state").isin(settling)).groupBy(*keys)
               .agg(F.min_by("state", "seq").alias("kept"), F.min("seq").alias("_at")))
    late = updates.filter(is_final(F.col("state"))).join(settled, keys)
    late = late.filter((F.col("seq") > F.col("_at")) & (F.col("state") != F.col("kept")))
    reason = F.concat(F.lit("invalid transition: "), F.col("kept"), F.lit(" -> "), F.col("state"))
    return late.select(*keys, "seq", "state", "kept", reason.alias("reason"))


def announced(changes: DataFrame, keys=("uid",)) -> DataFrame:
    """One row per announced state; a corrected final is announced once."""
    to_tell = F.when(F.size("passed") > 0, F.col("passed")).otherwise(F.array("state"))
    return changes.select(*keys, "seq", "state", F.posexplode(to_tell).alias("step", "announced"))


def check_transitions(updates: DataFrame, model: str = "task", keys=("uid",)) -> DataFrame:
    """Updates that break the strict order, with the state before and a reason.

    Expects one row per update in the order `seq`; the first row of a key is
    its start.
    """
    keys = list(keys)
    rows = running(updates.select(*keys, "seq", "state"), keys, ["seq"],
                   lags={"before": F.col("state")})
    step = value_of(F.col("state"), model) - value_of(F.col("before"), model)
    failing = F.col("state").isin("FAILED", "CANCELED")
    if model == "task":
        reason = (F.when(F.col("before").isin("DONE", "FAILED"), F.lit("frozen"))
                  .when((F.col("before") == "CANCELED") & (F.col("state") != "DONE"), F.lit("cancelled"))
                  .when(F.col("before") == "CANCELED", F.lit(None))
                  .when(~failing & (step != 1), F.lit("step")))
    else:
        reason = F.when(~failing & (step > 1), F.lit("step"))
    return (rows.filter(F.col("before").isNotNull())
            .withColumn("reason", reason).filter("reason is not null")
            .select(*keys, "seq", "before", "state", "reason"))


def latest_docs(updates: DataFrame, known: DataFrame | None = None, keys=("uid",)) -> DataFrame:
    """One document per key: each field holds its last non-null value by `seq`.

    With `known`, keys that are not in it are ignored.
    """
    keys = list(keys)
    fields = [c for c in updates.columns if c not in (*keys, "seq")]
    if known is not None:
        updates = updates.join(known.select(*keys).distinct(), keys, "left_semi")
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    return updates.groupBy(*keys).agg(
        F.max("seq").alias("seq"), *[F.max_by(c, when(c)).alias(c) for c in fields])


def merge_update(base: DataFrame, update: DataFrame, fields: list[str], keys=("uid",)) -> DataFrame:
    """Overwrite the listed fields by the update's value where that is not null."""
    keys = list(keys)
    changed = update.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return (base.join(changed, keys, "left")
            .withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields})
            .drop(*[f"_new_{c}" for c in fields]))


def map_legacy_states(df: DataFrame, column: str = "state") -> DataFrame:
    """Old state names and aliases to current ones; current ones stay."""
    names = {**schema.LEGACY_STATES, **schema.STATE_ALIASES}
    pairs = [F.lit(x) for item in names.items() for x in item]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def target_state(results: DataFrame) -> DataFrame:
    """Exit code 0 is DONE, any other or a missing one FAILED; a set target stays."""
    from_code = F.when(F.coalesce("exit_code", F.lit(-1)) == 0, F.lit("DONE")).otherwise(F.lit("FAILED"))
    kept = F.when(F.col("target_state") != "", F.col("target_state"))
    return results.withColumn("target_state", F.coalesce(kept, from_code))


def fail_lost(tasks: DataFrame, pilots: DataFrame) -> DataFrame:
    """Tasks that are not final fail when their own pilot is final."""
    keys = [k for k in ("sid",) if k in tasks.columns and k in pilots.columns]
    ended = pilots.filter(is_final(F.col("state"))).select(*keys, F.col("uid").alias("pilot")).distinct()
    marked = tasks.join(ended.withColumn("_ended", F.lit(True)), [*keys, "pilot"], "left")
    lost = F.col("_ended") & ~is_final(F.col("state"))
    return marked.withColumn("state", F.when(lost, F.lit("FAILED")).otherwise(F.col("state"))) \
                 .drop("_ended")


def state_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def completion(states: DataFrame, targets: list[str], uids: DataFrame | None = None,
               model: str = "task") -> DataFrame:
    """One row: items, items at a target state, and whether all are."""
    if uids is not None:
        states = states.join(uids.select("uid").distinct(), "uid", "left_semi")
    least = min(schema.state_values(model)[s] for s in targets)
    there = (value_of(F.col("state"), model) >= least) | is_final(F.col("state"))
    return states.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(there.cast("long")), F.lit(0)).alias("n_reached"),
    ).withColumn("done", F.col("n") == F.col("n_reached"))
