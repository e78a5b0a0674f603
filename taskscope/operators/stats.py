"""Session statistics per pilot and mode, and merged rank results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskscope.operators.clean import session_keys
from taskscope.operators.ordered import listed


def pilot_summary(tasks: DataFrame, pilots: DataFrame, events: DataFrame) -> DataFrame:
    """Per pilot: tasks, their cores, resource, start, end and busy time.

    A task without `cores` counts as one core.  Busy time is from
    `bootstrap_0_start` to `bootstrap_0_stop`.
    """
    keys = [k for k in session_keys(events) if k in tasks.columns and k in pilots.columns]
    work = tasks.filter("pilot is not null").groupBy(*keys, "pilot").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum(F.coalesce("cores", F.lit(1))).alias("task_cores"))
    at = lambda c: F.when(c, F.col("time"))
    state = lambda *s: (F.col("event") == "state") & F.col("state").isin(*s)
    life = events.filter(F.col("uid").startswith("pilot.")).groupBy(*keys, F.col("uid").alias("pilot")).agg(
        F.min(at(state("NEW"))).alias("started"),
        F.min(at(state("DONE", "FAILED", "CANCELED"))).alias("finished"),
        F.min(at(F.col("event") == "bootstrap_0_start")).alias("_b0"),
        F.max(at(F.col("event") == "bootstrap_0_stop")).alias("_b1"))
    return (pilots.select(*keys, F.col("uid").alias("pilot"), "resource", "cores")
            .join(work, [*keys, "pilot"], "left").join(life, [*keys, "pilot"], "left")
            .withColumns({"n_tasks": F.coalesce("n_tasks", F.lit(0)),
                          "task_cores": F.coalesce("task_cores", F.lit(0)),
                          "busy": F.col("_b1") - F.col("_b0")})
            .drop("_b0", "_b1"))


def task_rate(summary: DataFrame, timing: DataFrame) -> DataFrame:
    """Tasks per second of the time in which the tasks of that session started; null without it.

    `timing`: sid and t_xy, as `session_timing` gives them; `summary` has a sid.
    """
    spent = timing.select("sid", F.nullif("t_xy", F.lit(0.0)).alias("_spent"))
    return summary.join(spent, "sid", "left").withColumn("rate", F.col("n_tasks") / F.col("_spent")).drop("_spent")


def utilisation(summary: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """`utilisation_ref`: busy time in percent of runtime times cores (1 when
    one is missing), and from core-time shares the core-weighted `utilisation`."""
    whole = (F.col("started") != 0) & (F.col("finished") != 0) & (F.col("cores") != 0)
    runtime = F.when(F.coalesce(whole, F.lit(False)),
                     (F.col("finished") - F.col("started")) * F.col("cores")).otherwise(1.0)
    out = summary.withColumn("utilisation_ref", F.col("busy") * 100 / F.nullif(runtime, F.lit(0.0)))
    if shares is None:
        return out
    keys = [k for k in session_keys(shares) if k in summary.columns]  # pids are unique within a session
    used = shares.groupBy(*keys, F.col("pid").alias("pilot")).agg((F.sum("share") * 100).alias("utilisation"))
    return out.join(used, [*keys, "pilot"], "left")


def mode_progress(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Submitted and collected per mode; complete when all came back."""
    sent = requests.groupBy("mode").agg(F.count(F.lit(1)).alias("submitted"))
    back = results.groupBy("mode").agg(F.count(F.lit(1)).alias("collected"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (sent.join(back, "mode", "full")
            .withColumns({"submitted": zero("submitted"), "collected": zero("collected")})
            .withColumn("complete", F.col("collected") >= F.col("submitted")))


def merge_ranks(results: DataFrame, size: int = 4096) -> DataFrame:
    """Tasks whose ranks have all reported: their outputs in rank order, and the
    highest exit code.

    `results`: uid, rank, ranks, stdout, stderr, return_value, exit_code.  A
    task with very many ranks comes in chunks of `size` ranks.
    """
    whole = results.groupBy("uid").agg(
        F.count_distinct("rank").alias("_n"), F.max("ranks").alias("_ranks"), F.max("exit_code").alias("exit_code")) \
        .filter(F.col("_n") >= F.coalesce("_ranks", F.lit(1))).select("uid", "exit_code")
    fields = F.struct("stdout", "stderr", "return_value")
    # a rank that reports twice counts once
    once = results.join(whole, "uid", "left_semi").dropDuplicates(["uid", "rank"])
    lists = listed(once, ["uid"], ["rank"], fields, "r", size)
    return lists.join(whole, "uid").select(
        "uid", "chunk", F.col("r.stdout").alias("stdout"), F.col("r.stderr").alias("stderr"),
        F.col("r.return_value").alias("return_value"), "exit_code")


def node_uniformity(nodes: DataFrame, keys=("pid",)) -> DataFrame:
    """Per pilot whether all nodes have one shape, and that shape."""
    shape = F.struct("cores", "gpus", "lfs", "mem")
    found = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min(shape).alias("_a"), F.max(shape).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return found.select(*keys, "n_nodes", same.alias("uniform"),
                        *[F.when(same, F.col(f"_a.{c}")).alias(f"{c}_per_node")
                          for c in ("cores", "gpus", "lfs", "mem")])
