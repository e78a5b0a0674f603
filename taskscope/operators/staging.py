"""Staging manifests: expand, filter by phase, group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskscope import schema
from taskscope.functions.text import basename, complete_url, parse_directive, url_path

_OBJECT = "source string, target string, action string, flags int, priority int, uid string"
_KEYS = ["source", "target", "action", "flags", "priority", "uid"]


def expand_directives(df: DataFrame, column: str = "directive", keys=("uid", "pos")) -> DataFrame:
    """Directives as rows with all fields, and `error` where one is wrong.

    The column holds a short form such as `a > b` or a JSON object.  Ids follow
    from the keys, so a repeated run gives the same ones.
    """
    text = F.col(column)
    is_object = F.ltrim(text).startswith("{")
    given = F.from_json(F.when(is_object, text), _OBJECT)
    short = parse_directive(F.when(~is_object, text))
    source = F.coalesce(given.source, short.source)
    target = F.coalesce(given.target, short.target, basename(url_path(source)))
    unknown = F.array_except(F.json_object_keys(F.when(is_object, text)),
                             F.array(*[F.lit(k) for k in _KEYS]))
    error = (F.when(F.size(unknown) > 0, F.concat(F.lit("invalid key: "), F.get(unknown, F.lit(0))))
             .when(F.coalesce(source, F.lit("")) == "", F.lit("no source")))
    number = F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), 256)
    return df.withColumns({
        "sd_uid": F.concat(F.lit("sd."), number),
        "source": source, "target": target,
        "action": F.coalesce(given.action, F.lit(schema.DEFAULT_ACTION)),
        "flags": F.coalesce(given.flags, F.lit(schema.DEFAULT_FLAGS)),
        "priority": F.coalesce(given.priority, F.lit(schema.DEFAULT_PRIORITY)),
        "error": error})


def actionable(directives: DataFrame, phase: str) -> DataFrame:
    if phase not in schema.PHASE_ACTIONS:
        raise ValueError(f"unknown phase: {phase}")
    return directives.filter(F.col("action").isin(schema.PHASE_ACTIONS[phase]))


def needs_output_staging(tasks: DataFrame) -> DataFrame:
    """Tasks whose output is staged: done, or staged on error too."""
    return tasks.filter((F.col("target_state") == "DONE") | F.coalesce("stage_on_error", F.lit(False)))


def complete_directives(directives: DataFrame, source_context: Column, target_context: Column) -> DataFrame:
    """Source and target placed by their contexts; `error` for a host in a
    known schema."""
    src, tgt = complete_url(F.col("source"), source_context), complete_url(F.col("target"), target_context)
    return directives.withColumns({
        "source": src.url, "target": tgt.url, "error": F.coalesce(src.error, tgt.error)})


def sandbox_context(tasks: DataFrame, pilots: DataFrame) -> DataFrame:
    """Tasks with `context`: what each schema stands for.

    Tasks have client_sandbox and task_sandbox, pilots endpoint_fs,
    resource_sandbox, session_sandbox and pilot_sandbox.
    """
    bases = pilots.select(F.col("uid").alias("pilot"), "endpoint_fs", "resource_sandbox",
                          "session_sandbox", "pilot_sandbox")
    names = {"pwd": "task_sandbox", "client": "client_sandbox", "task": "task_sandbox",
             "pilot": "pilot_sandbox", "session": "session_sandbox",
             "resource": "resource_sandbox", "endpoint": "endpoint_fs"}
    pairs = [x for schema_name, c in names.items() for x in (F.lit(schema_name), F.col(c))]
    return (tasks.join(bases, "pilot").withColumn("context", F.create_map(*pairs))
            .drop("endpoint_fs", "resource_sandbox", "session_sandbox", "pilot_sandbox"))


def bulk_groups(tasks: DataFrame, threshold: int) -> DataFrame:
    """Tasks with `bulk`: whether their pilot's batch is large enough.

    Counted by aggregation and joined back, so one pilot with most tasks does
    not put them into one task.
    """
    sizes = tasks.groupBy("pilot").agg((F.count(F.lit(1)) >= threshold).alias("bulk"))
    return tasks.join(sizes, "pilot")


def group_tarballs(directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directives, members): tarball directives of a task become one transfer
    of a tarball and one directive to unpack it; members say what goes in."""
    tar = F.col("action") == "Tarball"
    members = directives.filter(tar).select(
        "uid", F.concat("uid", F.lit(".tar")).alias("tarball"), "source", "target")
    archives = directives.filter(tar).select("uid").distinct()
    made = archives.select(
        "uid", F.concat(F.lit("file://localhost/"), "uid", F.lit(".tar")).alias("source"),
        F.concat(F.lit("task:///"), "uid", F.lit(".tar")).alias("target"),
        F.explode(F.array(F.lit("Transfer"), F.lit("Tarball"))).alias("action"),
        F.lit(schema.DEFAULT_FLAGS).alias("flags"))
    rest = directives.filter(~tar).select("uid", "source", "target", "action", "flags")
    return rest.unionByName(made), members
