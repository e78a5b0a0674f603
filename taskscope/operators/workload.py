"""Task and pilot descriptions: select, validate, migrate, derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope import schema


def entities(df: DataFrame, etype=None, uid=None) -> DataFrame:
    """Rows of one or several entity types and uids."""
    for column, wanted in (("etype", etype), ("uid", uid)):
        if wanted is not None:
            df = df.filter(F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    return df


def get_by_uid(df: DataFrame, uids=None) -> DataFrame:
    """Rows of the given ids; all without ids; an unknown id is an error.

    `uids` is an id, a list of ids, or a DataFrame with a column `uid`.
    """
    if uids is None:
        return df
    if not isinstance(uids, DataFrame):
        listed = [uids] if isinstance(uids, str) else list(uids)
        uids = df.sparkSession.createDataFrame([(u,) for u in listed], "uid string")
    wanted = uids.select("uid").distinct()
    unknown = [r.uid for r in wanted.join(df.select("uid"), "uid", "left_anti").limit(5).collect()]
    if unknown:
        raise KeyError(f"unknown ids, for example {unknown}")
    return df.join(wanted, "uid", "left_semi")


def drop_cancelled(df: DataFrame, cancelled: DataFrame, needed: Column | None = None) -> DataFrame:
    """Items without those to be cancelled; items still needed stay."""
    if needed is None:
        return df.join(cancelled.select("uid"), "uid", "left_anti")
    marks = cancelled.select("uid").distinct().withColumn("_cancelled", F.lit(True))
    kept = F.col("_cancelled").isNull() | needed
    return df.join(marks, "uid", "left").filter(kept).drop("_cancelled")


def waiting(every: DataFrame, taken: DataFrame) -> DataFrame:
    return every.join(taken.select("uid"), "uid", "left_anti")


def with_etype(tasks: DataFrame) -> DataFrame:
    """Entity type from the mode, unless one is set."""
    mode = F.col("mode")
    derived = (F.when(mode.isin(schema.OVERLAY_MODES), mode)
               .when(mode == "task.executable", F.lit("task")).otherwise(F.lit("raptor.task")))
    given = F.when(F.col("etype") != "", F.col("etype")) if "etype" in tasks.columns else F.lit(None)
    return tasks.withColumn("etype", F.coalesce(given, derived))


def with_resources(tasks: DataFrame) -> DataFrame:
    """cpu and gpu counts from ranks, unless resources are set."""
    derived = F.struct(
        (F.col("ranks") * F.col("cores_per_rank")).cast("double").alias("cpu"),
        (F.col("ranks") * F.col("gpus_per_rank")).cast("double").alias("gpu"))
    if "resources" in tasks.columns:
        derived = F.coalesce("resources", derived)
    return tasks.withColumn("resources", derived)


def truthy(df: DataFrame, column: str) -> Column:
    """Set and not zero or empty; never null."""
    kind = df.schema[column].dataType
    empty = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return F.coalesce(F.col(column) != empty, F.lit(False))


def with_pilot_size(pilots: DataFrame) -> DataFrame:
    """Cores and gpus of pilots that were asked for by nodes; `error` where the
    node size is missing."""
    by_nodes = truthy(pilots, "nodes")
    no_cores = by_nodes & ~truthy(pilots, "cores")
    no_cpn = no_cores & ~truthy(pilots, "cores_per_node")
    cores = F.when(no_cores & ~no_cpn, F.col("nodes") * F.col("cores_per_node")).otherwise(F.col("cores"))
    gpus = F.when(by_nodes & ~truthy(pilots, "gpus"),
                  F.col("nodes") * F.coalesce("gpus_per_node", F.lit(0))).otherwise(F.col("gpus"))
    return pilots.withColumns({
        "cores": cores, "gpus": gpus,
        "error": F.when(no_cpn, F.lit("cores_per_node is missing"))})


def required_nodes(requests: DataFrame) -> DataFrame:
    """Nodes a request needs on nodes less their blocked cores and gpus.

    Columns cores, gpus, cores_per_node, gpus_per_node, blocked_cores and
    blocked_gpus (lists of indexes), and nodes (a set value stays).
    """
    left = lambda per_node, blocked: F.col(per_node) - F.coalesce(
        F.greatest(F.size(blocked), F.lit(0)), F.lit(0))
    cpn, gpn = left("cores_per_node", "blocked_cores"), left("gpus_per_node", "blocked_gpus")
    needed = F.greatest(F.col("cores") / F.nullif(cpn, F.lit(0)), F.col("gpus") / F.nullif(gpn, F.lit(0)))
    return requests.withColumns({
        "free_cores": cpn, "free_gpus": gpn,
        "nodes": F.when(truthy(requests, "nodes"), F.col("nodes")).otherwise(F.ceil(needed).cast("int"))})


def with_size(tasks: DataFrame) -> DataFrame:
    """Size as (ranks, cores, gpus) and as their product."""
    return tasks.withColumns({
        "tuple_size": F.struct("ranks", "cores_per_rank", "gpus_per_rank"),
        "size": F.col("ranks") * F.col("cores_per_rank") * F.col("gpus_per_rank")})


def work_order(tasks: DataFrame, mode: str = "waiting") -> DataFrame:
    """Highest priority first, then largest: by the product for waiting tasks,
    by ranks for incoming ones."""
    size = {"waiting": F.col("ranks") * F.col("cores_per_rank") * F.col("gpus_per_rank"),
            "incoming": F.col("ranks")}[mode]
    return tasks.orderBy(F.desc("priority"), size.desc(), "uid")


def due(tasks: DataFrame, now: float) -> DataFrame:
    """Items past their deadline, earliest first; a deadline of 0 is none."""
    return tasks.filter((F.col("deadline") < now) & (F.col("deadline") != 0)).orderBy("deadline", "uid")


def _split(df: DataFrame, reasons: list[Column]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return (marked.filter(F.size("reasons") == 0).drop("reasons"),
            marked.filter(F.size("reasons") > 0))


def validate_tasks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows carry `reasons`; no mode means executable."""
    df = df.withColumn("mode", F.coalesce(F.when(F.col("mode") != "", F.col("mode")), F.lit("task.executable")))
    mode = F.col("mode")

    def needs(modes, column):
        return F.when(mode.isin(modes) & ~truthy(df, column),
                      F.concat(mode, F.lit(f" needs '{column}'")))

    named = mode.isin(schema.FUNCTION_MODES) & truthy(df, "named_env")
    return _split(df, [
        needs(schema.EXECUTABLE_MODES + ["task.proc"], "executable"),
        needs(schema.FUNCTION_MODES, "function"),
        needs(["task.eval", "task.exec"], "code"),
        needs(["task.shell"], "command"),
        F.when(named, F.concat(mode, F.lit(" does not support 'named_env'"))),
    ])


#: fixed values: replaced attribute -> attribute that took its place
RENAMED = {
    "cpu_processes": "ranks",
    "cpu_threads": "cores_per_rank",
    "cpu_thread_type": "threading_type",
    "gpu_processes": "gpus_per_rank",
    "gpu_process_type": "gpu_type",
    "lfs_per_process": "lfs_per_rank",
    "mem_per_process": "mem_per_rank",
    "scheduler": "raptor_id",
    "worker_file": "raptor_file",
    "worker_class": "raptor_class",
}


def migrate_tasks(df: DataFrame) -> DataFrame:
    """Deprecated attributes that are set replace the current ones and are
    cleared; `use_mpi` follows from the ranks where it is null."""
    changes = {}
    for old, new in RENAMED.items():
        if old not in df.columns:
            continue
        kind = df.schema[old].dataType
        value = F.col(old)
        if new in df.columns:
            value = F.when(truthy(df, old), value.cast(df.schema[new].dataType)).otherwise(F.col(new))
        changes[new] = value
        changes[old] = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    df = df.withColumns(changes)
    return df.withColumn("use_mpi", F.coalesce("use_mpi", F.col("ranks") > 1))


def validate_pilots(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a resource, and either nodes or cores and gpus."""
    has = lambda c: truthy(df, c)
    return _split(df, [
        F.when(~has("resource"), F.lit("needs 'resource'")),
        F.when(has("backup_nodes") & ~has("nodes"), F.lit("'backup_nodes' needs 'nodes'")),
        F.when(~has("nodes") & ~has("cores"), F.lit("needs 'nodes' or 'cores'")),
        F.when(has("nodes") & has("cores"), F.lit("'nodes' excludes 'cores'")),
        F.when(has("nodes") & has("gpus"), F.lit("'nodes' excludes 'gpus'")),
    ])


def apply_overrides(tasks: DataFrame, overrides: dict) -> DataFrame:
    """Set `ranks` and `cores_per_rank` on all tasks where an override is given."""
    new = {c: F.lit(int(overrides[c])) for c in ("ranks", "cores_per_rank")
           if overrides.get(c) is not None}
    return tasks.withColumns(new) if new else tasks


def read_overrides(spark, path: str) -> dict:
    """The one object of an override file; nothing when there is no file."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema("ranks int, cores_per_rank int").json(path, multiLine=True).head(1)
    except AnalysisException:
        return {}
    return rows[0].asDict() if rows else {}


def commands_for_rank(df: DataFrame, column: str = "pre_exec") -> DataFrame:
    """(uid, rank, pos, step, command) from a JSON list of commands.

    A string runs on every rank, an object names the ranks: rank -> command or
    list of commands.  One value in place of the list counts as a list.
    """
    spec = F.parse_json(column)
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    as_list = lambda v: F.when(is_list(v), F.try_variant_get(v, "$", "array<string>")) \
        .when(is_text(v), F.array(F.try_variant_get(v, "$", "string")))
    entries = F.when(is_list(spec), F.try_variant_get(spec, "$", "array<variant>")).otherwise(F.array(spec))
    rows = df.select("uid", "ranks", F.posexplode(entries).alias("pos", "entry"))
    every = rows.filter(is_text(F.col("entry"))).select(
        "uid", "pos", F.explode(F.sequence(F.lit(0), F.col("ranks") - 1)).alias("rank"),
        F.array(F.try_variant_get("entry", "$", "string")).alias("todo"))
    some = rows.filter(~is_text(F.col("entry"))).select(
        "uid", "ranks", "pos", F.explode(F.try_variant_get("entry", "$", "map<string,variant>")).alias("key", "value")) \
        .withColumn("rank", F.col("key").try_cast("int")) \
        .filter("rank >= 0 AND rank < ranks") \
        .select("uid", "pos", "rank", as_list(F.col("value")).alias("todo"))
    return every.unionByName(some).select(
        "uid", "rank", "pos", F.posexplode("todo").alias("step", "command"))
