"""Session documents: managers, pilots and tasks, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope import schema
from taskscope.operators.ordered import listed
from taskscope.sources.ranges import RANGE, json_entries, json_fragments


def read_manager_docs(spark: SparkSession, path: str, kind: str, glob: str,
                      size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(managers, items) of manager documents, one document per file.

    Task managers hold a map of tasks, pilot managers a list of pilots.  A large
    document is read by many tasks, `size` bytes by each, see `ranges`.
    """
    layout, items = {"tmgr": (schema.TASK, "tasks"), "pmgr": (schema.PILOT, "pilots")}[kind]
    scalars, spans, entries = json_entries(json_fragments(spark, path, glob, size))
    uids = scalars.filter("key = 'uid'").select("file", F.get_json_object(
        F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("uid"))
    managers = uids.join(_texts(spans, entries, "cfg"), "file", "left").select("uid", "cfg")
    rows = (entries.filter(F.col("key") == items).select("file", F.from_json("value", layout).alias("i"))
            .join(F.broadcast(uids.select("file", F.col("uid").alias("_mgr"))), "file").select("_mgr", "i.*"))
    return managers, rows.withColumn(kind, F.coalesce(kind, "_mgr")).drop("_mgr")


def _texts(spans: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(file, key): the JSON text of a small map that stands under a key."""
    text = F.concat(F.lit('"'), "name", F.lit('":'), "value")
    parts = F.array_sort(F.collect_list(F.struct("id", text.alias("text"))))
    inner = entries.filter(F.col("key") == key).groupBy("file").agg(
        F.concat_ws(",", F.transform(parts, lambda p: p["text"])).alias("_in"))
    return spans.filter(F.col("key") == key).join(inner, "file", "left").select(
        "file", F.concat(F.lit("{"), F.coalesce("_in", F.lit("")), F.lit("}")).alias(key))


def read_session(spark: SparkSession, path: str, sid: str, names: dict[str, str] = {}) -> dict[str, DataFrame]:
    """Tables session, tmgr, pmgr, pilot and task of a session folder.

    Of the registry only the configuration is kept, the large rest is not.
    `names` are patterns of the files of `reg`, `tmgr` and `pmgr`, if they are others.
    """
    names = {"reg": f"{sid}.reg.json", "tmgr": "tmgr.*.json", "pmgr": "pmgr.*.json", **names}
    _, spans, registry = json_entries(json_fragments(spark, path, names["reg"]))
    tmgr, task = read_manager_docs(spark, path, "tmgr", names["tmgr"])
    pmgr, pilot = read_manager_docs(spark, path, "pmgr", names["pmgr"])
    tables = {"session": _texts(spans, registry, "cfg").select(F.lit(sid).alias("uid"), "cfg"),
              "tmgr": tmgr, "pmgr": pmgr, "pilot": pilot, "task": task}
    return {name: df.withColumn("sid", F.lit(sid)) for name, df in tables.items()}


def write_session(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per table, and in it one per session; other sessions stay."""
    for name, df in tables.items():
        writer = (df.write.mode("overwrite").format(fmt)
                  .option("partitionOverwriteMode", "dynamic"))
        if "sid" in df.columns:
            writer = writer.partitionBy("sid")
        writer.save(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.format(fmt).load(f"{path}/{name}") for name in names}


def source_version(spark: SparkSession, path: str) -> str:
    """A mark of a folder's files: changes when one is added or written."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "modificationTime", "length"))
    mark = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))
                     .alias("x")).head()
    return f"{mark.n}_{(mark.x or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def cached_session(spark: SparkSession, sid: str, cache_dir: str,
                   build: Callable[[], dict[str, DataFrame]], names, version: str = "0") -> dict[str, DataFrame]:
    """Tables of a session from the cache; built and written when they are not
    there, can not be read, or belong to another version of the source."""
    place = f"{cache_dir}/sid={sid}/version={version}"
    try:
        return read_tables(spark, place, names)
    except AnalysisException:
        write_session(build(), place)
        return read_tables(spark, place, names)


def session_with_task_ids(pilots: DataFrame, tasks: DataFrame, size: int = 4096) -> DataFrame:
    """Pilots with the sorted ids of their tasks, in chunks of `size` ids.

    A pilot without tasks has one empty chunk.  With a `sid` in both tables a
    task belongs to the pilot of its own session.
    """
    sid = ["sid"] if "sid" in pilots.columns and "sid" in tasks.columns else []
    placed = tasks.filter("pilot is not null").select(*sid, F.col("pilot").alias("uid"), F.col("uid").alias("_t"))
    ids = listed(placed, [*sid, "uid"], ["_t"], F.col("_t"), "task_ids", size)
    return (pilots.join(ids, [*sid, "uid"], "left")
            .withColumns({"chunk": F.coalesce("chunk", F.lit(0).cast("long")),
                          "task_ids": F.coalesce("task_ids", F.array().cast("array<string>"))}))


def _key_values(df: DataFrame, etype: str) -> DataFrame:
    """(etype, uid, key, value) for the fields of each document that are set."""
    def shown(field):
        column = F.col(field.name)
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.to_json(column) if nested else column.cast("string")

    fields = F.array(*[F.struct(F.lit(f.name).alias("key"), shown(f).alias("value"))
                       for f in df.schema.fields])
    return (df.select(F.lit(etype).alias("etype"), "uid", F.explode(fields).alias("f"))
            .filter("f.value is not null").select("etype", "uid", "f.key", "f.value"))


def session_inventory(tables: dict[str, DataFrame], mode: str = "sort") -> DataFrame:
    """Uids by type (`sort`), with the keys of each document (`tree`), or also
    their values (`dump`)."""
    if mode not in ("sort", "tree", "dump"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "sort":
        parts = [df.select(F.lit(name).alias("etype"), "uid") for name, df in tables.items()]
    else:
        parts = [_key_values(df, name) for name, df in tables.items()]
        parts = [df.drop("value") for df in parts] if mode == "tree" else parts
    return reduce(DataFrame.unionByName, parts)


HAS = {"session": ["tmgr", "pmgr"], "pmgr": ["pilot"], "tmgr": ["task"], "pilot": ["task"], "task": []}


def entity_tree(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of session -> managers -> pilots -> tasks.

    A task hangs below its manager and its pilot.  A task without a pilot has
    the manager's edge only and is no node.  Children are edges, not lists;
    see `children`.  If managers, pilots and tasks have a `sid`, so have nodes
    and edges.
    """
    keyed = all("sid" in tables[name].columns for name in ("pmgr", "tmgr", "pilot", "task"))

    def sid(name):
        return [F.col("uid" if name == "session" else "sid").alias("sid")] if keyed else []

    def nodes(name, df, resources=None, description=None, etype=None):
        text = lambda c: F.to_json(c) if c and c in df.columns else F.lit(None).cast("string")
        return df.select(
            *sid(name), "uid", F.coalesce(etype if etype is not None else F.lit(name), F.lit(name)).alias("etype"),
            (F.col("cfg") if "cfg" in df.columns else F.lit(None).cast("string")).alias("cfg"),
            F.array(*[F.lit(x) for x in HAS[name]]).cast("array<string>").alias("has"),
            text(resources).alias("resources"), text(description).alias("description"))

    def edges(df, parent, child="uid"):
        return df.filter(F.coalesce(parent, F.lit("")) != "").select(
            *sid(""), F.col(parent).alias("parent"), F.col(child).alias("child"))

    task, pilot = tables["task"], tables["pilot"]
    placed = task.filter(F.coalesce("pilot", F.lit("")) != "")
    all_nodes = [nodes("session", tables["session"]), nodes("pmgr", tables["pmgr"]),
                 nodes("tmgr", tables["tmgr"]), nodes("pilot", pilot, "resource_details", "description"),
                 nodes("task", placed, "resources", "description",
                       F.col("etype") if "etype" in placed.columns else None)]
    all_edges = [edges(tables["pmgr"], "sid"), edges(tables["tmgr"], "sid"),
                 edges(pilot, "pmgr"), edges(task, "tmgr"), edges(placed, "pilot")]
    return reduce(DataFrame.unionByName, all_nodes), reduce(DataFrame.unionByName, all_edges)


def children(edges: DataFrame, size: int = 4096) -> DataFrame:
    """Sorted children per parent, in chunks of `size`."""
    keys = ["sid", "parent"] if "sid" in edges.columns else ["parent"]
    return listed(edges, keys, ["child"], F.col("child"), "children", size)
