"""Session documents, tool logs, host lists and task outputs.

The files are written from the tables by Spark first, so they grow with them.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from suite.views import sql, table, view
from taskscope.session import fresh_path
from taskscope.sources import documents as d
from taskscope.sources import logs, ranges
from taskscope.sources.trace import read_lines

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


# ---- session documents -----------------------------------------------------
#: tasks per manager document
PER_MANAGER = 1000


def manager_files(s, p):
    """One document per task manager, each with a map of its tasks."""
    t = view(s, p, "tasks_v").withColumn(
        "mgr", F.format_string("tmgr.%04d", F.floor(F.substring("uid", 6, 9).cast("long") / PER_MANAGER)))
    doc = F.struct("uid", "state", "pilot", F.struct(
        F.lit("task.executable").alias("mode"), F.lit("/bin/date").alias("executable"), "ranks", "cores_per_rank",
        F.col("gpus_per_rank").cast("double").alias("gpus_per_rank")).alias("description"))
    # bounded: a manager has at most PER_MANAGER tasks
    docs = t.groupBy("mgr").agg(F.map_from_entries(F.collect_list(F.struct("uid", doc.alias("doc")))).alias("tasks"))
    path = fresh_path(s, "tmgr")
    docs.select("mgr", F.to_json(F.struct(F.col("mgr").alias("uid"), F.struct(F.lit(1).alias("v")).alias("cfg"),
                                          "tasks")).alias("value")) \
        .write.partitionBy("mgr").text(path)
    return path


add("S3_read_session_tasks",
    lambda s, p: d.read_manager_docs(s, manager_files(s, p), "tmgr", "*.txt")[1].select(
        "uid", "tmgr", "pilot", "state", "description.ranks", "description.gpus_per_rank"),
    f"""SELECT uid, concat('tmgr.', lpad(CAST(CAST(substr(uid, 6, 9) AS BIGINT) // {PER_MANAGER} AS VARCHAR(20)), 4, '0')) AS tmgr,
  pilot, state, ranks, CAST(gpus_per_rank AS DOUBLE) AS gpus_per_rank FROM tasks_v""")
add("S3_read_session_managers",
    lambda s, p: d.read_manager_docs(s, manager_files(s, p), "tmgr", "*.txt")[0],
    f"""SELECT DISTINCT concat('tmgr.', lpad(CAST(CAST(substr(uid, 6, 9) AS BIGINT) // {PER_MANAGER} AS VARCHAR(20)), 4, '0')) AS uid,
  '{{"v":1}}' AS cfg FROM tasks_v""")



def pilot_manager_files(s, p):
    """One document per pilot manager, each with a list of its pilots."""
    v = view(s, p, "pilots_v").withColumn("mgr", F.format_string("pmgr.%04d", F.col("pos") % 4))
    doc = F.struct("uid", "state", F.struct("resource", "nodes", "cores").alias("description"))
    docs = v.groupBy("mgr").agg(F.collect_list(doc).alias("pilots"))
    path = fresh_path(s, "pmgr")
    docs.select("mgr", F.to_json(F.struct(F.col("mgr").alias("uid"), F.struct(F.lit(2).alias("v")).alias("cfg"),
                                          "pilots")).alias("value")) \
        .write.partitionBy("mgr").text(path)
    return path


add("S3_read_session_pilots",
    lambda s, p: d.read_manager_docs(s, pilot_manager_files(s, p), "pmgr", "*.txt")[1].select(
        "uid", "pmgr", "state", "description.resource", "description.nodes", "description.cores"),
    """SELECT uid, concat('pmgr.', lpad(CAST(pos % 4 AS VARCHAR(20)), 4, '0')) AS pmgr, state, resource, nodes, cores FROM pilots_v""")
add("S3_read_session_pilot_managers",
    lambda s, p: d.read_manager_docs(s, pilot_manager_files(s, p), "pmgr", "*.txt")[0],
    """SELECT DISTINCT concat('pmgr.', lpad(CAST(pos % 4 AS VARCHAR(20)), 4, '0')) AS uid, '{"v":2}' AS cfg FROM pilots_v""")



# ---- a whole session folder: one large document per manager ----------------
#: Lines of a document that one task sorts, about, and bytes that are copied at a time.
PIECE, COPIED = 200_000, 1 << 20


def joined_files(pieces, path):
    """A file below `path` for each row (folder, parts): its parts, one after another, copied as streams."""
    def run(batches):
        system, root = ranges.opened(path)
        for batch in batches:
            for folder, parts in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{root}/{folder}")
                with system.open_output_stream(f"{root}/{folder}/part-0.txt") as out:
                    for place in parts:
                        with system.open_input_stream(place) as f:
                            while data := f.read(COPIED):
                                out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["folder"])

    return pieces.select("folder", "parts").mapInArrow(run, "folder string")


def session_folder(s, p):
    """Registry, one pilot manager, and four task managers with a quarter of all tasks each.

    The lines of a document are dealt to pieces in order, and the pieces copied into its file
    one after another, so that no task sorts a document or writes one from one row.
    """
    path, pieces = fresh_path(s, "session-folder"), fresh_path(s, "session-pieces")
    t = view(s, p, "tasks_v").withColumn("k", F.col("bag_order") % 4)
    doc = F.struct("uid", F.when(F.col("priority") > 1, F.col("pilot")).alias("pilot"), "state", F.struct(
        F.lit('a "quoted", {odd} \\ name').alias("name"), "ranks", "cores_per_rank").alias("description"))
    first = t.groupBy("k").agg(F.min("uid").alias("_first"))  # four rows
    lines = t.join(F.broadcast(first), "k").select("k", F.lit(1).alias("part"), "uid", F.concat(
        F.when(F.col("uid") == F.col("_first"), "").otherwise(","), F.lit('"'), "uid", F.lit('": '), F.to_json(doc)).alias("value"))
    frame = s.range(4).select(F.col("id").alias("k"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"uid": "tmgr.000'), F.col("id").cast("string"),
                                                  F.lit('", "cfg": {"bulk": '), F.col("id").cast("string"), F.lit('},\n"tasks": {')).alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("}}").alias("value")))).alias("f")).select("k", "f.part", F.lit("").alias("uid"), "f.value")
    named = lines.unionByName(frame).withColumn("mgr", F.concat(F.lit("tmgr.000"), F.col("k").cast("string")))
    n = t.count() // PIECE + s.sparkContext.defaultParallelism
    named.repartitionByRange(n, "mgr", "part", "uid").sortWithinPartitions("mgr", "part", "uid").select("mgr", "value") \
        .write.partitionBy("mgr").text(pieces)
    # names of pieces are in the order of their ranges; one row per manager and piece
    found = ranges.files_below(s, pieces, "*.txt").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "path")
    joined_files(found.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("parts")).repartition(4, "folder"), path) \
        .write.format("noop").mode("overwrite").save()
    pilots = view(s, p, "pilots_v").select(F.to_json(F.struct(
        "uid", "state", F.struct("resource", "nodes", "cores").alias("description"))).alias("d"))
    pilots.agg(F.array_sort(F.collect_list("d")).alias("l")).select(F.concat(  # one per nation
        F.lit('{"pilots": ['), F.array_join("l", ", "), F.lit('], "uid": "pmgr.0000", "cfg": {}}')).alias("value"), F.lit("pmgr").alias("mgr")) \
        .write.mode("append").partitionBy("mgr").text(path)
    s.range(1).select(F.lit('{"cfg": {"base": "/r", "n": 3}, "rcfgs": {"a": {"large": [1, 2, 3]}}}').alias("value"), F.lit("reg").alias("mgr")) \
        .write.mode("append").partitionBy("mgr").text(path)
    return path


def session_tables(s, p):
    """Counts over all tables that `read_session` gives, by kind and state."""
    got = d.read_session(s, session_folder(s, p), "s0", {"reg": "mgr=reg/*", "tmgr": "mgr=tmgr.*/*", "pmgr": "mgr=pmgr/*"})
    per = lambda name, state, text: got[name].groupBy(state.alias("state"), text.alias("text")).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(name).alias("name"), "state", "text", "n")
    return (per("task", F.col("state"), F.col("tmgr")).unionByName(per("pilot", F.col("state"), F.col("pmgr")))
            .unionByName(per("tmgr", F.col("uid"), F.col("cfg"))).unionByName(per("pmgr", F.col("uid"), F.col("cfg")))
            .unionByName(per("session", F.col("uid"), F.col("cfg"))))


add("S3_session_tables", session_tables,
    """SELECT 'task' AS name, state, concat('tmgr.000', CAST(bag_order % 4 AS VARCHAR(20))) AS text, count(*) AS n FROM tasks_v GROUP BY ALL
UNION ALL SELECT 'pilot', state, 'pmgr.0000', count(*) FROM pilots_v GROUP BY ALL
UNION ALL SELECT 'tmgr', concat('tmgr.000', CAST(k AS VARCHAR(20))), concat('{"bulk":', CAST(k AS VARCHAR(20)), '}'), 1 FROM range(4) t(k)
UNION ALL VALUES ('pmgr', 'pmgr.0000', '{}', 1), ('session', 's0', '{"base":"/r","n":3}', 1)""")

add("S4_task_ids",
    lambda s, p: d.session_with_task_ids(view(s, p, "pilots_v").select("uid", "resource").union(
                                             s.sql("SELECT 'pilot.none', 'no tasks'")), view(s, p, "tasks_v"), 100)
    .select("uid", "resource", "chunk", F.array_join("task_ids", ",").alias("task_ids")),
    """WITH n AS (SELECT pilot, uid, (row_number() OVER (PARTITION BY pilot ORDER BY uid) - 1) // 100 AS chunk
  FROM tasks_v),
c AS (SELECT pilot, chunk, string_agg(uid, ',' ORDER BY uid) AS ids FROM n GROUP BY 1, 2)
SELECT p.uid, p.resource, coalesce(c.chunk, 0) AS chunk, coalesce(c.ids, '') AS task_ids
FROM (SELECT uid, resource FROM pilots_v UNION ALL SELECT 'pilot.none', 'no tasks') p LEFT JOIN c ON c.pilot = p.uid""")


def tables(s, p):
    """Tables of a session: managers by nation key, pilots and tasks of the views."""
    n = table(s, p, "nation")
    region = lambda c, prefix: F.concat(F.lit(prefix), (F.col(c) % 5).cast("string"))
    return {
        "session": s.range(1).select(F.lit("s0").alias("uid"), F.lit("{}").alias("cfg")),
        "pmgr": n.select(region("n_regionkey", "pmgr.").alias("uid"), F.lit("{}").alias("cfg"), F.lit("s0").alias("sid")).distinct(),
        "tmgr": n.select(region("n_regionkey", "tmgr.").alias("uid"), F.lit("{}").alias("cfg"), F.lit("s0").alias("sid")).distinct(),
        "pilot": view(s, p, "pilots_v").select("uid", region("pos", "pmgr.").alias("pmgr"), F.struct(
            F.col("cores_per_node").alias("cores_per_node")).alias("resource_details"), F.struct("resource").alias("description")),
        "task": view(s, p, "tasks_v").select(
            "uid", region("priority", "tmgr.").alias("tmgr"), F.when(F.col("priority") > 1, F.col("pilot")).alias("pilot"),
            F.when(F.col("ranks") == 4, "raptor.task").otherwise("task").alias("etype"),
            F.struct(F.col("ranks").alias("cpu")).alias("resources")),
    }


add("J2_entity_nodes",
    lambda s, p: d.entity_tree(tables(s, p))[0].select("uid", "etype", F.array_join("has", ",").alias("has"), "resources"),
    """SELECT 's0' AS uid, 'session' AS etype, 'tmgr,pmgr' AS has, NULL AS resources
UNION ALL SELECT DISTINCT concat('pmgr.', CAST(n_regionkey % 5 AS VARCHAR(20))), 'pmgr', 'pilot', NULL FROM nation
UNION ALL SELECT DISTINCT concat('tmgr.', CAST(n_regionkey % 5 AS VARCHAR(20))), 'tmgr', 'task', NULL FROM nation
UNION ALL SELECT uid, 'pilot', 'task', '{"cores_per_node":8}' FROM pilots_v
UNION ALL SELECT uid, CASE WHEN ranks = 4 THEN 'raptor.task' ELSE 'task' END, '', concat('{"cpu":', CAST(ranks AS VARCHAR(20)), '}')
FROM tasks_v WHERE priority > 1""")
_EDGES = """edges AS (SELECT DISTINCT 's0' AS parent, concat('pmgr.', CAST(n_regionkey % 5 AS VARCHAR(20))) AS child FROM nation
UNION ALL SELECT DISTINCT 's0', concat('tmgr.', CAST(n_regionkey % 5 AS VARCHAR(20))) FROM nation
UNION ALL SELECT concat('pmgr.', CAST(pos % 5 AS VARCHAR(20))), uid FROM pilots_v
UNION ALL SELECT concat('tmgr.', CAST(priority % 5 AS VARCHAR(20))), uid FROM tasks_v
UNION ALL SELECT pilot, uid FROM tasks_v WHERE priority > 1)"""
add("J2_entity_edges", lambda s, p: d.entity_tree(tables(s, p))[1], f"WITH {_EDGES} SELECT parent, child FROM edges")
add("L5_children",
    lambda s, p: d.children(d.entity_tree(tables(s, p))[1], 500).select(
        "parent", "chunk", F.array_join("children", ",").alias("children")),
    f"""WITH {_EDGES}, n AS (SELECT parent, child, (row_number() OVER (PARTITION BY parent ORDER BY child) - 1) // 500 AS chunk FROM edges)
SELECT parent, chunk, string_agg(child, ',' ORDER BY child) AS children FROM n GROUP BY 1, 2""")


def written(s, p):
    path = fresh_path(s, "session")
    d.write_session({"task": view(s, p, "tasks_v").withColumn("sid", F.lit("s0")),
                     "pilot": view(s, p, "pilots_v").withColumn("sid", F.lit("s0"))}, path, "json")
    return d.read_tables(s, path, ["task", "pilot"], "json")["task"].groupBy("sid", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ranks").alias("ranks"))


add("S9_write_session", written,
    """SELECT 's0' AS sid, state, count(*) AS n, CAST(sum(ranks) AS BIGINT) AS ranks FROM tasks_v GROUP BY state""")


def cached(s, p):
    place = fresh_path(s, "cache")
    version = d.source_version(s, f"{p}/orders.parquet")
    build = lambda: {"task": view(s, p, "tasks_v").select("uid", "pilot")}
    d.cached_session(s, "s0", place, build, ["task"], version)

    def again():
        raise RuntimeError("the cache was not used")

    return d.cached_session(s, "s0", place, again, ["task"], version)["task"].select("uid", "pilot")


add("S10_cached_session", cached, "SELECT uid, pilot FROM tasks_v")

add("S15_inventory_sort",
    lambda s, p: d.session_inventory({"pilot": view(s, p, "pilots_v"), "task": view(s, p, "tasks_v")}, "sort"),
    "SELECT 'pilot' AS etype, uid FROM pilots_v UNION ALL SELECT 'task', uid FROM tasks_v")
_TASK_KEYS = ["uid", "pilot", "state", "ranks"]
_PICK = "CASE key " + " ".join(f"WHEN '{k}' THEN CAST({k} AS VARCHAR)" for k in _TASK_KEYS) + " END"
for _mode in ("tree", "dump"):
    add(f"S15_inventory_{_mode}",
        lambda s, p, mode=_mode: d.session_inventory({"task": view(s, p, "tasks_v").select(
            "uid", "pilot", F.when(F.col("state") != "DONE", F.col("state")).alias("state"), "ranks")}, mode),
        f"""WITH t AS (SELECT uid, pilot, CASE WHEN state <> 'DONE' THEN state END AS state, ranks FROM tasks_v),
x AS (SELECT 'task' AS etype, uid, key, {_PICK} AS value FROM t CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in _TASK_KEYS)}) AS k(key))
SELECT etype, uid, key{', value' if _mode == 'dump' else ''} FROM x WHERE value IS NOT NULL""")


# ---- tool logs -------------------------------------------------------------
_EVENTS = ["INIT_DONE", "PENDING ALLOCATION", "RUNNING", "STATE TERMINATED"]


def log_lines(s, p):
    """Log lines from line items; some without an event, some about other things."""
    li = table(s, p, "lineitem")
    time = F.format_string("%d.%06d", F.col("l_orderkey") + 1500000000, F.col("l_partkey"))
    tool = F.concat(F.lit("33357,"), (F.col("l_orderkey") % 50).cast("string"))
    state = F.element_at(F.array(*[F.lit(e) for e in _EVENTS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    head = F.concat(F.lit("DEBUG : output: [batch"), (F.col("l_suppkey") % 9).cast("string"), F.lit(":80017] [[33357,0],0] ["), time,
                    F.lit("] ACTIVATE "))
    value = (F.when(F.col("l_quantity") > 45, F.concat(head, F.lit("NOTHING")))
             .when(F.col("l_quantity") < 5, F.lit("other text"))
             .when(F.col("l_returnflag") == "A", F.concat(head, F.lit("PROC [["), tool, F.lit("],3] STATE "), state, F.lit(" AT a.c:1")))
             .otherwise(F.concat(head, F.lit("JOB ["), tool, F.lit("] STATE "), state, F.lit(" AT a.c:1"))))
    return li.select(F.concat(F.lit("pilot.000"), (F.col("l_suppkey") % 5).cast("string")).alias("pid"), value.alias("value"))


def idmap_lines(s, p):
    o = table(s, p, "orders")
    return o.select((F.col("o_orderkey")).alias("pos"), F.concat(
        F.lit("x PRTE IDMAP: 33357,"), (F.col("o_orderkey") % 40).cast("string"), F.lit(":task."), F.col("o_orderkey").cast("string"),
        F.lit("  ")).alias("value"))


_IDMAP = """ids AS (SELECT concat('33357,', CAST(o_orderkey % 40 AS VARCHAR(20))) AS tool_id,
  concat('task.', CAST(max(o_orderkey) AS VARCHAR(20))) AS uid FROM orders GROUP BY 1)"""
add("S6_log_idmap", lambda s, p: logs.log_idmap(idmap_lines(s, p), ["pos"]), f"WITH {_IDMAP} SELECT tool_id, uid FROM ids")


def through_files(s, p):
    path = fresh_path(s, "logs")
    log_lines(s, p).write.partitionBy("pid").text(path)
    lines = read_lines(s, path).withColumn("pid", F.regexp_extract("file", "pid=([^/]+)", 1))
    return logs.log_to_events(lines, logs.log_idmap(idmap_lines(s, p), ["pos"]))


_LOG = f"""{_IDMAP}, l AS (SELECT *, concat('33357,', CAST(l_orderkey % 50 AS VARCHAR(20))) AS tool_id FROM lineitem
  WHERE l_quantity BETWEEN 5 AND 45)"""
add("S5_log_events",
    lambda s, p: through_files(s, p)[0].select("time", "event", "thread", "uid", "state", "msg"),
    f"""WITH {_LOG} SELECT CAST(concat(CAST(l_orderkey + 1500000000 AS VARCHAR(20)), '.', lpad(CAST(l_partkey AS VARCHAR(20)), 6, '0')) AS DOUBLE) AS time,
  ['prte_init_done', 'prte_pending_allocation', 'prte_running', 'prte_terminated'][l_linenumber % 4 + 1] AS event,
  '33357.0.0' AS thread, coalesce(ids.uid, concat('pilot.000', CAST(l_suppkey % 5 AS VARCHAR(20)))) AS uid, 'AGENT_EXECUTING' AS state,
  concat('batch', CAST(l_suppkey % 9 AS VARCHAR(20)), ':80017') AS msg FROM l LEFT JOIN ids USING (tool_id)""")
add("S5_log_rejects",
    lambda s, p: through_files(s, p)[1].groupBy("pid", "reason").agg(F.count(F.lit(1)).alias("n")),
    """SELECT concat('pilot.000', CAST(l_suppkey % 5 AS VARCHAR(20))) AS pid, 'no event in line' AS reason, count(*) AS n
FROM lineitem WHERE l_quantity > 45 GROUP BY 1""")
add("J5_tool_ids",
    lambda s, p: through_files(s, p)[0].groupBy("uid").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {_LOG} SELECT coalesce(ids.uid, concat('pilot.000', CAST(l_suppkey % 5 AS VARCHAR(20)))) AS uid, count(*) AS n
FROM l LEFT JOIN ids USING (tool_id) GROUP BY 1""")


# ---- host lists ------------------------------------------------------------
def host_lines(s, p):
    o = table(s, p, "orders")
    host = F.concat(F.lit("node"), F.lpad((F.col("o_custkey") % 37).cast("string"), 3, "0"))
    bad = (F.col("o_orderkey") % 60 == 7) & (F.col("o_custkey") % 37 == 5)
    return o.select((F.col("o_orderkey") % 60).alias("job"), F.col("o_orderkey").alias("pos"),
                    F.when(bad, F.concat(host, F.lit(" slots=2"))).otherwise(host).alias("value"))


_HOSTS = """h AS (SELECT o_orderkey % 60 AS job, concat('node', lpad(CAST(o_custkey % 37 AS VARCHAR(20)), 3, '0')) AS host,
  count(*) AS n, min(o_orderkey) AS pos FROM orders WHERE NOT (o_orderkey % 60 = 7 AND EXISTS (
    SELECT 1 FROM orders b WHERE b.o_orderkey % 60 = 7 AND b.o_custkey % 37 = 5)) GROUP BY 1, 2)"""
add("S7_host_slots", lambda s, p: logs.host_slots(host_lines(s, p), smt=2).select("job", "host", "slots"),
    f"WITH {_HOSTS} SELECT job, host, n * 2 AS slots FROM h")
add("S7_host_slots_cpn", lambda s, p: logs.host_slots(host_lines(s, p), cpn=42, smt=4).select("job", "host", "slots"),
    f"WITH {_HOSTS} SELECT job, host, CAST(168 AS BIGINT) AS slots FROM h")
add("S8_host_shapes",
    lambda s, p: logs.host_shapes(logs.host_slots(host_lines(s, p)), gpn=2, lfs=10, mem=20).select(
        "job", "name", "index", F.size("cores").alias("cores"), F.size("gpus").alias("gpus"), "lfs", "mem"),
    f"""WITH {_HOSTS} SELECT job, host AS name, CAST(row_number() OVER (PARTITION BY job ORDER BY pos) - 1 AS INT) AS index,
  CAST(n AS INT) AS cores, 2 AS gpus, CAST(10 AS BIGINT) AS lfs, CAST(20 AS BIGINT) AS mem FROM h""")


# ---- task outputs ----------------------------------------------------------
add("S13_shown_text",
    lambda s, p: table(s, p, "documents").select("doc_id", logs.shown_text(
        F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("ff00fe"))).otherwise(F.encode("text", "utf-8")),
        F.lit("stdout")).alias("text")),
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'task stdout is binary -- use file staging'
  WHEN length(text) > 1024 THEN concat('[... CONTENT SHORTENED ...]', chr(10), right(text, 1024)) ELSE coalesce(text, '') END AS text
FROM documents""")


def output_files(s, p):
    """Folders of tasks as a run leaves them: one output of each text, file names as `.ofiles`."""
    path = fresh_path(s, "outputs")
    texts = table(s, p, "documents").select(
        F.concat(F.lit("task."), F.col("doc_id").cast("string")).alias("uid"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("ff00fe"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("out"))

    def write(rows):
        system, root = ranges.opened(path)
        for uid, text, out in rows:
            system.create_dir(f"{root}/{uid}", recursive=True)
            for kind, data in (("out", bytes(out)), ("err", text[:2000].encode()), ("ofiles", f"{uid}.a \n{uid}.b\n".encode())):
                with system.open_output_stream(f"{root}/{uid}/{uid}.{kind}") as f:
                    f.write(data)

    texts.repartition(8).foreachPartition(write)
    return path


add("S13_collected_outputs", lambda s, p: logs.collect_outputs(s, output_files(s, p))[0],
    """WITH d AS (SELECT concat('task.', CAST(doc_id AS VARCHAR(20))) AS uid, doc_id, coalesce(text, '') AS out, left(coalesce(text, ''), 2000) AS err FROM documents),
t AS (SELECT uid, doc_id, 'stdout' AS stream, out AS text FROM d UNION ALL SELECT uid, 1, 'stderr', err FROM d)
SELECT uid, stream, CASE WHEN doc_id % 7 = 0 THEN 'task stdout is binary -- use file staging'
  WHEN length(text) > 1024 THEN concat('[... CONTENT SHORTENED ...]', chr(10), right(text, 1024)) ELSE text END AS text FROM t""")
add("S13_output_lists", lambda s, p: logs.collect_outputs(s, output_files(s, p))[1],
    """SELECT concat('task.', CAST(doc_id AS VARCHAR(20))) AS uid, CAST(pos AS INT) AS pos, concat('task.', CAST(doc_id AS VARCHAR(20)), name) AS file
FROM documents, (VALUES (0, '.a'), (1, '.b')) AS n(pos, name)""")
