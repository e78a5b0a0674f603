"""Descriptions, staging, assignment, audits and statistics."""

from pyspark.sql import functions as F

from suite import usage
from suite.views import slots_in_place, sql, table, view
from taskscope import schema
from taskscope.functions import slots as sl
from taskscope.functions import text as tx
from taskscope.operators import assign, audit, staging, stats
from taskscope.operators import usage as u
from taskscope.operators import workload as w
from taskscope.operators.durations import session_timing
from taskscope.session import fresh_path

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


def uid_col(prefix, column, width):
    return F.concat(F.lit(prefix + "."), F.lpad(F.col(column).cast("string"), width, "0"))


def sql_list(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


# ---- selections ------------------------------------------------------------
add("P2_entities",
    lambda s, p: w.entities(w.with_etype(view(s, p, "descriptions_v")), etype=["task", "raptor.master"])
    .groupBy("etype").agg(F.count(F.lit(1)).alias("n")),
    """SELECT etype, count(*) AS n FROM (SELECT CASE WHEN mode = 'raptor.master' THEN mode
  WHEN mode = 'task.executable' THEN 'task' ELSE 'raptor.task' END AS etype FROM descriptions_v)
WHERE etype IN ('task', 'raptor.master') GROUP BY 1""")
add("P3_get_by_uid",
    lambda s, p: w.get_by_uid(view(s, p, "tasks_v"), table(s, p, "orders").filter("o_custkey % 10 = 3")
                              .select(uid_col("task", "o_orderkey", 9).alias("uid"))).select("uid", "pilot", "state"),
    """SELECT uid, pilot, state FROM tasks_v WHERE uid IN (
SELECT concat('task.', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) FROM orders WHERE o_custkey % 10 = 3)""")
add("P7_drop_cancelled",
    lambda s, p: w.drop_cancelled(view(s, p, "tasks_v"), view(s, p, "tasks_v").filter("priority = 2"),
                                  needed=F.col("gpus_per_rank") > 0).select("uid", "priority"),
    "SELECT uid, priority FROM tasks_v WHERE priority <> 2 OR gpus_per_rank > 0")
add("U3_waiting",
    lambda s, p: w.waiting(view(s, p, "tasks_v").select("uid"), view(s, p, "slots_v").select("uid").distinct()),
    "SELECT uid FROM tasks_v WHERE uid NOT IN (SELECT uid FROM slots_v)")
add("P8_etype",
    lambda s, p: w.with_etype(view(s, p, "descriptions_v").withColumn(
        "etype", F.when(F.col("ranks") == 3, "own"))).select("uid", "mode", "etype"),
    """SELECT uid, mode, CASE WHEN ranks = 3 THEN 'own' WHEN mode IN ('raptor.master', 'raptor.worker') THEN mode
WHEN mode = 'task.executable' THEN 'task' ELSE 'raptor.task' END AS etype FROM descriptions_v""")
add("P9_resources",
    lambda s, p: w.with_resources(view(s, p, "tasks_v")).select("uid", "resources.cpu", "resources.gpu"),
    """SELECT uid, CAST(ranks * cores_per_rank AS DOUBLE) AS cpu, CAST(ranks * gpus_per_rank AS DOUBLE) AS gpu FROM tasks_v""")
add("P10_pilot_size",
    lambda s, p: w.with_pilot_size(view(s, p, "pilot_requests_v")).select("uid", "cores", "gpus", "error"),
    """SELECT uid, CASE WHEN nodes > 0 AND cores = 0 AND cores_per_node > 0 THEN nodes * cores_per_node ELSE cores END AS cores,
  CASE WHEN nodes > 0 AND gpus = 0 THEN nodes * gpus_per_node ELSE gpus END AS gpus,
  CASE WHEN nodes > 0 AND cores = 0 AND cores_per_node = 0 THEN 'cores_per_node is missing' END AS error
FROM pilot_requests_v""")
add("P11_required_nodes",
    lambda s, p: w.required_nodes(view(s, p, "pilot_requests_v").withColumns({
        "blocked_cores": F.when(F.col("gpus_per_node") == 1, F.array(F.lit(0), F.lit(1))),
        "blocked_gpus": F.array().cast("array<int>")}))
    .select("uid", "free_cores", "free_gpus", "nodes"),
    """WITH f AS (SELECT *, cores_per_node - CASE WHEN gpus_per_node = 1 THEN 2 ELSE 0 END AS fc FROM pilot_requests_v)
SELECT uid, fc AS free_cores, gpus_per_node AS free_gpus, CASE WHEN nodes > 0 THEN nodes
  ELSE CAST(ceil(greatest(cores / nullif(fc, 0), gpus / nullif(gpus_per_node, 0))) AS INT) END AS nodes FROM f""")
add("P12_size",
    lambda s, p: w.with_size(view(s, p, "tasks_v")).groupBy("size").agg(F.count(F.lit(1)).alias("n")),
    "SELECT ranks * cores_per_rank * gpus_per_rank AS size, count(*) AS n FROM tasks_v GROUP BY 1")

# ---- descriptions ----------------------------------------------------------
_MODE = "coalesce(mode, 'task.executable')"
_TASK_RULES = f"""m AS (SELECT *, {_MODE} AS kind FROM descriptions_v),
r AS (SELECT uid, kind, CASE
  WHEN kind IN ('task.executable', 'task.service', 'agent.service', 'task.proc') AND executable = ''
    THEN concat(kind, ' needs ''executable''')
  WHEN kind IN ('task.eval', 'task.exec') AND code IS NULL THEN concat(kind, ' needs ''code''')
  WHEN kind = 'task.shell' AND command = '' THEN concat(kind, ' needs ''command''') END AS a,
  CASE WHEN kind IN ('task.function', 'task.method') AND function IS NULL THEN concat(kind, ' needs ''function''') END AS b,
  CASE WHEN kind IN ('task.function', 'task.method') AND named_env IS NOT NULL
    THEN concat(kind, ' does not support ''named_env''') END AS c FROM m)"""
add("P13_valid_tasks",
    lambda s, p: w.validate_tasks(view(s, p, "descriptions_v"))[0].groupBy("mode").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_TASK_RULES} SELECT kind AS mode, count(*) AS n FROM r WHERE coalesce(a, b, c) IS NULL GROUP BY 1")
add("P13_rejected_tasks",
    lambda s, p: w.validate_tasks(view(s, p, "descriptions_v"))[1].select(
        "uid", "mode", F.concat_ws("; ", "reasons").alias("reasons")),
    f"""WITH {_TASK_RULES} SELECT uid, kind AS mode, concat_ws('; ', a, b, c) AS reasons
FROM r WHERE coalesce(a, b, c) IS NOT NULL""")
add("P14_migrate_tasks",
    lambda s, p: w.migrate_tasks(view(s, p, "descriptions_v")).select(
        "uid", "ranks", "cores_per_rank", "gpus_per_rank", "raptor_id", "raptor_class", "use_mpi",
        "cpu_processes", "cpu_threads", "gpu_processes", "scheduler", "worker_class"),
    """WITH m AS (SELECT *, CASE WHEN cpu_processes > 0 THEN cpu_processes ELSE ranks END AS n FROM descriptions_v)
SELECT uid, n AS ranks, CASE WHEN cpu_threads > 0 THEN cpu_threads ELSE cores_per_rank END AS cores_per_rank,
  CASE WHEN gpu_processes > 0 THEN CAST(gpu_processes AS DOUBLE) ELSE gpus_per_rank END AS gpus_per_rank,
  CASE WHEN scheduler <> '' THEN scheduler ELSE raptor_id END AS raptor_id,
  CASE WHEN worker_class <> '' THEN worker_class ELSE raptor_class END AS raptor_class, n > 1 AS use_mpi,
  0 AS cpu_processes, 0 AS cpu_threads, 0 AS gpu_processes, '' AS scheduler, '' AS worker_class FROM m""")
_PILOT_RULES = """r AS (SELECT uid, concat_ws('; ', CASE WHEN resource = '' THEN 'needs ''resource''' END,
  CASE WHEN backup_nodes > 0 AND nodes = 0 THEN '''backup_nodes'' needs ''nodes''' END,
  CASE WHEN nodes = 0 AND cores = 0 THEN 'needs ''nodes'' or ''cores''' END,
  CASE WHEN nodes > 0 AND cores > 0 THEN '''nodes'' excludes ''cores''' END,
  CASE WHEN nodes > 0 AND gpus > 0 THEN '''nodes'' excludes ''gpus''' END) AS reasons FROM pilot_requests_v)"""
add("P15_valid_pilots", lambda s, p: w.validate_pilots(view(s, p, "pilot_requests_v"))[0].select("uid"),
    f"WITH {_PILOT_RULES} SELECT uid FROM r WHERE reasons = ''")
add("P15_rejected_pilots",
    lambda s, p: w.validate_pilots(view(s, p, "pilot_requests_v"))[1].select(
        "uid", F.concat_ws("; ", "reasons").alias("reasons")),
    f"WITH {_PILOT_RULES} SELECT uid, reasons FROM r WHERE reasons <> ''")
add("S14_overrides",
    lambda s, p: w.apply_overrides(view(s, p, "tasks_v"), {"ranks": 7}).select("uid", "ranks", "cores_per_rank"),
    "SELECT uid, 7 AS ranks, cores_per_rank FROM tasks_v")


def override_file(s, p):
    """A file with as many ranks as there are regions, over several lines."""
    path = fresh_path(s, "overrides")
    (table(s, p, "region").agg(F.count(F.lit(1)).alias("n"))
     .select(F.format_string("{\n  \"ranks\": %d\n}", "n").alias("value")).write.text(path))
    return path


add("S14_override_file",
    lambda s, p: w.apply_overrides(view(s, p, "tasks_v"), w.read_overrides(s, override_file(s, p)))
    .select("uid", "ranks", "cores_per_rank"),
    "SELECT uid, CAST((SELECT count(*) FROM region) AS INT) AS ranks, cores_per_rank FROM tasks_v")
add("S14_no_override_file",
    lambda s, p: w.apply_overrides(view(s, p, "tasks_v"), w.read_overrides(s, fresh_path(s, "none")))
    .select("uid", "ranks", "cores_per_rank"),
    "SELECT uid, ranks, cores_per_rank FROM tasks_v")


def old_slots(s, p, pairs):
    """Slots per task and node from line items, indexes as numbers or pairs."""
    rows = view(s, p, "slots_v")
    if pairs:
        item = F.array(F.col("core").cast("double"), F.lit(0.5))
    else:
        item = F.col("core")
    slot = rows.groupBy("uid", "node_index").agg(F.sort_array(F.collect_set(item)).alias("cores"))
    packed = F.struct("cores", F.col("cores").alias("gpus"), F.lit(0).cast("long").alias("lfs"),
                      F.lit(None).cast("long").alias("mem"), "node_index",
                      F.concat(F.lit("n"), F.col("node_index").cast("string")).alias("node_name"))
    return slot.select("uid", F.array(packed).alias("slots"))


for _name, _pairs, _share in (("P19_slots_from_index", False, "1.0"), ("P19_slots_from_pairs", True, "0.5")):
    add(_name, lambda s, p, pairs=_pairs: sl.slots_to_new(old_slots(s, p, pairs)).select(
        "uid", F.inline("slots")).select("uid", "node_index", "node_name", "version", F.inline("cores")),
        f"""SELECT uid, node_index, concat('n', CAST(node_index AS VARCHAR(20))) AS node_name, 1 AS version,
  core AS index, CAST({_share} AS DOUBLE) AS occupation FROM slots_v""")
add("P19_slots_to_old",
    lambda s, p: sl.slots_to_old(sl.slots_to_new(old_slots(s, p, False))).select(
        "uid", F.inline("slots")).select("uid", "node_index", "lfs", "mem", F.array_join(F.flatten("cores"), ",").alias("cores")),
    """SELECT uid, node_index, CAST(0 AS BIGINT) AS lfs, CAST(0 AS BIGINT) AS mem,
  string_agg(CAST(core AS VARCHAR(20)), ',' ORDER BY core) AS cores FROM slots_v GROUP BY uid, node_index""")


def requirement(df, cores):
    return F.struct(F.expr(cores).alias("n_cores"), F.col("gpus_per_rank").alias("n_gpus"),
                    F.col("priority").alias("lfs"), F.lit(0).alias("mem"),
                    F.lit(1.0).alias("core_occupation"), F.lit(1.0).alias("gpu_occupation"))


add("F14_dominates",
    lambda s, p: (lambda t: t.select("bag_order", sl.compare(
        requirement(t, "cores_per_rank"), F.struct(
            F.lit(2).alias("n_cores"), F.lit(1).alias("n_gpus"), F.col("ranks").alias("lfs"), F.lit(0).alias("mem"),
            F.lit(1.0).alias("core_occupation"), F.lit(1.0).alias("gpu_occupation"))).alias("c"))
        .groupBy("bag_order", "c.le", "c.ge", "c.eq").agg(F.count(F.lit(1)).alias("n")))(view(s, p, "tasks_v")),
    """SELECT bag_order, cores_per_rank <= 2 AND gpus_per_rank <= 1 AND priority <= ranks AS le,
  cores_per_rank >= 2 AND gpus_per_rank >= 1 AND priority >= ranks AS ge,
  cores_per_rank = 2 AND gpus_per_rank = 1 AND priority = ranks AS eq, count(*) AS n FROM tasks_v GROUP BY ALL""")

# ---- staging ---------------------------------------------------------------
for _phase, _actions in schema.PHASE_ACTIONS.items():
    add(f"P16_actionable_{_phase}",
        lambda s, p, phase=_phase: staging.actionable(view(s, p, "directives_v"), phase).select("page_id", "action"),
        f"SELECT page_id, action FROM directives_v WHERE action IN {sql_list(_actions)}")
add("P17_output_staging",
    lambda s, p: staging.needs_output_staging(view(s, p, "tasks_v").withColumns({
        "target_state": F.col("state"), "stage_on_error": F.when(F.col("priority") < 4, F.col("priority") == 1)}))
    .select("uid", "state"),
    "SELECT uid, state FROM tasks_v WHERE state = 'DONE' OR priority = 1")
add("F2_parse_directive",
    lambda s, p: view(s, p, "directives_v").select("page_id", tx.parse_directive(F.col("directive")).alias("d"))
    .select("page_id", "d.*"),
    r"""SELECT page_id, url AS source, CASE page_id % 3 WHEN 0 THEN regexp_extract(regexp_replace(
  regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1)
  ELSE concat('p', CAST(page_id AS VARCHAR(20)), '.html') END AS target FROM pages""")


def as_objects(s, p):
    d = view(s, p, "directives_v").join(table(s, p, "pages").select("page_id", "url"), "page_id")
    obj = F.to_json(F.struct(
        F.when(F.col("page_id") % 10 != 4, F.col("url")).alias("source"), F.lit("x.dat").alias("target"),
        F.col("action"), F.when(F.col("page_id") % 20 != 4, F.col("flags").cast("int")).alias("flags"),
        F.when(F.col("page_id") % 14 == 6, 1).alias("mode")))
    return d.withColumn("directive", F.when(F.col("page_id") % 2 == 0, obj).otherwise(F.col("directive")))


add("F3_expand_directives",
    lambda s, p: staging.expand_directives(as_objects(s, p), keys=("uid", "page_id")).select(
        "page_id", "sd_uid", "target", "action", "flags", "priority", "error"),
    r"""SELECT page_id, concat('sd.', sha256(concat(uid, '/', CAST(page_id AS VARCHAR(20))))) AS sd_uid,
  CASE WHEN page_id % 2 = 0 THEN 'x.dat' WHEN page_id % 3 = 0 THEN regexp_extract(regexp_replace(regexp_replace(
    directive, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1)
    ELSE concat('p', CAST(page_id AS VARCHAR(20)), '.html') END AS target,
  CASE WHEN page_id % 2 = 0 THEN action ELSE 'Transfer' END AS action,
  CAST(CASE WHEN page_id % 2 = 0 AND page_id % 20 <> 4 THEN flags ELSE 2 END AS INT) AS flags, 0 AS priority,
  CASE WHEN page_id % 14 = 6 THEN 'invalid key: mode' WHEN page_id % 10 = 4 THEN 'no source' END AS error
FROM directives_v""")

# urls with each kind of schema
_URLS = """concat(CASE page_id % 6 WHEN 0 THEN 'task:///' WHEN 1 THEN 'pilot:///' WHEN 2 THEN '/' WHEN 3 THEN ''
  WHEN 4 THEN 'client://host/' ELSE 'ftp://far/' END, 'd/p', CAST(page_id AS VARCHAR(20)), '.html')"""
add("F4_complete_url",
    lambda s, p: table(s, p, "pages").select("page_id", tx.complete_url(F.expr(_URLS), F.create_map(
        F.lit("task"), F.lit("file://local/t/"), F.lit("pilot"), F.lit("sftp://far/p"), F.lit("pwd"), F.lit("file:///w"),
        F.lit("client"), F.lit("file:///c"), F.lit("file"), F.lit("file:///"))).alias("u")).select("page_id", "u.*"),
    """WITH n AS (SELECT page_id, concat('d/p', CAST(page_id AS VARCHAR(20)), '.html') AS f FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('file://local/t/', f) WHEN 1 THEN concat('sftp://far/p/', f)
  WHEN 2 THEN concat('file:///', f) WHEN 3 THEN concat('file:///w/', f) WHEN 5 THEN concat('ftp://far/', f) END AS url,
  CASE WHEN page_id % 6 = 4 THEN 'urls cannot specify a host for expanded schemas' END AS error FROM n""")
add("F5_default_target",
    lambda s, p: table(s, p, "pages").select("page_id", tx.default_target(
        F.col("url"), F.expr("CASE page_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'a.dat' END")).alias("target")),
    r"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'a.dat' ELSE concat('task:///', regexp_extract(regexp_replace(
  regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1)) END AS target FROM pages""")
add("F6_flags",
    lambda s, p: view(s, p, "directives_v").select("page_id", *[
        tx.has_flag(F.col("flags"), bit).alias(name) for name, bit in schema.FLAGS.items()]),
    """SELECT page_id, (flags & 1) <> 0 AS recursive, (flags & 2) <> 0 AS create_parents, (flags & 4) <> 0 AS non_fatal
FROM directives_v""")


def sources(s, p):
    d = view(s, p, "directives_v")
    return d.select("uid", F.concat(F.lit("client:///"), F.col("page_id").cast("string")).alias("source"),
                    F.concat(F.lit("task:///"), F.col("page_id").cast("string")).alias("target"), "action",
                    F.col("flags").cast("int").alias("flags"))


_SOURCES = """d AS (SELECT uid, concat('client:///', CAST(page_id AS VARCHAR(20))) AS source,
  concat('task:///', CAST(page_id AS VARCHAR(20))) AS target, action, CAST(flags AS INT) AS flags FROM directives_v)"""
add("A18_tarballs", lambda s, p: staging.group_tarballs(sources(s, p))[0],
    f"""WITH {_SOURCES}, t AS (SELECT DISTINCT uid FROM d WHERE action = 'Tarball')
SELECT * FROM d WHERE action <> 'Tarball' UNION ALL SELECT uid, concat('file://localhost/', uid, '.tar'),
  concat('task:///', uid, '.tar'), action, 2 FROM t CROSS JOIN (VALUES ('Transfer'), ('Tarball')) AS a(action)""")
add("A18_tarball_members", lambda s, p: staging.group_tarballs(sources(s, p))[1],
    f"WITH {_SOURCES} SELECT uid, concat(uid, '.tar') AS tarball, source, target FROM d WHERE action = 'Tarball'")
add("A17_bulk_groups",
    lambda s, p: staging.bulk_groups(view(s, p, "tasks_v"), 600)
    .groupBy("pilot", "bulk").agg(F.count(F.lit(1)).alias("n")),
    "SELECT pilot, count(*) >= 600 AS bulk, count(*) AS n FROM tasks_v GROUP BY pilot")


def sandboxes(s, p):
    t = view(s, p, "tasks_v").withColumns({
        "client_sandbox": F.lit("file:///home"), "task_sandbox": F.concat(F.lit("file:///s/"), "pilot", F.lit("/"), "uid")})
    q = view(s, p, "pilots_v").withColumns({
        "endpoint_fs": F.concat(F.lit("sftp://"), F.lower(F.replace("resource", F.lit(" "), F.lit("-")))),
        "resource_sandbox": F.lit("file:///r"), "session_sandbox": F.lit("file:///r/s0"),
        "pilot_sandbox": F.concat(F.lit("file:///r/s0/"), "uid")})
    return t, q


add("J11_sandbox_context",
    lambda s, p: staging.sandbox_context(*sandboxes(s, p)).select(
        "uid", *[F.col("context")[k].alias(k) for k in ("client", "task", "pilot", "session", "endpoint")]),
    """SELECT t.uid, 'file:///home' AS client, concat('file:///s/', t.pilot, '/', t.uid) AS task,
  concat('file:///r/s0/', p.uid) AS pilot, 'file:///r/s0' AS session,
  concat('sftp://', lower(replace(p.resource, ' ', '-'))) AS endpoint
FROM tasks_v t JOIN pilots_v p ON p.uid = t.pilot""")
add("J11_complete_directives",
    lambda s, p: staging.complete_directives(
        staging.sandbox_context(*sandboxes(s, p)).withColumns({
            "source": F.concat(F.lit("client:///in/"), "uid"), "target": F.lit("pilot:///shared.dat")}),
        F.col("context"), F.col("context")).select("uid", "source", "target", "error"),
    """SELECT t.uid, concat('file:///home/in/', t.uid) AS source, concat('file:///r/s0/', t.pilot, '/shared.dat') AS target,
  CAST(NULL AS VARCHAR) AS error FROM tasks_v t JOIN pilots_v p ON p.uid = t.pilot""")

# ---- assignment ------------------------------------------------------------
PILOT_NAMES = [f"pilot.{i:04d}" for i in range(7)]
add("W13_round_robin",
    lambda s, p: assign.assign_round_robin(
        view(s, p, "tasks_v").withColumn("pilot", F.when(F.col("priority") == 3, F.col("pilot"))),
        PILOT_NAMES).select("uid", "pilot"),
    """SELECT uid, CASE WHEN priority = 3 THEN pilot ELSE concat('pilot.', lpad(CAST((row_number() OVER (
  PARTITION BY priority = 3 ORDER BY uid) - 1) % 7 AS VARCHAR(20)), 4, '0')) END AS pilot FROM tasks_v""")
add("F15_with_uid",
    lambda s, p: assign.with_uid(view(s, p, "tasks_v").withColumns({
        "was": F.col("uid"), "uid": F.when(F.col("priority") != 3, F.col("uid"))}), ["was"]).select("uid", "was"),
    """SELECT CASE WHEN priority <> 3 THEN uid ELSE printf('task.%06d', row_number() OVER (PARTITION BY priority = 3 ORDER BY uid)
  + (SELECT max(CAST(substr(uid, 6) AS BIGINT)) FROM tasks_v WHERE priority <> 3)) END AS uid, uid AS was FROM tasks_v""")
add("W14_capacity_one",
    lambda s, p: assign.assign_capacity(view(s, p, "tasks_v").drop("pilot"), [("p", 1000, 100)])
    .select("uid", "pilot"),
    """WITH c AS (SELECT uid, sum(ranks * cores_per_rank) OVER (ORDER BY uid) - ranks * cores_per_rank AS before FROM tasks_v)
SELECT uid, CASE WHEN before < 1900 THEN 'p' END AS pilot FROM c""")
# targets one after the other: each starts where the one before has overshot
add("W14_capacity",
    lambda s, p: assign.assign_capacity(
        view(s, p, "tasks_v").drop("pilot"), [(f"p{i}", 300 + 50 * i, 40 * i) for i in range(8)])
    .select("uid", "pilot"),
    """WITH RECURSIVE c AS (SELECT uid, sum(ranks * cores_per_rank) OVER (ORDER BY uid) AS upto,
  ranks * cores_per_rank AS n FROM tasks_v),
k(i, begin, finish) AS (SELECT 0, 0::HUGEINT, (SELECT min(upto) FROM c WHERE upto >= 600)
  UNION ALL SELECT i + 1, finish, (SELECT min(upto) FROM c WHERE upto >= k.finish + 2 * (300 + 50 * (k.i + 1)) - 40 * (k.i + 1))
  FROM k WHERE i < 7 AND finish IS NOT NULL)
SELECT c.uid, 'p' || CAST(k.i AS VARCHAR(20)) AS pilot FROM c LEFT JOIN k
  ON c.upto - c.n >= k.begin AND c.upto - c.n < coalesce(k.finish, 1e18)""")
add("W15_used_capacity", lambda s, p: assign.used_capacity(view(s, p, "tasks_v")),
    """SELECT pilot, CAST(sum(CASE WHEN state = 'AGENT_EXECUTING' THEN ranks * cores_per_rank ELSE 0 END) AS BIGINT) AS used
FROM tasks_v GROUP BY pilot""")


def asks(s, p):
    return view(s, p, "tasks_v").withColumns({
        "lfs_per_rank": F.col("priority") * 10, "mem_per_rank": F.lit(0),
        "ranks_per_node": F.when(F.col("bag_order") == 1, 3)})


def shapes(s, p):
    return table(s, p, "part").select(
        F.col("p_partkey").alias("shape"), (F.col("p_partkey") % 9).cast("int").alias("cores"),
        (F.col("p_partkey") % 2).cast("int").alias("gpus"), (F.col("p_partkey") % 61).cast("int").alias("lfs"),
        F.lit(100).alias("mem"))


add("J6_feasible",
    lambda s, p: assign.feasible(asks(s, p), shapes(s, p)).select("uid", "n_shapes", "most_ranks"),
    """WITH a AS (SELECT *, priority * 10 AS lfs_per_rank, CASE WHEN bag_order = 1 THEN 3 END AS per_node FROM tasks_v),
s AS (SELECT p_partkey % 9 AS cores, p_partkey % 2 AS gpus, p_partkey % 61 AS lfs FROM part),
q AS (SELECT DISTINCT cores_per_rank, gpus_per_rank, lfs_per_rank, per_node FROM a),
f AS (SELECT q.*, least(floor(cores / cores_per_rank), floor(gpus / nullif(gpus_per_rank, 0)),
  floor(lfs / nullif(lfs_per_rank, 0)), per_node) AS n FROM q JOIN s
  ON cores >= cores_per_rank AND gpus >= gpus_per_rank AND lfs >= lfs_per_rank),
g AS (SELECT cores_per_rank, gpus_per_rank, lfs_per_rank, per_node, count(*) AS n_shapes, CAST(max(n) AS BIGINT) AS most_ranks
  FROM f GROUP BY 1, 2, 3, 4)
SELECT a.uid, coalesce(g.n_shapes, 0) AS n_shapes, coalesce(g.most_ranks, 0) AS most_ranks FROM a LEFT JOIN g
  ON a.cores_per_rank = g.cores_per_rank AND a.gpus_per_rank = g.gpus_per_rank AND a.lfs_per_rank = g.lfs_per_rank
  AND a.per_node IS NOT DISTINCT FROM g.per_node""")
add("J7_split_bound",
    lambda s, p: assign.split_bound(
        view(s, p, "tasks_v").withColumn("pilot", F.when(F.col("priority") != 2, F.col("pilot"))),
        view(s, p, "pilots_v").filter("pos % 4 <> 1")).select("uid", "pilot", "binding"),
    """SELECT t.uid, CASE WHEN priority <> 2 THEN t.pilot END AS pilot, CASE WHEN priority = 2 THEN 'unbound'
  WHEN p.pos % 4 <> 1 THEN 'known' ELSE 'unknown' END AS binding FROM tasks_v t LEFT JOIN pilots_v p ON p.uid = t.pilot""")
add("J8_eligible_env",
    lambda s, p: assign.eligible_env(
        view(s, p, "descriptions_v"),
        table(s, p, "region").select(F.concat(F.lit("env"), F.col("r_regionkey").cast("string")).alias("named_env")))
    .select("uid", "named_env"),
    """SELECT uid, named_env FROM descriptions_v WHERE named_env IS NULL
OR named_env IN (SELECT concat('env', CAST(r_regionkey AS VARCHAR(20))) FROM region)""")
MASTERS = ["master.a", "master.b", "master.c"]


def routed(s, p):
    return assign.route(view(s, p, "descriptions_v").withColumn(
        "raptor_id", F.expr("CASE ranks WHEN 1 THEN scheduler WHEN 2 THEN '*' WHEN 3 THEN 'master.z' END")), MASTERS)


add("X17_route",
    lambda s, p: routed(s, p).select("uid", "queue"),
    """WITH a AS (SELECT uid, mode, CASE ranks WHEN 1 THEN scheduler WHEN 2 THEN '*' ELSE 'master.z' END AS id FROM descriptions_v)
SELECT uid, CASE WHEN coalesce(id, '') = '' THEN 'agent' WHEN id = 'master.a' THEN id
  WHEN id = '*' THEN ['master.a', 'master.b', 'master.c'][1 + (row_number() OVER (PARTITION BY id ORDER BY uid) - 1) % 3]
  END AS queue FROM a""")

# ---- order -----------------------------------------------------------------
for _mode, _size in (("waiting", "ranks * cores_per_rank * gpus_per_rank"), ("incoming", "ranks")):
    add(f"L2_work_order_{_mode}",
        lambda s, p, mode=_mode: w.work_order(view(s, p, "tasks_v"), mode).select("uid", "priority", "ranks"),
        f"SELECT uid, priority, ranks FROM tasks_v ORDER BY priority DESC, {_size} DESC, uid")
add("L3_due",
    lambda s, p: w.due(view(s, p, "tasks_v").withColumn("deadline", F.col("t_submit") * F.col("gpus_per_rank")), 8e8)
    .select("uid", "deadline"),
    "SELECT uid, t_submit * gpus_per_rank AS deadline FROM tasks_v WHERE gpus_per_rank = 1 AND t_submit < 8e8 ORDER BY 2, 1")

# ---- bags and audits -------------------------------------------------------
# sizes differ within the bags of every tenth customer only
_SIZE = """CASE WHEN ends_with(ns, '0') AND priority = 1 THEN 11 WHEN ends_with(ns, '7') THEN 14 ELSE 10 END"""


def bags(s, p):
    return view(s, p, "tasks_v").withColumn("size", F.expr(_SIZE.replace("ends_with", "endswith")))


add("A14_bag_status",
    lambda s, p: audit.bag_status(bags(s, p)),
    f"""WITH b AS (SELECT *, {_SIZE} AS size FROM tasks_v)
SELECT ns, count(*) AS members, min(size) AS size, CASE WHEN min(size) <> max(size) THEN 'inconsistent'
  WHEN count(*) > min(size) THEN 'over' WHEN count(*) = min(size) THEN 'complete' ELSE 'open' END AS status
FROM b GROUP BY ns""")
add("A15_bag_requirement", lambda s, p: audit.bag_requirement(view(s, p, "tasks_v")),
    """SELECT ns, 1 + CAST(sum(ranks * cores_per_rank) AS BIGINT) AS cores, CAST(sum(ranks * gpus_per_rank) AS BIGINT) AS gpus
FROM tasks_v GROUP BY ns""")
add("A16_duplicate_uids",
    lambda s, p: audit.duplicate_uids(table(s, p, "lineitem").select(uid_col("task", "l_orderkey", 9).alias("uid"))),
    """SELECT concat('task.', lpad(CAST(l_orderkey AS VARCHAR(20)), 9, '0')) AS uid, count(*) AS n
FROM lineitem GROUP BY 1 HAVING count(*) > 1""")


# bags of a supplier's items by ship year, a bag is done when all items are returned
def ordered_items(s, p):
    return table(s, p, "lineitem").select(
        F.concat(F.lit("ns."), F.col("l_suppkey").cast("string")).alias("ns"),
        (F.year("l_shipdate") - 1992).alias("bag_order"), F.lit(5).alias("size"),
        F.when(F.col("l_linestatus") == "F", F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("start"),
        F.when(F.col("l_returnflag") != "R", F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
               + F.col("l_quantity") * 86400).alias("done"))


add("W11_order_audit", lambda s, p: audit.order_audit(ordered_items(s, p)),
    """WITH i AS (SELECT concat('ns.', CAST(l_suppkey AS VARCHAR(20))) AS ns, CAST(year(l_shipdate) - 1992 AS INT) AS bag_order,
  CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate)/1e6 END AS start,
  CASE WHEN l_returnflag <> 'R' THEN epoch_us(l_shipdate)/1e6 + l_quantity * 86400 END AS done FROM lineitem),
b AS (SELECT ns, bag_order, min(start) AS start, CASE WHEN count(done) >= 5 THEN max(done) END AS done FROM i GROUP BY 1, 2),
j AS (SELECT b.ns, b.bag_order, b.start, f.ns IS NULL AS no_front, f.done AS front_done FROM b LEFT JOIN b f
  ON f.ns = b.ns AND f.bag_order = b.bag_order - 1 WHERE b.bag_order > 0 AND b.start IS NOT NULL),
r AS (SELECT *, CASE WHEN no_front THEN 'missing' WHEN front_done IS NULL THEN 'open' WHEN start < front_done THEN 'early' END AS reason FROM j)
SELECT ns, bag_order, start, front_done, reason FROM r WHERE reason IS NOT NULL""")


def tagged(s, p):
    return slots_in_place(s, p).join(view(s, p, "tasks_v").select("uid", "ns", "priority", "bag_order"), "uid").select(
        "uid", F.when(F.col("bag_order") < 3, F.col("ns")).alias("tag"), (F.col("node_index") * 8 + F.col("core")).alias("node"),
        F.col("t0").alias("start"), (F.col("bag_order") == 1).alias("whole"), (F.col("bag_order") == 2).alias("exclusive"))


_TAGGED = """t AS (SELECT uid, ns AS tag, node_index * 8 + core AS node, t0 AS start, bag_order = 1 AS whole,
  bag_order = 2 AS exclusive FROM slots_v JOIN tasks_v USING (uid) WHERE bag_order < 3)"""
add("W12_colocation_audit", lambda s, p: audit.colocation_audit(tagged(s, p)),
    f"""WITH {_TAGGED}, f AS (SELECT tag, uid FROM (SELECT tag, uid, row_number() OVER (PARTITION BY tag ORDER BY start, uid) AS k
  FROM t) WHERE k = 1), home AS (SELECT DISTINCT tag, node FROM t JOIN f USING (tag, uid))
SELECT 'moved' AS rule, tag, uid, node FROM t WHERE (tag, node) NOT IN (SELECT (tag, node) FROM home)
UNION ALL SELECT 'spread', tag, NULL, NULL FROM t WHERE whole GROUP BY tag HAVING count(DISTINCT node) > 1
UNION ALL SELECT DISTINCT 'shared', tag, NULL, node FROM t WHERE exclusive
  AND node IN (SELECT node FROM t GROUP BY node HAVING count(DISTINCT tag) > 1)""")

# ---- statistics ------------------------------------------------------------
def summary(s, p):
    return stats.pilot_summary(
        view(s, p, "tasks_v").withColumn("cores", F.when(F.col("priority") != 5, F.col("ranks") * F.col("cores_per_rank"))),
        view(s, p, "pilots_v"), view(s, p, "pilot_trace_v").withColumn(
            "uid", F.concat(F.lit("pilot.00"), F.substring("uid", -2, 2))))


_SUMMARY = """w AS (SELECT pilot, count(*) AS n_tasks, CAST(sum(CASE WHEN priority <> 5 THEN ranks * cores_per_rank ELSE 1 END)
  AS BIGINT) AS task_cores FROM tasks_v GROUP BY pilot),
l AS (SELECT concat('pilot.00', right(uid, 2)) AS pilot, min(time) FILTER (WHERE event = 'state' AND state = 'NEW') AS started,
  min(time) FILTER (WHERE event = 'state' AND state IN ('DONE', 'FAILED', 'CANCELED')) AS finished,
  max(time) FILTER (WHERE event = 'bootstrap_0_stop') - min(time) FILTER (WHERE event = 'bootstrap_0_start') AS busy
  FROM pilot_trace_v GROUP BY 1),
s AS (SELECT p.uid AS pilot, p.resource, p.cores, coalesce(n_tasks, 0) AS n_tasks, coalesce(task_cores, 0) AS task_cores,
  started, finished, busy FROM pilots_v p LEFT JOIN w ON w.pilot = p.uid LEFT JOIN l ON l.pilot = p.uid)"""
add("A6_pilot_summary", summary, f"WITH {_SUMMARY} SELECT * FROM s")


def rate(s, p):
    timing = session_timing(view(s, p, "task_trace_v"))
    return stats.task_rate(summary(s, p).withColumn("sid", F.lit("s0")), timing).select(
        "pilot", F.round("rate", 9).alias("rate"))


add("A7_task_rate", rate,
    f"""WITH {_SUMMARY}, x AS (SELECT min(time) AS t FROM task_trace_v WHERE event = 'state' AND state = 'AGENT_EXECUTING' GROUP BY uid)
SELECT pilot, round(n_tasks / nullif((SELECT max(t) - min(t) FROM x), 0), 9) AS rate FROM s""")
add("A8_utilisation", lambda s, p: stats.utilisation(summary(s, p)).select(
    "pilot", F.round("utilisation_ref", 6).alias("utilisation_ref")),
    f"""WITH {_SUMMARY} SELECT pilot, round(busy * 100 / CASE WHEN started IS NULL OR finished IS NULL THEN 1
  ELSE (finished - started) * cores END, 6) AS utilisation_ref FROM s""")


def shared_use(s, p):
    """The core-weighted utilisation of pilots of two sessions with the same ids, from what was consumed."""
    two = lambda df, *times: usage.in_two(df, *times)
    shares = u.core_time(u.consumed(*usage.two_parts(s, p)), u.provided(*usage.two_without_slots(s, p)))
    shares = shares.filter("metric = 'exec_cmd' or sid = 's1' and metric = 'exec_prep'")
    return stats.utilisation(two(summary(s, p)), shares).select(
        "sid", "pilot", F.round("utilisation_ref", 6).alias("utilisation_ref"), F.round("utilisation", 6).alias("utilisation"))


add("A8_utilisation_sessions", shared_use,
    usage.with_(*usage.CONSUMED, usage.PROVIDED, _SUMMARY) + """, g AS (SELECT pid, sum((t1 - t0) * (r1 - r0 + 1)) AS given
  FROM nr JOIN life USING (pid) GROUP BY pid),
x AS (SELECT sid, pid, sum((t1 - t0) * (r1 - r0 + 1)) AS used FROM box, (VALUES ('s0'), ('s1')) AS ss(sid)
  WHERE metric = 'exec_cmd' OR (sid = 's1' AND metric = 'exec_prep') GROUP BY 1, 2)
SELECT ss.sid, pilot, round(busy * 100 / CASE WHEN started IS NULL OR finished IS NULL THEN 1
  ELSE (finished - started) * cores END, 6) AS utilisation_ref, round(used / given * 100, 6) AS utilisation
FROM s CROSS JOIN (VALUES ('s0'), ('s1')) AS ss(sid) LEFT JOIN x ON x.sid = ss.sid AND x.pid = s.pilot LEFT JOIN g ON g.pid = s.pilot""")
add("A11_mode_progress",
    lambda s, p: stats.mode_progress(
        view(s, p, "descriptions_v").filter("mode is not null AND mode <> 'task.shell'").select("mode"),
        view(s, p, "descriptions_v").filter("mode is not null AND mode <> 'task.proc' AND (ranks < 3 OR mode = 'task.exec')")
        .select("mode")),
    """SELECT mode, count(*) FILTER (WHERE mode <> 'task.shell') AS submitted,
  count(*) FILTER (WHERE mode <> 'task.proc' AND (ranks < 3 OR mode = 'task.exec')) AS collected,
  count(*) FILTER (WHERE mode <> 'task.proc' AND (ranks < 3 OR mode = 'task.exec'))
    >= count(*) FILTER (WHERE mode <> 'task.shell') AS complete
FROM descriptions_v WHERE mode IS NOT NULL GROUP BY mode""")


def rank_results(s, p):
    c = table(s, p, "conversations")
    ranks = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("ranks"))
    return c.join(ranks, "conv_id").select(
        F.concat(F.lit("task."), F.col("conv_id").cast("string")).alias("uid"), F.col("turn").alias("rank"),
        (F.col("ranks") + (F.col("conv_id") % 4 == 0).cast("int")).alias("ranks"), F.col("role").alias("stdout"),
        F.lit("").alias("stderr"), F.length("text").cast("string").alias("return_value"),
        (F.col("turn") * F.col("conv_id") % 3).cast("int").alias("exit_code"))


add("A12_merge_ranks",
    lambda s, p: stats.merge_ranks(rank_results(s, p)).select(
        "uid", "chunk", F.array_join("stdout", ",").alias("stdout"),
        F.array_join("return_value", ",").alias("return_value"), "exit_code"),
    """SELECT concat('task.', CAST(conv_id AS VARCHAR(20))) AS uid, CAST(0 AS BIGINT) AS chunk,
  string_agg(role, ',' ORDER BY turn) AS stdout, string_agg(CAST(length(text) AS VARCHAR(20)), ',' ORDER BY turn) AS return_value,
  CAST(max(turn * conv_id % 3) AS INT) AS exit_code
FROM conversations GROUP BY conv_id HAVING count(*) >= max(turn) + 1 + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END""")
add("A13_node_uniformity",
    lambda s, p: stats.node_uniformity(table(s, p, "customer").select(
        (F.col("c_custkey") % 97).alias("pid"), F.lit(8).alias("cores"),
        (F.col("c_custkey") % 97 % 4).alias("gpus"), F.lit(100).alias("lfs"),
        F.when(F.col("c_custkey") > 900, 1).otherwise(F.col("c_custkey") % 97 % 2).alias("mem"))),
    """WITH n AS (SELECT c_custkey % 97 AS pid, 8 AS cores, c_custkey % 97 % 4 AS gpus, 100 AS lfs,
  CASE WHEN c_custkey > 900 THEN 1 ELSE c_custkey % 97 % 2 END AS mem FROM customer)
SELECT pid, count(*) AS n_nodes, count(DISTINCT mem) = 1 AS uniform, CASE WHEN count(DISTINCT mem) = 1 THEN 8 END AS cores_per_node,
  CASE WHEN count(DISTINCT mem) = 1 THEN min(gpus) END AS gpus_per_node, CASE WHEN count(DISTINCT mem) = 1 THEN 100 END AS lfs_per_node,
  CASE WHEN count(DISTINCT mem) = 1 THEN min(mem) END AS mem_per_node FROM n GROUP BY pid""")
