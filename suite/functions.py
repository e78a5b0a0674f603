"""Text functions and functions run over work items."""

from pyspark.sql import functions as F

from suite.views import sql, table, view
from taskscope.functions import text as tx
from taskscope.operators import runner
from taskscope.operators.workload import commands_for_rank
from taskscope.sources import logs

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


add("F1_tail",
    lambda s, p: table(s, p, "documents").select("doc_id", tx.tail(F.col("text"), 100).alias("tail")),
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN concat('[... CONTENT SHORTENED ...]', chr(10), right(text, 100))
  ELSE coalesce(text, '') END AS tail FROM documents""")
add("F7_uid_type",
    lambda s, p: view(s, p, "heartbeats_v").groupBy(tx.uid_type(F.col("uid")).alias("etype")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT split_part(uid, '.', 1) AS etype, count(*) AS n FROM heartbeats_v GROUP BY 1")
add("F8_uid_code",
    lambda s, p: table(s, p, "documents").select(
        "doc_id", tx.uid_code(F.concat(F.lit("task."), "source", F.lit("-"), "lang", F.lit(".1")), r"-([a-z]+)\.").alias("code")),
    "SELECT doc_id, lang AS code FROM documents")
add("F9_time_text",
    lambda s, p: view(s, p, "heartbeats_v").select("uid", "hb", tx.ts_text(F.col("hb"), "yyyy-MM-dd HH:mm").alias("at")),
    """SELECT uid, hb, strftime(make_timestamp(CAST(floor(hb) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') AS at
FROM heartbeats_v""")


# lines of all documents, numbered
def lines(s, p):
    return table(s, p, "documents").select(
        F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("uid"),
        F.posexplode(F.split("text", "\n")).alias("pos", "value"))


add("F10_first_info",
    lambda s, p: logs.first_info(lines(s, p), r"([A-Z][a-z]+)\. ([A-Z][a-z]+)"),
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, regexp_extract(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$', 3) AS info FROM l
  WHERE regexp_matches(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$'))
SELECT concat('doc.', CAST(doc_id AS VARCHAR(20))) AS uid, arg_min(info, pos) AS info FROM m GROUP BY doc_id""")


# commands: one for all ranks, one as a list for rank 0, one for a rank that may not exist
def prepared(s, p):
    return view(s, p, "tasks_v").select("uid", "ranks", F.to_json(F.array(
        F.lit("module load a"))).alias("_"), F.concat(
        F.lit('["export N='), F.col("priority").cast("string"),
        F.lit('", {"0": ["cd x", "[ -f y ]"], "2": "sleep 1"}]')).alias("pre_exec"))


add("F12_commands_for_rank", lambda s, p: commands_for_rank(prepared(s, p)),
    """WITH t AS (SELECT uid, priority, unnest(range(ranks)) AS rank FROM tasks_v)
SELECT uid, CAST(rank AS INT) AS rank, 0 AS pos, 0 AS step, concat('export N=', CAST(priority AS VARCHAR(20))) AS command FROM t
UNION ALL SELECT uid, CAST(rank AS INT), 1, 0, 'cd x' FROM t WHERE rank = 0
UNION ALL SELECT uid, CAST(rank AS INT), 1, 1, '[ -f y ]' FROM t WHERE rank = 0
UNION ALL SELECT uid, CAST(rank AS INT), 1, 0, 'sleep 1' FROM t WHERE rank = 2""")


# ---- functions over rows ---------------------------------------------------
def items(s, p):
    return table(s, p, "conversations").select(
        F.concat_ws(".", F.lit("task"), "conv_id", "turn").alias("uid"), "text", "turn")


def measure(text, turn):
    print(len(text))
    if turn == 3:
        raise ValueError("no third turn")
    return len(text) - len(text.replace(" ", ""))


_MEASURED = """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, concat(CAST(length(text) AS VARCHAR(20)), chr(10)) AS out,
  CASE WHEN turn = 3 THEN concat(chr(10), 'call failed: no third turn') ELSE '' END AS err,
  CASE WHEN turn = 3 THEN 1 ELSE 0 END AS ret,
  CASE WHEN turn <> 3 THEN CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR(20)) END AS val,
  CASE WHEN turn = 3 THEN 'ValueError(''no third turn'')' END AS exc FROM conversations"""
SHOWN = ["uid", "out", "err", "ret", "val", "exc"]
add("X1_run_func",
    lambda s, p: runner.run_func(items(s, p), measure, ["text", "turn"]).select(SHOWN), _MEASURED)


class Worker:
    """Made once per partition; knows a word list."""

    def __init__(self):
        self.vowels = set("aeiou")

    def count(self, text):
        return sum(c in self.vowels for c in text)


add("X2_run_method",
    lambda s, p: runner.run_method(items(s, p), Worker, "count", ["text"]).select("uid", "ret", "val"),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, 0 AS ret,
  CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS VARCHAR(20)) AS val FROM conversations""")


async def later(a, b):
    return a * b


def mixed(s, p):
    return table(s, p, "orders").select(
        F.concat(F.lit("task."), F.col("o_orderkey").cast("string")).alias("uid"),
        F.expr("""CASE o_orderkey % 5 WHEN 0 THEN 'task.function' WHEN 1 THEN 'task.method' WHEN 2 THEN 'price'
          WHEN 3 THEN 'task.shell' ELSE 'odd' END""").alias("mode"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'later' ELSE 'nothing' END").alias("function"),
        F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]")).alias("args"),
        F.lit("echo no").alias("command"), (F.col("o_totalprice") * 100).cast("long").alias("cents"))


def price_mode():
    modes = runner.Modes()
    modes.register("price", lambda row: row["cents"] // 7)
    return modes


add("X8_run_tasks",
    lambda s, p: runner.run_tasks(mixed(s, p), {"later": later}, price_mode(), spread=s.sparkContext.defaultParallelism)
    .select("uid", "ret", "val", "err", "target_state"),
    """WITH o AS (SELECT *, o_orderkey % 5 AS k FROM orders)
SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid, CASE WHEN k IN (0, 2) THEN 0 ELSE 1 END AS ret,
  CASE k WHEN 0 THEN CAST(o_orderkey * o_custkey AS VARCHAR(20))
    WHEN 2 THEN CAST(CAST(trunc(o_totalprice * 100) AS BIGINT) // 7 AS VARCHAR(20)) END AS val,
  CASE k WHEN 1 THEN 'call failed: callable nothing not found'
    WHEN 3 THEN 'call failed: task.shell runs code from the data: allow_code is off'
    WHEN 4 THEN 'call failed: mode odd is unknown' ELSE '' END AS err,
  CASE WHEN k IN (0, 2) THEN 'DONE' ELSE 'FAILED' END AS target_state FROM o""")


# before: drop odd rows, double the rest; after: keep failures
def twice(df):
    return (df.filter("mode <> 'odd'").withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
            .withColumn("uid", F.concat_ws("-", "uid", "copy")))


add("X14_before_after",
    lambda s, p: runner.run_tasks(mixed(s, p), {"later": later}, price_mode(), before=twice,
                                  after=lambda r: r.filter("target_state = 'FAILED'")).select("uid", "target_state"),
    """SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20)), '-', c) AS uid, 'FAILED' AS target_state
FROM orders CROSS JOIN (VALUES ('a'), ('b')) AS x(c) WHERE o_orderkey % 5 IN (1, 3)""")


def share(size, rank, ranks):
    return size // ranks + (1 if rank < size % ranks else 0)


add("X13_run_ranks",
    lambda s, p: runner.run_ranks(
        table(s, p, "documents").select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("uid"),
                                        (F.col("doc_id") % 3 + 1).cast("int").alias("ranks"), "n_chars"),
        share, ["n_chars"]).select("uid", "rank", "ranks", F.col("val").cast("long").alias("val")),
    """WITH r AS (SELECT doc_id, n_chars, doc_id % 3 + 1 AS ranks, unnest(range(doc_id % 3 + 1)) AS rank FROM documents)
SELECT concat('doc.', CAST(doc_id AS VARCHAR(20))) AS uid, CAST(rank AS INT) AS rank, CAST(ranks AS INT) AS ranks,
  n_chars // ranks + CASE WHEN rank < n_chars % ranks THEN 1 ELSE 0 END AS val FROM r""")


def with_environment(s, p):
    return items(s, p).withColumn("environment", F.create_map(F.lit("TURN"), F.col("turn").cast("string")))


def read_environment():
    import os
    return os.environ["TURN"]


add("X10_environment",
    lambda s, p: runner.run_func(with_environment(s, p), read_environment).select("uid", "val"),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, concat('"', CAST(turn AS VARCHAR(20)), '"') AS val FROM conversations""")


# ---- one query per way to run ----------------------------------------------
add("X7_register_mode",
    lambda s, p: runner.run_tasks(mixed(s, p), modes=price_mode()).select("uid", "ret", "val"),
    """SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid, CASE WHEN o_orderkey % 5 = 2 THEN 0 ELSE 1 END AS ret,
  CASE WHEN o_orderkey % 5 = 2 THEN CAST(CAST(trunc(o_totalprice * 100) AS BIGINT) // 7 AS VARCHAR(20)) END AS val FROM orders""")
add("X12_async_function",
    lambda s, p: runner.run_func(table(s, p, "customer"), later, ["c_custkey", "c_nationkey"], keep=["c_custkey"],
                                 spread=4 * s.sparkContext.defaultParallelism)
    .select("c_custkey", "val"),
    "SELECT c_custkey, CAST(c_custkey * c_nationkey AS VARCHAR(20)) AS val FROM customer")


@runner.task_fn
def scaled(factor, offset=0):
    return factor * 10 + offset


# the arguments are bound: rows may not bring their own
add("X11_bound_function",
    lambda s, p: runner.run_tasks(table(s, p, "customer").select(
        F.concat(F.lit("task."), F.col("c_custkey").cast("string")).alias("uid"), F.lit("task.function").alias("mode"),
        F.lit("scaled").alias("function"), F.when(F.col("c_custkey") % 4 == 0, "[1]").otherwise("").alias("args")),
        {"scaled": scaled(4, offset=2)}).select("uid", "ret", "val", "exc"),
    """SELECT concat('task.', CAST(c_custkey AS VARCHAR(20))) AS uid, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS ret,
  CASE WHEN c_custkey % 4 <> 0 THEN '42' END AS val,
  CASE WHEN c_custkey % 4 = 0 THEN 'ValueError(''a function with bound arguments takes no others'')' END AS exc FROM customer""")
add("X15_after_hook",
    lambda s, p: runner.run_tasks(mixed(s, p), modes=price_mode(), after=lambda r:
                                  r.groupBy("target_state").agg(F.count(F.lit(1)).alias("n"))),
    """SELECT CASE o_orderkey % 5 WHEN 2 THEN 'DONE' ELSE 'FAILED' END AS target_state, count(*) AS n
FROM orders GROUP BY 1""")
add("X18_failures",
    lambda s, p: runner.run_func(items(s, p), measure, ["text", "turn"]).filter("ret <> 0").select(
        "uid", "exc", F.col("detail").contains("in measure").alias("traced")),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, 'ValueError(''no third turn'')' AS exc, true AS traced
FROM conversations WHERE turn = 3""")
add("F11_tool_name",
    lambda s, p: table(s, p, "part").groupBy(tx.tool_name(F.concat(
        F.lit("STATE Part "), (F.col("p_partkey") % 9).cast("string"))).alias("event")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT concat('part_', CAST(p_partkey % 9 AS VARCHAR(20))) AS event, count(*) AS n FROM part GROUP BY 1")

# ---- code from a column: fixed texts over the rows of a table --------------
add("X3_eval",
    lambda s, p: runner.run_eval(items(s, p).withColumn("code", F.concat(
        F.lit("sum(range("), F.col("turn").cast("string"), F.lit(")) + len('ab') * 3"))), allow_code=True)
    .select("uid", "ret", "val"),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, 0 AS ret,
  CAST(turn * (turn - 1) // 2 + 6 AS VARCHAR(20)) AS val FROM conversations""")
# a text over two lines stays as it is
_BODY = "\n".join(["text = '''a", "b'''", "if turn == 3:", "    raise ValueError('no third turn')",
                   "return len(text) * base + turn"])
add("X4_exec",
    lambda s, p: runner.run_exec(items(s, p).withColumns({
        "pre_exec": F.array(F.lit("base = 10"), F.concat(F.lit("turn = "), F.col("turn").cast("string"))),
        "code": F.lit(_BODY)}), allow_code=True).select("uid", "ret", "val", "exc"),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, CASE WHEN turn = 3 THEN 1 ELSE 0 END AS ret,
  CASE WHEN turn <> 3 THEN CAST(30 + turn AS VARCHAR(20)) END AS val,
  CASE WHEN turn = 3 THEN 'ValueError(''no third turn'')' END AS exc FROM conversations""")


def patient(turn):
    """The last turns would take far longer than their limit."""
    import time
    if turn >= 7:
        time.sleep(60)
    return turn


add("X9_time_limit",
    lambda s, p: runner.run_func(
        items(s, p).withColumn("timeout", F.when(F.col("turn") >= 7, 0.05)).repartition(s.sparkContext.defaultParallelism),
        patient, ["turn"]).select("uid", "ret", "val", "exc"),
    """SELECT concat_ws('.', 'task', conv_id, turn) AS uid, CASE WHEN turn >= 7 THEN 1 ELSE 0 END AS ret,
  CASE WHEN turn < 7 THEN CAST(turn AS VARCHAR(20)) END AS val,
  CASE WHEN turn >= 7 THEN 'TimeoutError("task timed out")' END AS exc FROM conversations""")
