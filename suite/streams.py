"""Streams, run over the tables in several micro-batches to their end."""

from pyspark.sql import functions as F

from suite.states import task_progress
from suite.views import cases, sql, table, view
from suite.workload import rank_results
from suite.durations import SMALL, found
from taskscope.operators import durations as d
from taskscope.operators import state as m
from taskscope.session import fresh_path
from taskscope.sources.trace import read_trace_stream, write_trace_text
from taskscope.streaming import hold as h
from taskscope.streaming import messages as msg
from taskscope.streaming import stateful as st

QUERIES, ORACLES = {}, {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = sql(oracle)


#: Files of a step, and of a micro-batch, at least; and rows of a file, about.
FILES, ROWS = 4, 1 << 18


def stream_of(s, df, order, batches=3):
    """A stream of the rows in `batches` steps, earlier ones of `order` first; each
    step is written and read by FILES tasks or more, as many as its rows ask for."""
    path = fresh_path(s, "source")
    bounds = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n")).head()
    step = (bounds.b - bounds.a) / batches
    files = max(FILES, bounds.n // (batches * ROWS))
    for i in range(batches):
        low, high = bounds.a + i * step, bounds.a + (i + 1) * step
        part = F.col(order) >= low
        if i < batches - 1:
            part = part & (F.col(order) < high)
        df.filter(part).repartition(files).write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def updates(s, p):
    return stream_of(s, view(s, p, "updates_v"), "seq")


_ANNOUNCED = """, parts AS (SELECT uid, seq, state, CASE WHEN passed = '' THEN [state] ELSE string_split(passed, ',') END AS l FROM changes)
SELECT uid, seq, state, CAST(generate_subscripts(l, 1) - 1 AS INT) AS step, unnest(l) AS announced FROM parts"""


def announced_sql(replay):
    """The changes of the batch query, one row per announced state."""
    text = task_progress(replay)
    cut = text.rindex("\nSELECT uid, seq, state, CASE")
    return f"{text[:cut]},\nchanges AS ({text[cut:]}){_ANNOUNCED}"


add("T1_progress_stream",
    lambda s, p: msg.run_to_end(st.progress_stream(updates(s, p)), fresh_path(s, "t1")), announced_sql(True))
add("M5_announced", lambda s, p: m.announced(m.progress(view(s, p, "updates_v"), replay_final=False)), announced_sql(False))


# ---- state that ends: a uid comes back in each of three steps, some of them after their state has ended
LIMIT = 300.0
_LIVES = """SELECT concat('task.', CAST(event_id % 400 AS VARCHAR(20))) AS uid, event_id AS seq, 1000.0 + event_id AS time,
  CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'AGENT_SCHEDULING' WHEN 'click' THEN 'AGENT_EXECUTING'
    WHEN 'purchase' THEN 'DONE' ELSE 'CANCELED' END AS state FROM {events}"""


def expiring(s, p):
    """Transitions, and the folder of the stream's checkpoint."""
    rows = s.sql(_LIVES.format(events="{events}"), events=table(s, p, "events"))
    rows = rows.withColumn("time", F.col("time").cast("double"))
    path = fresh_path(s, "t1")
    return msg.run_to_end(st.progress_stream(stream_of(s, rows, "seq"), forget=LIMIT, idle=LIMIT), path), f"{path}/checkpoint"


def lives_sql():
    """Announced states, uid cut into lives: a new one where the watermark, the latest time of earlier
    steps, had passed the end of the uid's state."""
    lives = f"""lv AS (SELECT *, CASE WHEN seq >= a + 2 * ((b - a) / 3) THEN 2 WHEN seq >= a + 1 * ((b - a) / 3) THEN 1 ELSE 0 END AS part
  FROM ({_LIVES.format(events="events")}), (SELECT min(event_id) AS a, max(event_id) AS b FROM events)),
marks AS (SELECT x.part, max(lv.time) AS mark FROM (SELECT DISTINCT part FROM lv) x JOIN lv ON lv.part < x.part GROUP BY 1),
ends AS (SELECT uid, part, max(time) AS last FROM lv GROUP BY 1, 2),
fresh AS (SELECT uid, part, CASE WHEN lag(last) OVER w + {LIMIT} <= mark THEN 1 ELSE 0 END AS fresh
  FROM ends LEFT JOIN marks USING (part) WINDOW w AS (PARTITION BY uid ORDER BY part)),
life AS (SELECT uid, part, sum(fresh) OVER (PARTITION BY uid ORDER BY part) AS life FROM fresh),
lives AS (SELECT concat(uid, '/', CAST(life AS VARCHAR(9))) AS uid, seq, state FROM lv JOIN life USING (uid, part)), """
    return announced_sql(True).replace("updates_v", "lives").replace("WITH ", f"WITH {lives}", 1)


add("T1_progress_expiry", lambda s, p: expiring(s, p)[0],
    f"SELECT split_part(uid, '/', 1) AS uid, seq, state, step, announced FROM ({lives_sql()})")


def state_left(s, p):
    """What the state store holds at the end: uids whose state has not ended, with their last state."""
    _, checkpoint = expiring(s, p)
    return (s.read.format("statestore").option("stateVarName", "current").load(checkpoint)
            .select("key.uid", F.col("value.last").alias("last")))


add("T1_state_left", state_left,
    f"""WITH an AS (SELECT * FROM ({lives_sql()})),
k AS (SELECT split_part(uid, '/', 1) AS uid, CAST(split_part(uid, '/', 2) AS INT) AS life, arg_max(state, seq) AS last FROM an GROUP BY an.uid),
t AS (SELECT concat('task.', CAST(event_id % 400 AS VARCHAR(20))) AS uid, max(event_id) AS seq FROM events GROUP BY 1)
SELECT uid, arg_max(last, life) AS last FROM k JOIN t USING (uid)
WHERE t.seq + {LIMIT} > (SELECT max(event_id) FROM events) GROUP BY uid""")


def told(s, p):
    path = fresh_path(s, "t2")
    msg.use_state_store(s)

    def subscriber(batch):
        batch.write.mode("append").parquet(f"{path}/seen")
        raise RuntimeError("a failing subscriber does not end the stream")

    msg.foreach_transition(st.progress_stream(updates(s, p)), subscriber, bulk=True).awaitTermination()
    return s.read.parquet(f"{path}/seen").groupBy("announced").agg(F.count(F.lit(1)).alias("n"))


add("T2_subscribers", told,
    f"SELECT announced, count(*) AS n FROM ({announced_sql(True)}) GROUP BY 1".replace("FROM (WITH", "FROM (WITH"))


def told_of_one(s, p):
    """What a subscriber to one uid is told, that of the first task."""
    path = fresh_path(s, "t2")
    msg.use_state_store(s)
    first = view(s, p, "updates_v").agg(F.min("uid")).first()[0]
    # the state of other uids is of no use to this subscriber
    own = updates(s, p).filter(F.col("uid") == first)
    msg.foreach_transition(st.progress_stream(own), lambda b: b.write.mode("append").parquet(path),
                           uid=first, bulk=True).awaitTermination()
    return s.read.parquet(path).select("uid", "announced")


add("T2_subscriber_of_one", told_of_one,
    f"SELECT uid, announced FROM ({announced_sql(True)}) WHERE uid = (SELECT min(uid) FROM updates_v)")


def messages(s, p):
    """Update messages as JSON: lists and single items, and other commands."""
    u = view(s, p, "updates_v")
    item = F.struct("uid", F.lit("task").alias("type"), "state", "seq")
    one = F.to_json(F.struct(F.when(F.col("seq") % 10 == 3, "cancel").otherwise("update").alias("cmd"), item.alias("arg")))
    many = F.to_json(F.struct(F.lit("update").alias("cmd"), F.array(item, item).alias("arg")))
    return stream_of(s, u.select(F.when(F.col("seq") % 4 == 0, many).otherwise(one).alias("value"), "seq"), "seq").select("value")


add("S12_read_updates",
    lambda s, p: msg.run_to_end(msg.read_updates(messages(s, p)), fresh_path(s, "s12")),
    """SELECT uid, 'task' AS type, state, seq FROM updates_v WHERE seq % 4 = 0 OR seq % 10 <> 3
UNION ALL SELECT uid, 'task', state, seq FROM updates_v WHERE seq % 4 = 0""")


def live(s, p):
    """Trace files that arrive in three steps; after each the query stops, and goes on from its checkpoint."""
    path, place = fresh_path(s, "trace"), fresh_path(s, "s2")
    events = view(s, p, "trace_v")
    bounds = events.agg(F.min("time").alias("a"), F.max("time").alias("b")).head()
    for i in range(3):
        low, high = (bounds.a + (bounds.b - bounds.a) * k / 3 for k in (i, i + 1))
        part = events.filter((F.col("time") >= low) & ((F.col("time") < high) | F.lit(i == 2)))
        write_trace_text(part, f"{path}/step{i}")
        stream = read_trace_stream(s, path, "*.txt", files_per_trigger=2)
        now = msg.latest_rows(d.durations(stream, SMALL, by=["uid"]), ["uid", "metric"], place)
    return now


add("S2_trace_stream", live, found(SMALL, "trace_v") + "SELECT uid, metric, t0, t1, dur FROM dur")


def live_metrics(s, p):
    events = stream_of(s, view(s, p, "task_trace_v"), "time")
    return msg.latest_rows(d.durations(events, "task_app", by=["uid"]), ["uid", "metric"], fresh_path(s, "t14"))


add("T14_live_durations", live_metrics, found("task_app", "task_trace_v") + "SELECT uid, metric, t0, t1, dur FROM dur")

# ---- time limits -----------------------------------------------------------
# the last part of the heartbeats comes from a quarter of the workers only
_BEATS = """b AS (SELECT *, max(hb) OVER () AS e FROM heartbeats_v),
h AS (SELECT uid, rank, hb FROM b WHERE uid LIKE '%1' OR hb < e - 86400 * 6 - rank * 3600)"""


def beats(s, p):
    hb = view(s, p, "heartbeats_v")
    end = hb.agg(F.max("hb").alias("e")).head().e
    return hb.filter(F.col("uid").endswith("1") | (F.col("hb") < end - 86400 * 6 - F.col("rank") * 3600)), end


def lost_batch(s, p):
    rows, end = beats(s, p)
    return st.lost_workers(rows, end, 86400.0)


add("T4_lost_workers", lost_batch,
    f"""WITH {_BEATS}, l AS (SELECT uid, rank, max(hb) AS last FROM h GROUP BY 1, 2)
SELECT uid, count(*) AS ranks, min(last) AS last FROM l WHERE last < (SELECT max(e) FROM b) - 86400 GROUP BY uid""")


def lost_stream(s, p):
    """Every alarm: a rank may be lost, return and be lost again."""
    rows, _ = beats(s, p)
    out = msg.run_to_end(st.lost_worker_stream(stream_of(s, rows, "hb", 4), 86400.0), fresh_path(s, "t4"))
    return out.select("uid", "rank", F.round("last", 2).alias("last"))


add("T4_lost_workers_stream", lost_stream,
    f"""WITH {_BEATS}, m AS (SELECT DISTINCT uid, rank, CAST(round(hb * 1000) AS BIGINT) AS ms FROM h),
g AS (SELECT uid, rank, ms, lead(ms) OVER (PARTITION BY uid, rank ORDER BY ms) AS back, max(ms) OVER () AS now FROM m)
SELECT uid, rank, round(ms / 1000, 2) AS last FROM g
WHERE back - ms >= 86400000 OR (back IS NULL AND ms + 86400000 <= now)""")

# submitted at the order date, started later, ended or not
_LIMITS = """SELECT {uid} AS uid, kind, {date}/1e6 + k * (o_custkey % 50) * 10 AS time,
  CAST(o_custkey % 3 * 100 AS DOUBLE) AS startup_timeout, CAST(o_orderkey % 4 * 100 AS DOUBLE) AS timeout
FROM {orders} CROSS JOIN (VALUES (0, 'submit'), (1, 'started'), (2, 'ended')) AS v(k, kind)
WHERE (k = 0 OR o_orderkey % 7 > 1) AND (k < 2 OR o_orderkey % 11 > 3)"""
_UID = "concat('task.', CAST(o_orderkey AS VARCHAR(20)))"


def limits(s, p):
    return s.sql(_LIMITS.format(uid=_UID, date="unix_micros(CAST(o_orderdate AS TIMESTAMP))", orders="{orders}"),
                 orders=table(s, p, "orders"))


add("T5_timeouts", lambda s, p: st.timeouts(limits(s, p), 9e8),
    f"""WITH u AS ({_LIMITS.format(uid=_UID, date="epoch_us(o_orderdate)", orders="orders")}),
k AS (SELECT uid, min(time) FILTER (WHERE kind = 'submit') AS a, min(time) FILTER (WHERE kind = 'started') AS b,
  min(time) FILTER (WHERE kind = 'ended') AS c, max(startup_timeout) AS s, max(timeout) AS r FROM u GROUP BY uid),
d AS (SELECT uid, c, CASE WHEN b IS NULL THEN a + CASE WHEN s > 0 THEN s WHEN r > 0 THEN r END
  WHEN r > 0 THEN b + r END AS deadline FROM k)
SELECT uid, 'task_timeout' AS event, deadline FROM d WHERE deadline < 9e8 AND (c IS NULL OR deadline < c)""")


def limits_stream(s, p):
    rows = limits(s, p)
    return msg.run_to_end(st.timeout_stream(stream_of(s, rows, "time", 3)), fresh_path(s, "t5"))


add("T5_timeouts_stream", limits_stream,
    ORACLES["T5_timeouts"].replace("deadline < 9e8", "deadline < (SELECT max(time) FROM u)"))

# ---- held rows -------------------------------------------------------------
_ORDER = """CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % 4 END"""


def bag_rows(s, p):
    return table(s, p, "orders").select(
        F.concat(F.lit("task."), F.col("o_orderkey").cast("string")).alias("uid"),
        F.concat(F.lit("ns."), (F.col("o_custkey") % 400).cast("string")).alias("ns"),
        (F.col("o_custkey") % 400 % 5 + 36).alias("size"), "o_orderkey")


add("T7_complete_bags",
    lambda s, p: h.complete_bags(bag_rows(s, p))[0].select("uid", "ns", "status"),
    """WITH b AS (SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid, concat('ns.', CAST(o_custkey % 400 AS VARCHAR(20))) AS ns,
  o_custkey % 400 % 5 + 36 AS size FROM orders), c AS (SELECT ns, count(*) AS n, max(size) AS size FROM b GROUP BY ns)
SELECT uid, ns, CASE WHEN n = c.size THEN 'complete' ELSE 'over' END AS status FROM b JOIN c USING (ns) WHERE n >= c.size""")


def exact_bags(s, p):
    """Bags as large as they get in every second namespace, one larger in the rest."""
    rows = bag_rows(s, p).drop("size")
    odd = F.substring("ns", 4, 9).cast("long") % 2
    sizes = rows.groupBy("ns").agg((F.count(F.lit(1)) + F.max(odd)).alias("size"))
    return rows.join(sizes, "ns")


def bag_stream(s, p):
    released, held = h.hold(stream_of(s, exact_bags(s, p), "o_orderkey"), h.complete_bags, fresh_path(s, "t7"))
    return released.select("uid", "status").unionByName(held.select("uid", F.lit("held").alias("status")))


add("T7_complete_bags_stream", bag_stream,
    """SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid,
  CASE WHEN o_custkey % 400 % 2 = 0 THEN 'complete' ELSE 'held' END AS status FROM orders""")


def rank_stream(s, p):
    rows = rank_results(s, p).withColumn("_o", F.regexp_extract("uid", r"(\d+)", 1).cast("long") * 7 % 10 + F.col("rank"))
    released, _ = h.hold(stream_of(s, rows, "_o").drop("_o"), h.gather_ranks, fresh_path(s, "t9"))
    return released.select("uid", "chunk", F.array_join("stdout", ",").alias("stdout"),
                           F.array_join("return_value", ",").alias("return_value"), "exit_code")


add("T9_gather_ranks", rank_stream,
    """SELECT concat('task.', CAST(conv_id AS VARCHAR(20))) AS uid, CAST(0 AS BIGINT) AS chunk,
  string_agg(role, ',' ORDER BY turn) AS stdout, string_agg(CAST(length(text) AS VARCHAR(20)), ',' ORDER BY turn) AS return_value,
  CAST(max(turn * conv_id % 3) AS INT) AS exit_code
FROM conversations GROUP BY conv_id HAVING count(*) >= max(turn) + 1 + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END""")


def with_keys(s, p):
    tasks = view(s, p, "descriptions_v").select(
        F.lit("task").alias("kind"), "uid", F.col("named_env").alias("needs"), F.substring("uid", 6, 9).cast("long").alias("o"))
    keys = table(s, p, "region").select(
        F.lit("key").alias("kind"), F.concat(F.lit("env"), F.col("r_regionkey").cast("string")).alias("uid"),
        F.lit(None).cast("string").alias("needs"), (F.col("r_regionkey") * 2000).alias("o"))
    return tasks.unionByName(keys)


def known_stream(s, p):
    released, held = h.hold(stream_of(s, with_keys(s, p), "o").drop("o"), h.when_known, fresh_path(s, "t8"))
    return released.select("uid", "needs", F.lit("released").alias("status")).unionByName(
        held.filter("kind = 'task'").select("uid", "needs", F.lit("held").alias("status")))


add("T8_release_when_known", known_stream,
    """SELECT uid, named_env AS needs, CASE WHEN named_env IS NULL OR named_env IN (
  SELECT concat('env', CAST(r_regionkey AS VARCHAR(20))) FROM region) THEN 'released' ELSE 'held' END AS status FROM descriptions_v""")


def with_cancels(s, p):
    t = table(s, p, "orders")
    uid = F.concat(F.lit("task."), F.col("o_orderkey").cast("string")).alias("uid")
    return t.select(F.lit("task").alias("kind"), uid, F.col("o_orderkey").alias("o")).unionByName(
        t.filter("o_custkey % 9 = 2").select(F.lit("cancel").alias("kind"), uid, (F.col("o_custkey") * 10).alias("o")))


def cancel_stream(s, p):
    out, held = h.hold(stream_of(s, with_cancels(s, p), "o").drop("o"), h.cancels, fresh_path(s, "t11"))
    return out.select("uid", F.lit("cancelled").alias("status")).unionByName(
        held.filter("kind = 'task'").select("uid", F.lit("waiting").alias("status")))


add("T11_cancels", cancel_stream,
    """SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid, CASE WHEN o_custkey % 9 = 2 THEN 'cancelled' ELSE 'waiting' END AS status
FROM orders""")


def ordered_rows(s, p):
    """Tasks in bags of namespaces, and the members that are done."""
    t = table(s, p, "orders").select(
        F.concat(F.lit("task."), F.col("o_orderkey").cast("string")).alias("uid"),
        F.concat(F.lit("ns."), (F.col("o_custkey") % 200).cast("string")).alias("ns"),
        F.expr("CAST(o_orderkey % 4 AS INT)").alias("bag_order"), F.lit(10).alias("size"), F.lit(1).cast("long").alias("n"),
        "o_orderkey", "o_custkey")
    tasks = t.select(F.lit("task").alias("kind"), "uid", "ns", "bag_order", "size", "n", F.col("o_orderkey").alias("o"))
    done = t.filter("o_custkey % 5 <> 3").select(
        F.lit("done").alias("kind"), "uid", "ns", "bag_order", "size", "n", (F.col("o_orderkey") + 4000).alias("o"))
    return tasks.unionByName(done)


def ordered_stream(s, p):
    released, held = h.hold(stream_of(s, ordered_rows(s, p), "o").drop("o"), h.ordered_bags, fresh_path(s, "t6"))
    return released.select("uid", F.lit("released").alias("status")).unionByName(
        held.filter("kind = 'task'").select("uid", F.lit("held").alias("status")))


add("T6_ordered_bags", ordered_stream,
    """WITH t AS (SELECT concat('task.', CAST(o_orderkey AS VARCHAR(20))) AS uid, o_custkey % 200 AS ns, o_orderkey % 4 AS k, o_custkey FROM orders),
d AS (SELECT ns, k FROM t WHERE o_custkey % 5 <> 3 GROUP BY 1, 2 HAVING count(*) >= 10),
g AS (SELECT t.uid, t.k, count(d.k) AS before FROM t LEFT JOIN d ON d.ns = t.ns AND d.k < t.k GROUP BY t.uid, t.k)
SELECT uid, CASE WHEN before = k THEN 'released' ELSE 'held' END AS status FROM g""")


def queue_rows(s, p):
    e = table(s, p, "events")
    return e.select((F.col("user_id") % 7).alias("queue"), F.when(F.col("event_type") == "click", "assign")
                    .when(F.col("event_type") != "error", "arrive").otherwise("other").alias("kind"), "event_id")


add("T10_waiting_size",
    lambda s, p: msg.latest_rows(msg.waiting_size(stream_of(s, queue_rows(s, p), "event_id")), ["queue"], fresh_path(s, "t10")),
    """SELECT user_id % 7 AS queue, CAST(sum(CASE event_type WHEN 'click' THEN -1 WHEN 'error' THEN 0 ELSE 1 END) AS BIGINT) AS waiting
FROM events GROUP BY 1""")


def text_lines(s, p):
    return table(s, p, "documents").select(
        F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("uid"), F.col("doc_id").alias("o"),
        F.posexplode(F.split("text", "\n")).alias("pos", "value")) \
        .withColumn("time", (F.col("o") + F.col("pos") / 1000.0).cast("double"))


def infos(s, p):
    lines = stream_of(s, text_lines(s, p), "o", 2).drop("o")
    return msg.run_to_end(st.info_stream(lines, r"([A-Z][a-z]+)\. ([A-Z][a-z]+)"), fresh_path(s, "t13")).select("uid", "info")


add("T13_info_stream", infos,
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, regexp_extract(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$', 3) AS info FROM l
  WHERE regexp_matches(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$'))
SELECT concat('doc.', CAST(doc_id AS VARCHAR(20))) AS uid, arg_min(info, pos) AS info FROM m GROUP BY doc_id""")


def limited_infos(s, p):
    """A match within 3 ms (lines) of a text's first line, or an error."""
    lines = stream_of(s, text_lines(s, p), "o", 3).drop("o")
    return msg.run_to_end(st.info_stream(lines, r"([A-Z][a-z]+)\. ([A-Z][a-z]+)", timeout=0.003), fresh_path(s, "t13"))


add("T13_info_time_limit", limited_infos,
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, pos, doc_id * 1000 + pos AS ms, regexp_extract(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$', 3) AS info,
  regexp_matches(value, '^.*(([A-Z][a-z]+)\. ([A-Z][a-z]+)).*$') AS hit FROM l),
f AS (SELECT doc_id, arg_min(info, pos) FILTER (WHERE hit AND pos <= 3) AS info, max(pos) AS last FROM m GROUP BY doc_id)
SELECT concat('doc.', CAST(doc_id AS VARCHAR(20))) AS uid, info, CASE WHEN info IS NULL THEN 'startup timeout' END AS error
FROM f WHERE info IS NOT NULL OR last > 3 OR doc_id * 1000 + 3 <= (SELECT max(ms) FROM m)""")


def late_ranks(s, p):
    """Every rank reports again after all have: nothing is released twice, nothing is held for ever."""
    rows = rank_results(s, p).withColumn("_o", F.regexp_extract("uid", r"(\d+)", 1).cast("long") * 7 % 10 + F.col("rank"))
    again = rows.withColumn("_o", F.col("_o") + 1000)
    released, held = h.hold(stream_of(s, rows.unionByName(again), "_o").drop("_o"), h.gather_ranks, fresh_path(s, "t9"))
    return released.select("uid", F.lit("released").alias("status"), F.lit(0).cast("long").alias("rank")).unionByName(
        held.select("uid", F.lit("held").alias("status"), F.col("rank").cast("long")))


add("T9_late_ranks", late_ranks,
    """WITH r AS (SELECT concat('task.', CAST(conv_id AS VARCHAR(20))) AS uid, turn AS rank,
  count(*) OVER (PARTITION BY conv_id) >= max(turn) OVER (PARTITION BY conv_id) + 1 + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS whole
  FROM conversations)
SELECT DISTINCT uid, 'released' AS status, CAST(0 AS BIGINT) AS rank FROM r WHERE whole
UNION ALL SELECT uid, 'held', CAST(rank AS BIGINT) FROM r, (VALUES (1), (2)) AS twice(k) WHERE NOT whole""")
