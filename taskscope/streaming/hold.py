"""Streams that hold rows back until something is complete.

Rows that wait are written once, to a log in the shared folder that is only
appended to.  What decides on them is a small state per key (how many members a
bag has, which ranks are in, whether a key is known), kept in the state store and
touched for the keys of new rows only.  When a key is complete the state gives a
mark; the marked rows of the log go, found by the bucket of their key.  So the
work of a micro-batch follows its new rows and what it releases, not what waits,
and a bag or key with most rows is spread over files like any other table.

Every `every` batches the rows that still wait are written anew as the base of a
new generation, and the generation before is emptied.  State that has served its
purpose (a bag that has gone, a key that is known, a cancel request) is forgotten
`ttl` seconds after its last row has arrived.

A rule is also a function of a table, for a batch job on the same rows: it gives
the rows to release and the rows to hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taskscope.operators.audit import bag_status
from taskscope.operators.ordered import running
from taskscope.operators.stats import merge_ranks
from taskscope.streaming.buckets import Bucketed, in_buckets
from taskscope.streaming.messages import use_state_store

#: Buckets of keys; a log file is in order of them, so that few of its row groups are read for a key.
BUCKETS = 256
#: What counts of new rows go to the state, combined per Arrow batch.
COUNTS = "_key string, _kind string, _part long, _n long, _low long, _high long, _ms long, _at timestamp"
MARK = "_key string, _part long, _status string, _scope string"


class Counter(StatefulProcessor):
    """State of a key with an end; `seen` gets the counts and gives marks.

    A mark has a status and a scope: `all` rows of (key, part) that have come so
    far, only the `new` ones of this batch, or `drop` for new ones that count no more.
    """

    fields = ""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts = list(rows)  # one row per kind and part of an Arrow batch
        *old, until = self.state.get() or (*self.empty, 0)
        new, ends, marks = self.seen(tuple(old), counts)
        end = until
        if ends:
            end = max(c._ms for c in counts) + self.ttl_ms
        if end != until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(end)
        self.state.update((*new, end))
        for part, status, scope in marks:
            yield Row(_key=key[0], _part=part, _status=status, _scope=scope)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        return iter(())

    def forget(self) -> None:
        self.state.clear()

    def close(self) -> None:
        pass


class Bags(Counter):
    """Members of a bag against its size; later members of a bag that has gone are one too many."""

    fields, empty = "n long, low long, high long, status string", (0, None, None, None)

    def seen(self, old, counts):
        n, low, high, status = old
        n += sum(c._n for c in counts)
        low = min((x for x in (low, *(c._low for c in counts)) if x is not None), default=None)
        high = max((x for x in (high, *(c._high for c in counts)) if x is not None), default=None)
        if status:
            return (n, low, high, status), True, [(0, "over", "new")]
        if low is not None:
            status = "inconsistent" if low != high else "over" if n > low else "complete" if n == low else None
        return (n, low, high, status), bool(status), [(0, status, "all")] if status else []


class Ranks(Counter):
    """Ranks that have reported, as bits in chunks; a repeat after the task has gone counts no more."""

    fields, empty = "n long, ranks long, gone boolean", (0, 1, False)
    CHUNK = 8 * 512

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bits = handle.getMapState("bits", "chunk long", "bits binary")

    def seen(self, old, counts):
        n, ranks, gone = old
        if gone:
            return old, True, [(0, "late", "drop")]
        chunks: dict[int, set[int]] = {}
        for c in counts:
            ranks = max(ranks, c._high)
            chunks.setdefault(c._part // self.CHUNK, set()).add(c._part % self.CHUNK)
        for chunk, places in chunks.items():
            have = bytearray(self.bits.getValue((chunk,))[0] if self.bits.containsKey((chunk,)) else self.CHUNK // 8)
            for place in places:
                bit = 1 << place % 8
                n += not have[place // 8] & bit
                have[place // 8] |= bit
            self.bits.updateValue((chunk,), (bytes(have),))
        if n < ranks:
            return (n, ranks, False), False, []
        self.bits.clear()
        return (n, ranks, True), True, [(0, "complete", "all")]

    def forget(self) -> None:
        super().forget()
        self.bits.clear()


class Known(Bucketed):
    """Keys that are known, by a row of another kind than `task`: no state for others.

    Marks are those of a `Counter`.
    """

    layout = pa.schema([("key", pa.string()), ("ends", pa.int64())])

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def seen(self, state: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        task = rows["kind"] == "task"
        asking = rows.loc[task, "key"].drop_duplicates()
        told = rows[~task]["key"].drop_duplicates()
        before, news = asking[asking.isin(state["key"])], told[~told.isin(state["key"])]
        marks = pd.concat([pd.DataFrame({"_key": before, "_scope": "new"}), pd.DataFrame({"_key": news, "_scope": "all"})])
        ends = rows[rows["key"].isin(told)].groupby("key", as_index=False)["ms"].max().rename(columns={"ms": "ends"})
        ends["ends"] += self.ttl_ms
        state = pd.concat([state[~state["key"].isin(told)], ends], ignore_index=True)
        return state, marks.assign(_part=0, _status="released")[["_key", "_part", "_status", "_scope"]]

    def ended(self, over: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return over.iloc[:0], over.iloc[:0]


class Order(Counter):
    """How many bags of a namespace are done without a gap, and the counts of those that are not.

    Bags that are done leave the state; the namespace stays.
    """

    fields, empty = "current long", (0,)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bags = handle.getMapState("bags", "bag_order long", "n long, size long")

    def seen(self, old, counts):
        (before,) = old
        for c in counts:
            if c._kind == "done" and c._part >= before:
                n, size = self.bags.getValue((c._part,)) if self.bags.containsKey((c._part,)) else (0, c._high)
                self.bags.updateValue((c._part,), (n + c._n, max(size, c._high)))
        current = before
        while self.bags.containsKey((current,)):
            n, size = self.bags.getValue((current,))
            if n < size:
                break
            self.bags.removeKey((current,))
            current += 1
        free = {c._part for c in counts if c._kind == "task" and c._part <= before}
        marks = [(part, "released", "new") for part in sorted(free)]
        return (current,), False, marks + [(part, "released", "all") for part in range(before + 1, current + 1)]


@dataclass(frozen=True)
class Held:
    """How a rule works on a stream; all but the first and last are SQL expressions of a row.

    key, part: what a row waits on.  waits: rows that are kept; others count only.
    free: rows that go at once.  n, size: what the state adds up and takes the least
    and the most of, for each key, kind and counted part.  finish: from marked rows,
    with `status`, to released ones.
    """

    processor: type[Counter] | type[Bucketed]
    key: str
    kind: str = "'task'"
    waits: str = "true"
    free: str = "false"
    part: str = "0"
    counted_part: str = "0"
    n: str = "1"
    size: str = "0"
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows.drop("status")


Rule = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key, kind and part of an Arrow batch."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["_key", "_kind", "_part"], use_threads=False).aggregate(
                [("_n", "sum"), ("_low", "min"), ("_high", "max"), ("_ms", "max"), ("_at", "max")])
            t = t.select(["_key", "_kind", "_part", "_n_sum", "_low_min", "_high_max", "_ms_max", "_at_max"])
            yield from t.rename_columns(b.schema.names).cast(b.schema).to_batches()


def _marks(stream: DataFrame, how: Held, ttl: float) -> DataFrame:
    """Marks of the rows' state, in event time by their arrival, so that no row is late."""
    counts = stream.filter(f"({how.key}) is not null and ({how.counted_part}) is not null and not ({how.free})").selectExpr(
        f"cast({how.key} as string) as _key", f"{how.kind} as _kind", f"cast({how.counted_part} as long) as _part",
        f"cast({how.n} as long) as _n", f"cast({how.size} as long) as _low", f"cast({how.size} as long) as _high",
        "unix_millis(current_timestamp()) as _ms", "current_timestamp() as _at")
    counts, processor = counts.mapInArrow(_combined, COUNTS).withWatermark("_at", "0 seconds"), how.processor(round(ttl * 1000))
    if isinstance(processor, Bucketed):
        return in_buckets(counts, F.col("_key"), processor, MARK)
    return counts.groupBy("_key").transformWithState(processor, MARK, "append", "eventTime")


class _Log:
    """Rows that wait, by generation; `n` is the batch they came in."""

    def __init__(self, spark, path: str, schema, every: int):
        self.spark, self.path, self.schema, self.every = spark, path, schema, every

    def at(self, generation: int, part: str, number: int | None = None) -> str:
        return f"{self.path}/log/{generation}/{part}" + (f"/n={number}" if number is not None else "")

    def waiting(self, generation: int, upto: int, buckets: list[int] | None = None) -> DataFrame:
        """What waits before batch `upto`; of some buckets only, if they are given."""
        read = lambda part, schema: self.spark.read.schema(schema).parquet(self.at(generation, part)).filter(F.col("n") < upto)
        rows = read("new", f"{self.schema}, n int")
        if buckets is not None:
            rows = rows.filter(F.col("_bucket").isin(buckets))
        marks = read("marks", "_key string, _part long, n int").select(
            "_key", "_part", F.col("n").alias("_until")).groupBy("_key", "_part").agg(F.max("_until").alias("_until"))
        on = (rows["_key"] == marks["_key"]) & (rows["_part"] == marks["_part"]) & (rows["n"] < marks["_until"])
        return rows.join(marks, on, "left_anti")

    def open_generation(self, number: int) -> None:
        """The rows that wait become the base of a new generation: batch `number` - 1 of it."""
        new = number // self.every
        base = self.spark.createDataFrame([], self.schema) if not number \
            else self.waiting(new - 1, number).drop("n")
        base.sortWithinPartitions("_bucket").write.mode("overwrite").parquet(self.at(new, "new", number - 1))
        self.spark.createDataFrame([], "_key string, _part long").write.mode("overwrite").parquet(
            self.at(new, "marks", number - 1))

    def empty_generation(self, generation: int) -> None:
        """Overwrite a generation that is no longer read with nothing."""
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/log/{generation}")


def hold(stream: DataFrame, rule: Rule, path: str, ttl: float = 86400.0, every: int = 32) -> tuple[DataFrame, DataFrame]:
    """Run a rule over a stream to its present end: (released, held).

    A repeated batch overwrites what it wrote before.  A call on the same path
    goes on where the last one ended, also when nothing new has come.  Rows with
    a null key are held.
    """
    spark, how, columns = stream.sparkSession, rule.stream, stream.columns
    use_state_store(spark)
    bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")
    rows = stream.filter(how.waits).selectExpr(
        "*", f"cast({how.key} as string) as _key", f"cast({how.part} as long) as _part", f"{how.free} as _free")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) \
        + ", _key string, _part long, _bucket int"
    log = _Log(spark, path, schema, every)
    both = rows.unionByName(_marks(stream, how, ttl), allowMissingColumns=True)

    def step(batch: DataFrame, number: int) -> None:
        generation, first = divmod(number, every)
        batch = batch.persist()  # rows and marks come from one run of the state
        if not first:
            log.open_generation(number)
        elif first == 1 and generation:
            log.empty_generation(generation - 1)
        if not first or not batch.isEmpty():
            _one(batch, number, generation)
        spark.range(number, number + 1).write.mode("overwrite").parquet(f"{path}/last/k={number % 2}")
        batch.unpersist()

    def _one(batch: DataFrame, number: int, generation: int) -> None:
        new = batch.filter("_scope is null").drop("_status", "_scope")
        marks = batch.filter("_scope is not null").select("_key", "_part", "_status", "_scope")
        found = new.join(marks, ["_key", "_part"], "left")
        goes = found.filter("_free or _scope in ('all', 'new')")
        whole = marks.filter("_scope = 'all'")
        buckets = [r[0] for r in whole.select(bucket).distinct().collect()]  # BUCKETS at most
        released = goes.select(*columns, F.col("_status").alias("status"))
        if buckets:
            before = log.waiting(generation, number, buckets).join(whole, ["_key", "_part"])
            released = released.unionByName(before.select(*columns, F.col("_status").alias("status")))
        how.finish(released).write.mode("overwrite").parquet(f"{path}/released/n={number}")
        stays = found.filter("not _free and _scope is null")
        stays.select(*columns, "_key", "_part", bucket.alias("_bucket")).sortWithinPartitions("_bucket") \
            .write.mode("overwrite").parquet(log.at(generation, "new", number))
        whole.select("_key", "_part").write.mode("overwrite").parquet(log.at(generation, "marks", number))

    query = (both.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    last = spark.read.parquet(f"{path}/last").agg(F.max("id")).first()[0]
    held = log.waiting(last // every, last + 1).select(*columns)
    return spark.read.parquet(f"{path}/released").drop("n"), held


def complete_bags(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bags (ns, size) with all members go together; wrong ones go with their status.

    In a stream a member that comes after its bag has gone goes as `over`.
    """
    status = bag_status(rows).select("ns", "status")
    marked = rows.join(status, "ns")
    return marked.filter("status <> 'open'"), marked.filter("status = 'open'").drop("status")


def gather_ranks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of ranks go as one when all ranks are in.

    In a stream a rank that reports again after that is dropped.
    """
    counts = rows.groupBy("uid").agg((F.count_distinct("rank") >= F.max(F.coalesce("ranks", F.lit(1)))).alias("_all"))
    open_ = rows.join(counts.filter("not _all"), "uid", "left_semi")
    return merge_ranks(rows), open_


def when_known(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of kind `task` go when their `needs` is empty or named by a row of
    kind `key` (in its uid); keys stay known, in a stream for the rule's `ttl`."""
    tasks, keys = rows.filter("kind = 'task'"), rows.filter("kind = 'key'")
    names = keys.select(F.col("uid").alias("needs")).distinct()
    free = tasks.filter(F.coalesce("needs", F.lit("")) == "")
    asking = tasks.filter(F.coalesce("needs", F.lit("")) != "")
    released = free.unionByName(asking.join(names, "needs", "left_semi").select(rows.columns))
    kept = keys.dropDuplicates(["uid"])
    return released, asking.join(names, "needs", "left_anti").select(rows.columns).unionByName(kept)


def cancels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waiting tasks that a row of kind `cancel` names are taken out (released);
    requests stay, for tasks that come later, in a stream for the rule's `ttl`."""
    tasks, asked = rows.filter("kind = 'task'"), rows.filter("kind = 'cancel'").dropDuplicates(["uid"])
    out = tasks.join(asked.select("uid"), "uid", "left_semi")
    stay = tasks.join(asked.select("uid"), "uid", "left_anti")
    return out.select(rows.columns), stay.select(rows.columns).unionByName(asked)


def ordered_bags(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks of bag n of a namespace go when all bags before it are done.

    Columns kind, uid, ns, bag_order, size, n.  Rows of kind `task` wait, rows
    of kind `done` count finished members (n of them); a bag is done when
    `size` members are.  Held are waiting tasks and, in a batch job, one `done`
    row per bag; a stream keeps these counts in its state.
    """
    tasks, done = rows.filter("kind = 'task'"), rows.filter("kind = 'done'")
    bags = done.groupBy("ns", "bag_order").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    whole = bags.filter("n >= size").select("ns", "bag_order")
    # done bags without a gap from 0 on: the row number equals the order
    numbered = running(whole, ["ns"], ["bag_order"], number="_k")
    current = numbered.filter(F.col("_k") == F.col("bag_order") + 1).groupBy("ns").agg(F.max("_k").alias("_current"))
    marked = tasks.join(current, "ns", "left").withColumn(
        "_go", F.col("bag_order") <= F.coalesce("_current", F.lit(0)))
    counts = bags.select(F.lit("done").alias("kind"), F.lit(None).cast("string").alias("uid"), "ns", "bag_order",
                         F.col("size").cast(rows.schema["size"].dataType).alias("size"),
                         F.col("n").cast(rows.schema["n"].dataType).alias("n"))
    return (marked.filter("_go").select(rows.columns),
            marked.filter("not _go").select(rows.columns).unionByName(counts.select(rows.columns)))


complete_bags.stream = Held(Bags, "ns", size="size", finish=lambda rows: rows)
gather_ranks.stream = Held(Ranks, "uid", counted_part="rank", size="coalesce(ranks, 1)",
                           finish=lambda rows: merge_ranks(rows.drop("status")))
when_known.stream = Held(Known, "case when kind = 'task' then needs else uid end", "kind", "kind = 'task'",
                         free="kind = 'task' and coalesce(needs, '') = ''")
cancels.stream = Held(Known, "uid", "kind", "kind = 'task'")
ordered_bags.stream = Held(Order, "ns", "kind", "kind = 'task'", part="bag_order", counted_part="bag_order",
                           n="n", size="size")
