"""Assign work to targets, and check what fits where."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.operators.ordered import RUN, global_index
from taskscope.operators.state import value_of
from taskscope.schema import state_values
from taskscope.session import fresh_path


def with_uid(df: DataFrame, order: list[str], prefix: str = "task") -> DataFrame:
    """Rows without an id get `task.000000`, `task.000001`, ... in order, after the ids of that form that rows have."""
    missing = F.coalesce("uid", F.lit("")) == ""
    numbered = global_index(df.filter(missing).drop("uid"), order, "_no")
    number = F.regexp_extract("uid", rf"^{re.escape(prefix)}\.([0-9]{{1,18}})$", 1).try_cast("long")
    used = df.filter(~missing).agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("_used"))  # one row
    named = (numbered.crossJoin(F.broadcast(used))
             .withColumn("uid", F.format_string(prefix + ".%06d", F.col("_no") + F.col("_used"))).drop("_no", "_used"))
    return df.filter(~missing).unionByName(named.select(df.columns))


def assign_round_robin(tasks: DataFrame, targets: list[str], order=("uid",), to: str = "pilot") -> DataFrame:
    """Items without a target take them in turn; bound items keep theirs."""
    if not targets:
        return tasks
    free = F.coalesce(F.col(to), F.lit("")) == ""
    names = F.array(*[F.lit(t) for t in targets])
    dealt = global_index(tasks.filter(free), list(order), "_no")
    dealt = dealt.withColumn(to, F.get(names, F.pmod("_no", F.lit(len(targets))).cast("int"))).drop("_no")
    return tasks.filter(~free).unionByName(dealt.select(tasks.columns))


def route(tasks: DataFrame, names: list[str], order=("uid",)) -> DataFrame:
    """Tasks with `queue`: the named master's, any in turn for `*`, null while
    that master is unknown.  Tasks that name none, and workers, get `agent`."""
    asked = F.coalesce("raptor_id", F.lit(""))
    direct = (asked == "") | (F.coalesce("mode", F.lit("")) == "raptor.worker")
    tasks = tasks.withColumn("queue", F.when(direct, F.lit("agent"))
                             .when(F.col("raptor_id").isin(names), F.col("raptor_id")))
    turn = ~direct & (asked == "*")
    if not names:
        return tasks
    shared = assign_round_robin(tasks.filter(turn), names, order, "queue")
    return tasks.filter(~turn).unionByName(shared)


def assign_capacity(tasks: DataFrame, targets: list[tuple], hwm: float = 200.0, order=("uid",),
                    reject_larger: bool = False) -> DataFrame:
    """Tasks with `pilot`: fill targets one after the other, the rest waits.

    `targets` are (name, cores, used).  A target takes items until its used
    cores reach hwm percent of its cores; the last item may overshoot.  With
    `reject_larger` items larger than every target wait too.

    Each cut depends on the one before, as the last item may overshoot.  Items are
    written in ranges of their order; the totals of the ranges say in which one the
    next cut lies, and that range is read once for all its cuts.  So jobs follow
    the ranges in which something is cut, not the targets.
    """
    size = F.col("ranks") * F.col("cores_per_rank")
    larger = F.lit(False)
    if reject_larger and targets:
        larger = size > max(cores for _, cores, _ in targets)
    sized = tasks.filter(~larger).withColumn("_size", size.cast("long"))
    path = fresh_path(tasks.sparkSession, "capacity")
    (sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(RUN, F.spark_partition_id())
     .write.partitionBy(RUN).parquet(path))
    items = tasks.sparkSession.read.schema(T.StructType([*sized.schema, T.StructField(RUN, T.IntegerType())])).parquet(path)
    totals = sorted((r[0], r[1]) for r in items.groupBy(RUN).agg(F.sum("_size")).collect())  # one row per range

    rooms = [(name, cores * hwm / 100.0 - used) for name, cores, used in targets]
    rooms = [(name, room) for name, room in rooms if room > 0]
    offsets, cuts, start, upto = [], [], 0, 0
    for run, total in totals:
        offsets.append((run, upto))
        if len(cuts) < len(rooms) and upto + total >= start + rooms[len(cuts)][1]:
            inside = _cuts(items.filter(F.col(RUN) == run), list(order), upto, start, [room for _, room in rooms[len(cuts):]])
            cuts += inside
            start = cuts[-1]
        upto += total
    names = [name for name, _ in rooms[:len(cuts) + 1]]
    starts = [0, *cuts][:len(names)]
    ends = [*cuts, None][:len(names)]

    # the sum up to an item, and the target in whose stretch it begins
    ordered = Window.partitionBy(RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.sparkSession.createDataFrame(offsets, f"{RUN} int, _offset long")
    before = items.join(F.broadcast(shift), RUN).withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_size").over(ordered), F.lit(0))).select(*tasks.columns, "_before")
    placed = before.mapInArrow(_placed(names, starts, ends), T.StructType(
        [*tasks.drop("pilot").schema, T.StructField("pilot", T.StringType())]))
    if not reject_larger:
        return placed
    return placed.unionByName(tasks.filter(larger).withColumn("pilot", F.lit(None).cast("string"))
                              .select(placed.columns))


def _cuts(items: DataFrame, order: list[str], upto: int, start: int, rooms: list[float]) -> list[int]:
    """The sums at which targets are full, as far as they lie in these items, which one task reads in order."""
    def run(batches):
        at, since, found = upto, start, []
        for b in batches:
            sums = at + np.cumsum(b.column(0).to_numpy())
            while len(found) < len(rooms):
                i = int(np.searchsorted(sums, since + rooms[len(found)]))
                if i == len(sums):
                    break
                since = int(sums[i])
                found.append(since)
            at = int(sums[-1]) if len(sums) else at
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["cut"])

    rows = items.coalesce(1).sortWithinPartitions(*order).select("_size").mapInArrow(run, "cut long")
    return sorted(r.cut for r in rows.collect())


def _placed(names: list[str], starts: list[int], ends: list[int | None]):
    """Adds `pilot` in place of `_before`, the last column."""
    begin = np.array(starts, np.int64)
    until = np.array([np.iinfo(np.int64).max if e is None else e for e in ends], np.int64)
    shown = pa.array([*names, None], pa.string())

    def run(batches):
        for b in batches:
            before = b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(begin, before, side="right") - 1
            fits = (at >= 0) & (before < until[at]) if len(begin) else np.zeros(len(before), bool)
            keep = [n for n in b.schema.names if n not in ("pilot", "_before")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), shown.take(pa.array(np.where(fits, at, len(names))))],
                                             names=[*keep, "pilot"])
    return run


def used_capacity(tasks: DataFrame) -> DataFrame:
    """Cores per pilot of tasks that have not gone past execution."""
    running = value_of(F.col("state")) <= state_values("task")["AGENT_EXECUTING"]
    cores = F.col("ranks") * F.col("cores_per_rank")
    return tasks.filter("pilot is not null").groupBy("pilot").agg(
        F.sum(F.when(running, cores).otherwise(0)).alias("used"))


REQUEST = ["cores_per_rank", "gpus_per_rank", "lfs_per_rank", "mem_per_rank", "ranks_per_node"]


HAVE = ["cores", "gpus", "lfs", "mem"]
#: Distinct shapes of a block, and of a bucket in it; distinct requests that meet a block at once.
SHAPES, BUCKET, REQUESTS = 1 << 16, 64, 1024


def feasible(tasks: DataFrame, shapes: DataFrame) -> DataFrame:
    """Tasks with the node shapes that can hold a rank: `n_shapes`, and
    `most_ranks`, the most ranks one node takes.

    `shapes`: shape, cores, gpus, lfs, mem per node.  Both sides repeat few
    distinct vectors, so these are counted first.  Blocks of shapes are divided
    into buckets by halving one dimension after the other.  A bucket whose least
    shape holds a request counts whole, one whose largest does not counts for
    nothing; only shapes of the buckets between are compared.  The most ranks
    are looked for in the buckets that allow most.  A block gives one row per
    request; the answer is joined back by equality.
    """
    requests = tasks.select(*REQUEST).distinct()
    vectors = shapes.filter("gpus >= 0").groupBy(*HAVE).agg(F.count(F.lit(1)).alias("_same"))
    blocks = lambda df, size: -(-df.count() // size) or 1
    many, chunks = blocks(vectors, SHAPES), blocks(requests, REQUESTS)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    left = requests.withColumns({"_chunk": number(REQUEST, chunks), "_block": spread(many)})
    right = vectors.withColumns({"_block": number(HAVE, many), "_chunk": spread(chunks)})
    asked = [tasks.schema[c] for c in REQUEST]
    # shapes whose chunk has no request meet nothing, and need no group
    right = right.join(left.select("_chunk").distinct(), "_chunk", "left_semi")
    found = left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block")).applyInArrow(
        _fits, T.StructType([*asked, T.StructField("n", T.LongType()), T.StructField("most", T.LongType())]))
    answer = found.groupBy(*REQUEST).agg(F.sum("n").alias("n_shapes"), F.max("most").alias("most_ranks"))
    answer = answer.select(*[F.col(c).alias(f"_{c}") for c in REQUEST], "n_shapes", "most_ranks")
    back = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REQUEST])
    return (tasks.join(answer, back, "left").drop(*[f"_{c}" for c in REQUEST])
            .withColumns({"n_shapes": F.coalesce("n_shapes", F.lit(0)),
                          "most_ranks": F.coalesce("most_ranks", F.lit(0))}))


def buckets(vectors: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Rows of vectors in groups of at most `size`, halved along one dimension after the other."""
    todo, out = [(np.arange(len(vectors)), 0)], []
    while todo:
        rows, turn = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        rows = rows[np.argsort(vectors[rows, turn % vectors.shape[1]], kind="stable")]
        todo += [(half, turn + 1) for half in np.array_split(rows, 2)]
    return out


def _ranks(have: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Ranks that each row of `have` takes; what is not asked for sets no limit."""
    needs = np.flatnonzero(ask > 0)
    return np.floor(have[:, needs] / ask[needs]).min(axis=1, initial=np.inf)


def _fits(requests: pa.Table, shapes: pa.Table) -> pa.Table:
    """Per request the shapes of the block that hold it, and the most ranks that one of them takes."""
    if not shapes.num_rows:
        return requests.select(REQUEST).append_column("n", pa.array([0] * requests.num_rows, pa.int64())) \
            .append_column("most", pa.nulls(requests.num_rows, pa.int64()))
    matrix = lambda t, cols: np.stack([t.column(c).cast(pa.float64()).to_numpy() for c in cols], axis=1)
    have, same = matrix(shapes, HAVE), shapes.column("_same").to_numpy()
    ask = matrix(requests, REQUEST[:4])  # a null is NaN, which nothing holds
    per_node = requests.column(REQUEST[4]).to_pylist()
    groups = buckets(have)
    low, high = (np.array([f(have[g], axis=0) for g in groups]) for f in (np.min, np.max))
    count = np.array([same[g].sum() for g in groups])
    whole = (low[None] >= ask[:, None]).all(axis=2)
    some = (high[None] >= ask[:, None]).all(axis=2)
    n = whole @ count
    most: list[int | None] = []
    for i, row in enumerate(ask):
        for g in np.flatnonzero(some[i] & ~whole[i]).tolist():
            n[i] += same[groups[g]][(have[groups[g]] >= row).all(axis=1)].sum()
        best, open_ = -1.0, np.flatnonzero(some[i])
        bound = _ranks(high[open_], row)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] <= best:
                break
            own = have[groups[open_[k]]]
            best = max(best, _ranks(own[(own >= row).all(axis=1)], row).max(initial=-1.0))
        limit = np.inf if per_node[i] is None else per_node[i]
        best = min(best, limit) if best >= 0 else -1.0
        most.append(int(best) if 0 <= best < np.inf else None)
    return requests.select(REQUEST).append_column("n", pa.array(n, pa.int64())).append_column("most", pa.array(most, pa.int64()))


def split_bound(tasks: DataFrame, pilots: DataFrame) -> DataFrame:
    """Tasks with `binding`: known, unknown (waits for its pilot) or unbound."""
    known = pilots.select(F.col("uid").alias("pilot")).distinct().withColumn("_known", F.lit(True))
    bound = F.coalesce("pilot", F.lit("")) != ""
    return (tasks.join(known, "pilot", "left")
            .withColumn("binding", F.when(~bound, F.lit("unbound"))
                        .when(F.col("_known"), F.lit("known")).otherwise(F.lit("unknown")))
            .drop("_known"))


def eligible_env(tasks: DataFrame, envs: DataFrame) -> DataFrame:
    """Tasks that name no environment, or one that exists."""
    known = envs.select("named_env").distinct().withColumn("_known", F.lit(True))
    free = F.coalesce("named_env", F.lit("")) == ""
    return tasks.join(known, "named_env", "left").filter(free | F.col("_known")).drop("_known")
