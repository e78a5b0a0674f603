"""Ordered computations per key that do not depend on the size of one key.

A window over a key runs in one task, so one key with a third of all rows would
stall the job.  Here rows are range partitioned by (key, order), which splits a
large key over many tasks; each task works on its run of rows and the totals of
earlier runs of the same key are added.  The plan is the same for all sizes.

The number of ranges is what `spark.sql.adaptive.coalescePartitions.initialPartitionNum`
allows at most; adaptive execution joins small ranges, so it follows the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskscope.session import cut

RUN = "_run"


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(left, right)])


def in_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in global order, numbered by the task that holds them.

    The checkpoint fixes which row is in which run, also after a lost executor.
    """
    return _in_ranges(df, [*keys, *order]).withColumn(RUN, F.spark_partition_id())


def _in_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    # no fixed number: ranges follow the size of the data
    return cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns))


def _spanning(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of keys that reach over more than one run.

    In range order only the last key of a run can go on in the next one, so
    this has at most two rows per run and is safe to broadcast.
    """
    several = (totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .filter("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    on = same([F.col(k) for k in keys], [F.col(f"_k{i}") for i in range(len(keys))])
    return totals.join(several, on, "left_semi")


def _with_carry(df: DataFrame, totals: DataFrame, keys: list[str], carry: dict) -> DataFrame:
    """Join what earlier runs of the key hand over; null in a key's first run."""
    before = Window.partitionBy(*keys).orderBy(RUN)
    handed = _spanning(totals, keys)
    handed = handed.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(RUN).alias("_krun"),
        *[build(before).alias(name) for name, build in carry.items()])
    on = same([F.col(RUN)] + [F.col(k) for k in keys],
              [F.col("_krun")] + [F.col(f"_k{i}") for i in range(len(keys))])
    joined = df.join(F.broadcast(handed), on, "left")
    return joined.drop("_krun", *[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[str],
            sums: dict[str, Column] = {}, maxs: dict[str, Column] = {},
            lags: dict[str, Column] = {}, past_maxs: dict[str, Column] = {},
            number: str | None = None) -> DataFrame:
    """Add running sums and maxima (with the row itself), the value of the row
    before, the maximum of all rows before, and the row number, per key in the
    given order.

    The order must be unique within a key; column names must be new.
    """
    if not keys:
        raise ValueError("running needs a key; see global_index")
    inputs = {**sums, **maxs, **past_maxs, **lags}
    df = in_runs(df.withColumns({f"_in_{n}": c for n, c in inputs.items()}), keys, order)
    col = {n: F.col(f"_in_{n}") for n in inputs}
    group = [RUN, *keys]

    ordered = Window.partitionBy(*group).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {n: F.sum(col[n]).over(upto) for n in sums}
    new.update({n: F.max(col[n]).over(upto) for n in maxs})
    new.update({n: F.max(col[n]).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
                for n in past_maxs})
    new.update({n: F.lag(col[n]).over(ordered) for n in lags})
    if number or lags:
        new[number or "_pos"] = F.row_number().over(ordered)
    out = df.withColumns(new)

    last = F.struct(*order)
    totals = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(col[n]).alias(f"_t_{n}") for n in sums],
        *[F.max(col[n]).alias(f"_t_{n}") for n in (*maxs, *past_maxs)],
        *[F.max_by(col[n], last).alias(f"_t_{n}") for n in lags])
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_c_rows": lambda w: F.sum("_rows").over(past(w))}
    for n in sums:
        carry[f"_c_{n}"] = lambda w, n=n: F.sum(f"_t_{n}").over(past(w))
    for n in (*maxs, *past_maxs):
        carry[f"_c_{n}"] = lambda w, n=n: F.max(f"_t_{n}").over(past(w))
    for n in lags:
        carry[f"_c_{n}"] = lambda w, n=n: F.lag(f"_t_{n}").over(w)
    out = _with_carry(out, totals, keys, carry)

    pos = number or "_pos"
    fixed = {}
    for n in sums:
        # a sum of nulls stays null, as in a plain window
        fixed[n] = F.when(F.col(n).isNull(), F.col(f"_c_{n}")) \
                    .otherwise(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in (*maxs, *past_maxs):
        fixed[n] = F.greatest(n, f"_c_{n}")
    for n in lags:
        fixed[n] = F.when(F.col(pos) == 1, F.col(f"_c_{n}")).otherwise(F.col(n))
    if number:
        fixed[number] = F.col(number) + F.coalesce(F.col("_c_rows"), F.lit(0))
    helpers = [RUN, "_pos", "_c_rows", *[f"_c_{n}" for n in inputs], *[f"_in_{n}" for n in inputs]]
    return out.withColumns(fixed).drop(*helpers)


def global_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number all rows from 0 in the given order, without one task seeing them all.

    Ranges are sorted in parallel; a row's number is its position in its range
    plus the number of rows in earlier ranges (one small row per range).
    """
    placed = _in_ranges(df, order).withColumns({
        RUN: F.spark_partition_id(),
        "_id": F.monotonically_increasing_id(),
    })
    sizes = placed.groupBy(RUN).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(RUN).alias("_orun"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    in_range = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(offsets), F.col(RUN) == F.col("_orun"))
            .withColumn(name, in_range + F.col("_offset"))
            .drop(RUN, "_id", "_orun", "_offset"))


def global_running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Running sum over all rows in the given order, range by range."""
    ranged = in_runs(df.withColumn("_in", value), [], order)
    upto = (Window.partitionBy(RUN).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(RUN).agg(F.sum("_in").alias("_t"))
               .select(F.col(RUN).alias("_orun"),
                       F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset")))
    return (ranged.withColumn(name, F.sum("_in").over(upto))
            .join(F.broadcast(offsets), F.col(RUN) == F.col("_orun"))
            .withColumn(name, F.col(name) + F.col("_offset"))
            .drop(RUN, "_orun", "_offset", "_in"))


def listed(df: DataFrame, keys: list[str], order: list[str], item: Column,
           name: str, size: int = 4096) -> DataFrame:
    """Lists per key in order, in chunks of `size` items: (keys, chunk, name).

    No row ever holds more than one chunk, however many items a key has.
    """
    numbered = running(df.withColumn("_item", item), keys, order, number="_n")
    chunk = F.floor((F.col("_n") - 1) / size).cast("long")
    return (numbered.groupBy(*keys, chunk.alias("chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("_n", "_item"))).alias("_l"))
            .select(*keys, "chunk", F.col("_l._item").alias(name)))
