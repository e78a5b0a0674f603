"""State-update messages, subscribers, and helpers to run a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.session import SETTINGS, fresh_path

log = logging.getLogger(__name__)

UPDATE = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("seq", T.LongType()),
])


def read_updates(messages: DataFrame, item: T.StructType = UPDATE) -> DataFrame:
    """Update rows from messages `{"cmd": "update", "arg": one or many}`.

    `messages` has a text column `value`, as Kafka and text sources give.
    Other commands are left out.
    """
    kind = F.get_json_object("value", "$.cmd")
    arg = F.get_json_object("value", "$.arg")
    many = F.from_json(arg, T.ArrayType(item))  # a single object becomes a list of one
    return messages.filter(kind == "update").select(F.explode(many).alias("u")).select("u.*")


def first_per_batch(df: DataFrame, keys: list[str], order: str, last: bool = False, latest: list[str] = []) -> DataFrame:
    """Combine map-side: per Arrow batch and key only the smallest `order` goes
    on, or the largest with `last`, and the largest of each column of `latest`.

    For streams whose first (or last) row per key decides; a hot key then sends
    a few rows per batch to its stateful task instead of all.  Columns are keys,
    order and latest only.
    """
    rows = df.select(*keys, order, *latest)
    names = [*keys, order, *latest]
    picks = [(order, "max" if last else "min"), *((c, "max") for c in latest)]

    def combine(batches):
        for batch in batches:
            small = pa.Table.from_batches([batch]).group_by(keys).aggregate(picks)
            small = small.select([*keys, *(f"{c}_{p}" for c, p in picks)]).rename_columns(names)
            yield from small.cast(batch.schema).to_batches()

    return rows.mapInArrow(combine, rows.schema)


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a session setting."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet below `path`, and read it."""
    use_state_store(stream.sparkSession)
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start(f"{path}/data"))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def latest_rows(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run an updating aggregation to the end; the last row per key counts.

    Each micro-batch is written under its number, so a repeated batch replaces
    its own rows.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/n={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/data").drop("n")
    rest = [c for c in stream.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
            .select(*keys, "_r.*"))


def foreach_transition(stream: DataFrame, fn: Callable, uid: str = "*", bulk: bool = False,
                       checkpoint: str | None = None):
    """Call a subscriber for the transitions of one uid or of all (`*`).

    With `bulk` it is called with the DataFrame of a micro-batch, else with each
    row, where that row is.  A subscriber that fails is logged; the stream goes
    on.  Returns the started query.
    """
    wanted = stream if uid == "*" else stream.filter(F.col("uid") == uid)

    def each(rows):
        for row in rows:
            try:
                fn(row)
            except Exception:
                log.exception("subscriber failed for %s", row)

    def notify(batch: DataFrame, number: int) -> None:
        try:
            if bulk:
                fn(batch)
            else:
                batch.foreachPartition(each)
        except Exception:
            log.exception("subscriber failed for batch %s", number)

    return (wanted.writeStream.foreachBatch(notify)
            .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "subscriber"))
            .trigger(availableNow=True).start())


def waiting_size(changes: DataFrame) -> DataFrame:
    """Items waiting: rows of kind `arrive` less rows of kind `assign`, per queue."""
    step = F.when(F.col("kind") == "arrive", 1).when(F.col("kind") == "assign", -1).otherwise(0)
    return changes.groupBy("queue").agg(F.sum(step).alias("waiting"))
