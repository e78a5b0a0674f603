"""State of many keys in one value, for streams with many keys per micro-batch.

A stateful processor pays for each access to a key's state with a message to the
store, about a millisecond a key.  Here keys are dealt to a fixed number of buckets;
the state of a bucket is one Arrow table, read and written once per micro-batch, and
its keys are worked on together.  A bucket has one timer, at the earliest end of
its keys.  Only buckets with new rows or a timer that has come are touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of keys of a stream; fixed for the life of its checkpoint.
BUCKETS = 256


class Bucketed(StatefulProcessor):
    """State of the keys of a bucket: a table of `layout`, whose column `ends` is the time
    (ms) at which a key's timer goes off, 0 for never.

    `seen` gets the table and the new rows and gives the table and what goes out; `ended` gets
    the rows of the table whose time has come and gives what of them stays and what goes out.
    """

    layout: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "keys binary, timer long")

    def _load(self) -> tuple[pd.DataFrame, int]:
        keys, timer = self.bucket.get() or (None, 0)
        table = pa.ipc.open_stream(keys).read_all() if keys else self.layout.empty_table()
        return table.to_pandas(), timer

    def _store(self, state: pd.DataFrame, timer: int, fired: int = 0) -> None:
        ends = state["ends"][state["ends"] > 0]
        now = int(ends.min()) if len(ends) else 0
        if now != timer:
            if timer and timer != fired:
                self.handle.deleteTimer(timer)
            if now:
                self.handle.registerTimer(now)
        if not len(state):
            self.bucket.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.layout) as writer:
            writer.write_table(pa.Table.from_pandas(state[self.layout.names], self.layout, preserve_index=False))
        self.bucket.update((sink.getvalue().to_pybytes(), now))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        state, out = self.seen(state, pd.concat(list(rows), ignore_index=True))
        self._store(state, timer)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        over = (state["ends"] > 0) & (state["ends"] <= timerValues.getCurrentWatermarkInMs())
        stays, out = self.ended(state[over])
        self._store(pd.concat([state[~over], stays], ignore_index=True), timer, expiredTimerInfo.getExpiryTimeInMs())
        if len(out):
            yield out

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, key: Column, processor: Bucketed, schema: str) -> DataFrame:
    """`processor` over the buckets of `key`, in event time.

    It gets the columns without underscores in front, which named tuples may not have.
    """
    rows = rows.withColumn("in_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return (rows.toDF(*[c.lstrip("_") for c in rows.columns]).groupBy("in_bucket")
            .transformWithStateInPandas(processor, schema, "append", "eventTime"))
