"""Boxes over resources and time, swept on compressed bounds.

The resources of a pilot are cut where any box begins or ends; between two such
bounds lies a strip, and within a strip all resources have the same boxes.  Work
follows the number of bounds, not the number of resources: a machine of 10^5
cores that is used in whole nodes has as many strips as nodes.

Sweeps over time are cut into cells, stretches of a pilot's time with about as many
boxes each, whatever their number.  A box is in every cell that it reaches into, so
that a cell needs no other, and moves in lists of boxes, not as a row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taskscope.session import staged

#: the metric of provided time that no box covers
UNUSED = "unused"
#: boxes of a cell, about, and the quantiles of which the bounds of cells are some
CELL, QUANTILES = 1 << 19, 4096
#: boxes that are put into lists at a time
PACK = 1 << 17


def strips_of(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, strip, r0, r1): the strips of each key, numbered from 1 in order.

    A key has at most one bound more than it has resources.
    """
    bounds = boxes.select(*keys, F.explode(F.array("r0", F.col("r1") + 1)).alias("r0")).distinct()
    order = Window.partitionBy(*keys).orderBy("r0")
    return bounds.withColumns({"strip": F.row_number().over(order), "r1": F.lead("r0").over(order) - 1}) \
                 .select(*keys, "strip", "r0", "r1")


def cut_boxes(boxes: DataFrame, strips: DataFrame, keys: list[str]) -> DataFrame:
    """`boxes` with `strip` in place of r0 and r1, one row for each strip a box covers.

    Both ends of a box are bounds, so its first and its last strip are found by equality.
    """
    first = strips.select(*keys, "r0", F.col("strip").alias("_s0"))
    last = strips.select(*keys, F.col("r0").alias("_end"), F.col("strip").alias("_s1"))
    return (boxes.withColumn("_end", F.col("r1") + 1).join(first, [*keys, "r0"]).join(last, [*keys, "_end"])
            .withColumn("strip", F.explode(F.sequence("_s0", F.col("_s1") - 1)))
            .drop("r0", "r1", "_end", "_s0", "_s1"))


def merge_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, r0, r1) that follow each other without a gap become one.

    The ranges of a key must not overlap, but may repeat.
    """
    order = Window.partitionBy(*keys).orderBy("r0")
    alone = lambda c: F.coalesce(c, F.lit(True))
    runs = rows.select(*keys, "r0", "r1").withColumns({
        "_first": F.when(alone(F.lag("r1").over(order) + 1 < F.col("r0")), F.col("r0")),
        "_last": alone(F.lead("r0").over(order) - 1 > F.col("r1"))})
    first = F.max("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.select(*keys, first.alias("r0"), "r1", "_last").filter("_last").drop("_last")


def _bounds(points: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """The times that part the cells of each key with more than `CELL` boxes: quantiles of their starts.

    `points` has a start `t0` in each row, of one box or of as many as its `weight`.  There are
    fewer of these times than `CELL` goes into the number of boxes.
    """
    weight = F.col("weight") if "weight" in points.columns else F.lit(1)
    q = F.percentile("t0", [i / QUANTILES for i in range(1, QUANTILES)], weight)
    step = f"greatest(1, {QUANTILES * CELL} div n)"
    rows = (points.groupBy(*keys).agg(F.sum(weight).alias("n"), q.alias("q")).filter(F.col("n") > CELL)
            .withColumn("q", F.expr(f"transform(sequence({step}, {QUANTILES - 1}L, {step}), i -> q[int(i) - 1])")))
    return {tuple(r[k] for k in keys): np.unique(r.q) for r in rows.collect()}


def _xored(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of 64-bit numbers as what differs from the row before; those at `first` as they are."""
    out = x.copy()
    out[1:] ^= x[:-1]
    out[first] = x[first]
    return out


def _unxored(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    out = np.bitwise_xor.accumulate(x, axis=0)
    before = out[np.maximum(first - 1, 0)]
    before[first == 0] = 0
    return out ^ np.repeat(before, np.diff(np.append(first, len(x))), axis=0)


def _binaries(data: np.ndarray | pa.Buffer, ends: np.ndarray) -> pa.Array:
    """Consecutive pieces of bytes, cut at `ends`, which begin with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)) if isinstance(data, np.ndarray) else data])


def _bytes_of(pieces: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All pieces as one array, and the number of items of each."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = pieces.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind), np.diff(ends) // size


class _Boxes:
    """Boxes of several lists, and their short form: binary columns with a row for each list.

    Times and numbers are kept as what differs from the box before, texts where they change:
    the phases of a task follow each other, and take a few bytes each when compressed.
    """

    def __init__(self, times: np.ndarray, numbers: dict[str, np.ndarray], texts: dict[str, tuple[np.ndarray, pa.Array]]):
        self.times, self.numbers, self.texts = times, numbers, texts  # texts: codes, -1 for null, and their values

    @classmethod
    def of_rows(cls, table: pa.Table, numbers: list[str], texts: list[str]) -> _Boxes:
        coded = {}
        for c in texts:
            d = pc.dictionary_encode(table[c]).combine_chunks()
            d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
            coded[c] = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False), d.dictionary
        times = np.column_stack([table[c].to_numpy().astype(np.float64) for c in ("t0", "t1")])
        return cls(times, {c: table[c].to_numpy().astype(np.int64) for c in numbers}, coded)

    @classmethod
    def read(cls, table: pa.Table, numbers: list[str], texts: list[str]) -> tuple[_Boxes, np.ndarray]:
        """The boxes of all rows, and how many there are in each."""
        one = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
        flat, n = _bytes_of(one("times"), np.int64)
        n = n // 2
        first = np.cumsum(n) - n
        first, lists = first[n > 0], len(n)
        times = _unxored(flat.reshape(-1, 1), 2 * first).view(np.float64).reshape(-1, 2)
        found = {c: _unxored(_bytes_of(one(c), np.int64)[0], first) for c in numbers}
        coded = {}
        for c in texts:
            size = _bytes_of(one(f"{c}_size"), np.int32)[0]
            own = size[size != -1]
            values = pa.Array.from_buffers(pa.string(), len(own), [
                None, pa.py_buffer(np.append(0, np.cumsum(np.maximum(own, 0))).astype(np.int32)),
                pa.py_buffer(_bytes_of(one(c), np.uint8)[0])])
            d = pc.dictionary_encode(values)
            code = np.where(own == -2, -1, d.indices.to_numpy(zero_copy_only=False))
            coded[c] = code[np.cumsum(size != -1) - 1], d.dictionary
        return cls(times, found, coded), n

    def taken(self, rows: np.ndarray) -> _Boxes:
        return _Boxes(self.times[rows], {c: x[rows] for c, x in self.numbers.items()},
                      {c: (x[rows], values) for c, (x, values) in self.texts.items()})

    def written(self, first: np.ndarray) -> dict[str, pa.Array]:
        """The short form; a list begins at each of `first`."""
        ends = np.append(first, len(self.times))
        out = {"times": _binaries(_xored(np.ascontiguousarray(self.times).view(np.int64).reshape(-1, 1), 2 * first), 16 * ends)}
        for c, x in self.numbers.items():
            out[c] = _binaries(_xored(x, first), 8 * ends)
        for c, (code, values) in self.texts.items():
            new = np.append(True, code[1:] != code[:-1])[:len(code)]
            new[first] = True
            size = np.append(pc.binary_length(values).to_numpy(zero_copy_only=False), -2).astype(np.int32)[code]
            size[~new] = -1
            own = values.take(pa.array(code[new & (code >= 0)]))
            upto = np.append(0, np.cumsum(np.maximum(size, 0)))[ends]
            out[f"{c}_size"] = _binaries(size, 4 * ends)
            out[c] = pa.Array.from_buffers(pa.binary(), len(first), [
                None, pa.py_buffer(upto.astype(np.int32)), own.buffers()[2] if upto[-1] else pa.py_buffer(b"")])
        return out

    def columns(self) -> dict:
        """NumPy arrays of times and numbers, dictionary arrays of texts."""
        return {"t0": self.times[:, 0], "t1": self.times[:, 1], **self.numbers, **{
            c: pa.DictionaryArray.from_arrays(pa.array(code, mask=code < 0), values) for c, (code, values) in self.texts.items()}}


def _packer(keys: list[str], numbers: list[str], texts: list[str], size: int):
    """Rows of boxes to lists of boxes per key, each of one task and of `size` rows or so."""
    def pack(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        code = np.zeros(table.num_rows, np.int64)
        for k in keys:
            part = pc.dictionary_encode(table[k], null_encoding="encode").combine_chunks()
            part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
            _, code = np.unique(code * (len(part.dictionary) + 1) + part.indices.to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
        found = _Boxes.of_rows(table, numbers, texts).taken(order).written(first)
        own = pa.array(order[first])
        return pa.RecordBatch.from_pydict({**{k: table[k].take(own).combine_chunks() for k in keys}, **found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= size:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))
    return run


def _starts(keys: list[str], step: int):
    """(keys, t0, weight): the starts of each list in groups of `step`, each by its middle one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes, n = _Boxes.read(batch, [], [])
            at, row, weight = [], [], []
            for i, part in enumerate(np.split(boxes.times[:, 0], np.cumsum(n)[:-1])):
                part = np.sort(part)
                group = np.arange(0, len(part), step)
                count = np.diff(np.append(group, len(part)))
                at.append(part[group + count // 2])
                row.append(np.full(len(group), i))
                weight.append(count)
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_pydict({**{k: batch[k].take(row) for k in keys}, "t0": pa.array(np.concatenate(at)),
                                                  "weight": pa.array(np.concatenate(weight))})
    return run


def _parter(keys: list[str], kind: list[str], numbers: list[str], texts: list[str], bounds):
    """Lists of boxes per key to lists per key and cell.

    A box comes in each cell that it reaches into.  Of boxes that began in an earlier cell
    only the latest end counts for each range and `kind`.
    """
    def part(row: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        boxes, _ = _Boxes.read(row, numbers, texts)
        (t0, t1), by = boxes.times.T, [boxes.numbers[c] for c in (*kind, "r0", "r1")]
        c0, c1 = np.searchsorted(edges, t0, "right"), np.searchsorted(edges, t1, "left")
        times = c1 - c0 + 1
        box = np.repeat(np.arange(len(t0)), times)
        later = np.arange(len(box)) - np.repeat(np.cumsum(times) - times, times)
        cell = c0[box] + later
        at = np.flatnonzero(later)
        if len(at):
            of = np.stack([cell[at], *(x[box[at]] for x in by)])
            order = np.lexsort((t1[box[at]], *of[::-1]))
            last = np.append((of[:, order[1:]] != of[:, order[:-1]]).any(axis=0), True)
            at = np.concatenate([np.flatnonzero(later == 0), at[order[last]]])
            box, cell = box[at], cell[at]
        order = np.argsort(cell, kind="stable")
        box, cell = box[order], cell[order]
        first = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        return pa.RecordBatch.from_pydict({**{k: pa.repeat(row[k][0], len(first)) for k in keys}, "cell": pa.array(cell[first]),
                                           **boxes.taken(box).written(first)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [bounds.value.get(key) for key in zip(*(batch[k].to_pylist() for k in keys))]
            for i, own in enumerate(edges):
                if own is not None:
                    yield part(batch.slice(i, 1), own)
            small = batch.filter(pa.array([own is None for own in edges], pa.bool_()))
            if small.num_rows:
                yield pa.RecordBatch.from_pydict({**{k: small[k] for k in keys}, "cell": pa.array(np.zeros(small.num_rows, np.int64)),
                                                  **{c: small[c] for c in small.schema.names if c not in keys}})
    return run


def _swept(boxes: DataFrame, keys: list[str], kind: list[str], sweep, schema: str) -> DataFrame:
    """`sweep(columns, start, end)` of the boxes of every cell, with its key: columns of `schema`.

    The time of a key is cut into cells of about `CELL` boxes.  A cell is swept by itself,
    on the strips between the bounds of its own boxes.  Boxes are computed once and written
    in their short form.
    """
    rest = [f for f in boxes.schema.fields if f.name not in [*keys, "t0", "t1"]]
    texts = [f.name for f in rest if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in rest if f.name not in texts]
    own = [boxes.schema[k] for k in keys]
    short = [T.StructField(c, T.BinaryType()) for c in ("times", *numbers, *(x for c in texts for x in (f"{c}_size", c)))]
    lists = staged(boxes.select(*keys, "t0", "t1", *numbers, *texts).mapInArrow(
        _packer(keys, numbers, texts, PACK), T.StructType([*own, *short])), "boxes", "zstd")
    points = lists.select(*keys, "times").mapInArrow(_starts(keys, max(1, CELL // 128)), T.StructType(
        [*own, T.StructField("t0", T.DoubleType()), T.StructField("weight", T.LongType())]))
    bounds = boxes.sparkSession.sparkContext.broadcast(_bounds(points, keys))
    out = T.StructType([*own, *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def of_cell(key: tuple, table: pa.Table) -> pa.Table:
        *key, cell = (k.as_py() for k in key)
        edges = bounds.value.get(tuple(key), np.zeros(0))
        start, end = edges[cell - 1] if cell else -np.inf, edges[cell] if cell < len(edges) else np.inf
        found = sweep(_Boxes.read(table, numbers, texts)[0].columns(), start, end)
        n = len(next(iter(found.values())))
        keyed = {k: pa.repeat(pa.scalar(v, arrow.field(k).type), n) for k, v in zip(keys, key)}
        return pa.table({**keyed, **found}).select(arrow.names).cast(arrow)

    return (lists.mapInArrow(_parter(keys, kind, numbers, texts, bounds),
                             T.StructType([*own, T.StructField("cell", T.LongType()), *short]))
            .groupBy(*keys, "cell").applyInArrow(of_cell, out))


def _on_strips(r0: np.ndarray, r1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, box, strip): strip i goes from bounds[i] up to bounds[i + 1]; a row for each strip of each box."""
    bounds = np.unique(np.concatenate([r0, r1 + 1]))
    first, end = np.searchsorted(bounds, r0), np.searchsorted(bounds, r1 + 1)
    box = np.repeat(np.arange(len(r0)), end - first)
    return bounds, box, first[box] + np.arange(len(box)) - np.repeat(np.cumsum(end - first) - (end - first), end - first)


def _places(columns: list) -> np.ndarray:
    """Places of rows in the order of the columns, equal rows at equal places; nulls come last."""
    at, most = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if isinstance(c, pa.DictionaryArray):
            rank = np.empty(len(c.dictionary) + 1, np.int64)
            rank[pc.array_sort_indices(c.dictionary).to_numpy()] = np.arange(len(c.dictionary))
            rank[-1] = len(c.dictionary)
            code = rank[pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False)]
        else:
            _, code = np.unique(c, return_inverse=True)
        own = int(code.max(initial=0)) + 1
        if most * own >= 1 << 62:
            _, at = np.unique(at, return_inverse=True)
            most = len(at)
        at, most = at * own + code, most * own
    return np.unique(at, return_inverse=True)[1]


def _sorted_by(*columns: np.ndarray) -> np.ndarray:
    """Order of rows by columns of numbers from 0 on, the first one first."""
    size = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(size) >= 1 << 62:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], size[1:]):
        key = key * n + c
    return np.argsort(key)


def _overlapping(columns: dict, start: float, end: float) -> dict:
    t0, t1, r0, r1 = (columns[c] for c in ("t0", "t1", "r0", "r1"))
    own = t0 >= start
    # earlier by start, end, metric and uid; what began in an earlier cell comes first
    place = np.where(own, 1 + _places([columns[c] for c in ("t0", "t1", "metric", "uid")]), 0)
    bounds, box, strip = _on_strips(r0, r1)
    order = _sorted_by(strip, place[box])
    box, strip = box[order], strip[order]
    ends, level = np.unique(t1, return_inverse=True)
    # the maxima of a strip begin anew, as all of its values are above those of the strip before
    most = np.maximum.accumulate(strip * len(ends) + level[box])[:-1] - strip[1:] * len(ends)
    at = 1 + np.flatnonzero((most >= 0) & own[box[1:]] & (t0[box[1:]] < ends[np.maximum(most, 0)]))
    before = most[at - 1]
    box, strip = box[at], strip[at]
    order = _sorted_by(place[box], before, strip)
    box, strip, before = box[order], strip[order], before[order]
    new = np.flatnonzero(np.append(True, (np.diff(place[box]) != 0) | (np.diff(before) != 0) | (np.diff(strip) != 1))[:len(box)])
    last = np.append(new[1:], len(box))[:len(new)] - 1
    at = box[new]
    return {"r0": pa.array(bounds[strip[new]]), "r1": pa.array(bounds[strip[last] + 1] - 1), "t0": pa.array(t0[at]), "t1": pa.array(t1[at]),
            **{c: columns[c].take(pa.array(at)).dictionary_decode() for c in ("metric", "uid")}, "before": pa.array(ends[before[new]])}


def overlaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that begin on resources before an earlier box there has ended.

    (keys, r0, r1, metric, uid, t0, t1, before): `before` is the latest end of
    earlier boxes on r0..r1.  Earlier is by start; boxes with the same start
    follow each other by end, metric and uid.
    """
    boxes = boxes.filter(F.col("t1") > F.col("t0")).select(
        *keys, *[F.col(c).cast("long").alias(c) for c in ("r0", "r1")], "t0", "t1", "metric", "uid")
    return _swept(boxes, keys, [], _overlapping,
                  "r0 long, r1 long, metric string, uid string, t0 double, t1 double, before double")


def _attributed(metrics: int):
    def run(columns: dict, start: float, end: float) -> dict:
        t0, t1, r0, r1, place = (columns[c] for c in ("t0", "t1", "r0", "r1", "place"))
        bounds, box, strip = _on_strips(r0, r1)
        time = np.concatenate([np.maximum(t0, start)[box], np.minimum(t1, end)[box]])
        strip, of, by = np.tile(strip, 2), np.tile(place[box], 2), np.repeat(np.array([1, -1], np.int32), len(box))
        order = np.lexsort((time, strip))
        time, strip, of, by = time[order], strip[order], of[order], by[order]
        open_ = lambda p: np.cumsum(np.where(of == p, by, 0)) > 0
        metric = np.full(len(time), metrics)
        for p in np.unique(place)[::-1]:  # the first in order is written last
            if p >= 0:
                metric[open_(p)] = p
        at = np.flatnonzero(open_(-1)[:-1] & (strip[1:] == strip[:-1]) & (time[1:] > time[:-1]))
        used = np.bincount(metric[at], (time[at + 1] - time[at]) * np.diff(bounds)[strip[at]], metrics + 1)
        found = np.flatnonzero(used)
        return {"place": pa.array(found), "used": pa.array(used[found])}
    return run


def attribution(boxes: DataFrame, total: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, used, given, share): provided resource time, each instant of each resource once.

    Where boxes overlap, the metric that comes first in `order` counts; metrics
    that are not in it count after all others, as `other`.  Time outside `total`
    does not count; time that no box covers is `unused`.  The shares of a key
    add up to one.
    """
    cols = [*keys, *[F.col(c).cast("long").alias(c) for c in ("r0", "r1")], "t0", "t1"]
    place = F.coalesce(*[F.when(F.col("metric") == m, i) for i, m in enumerate(order)], F.lit(len(order)))
    both = (boxes.select(*cols, place.alias("place"))
            .unionByName(total.select(*cols, F.lit(-1).alias("place")))  # -1 is what is provided
            .filter(F.col("t1") > F.col("t0")))
    names = F.array(*[F.lit(m) for m in [*order, "other", UNUSED]])
    used = staged(_swept(both, keys, ["place"], _attributed(len(order) + 1), "place int, used double")
                  .select(*keys, F.element_at(names, F.col("place") + 1).alias("metric"), "used"), "attributed")
    spent = used.groupBy(*keys, "metric").agg(F.sum("used").alias("used"))
    given = used.groupBy(*keys).agg(F.sum("used").alias("given"))
    return spent.join(given, keys).withColumn("share", F.col("used") / F.col("given"))
