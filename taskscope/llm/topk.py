"""Exact top-k search by tiled matrix products.

Each component x becomes the integer floor(64 * x).  Vectors are packed into blocks of
one length and one width of integer, and written once.  Blocks of queries form groups and
blocks of candidates shards, as large as `GROUP_BYTES` and `SHARD_BYTES` allow; every
group meets every shard in a tile.  A tile multiplies its blocks pair by pair, keeps the
best of each product by partial selection, and hands on one list of k per query.  Lists
of `FAN` neighbouring shards are merged at a time until one is left.

Products are exact: a pair of blocks is multiplied in single precision only if no sum can
reach 2^24, in double precision below 2^53, in 64-bit integers below 2^63, and in
unbounded integers otherwise.  A score beyond 64 bits counts as the nearest 64-bit number.

The number of scores is that of queries times candidates, as the question asks; a tile
holds a group, a shard and one block of products, whatever the size of the tables.

Vectors that are null or hold a null, a NaN or an infinite component (also after the
factor) take no part, nor do rows without an id.  Vectors of different lengths do not
meet; empty ones meet with score 0.  A query's own id is no candidate for it.  Rows that
share an id are candidates one by one; as queries they count once if their vectors
agree, else each has its own list.  Ties go to the smaller id.  Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskscope.session import staged

SCALE = 64.0
#: Vectors, and bytes, of a block.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
#: Bytes of the integers of the queries of a group, and of the candidates of a shard.
GROUP_BYTES, SHARD_BYTES = 1 << 20, 1 << 24
#: Lists of one query that are merged at a time.
FAN = 16

_WIDTHS = (np.int8, np.int16, np.int32, np.float64)  # the last holds integers that need more bits
_LIMITS = (1 << 7, 1 << 15, 1 << 31)
BLOCKS = "query boolean, dim int, width int, most double, ids array<long>, data binary"
#: No score; scores are held between this and its opposite.
_NONE = np.iinfo(np.int64).min


def integers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and the integers of each, as doubles."""
    rows, out = [], []
    for i, v in enumerate(vectors):
        if v.is_valid:
            x = v.values
            if x.null_count == 0:
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(SCALE * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    rows.append(i)
                    out.append(x + 0.0)  # no negative zero
    return np.array(rows, np.int64), out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, is a query, vector) rows."""
    open_: dict[tuple, list] = {}

    def block(kind: tuple) -> pa.RecordBatch:
        query, dim, width = kind
        ids, own = zip(*open_.pop(kind))
        data = np.array(own).reshape(len(own), dim)
        return pa.RecordBatch.from_arrays(
            [pa.array([query]), pa.array([dim], pa.int32()), pa.array([width], pa.int32()),
             pa.array([float(np.abs(data).max(initial=0))]), pa.array([ids], pa.list_(pa.int64())),
             pa.array([data.astype(_WIDTHS[width]).tobytes()], pa.binary())],
            names=["query", "dim", "width", "most", "ids", "data"])

    for b in batches:
        rows, vectors = integers(b.column(2))
        own = b.take(pa.array(rows, pa.int64()))
        for i, query, x in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), vectors):
            most = np.abs(x).max(initial=0)
            kind = (query, len(x), sum(int(most >= limit) for limit in _LIMITS))
            held = open_.setdefault(kind, [])
            held.append((i, x))
            if len(held) == BLOCK or len(held) * len(x) * 8 >= BLOCK_BYTES:
                yield block(kind)
    for kind in list(open_):
        yield block(kind)


def packed(vectors: DataFrame, vec_id: str, vector: str, every: int) -> DataFrame:
    """The table of blocks, written."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.lit(False).alias("query"),
                          F.col(vector).alias("x")).filter("id is not null")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("query", F.lit(True)).dropDuplicates(["id", "x"])
    return staged(rows.union(asked).mapInArrow(_packed, BLOCKS)
                  .withColumn("block", F.monotonically_increasing_id()), "topk-blocks")


def product(a: np.ndarray, b: np.ndarray, most_a: float, most_b: float) -> np.ndarray:
    """All inner products of the rows of a and b, exact."""
    bound = int(most_a) * int(most_b) * max(a.shape[1], 1)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in m.tolist()] for m in (a, b)]
    held = [[min(max(sum(x * y for x, y in zip(p, q)), _NONE + 1), -_NONE - 1) for q in whole[1]] for p in whole[0]]
    return np.array(held, np.int64).reshape(len(a), len(b))


class Best:
    """The k best scores of each query so far, highest first, with their ids."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.scores = np.full((len(own), k), _NONE)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates in order of their ids; a query's own id is left out."""
        scores = np.where(self.own[:, None] == ids, _NONE, scores)
        rows = np.flatnonzero(scores.max(axis=1, initial=_NONE) >= self.scores[:, -1])
        if not len(rows) or not len(ids):
            return
        scores, take = scores[rows], min(self.k, len(ids))
        if max(abs(int(scores.max())), abs(int(scores.min(initial=0, where=scores > _NONE)))) < 1 << 40:
            # score and place in one number, so that the partial selection settles ties
            both = np.where(scores > _NONE, scores * len(ids) - np.arange(len(ids)), _NONE)
            at = np.argpartition(both, len(ids) - take, axis=1)[:, len(ids) - take:]
        else:
            at = np.argsort(~scores, axis=1, kind="stable")[:, :take]
        found = np.take_along_axis(scores, at, axis=1)
        scores = np.concatenate([self.scores[rows], found], axis=1)
        ids = np.concatenate([self.ids[rows], np.where(found > _NONE, ids[at], np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((ids, ~scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)


def _blocks(table: pa.Table) -> Iterator[tuple]:
    """(number, length, largest, ids in order, places in the block, vectors)."""
    if not table.num_rows:  # a side without rows may come without columns
        return
    for r in table.select(["block", "dim", "width", "most", "ids", "data"]).to_batches():
        for i in range(r.num_rows):
            block, dim, width, most, ids, data = (c[i] for c in r.columns)
            own = ids.values.to_numpy()
            order = np.argsort(own, kind="stable")
            matrix = np.frombuffer(data.as_py(), _WIDTHS[width.as_py()]).reshape(len(own), dim.as_py())
            yield block.as_py(), dim.as_py(), most.as_py(), own[order], order, matrix[order]


LISTS = "query_id long, block long, place int, shard long, vec_id long, score long"


def _tile(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in LISTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        lists = [pa.table({n: pa.array([], t) for n, t in zip(names, types)})]
        for block, dim, most, own, places, matrix in _blocks(queries):
            best = Best(own, k)
            for _, other_dim, other_most, ids, _, other in _blocks(candidates):
                if other_dim == dim:
                    best.add(product(matrix, other, most, other_most), ids)
            row, column = np.nonzero(best.scores > _NONE)
            values = [own[row], np.full(len(row), block), places[row], np.full(len(row), key[1].as_py()),
                      best.ids[row, column], best.scores[row, column]]
            lists.append(pa.table({n: pa.array(v, t) for n, v, t in zip(names, values, types)}))
        return pa.concat_tables(lists)
    return run


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, with their place."""
    ordered = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


def _of(parts: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(parts))


def search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row whose id
    is divisible by `every`, against all rows but its own."""
    spark = vectors.sparkSession
    blocks = packed(vectors, vec_id, vector, every)
    size = {r[0]: r[1] for r in blocks.groupBy("query").agg(F.sum(F.length("data"))).collect()}
    shards = max(1, -(-size.get(False, 0) // SHARD_BYTES))
    groups = max(1, -(-size.get(True, 0) // GROUP_BYTES))
    least = blocks.filter("not query").count()
    while groups * shards < 4 * spark.sparkContext.defaultParallelism and 2 * shards < least:
        shards *= 2  # small tables: more tiles than cores
    queries = (blocks.filter("query").withColumn("group", _of(groups))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    candidates = (blocks.filter("not query").withColumn("shard", _of(shards))
                  .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    at = [F.col("group").cast("long").alias("group"), F.col("shard").cast("long").alias("shard")]
    columns = [*at, "block", "dim", "width", "most", "ids", "data"]
    # both sides come from one table: new columns on the right, or the cogroup takes them for the left ones
    right = candidates.select(*columns)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    lists = (queries.select(*columns).groupBy("group", "shard")
             .cogroup(right.groupBy("group", "shard")).applyInArrow(_tile(k), LISTS))
    query = ["query_id", "block", "place"]
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = _first(lists.withColumn("shard", F.expr(f"shard div {FAN}")), [*query, "shard"], k).drop("rank")
    return _first(lists, query, k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 20
"""
