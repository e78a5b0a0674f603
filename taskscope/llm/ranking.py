"""Ranked lexical search over an index whose terms have owners, in a pipeline.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in
lower case, known by 64-bit hashes.  One pass over the documents writes an index: for
each shard of at most `SHARD` documents the postings of every term that a query may hold
(a table of `CELLS` bits of the queries' terms, of fixed size, keeps most others out; the
join with the queries' terms is exact).

Terms are dealt to owners by how common they are, rare ones first (`OWNERS`).  Queries
travel in bundles: a bundle meets the postings of the first owner, shard by shard, takes
its contributions into sparse accumulators (document, integer score), and goes on with
them to the next owner, by a cogroup on (bundle, shard) at each stage.  Scores only grow.
So the k-th best partial score of a query over all shards is a floor for its last result,
and an accumulator goes as soon as even the largest contributions of all later owners
leave it below the floor; equal scores stay.  No candidate that could rank is lost.  The
last stage hands on the best k of each shard, which are then compared over all shards.

What is bounded: a task holds one shard's postings of one owner and a bundle's
accumulators on it; a common term has one list per shard.  Nothing is broadcast but the
bits; what the driver sees is those and two sums.

Null and empty texts have no terms: as queries they give no rows, as documents they do
not count.  Repeated rows are documents, or queries, of their own.  Equal scores go to the
smaller doc_id, nulls last; rows equal in score and id are numbered in an arbitrary order.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from taskscope.llm.words import ALNUM, pieces, words
from taskscope.session import staged

#: Documents of a shard, and the postings at which it ends before.
SHARD, POSTINGS = 4096, 1 << 20
#: Cells of the table of the queries' terms, as bits of their number.
CELLS = 20
#: (Query, term) pairs of a bundle.
BUNDLE = 4096
#: An owner has the terms that at most one of so many documents holds; the last one has all others.
OWNERS = (64, 16, 4)
#: A document's length counts for B of 100 parts in its norm.
B = 75

_SHIFT = np.uint64(64 - CELLS)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, term, times) of (query, text)."""
    for piece in pieces(batches):
        w = words(piece.column(1), ALNUM)
        owner = w.owner()
        order = np.lexsort((w.hash, owner))
        term, owner = w.hash[order], owner[order]
        new = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.append(True, term[1:] != term[:-1])[:len(term)])
        times = np.diff(np.append(new, len(term)))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).take(pa.array(owner[new])), pa.array(term[new].view(np.int64)), pa.array(times, pa.int64())],
            names=["query", "term", "times"])


class _Shard:
    """Documents of a task that make up one shard, and its index."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.ids, self.held, self.docs, self.postings, self.terms, self.full = id_type, [], [], 0, 0, 0, 0

    def add(self, ids: pa.Array, texts: pa.Array, wanted: np.ndarray) -> None:
        w = words(texts, ALNUM)
        at = np.flatnonzero(wanted[(w.hash >> _SHIFT).astype(np.int64)])
        term, doc = w.hash[at], w.owner()[at]
        order = np.lexsort((doc, term))
        term, doc = term[order], doc[order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[:len(term)])
        times = np.diff(np.append(new, len(term)))
        self.held.append((term[new], doc[new] + self.docs, times, w.counts[doc[new]]))
        self.ids.append(ids)
        self.docs += len(ids)
        self.postings += len(new)
        self.terms += len(w.start)
        self.full += int(np.count_nonzero(w.counts))

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row for each term, and one with the ids in order: places of documents follow their ids."""
        ids = pa.concat_arrays(self.ids)
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        term, doc, times, size = (np.concatenate(x) for x in zip(*self.held))
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, times, size = term[order], doc[order], times[order], size[order]
        new = np.flatnonzero(np.append(True, term[1:] != term[:-1])[:len(term)])
        ends = np.append(new, len(term)).astype(np.int32)
        k = len(new)
        lists = [pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())),
                                   pa.nulls(1, pa.list_(pa.int32()))]) for x in (doc, times, size)]
        most = np.maximum.reduceat(times, new) if k else times
        least = np.minimum.reduceat(size, new) if k else size
        with_null = lambda x: pa.array([*x.tolist(), None], pa.int64())
        only = lambda x: pa.array([None] * k + [x], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * (k + 1), pa.int64()), with_null(term.view(np.int64)[new]), with_null(np.diff(ends)),
             with_null(most), with_null(least), *lists, only(self.full), only(self.terms),
             pa.concat_arrays([pa.nulls(k, pa.list_(self.id_type)),
                               pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(by_id)))])],
            names=INDEX)


INDEX = ["shard", "term", "df", "most", "least", "docs", "times", "sizes", "full", "terms", "ids"]


def _indexed(bits, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        shard, number = _Shard(id_type), TaskContext.get().partitionId() << 32
        for piece in pieces(batches):
            i = 0
            while i < piece.num_rows:
                part = piece.slice(i, SHARD - shard.docs)  # what the shard has room for
                i += part.num_rows
                shard.add(part.column(0), part.column(1), wanted)
                if shard.docs >= SHARD or shard.postings >= POSTINGS:
                    yield shard.rows(number)
                    shard, number = _Shard(id_type), number + 1
        if shard.docs:
            yield shard.rows(number)
    return run


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written index of `docs` (doc_id, text): rows of terms, and one row without a term per shard."""
    spark = docs.sparkSession
    cells = terms.select(F.shiftrightunsigned("term", 64 - CELLS).alias("cell")).distinct().toArrow()  # 2^CELLS rows at most
    wanted = np.zeros(1 << CELLS, bool)
    wanted[cells.column(0).to_numpy()] = True
    bits = spark.sparkContext.broadcast(np.packbits(wanted).tobytes())
    field = docs.schema["doc_id"]
    numbers = T.ArrayType(T.IntegerType())
    kinds = [T.LongType()] * 5 + [numbers] * 3 + [T.LongType()] * 2 + [T.ArrayType(field.dataType)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(INDEX, kinds)])
    return staged(docs.select("doc_id", "text").mapInArrow(_indexed(bits, to_arrow_type(field.dataType)), schema),
                  "ranking-index")


def share(times, norm):
    """What `times` occurrences count in a document of this norm, per unit of weight."""
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


def _stage(docs: int, terms: int, k: int, last: bool):
    """Adds an owner's contributions to the accumulators of a bundle on a shard."""
    def run(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, shard = (x.as_py() for x in key)
        columns = lambda side, *names: zip(*(side.column(c) for c in names)) if side.num_rows else ()
        held: dict[int, list] = {}  # query: [floor, rest, (documents, scores) ...]
        for query, floor, rest, at, scores in columns(carried, "query", "floor", "rest", "docs", "scores"):
            held[query.as_py()] = [floor.as_py(), rest.as_py(), (at.values.to_numpy(), scores.values.to_numpy())]
        size = 1 + max((int(parts[0].max()) for _, _, parts in held.values() if len(parts[0])), default=-1)
        for at, times, sizes, asks in columns(postings, "docs", "times", "sizes", "asks"):
            at, times, sizes = (x.values.to_numpy().astype(np.int64) for x in (at, times, sizes))
            size = max(size, int(at[-1]) + 1)
            part = share(times, 100 - B + (B * sizes * docs) // terms)
            for ask in asks.as_py():
                own = held.setdefault(ask["query"], [ask["floor"], ask["rest"]])
                own.append((at, ask["gain"] * part))
        out: dict[str, list] = {"query": [], "docs": [], "scores": [], "best": []}
        for query, (floor, rest, *parts) in held.items():
            sums = np.zeros(size, np.int64)
            for at, scores in parts:  # a document once in each
                sums[at] += scores
            at = np.flatnonzero(sums)
            scores = sums[at]
            best = -np.sort(-np.partition(scores, len(scores) - k)[-k:]) if len(scores) > k else -np.sort(-scores)
            floor = max(floor, int(best[-1]) if len(best) == k else 1)
            keep = scores + rest >= floor
            at, scores = at[keep], scores[keep]
            if last and len(at) > k:
                order = np.lexsort((at, -scores))[:k]
                at, scores = at[order], scores[order]
            if len(at):
                out["query"].append(query)
                out["docs"].append(at)
                out["scores"].append(scores)
                out["best"].append(best)
        n = len(out["query"])
        return pa.table({"bundle": pa.array([bundle] * n, pa.int64()), "shard": pa.array([shard] * n, pa.int64()),
                         "query": pa.array(out["query"], pa.int64()), "docs": pa.array(out["docs"], pa.list_(pa.int32())),
                         "scores": pa.array(out["scores"], pa.list_(pa.int64())),
                         "best": pa.array(out["best"], pa.list_(pa.int64()))})
    return run


CARRIED = "bundle long, shard long, query long, docs array<int>, scores array<long>, best array<long>"


def _floors(carried: DataFrame, k: int) -> DataFrame:
    """The k-th best partial score of each query that has so many."""
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    return (carried.select("query", F.explode("best").alias("score"))
            .withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
            .groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor"))
            .filter(F.col("_n") == k).select("query", "floor"))


def rank(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents, of score above 0, for each row of `queries`
    (item_id, text)."""
    spark = docs.sparkSession
    items = staged(queries.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "ranking-items")
    asked = staged(items.select("query", "text").mapInArrow(_asked, "query long, term long, times long"), "ranking-terms")
    written = index(docs, asked)
    n, length = written.agg(F.sum("full"), F.sum("terms")).first()
    if not length:  # no document has a term
        return spark.createDataFrame([], T.StructType([queries.schema["item_id"], T.StructField("rank", T.IntegerType()),
                                                       docs.schema["doc_id"], T.StructField("score", T.LongType())]))
    # weight and owner of each term, and the most that a document can have from it
    df = F.col("df")
    norm = F.expr(f"{100 - B} + ({B} * least * {n}) div {length}")
    owner = F.lit(len(OWNERS))
    for i, one_of in reversed(list(enumerate(OWNERS))):
        owner = F.when(df * one_of <= n, i).otherwise(owner)
    known = (written.filter("term is not null").groupBy("term")
             .agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))
             .withColumn("weight", F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * df + 1))))
             .withColumn("norm", norm)
             .select("term", "weight", owner.alias("owner"),
                     F.expr("(1000000000 * most) div (1000 * most + 8 * norm)").alias("share")))
    pairs = asked.count()
    gains = staged(asked.join(known, "term").select(
        F.pmod(F.xxhash64("query"), F.lit(-(-pairs // BUNDLE) or 1)).alias("bundle"), "query", "term", "owner",
        (F.col("times") * F.col("weight")).alias("gain"),
        (F.col("times") * F.col("weight") * F.col("share")).alias("most")), "ranking-gains")
    postings = written.filter("term is not null").select("shard", "term", "docs", "times", "sizes")
    carried, floors = None, None
    for stage in range(len(OWNERS) + 1):
        last = stage == len(OWNERS)
        rest = gains.groupBy("query").agg(F.sum(F.when(F.col("owner") > stage, F.col("most")).otherwise(0)).alias("rest"))
        if floors is not None:
            rest = rest.join(floors, "query", "left").fillna({"floor": 1})
        else:
            rest = rest.withColumn("floor", F.lit(1).cast("long"))
        asks = (gains.filter(F.col("owner") == stage).join(rest, "query")
                .groupBy("bundle", "term").agg(F.collect_list(F.struct("query", "gain", "floor", "rest")).alias("asks")))
        right = postings.join(asks, "term").select("bundle", "shard", "docs", "times", "sizes", "asks")
        if carried is None:
            left = spark.createDataFrame([], CARRIED + ", floor long, rest long")
        else:
            left = carried.join(rest, "query")
        step = (left.select("bundle", "shard", "query", "floor", "rest", "docs", "scores").groupBy("bundle", "shard")
                .cogroup(right.groupBy("bundle", "shard")).applyInArrow(_stage(n, length, k, last), CARRIED))
        if not last:
            carried = staged(step, f"ranking-stage-{stage}")
            floors = staged(_floors(carried, k), "ranking-floors")
    found = step.select("query", "shard", F.explode(F.arrays_zip("docs", "scores")).alias("_d"))
    found = found.select("query", "shard", F.col("_d.docs").alias("place"), F.col("_d.scores").alias("score"))
    ids = written.filter("term is null").select("shard", "ids")
    ordered = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.join(ids, "shard").withColumn("doc_id", F.element_at("ids", F.col("place") + 1))
            .select("query", "doc_id", "score").withColumn("rank", F.row_number().over(ordered))
            .filter(F.col("rank") <= k).join(items.select("query", "item_id"), "query")
            .select("item_id", "rank", "doc_id", "score"))


ORACLE = r"""
WITH lower AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM lower WHERE len(t) > 0),
posted AS (
  SELECT doc_id, r, term, size, count(*)::BIGINT AS tf FROM (
    SELECT doc_id, r, len(t) AS size, unnest(t) AS term FROM lower) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posted, total GROUP BY term, n),
scored AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))))::BIGINT
    AS score FROM posted JOIN weights USING (term) JOIN asked USING (term), total GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
