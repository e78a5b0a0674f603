"""Importance resampling of documents towards a target distribution.

Features are runs of one and two words, hashed into `BUCKETS` buckets.  Both tables are
counted whole; a bucket's gain is the logarithm of how much likelier it is in the target,
and a document's weight the floored mean of the gains of its features, taken from an
array.  A document's score is its weight plus noise that its id alone decides, so the
highest scores are a draw without replacement.

The cutoff is found without a sort of all scores: each partition gives the median of the
keys that are left and how many there are; the median of these medians, weighted by the
sizes, has at least a quarter of the keys on either side; they are counted exactly, and
the side without the cutoff is dropped.  The same pass gives the medians of both sides for
the next round.  What is left is written anew when it has shrunk to an eighth, and sorted
when it is at most `SMALL` keys.  Only the winners are then sorted, range by range.

What is bounded: the driver sees at most `BUCKETS` counts, two medians per partition and
`SMALL` keys; a task holds the keys of one partition of the score table.

Null and empty texts have no features, weight 0, a score and no rank.  Equal scores go to
the smaller doc_id, nulls last; a null id draws its noise as an empty one.  Repeated rows
are documents of their own.  Empty tables give an empty result, or gains from the other
table alone.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskscope.llm.words import ALNUM, Words, pieces, words
from taskscope.operators.ordered import global_index
from taskscope.session import staged

BUCKETS = 10_000
SMALL = 1000
#: Bytes of a word that are hashed for all words at once; the rest of longer words one by one.
AT_ONCE = 48
#: The order of keys: highest score, then smallest id; the last two part repeated rows.
KEY = ["_low", "_none", "doc_id", "n_features", "_row"]


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _fed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Registers of CRC-32 after the bytes start..end of each range."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    own, at, size = crc[order], start[order], size[order]
    counts = np.searchsorted(-size, -np.arange(min(int(size[0]), AT_ONCE) if len(size) else 0))
    for k, m in enumerate(counts.tolist()):  # the first m ranges have a byte k
        now = own[:m]
        own[:m] = _TABLE[(now ^ data[at[:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -AT_ONCE))):
        rest = data[at[i] + AT_ONCE:at[i] + size[i]].tobytes()
        own[i] = zlib.crc32(rest, int(own[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(own)
    out[order] = own
    return out


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all pairs, and where the pairs start."""
    one = _fed(np.full(len(w.start), _ONES), w.data, w.start, w.end)
    owner = w.owner()
    at = np.flatnonzero(owner[1:] == owner[:-1])
    spaced = _TABLE[(one[at] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[at] >> np.uint32(8))
    two = _fed(spaced, w.data, w.start[at + 1], w.end[at + 1])
    return (one ^ _ONES) % np.uint32(BUCKETS), (two ^ _ONES) % np.uint32(BUCKETS), at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for piece in pieces(batches):
        one, two, _ = features(words(piece.column(0), ALNUM))
        counts += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column `text`."""
    rows = (texts.select("text").mapInArrow(_counted, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 * ln of the smoothed odds of each bucket, in doubles."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: str | None) -> int:
    """A Gumbel variate in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            w = words(piece.column(2), ALNUM)
            one, two, at = features(w)
            sums = np.zeros(len(one) + 1, np.int64)
            sums[1:] = gain.value[one]
            sums[at + 1] += gain.value[two]
            upto = np.cumsum(sums)
            total = upto[w.first[1:]] - upto[w.first[:-1]]
            many = np.maximum(2 * w.counts - 1, 0)
            weight = total // np.maximum(many, 1)
            score = weight + np.array([noise(seed, i) for i in piece.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(many, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())],
                names=["doc_id", "n_features", "weight", "score"])
    return run


def scores(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight and score of each document; a target row is a `text`."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))  # BUCKETS numbers
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType())
                                                    for c in ("n_features", "weight", "score"))])
    return (docs.select("doc_id", F.col("doc_id").cast("string").alias("_name"), "text")
            .mapInArrow(_scored(gain, seed), schema))


def _before(key: tuple) -> Column:
    """Rows whose key comes before this one."""
    same = lambda i: [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(KEY[:i], key[:i])]
    ways = [reduce(Column.__and__, [*same(i), F.coalesce(F.col(c) < F.lit(key[i]), F.lit(False))])
            for i, c in enumerate(KEY)]
    return (F.col(KEY[0]) <= F.lit(key[0])) & reduce(Column.__or__, ways)


def _same(key: tuple) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(KEY, key)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The middle key of each side of the pivot, and the side's size, in this partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    side = rows.column("side").to_numpy()
    for s in np.unique(side).tolist():
        own = rows.filter(pa.array(side == s))
        order = own.sort_by([(c, "ascending") for c in KEY])
        middle = order.slice((own.num_rows - 1) // 2, 1)
        for b in middle.append_column("size", pa.array([own.num_rows], pa.int64())).to_batches():
            yield b


def weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    """The first key, in order, up to which half of all sizes lie."""
    medians = sorted(medians)
    half, upto = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        upto += n
        if upto >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, want: int, small: int = SMALL) -> tuple:
    """The key of place `want` (from 1) among the rows of a written table with the columns KEY."""
    schema = T.StructType([T.StructField("side", T.IntegerType()), *(keys.schema[c] for c in KEY),
                           T.StructField("size", T.LongType())])
    rest, held, left, pivot = keys, None, None, None
    while True:
        if left is not None and left <= small:
            return sorted(tuple(r) for r in rest.select(*KEY).collect())[want - 1]
        side = F.lit(1) if pivot is None else F.when(_before(pivot), -1).when(_same(pivot), 0).otherwise(1)
        sides: dict[int, list[tuple[tuple, int]]] = {-1: [], 0: [], 1: []}
        for r in rest.select(side.alias("side"), *KEY).mapInArrow(_medians, schema).collect():
            sides[r[0]].append((tuple(r[1:-1]), r[-1]))
        low, equal, high = (sum(n for _, n in sides[s]) for s in (-1, 0, 1))
        held = held or high
        if want <= low:
            rest, left, chosen = rest.filter(_before(pivot)), low, sides[-1]
        elif want <= low + equal:
            return pivot
        else:
            if pivot is not None:
                rest = rest.filter(~_before(pivot) & ~_same(pivot))
            want, left, chosen = want - low - equal, high, sides[1]
        pivot = weighted_median(chosen)
        if 8 * left < held:
            rest, held = staged(rest, "resample-keys"), left


def drawn(scored: DataFrame, percent: int = 25, least_words: int = 20, small: int = SMALL) -> DataFrame:
    """All rows with `rank`: the floor(percent / 100) highest scores of documents of enough words, from 1."""
    rows = staged(scored.select(
        "*", (-F.col("score")).alias("_low"), F.col("doc_id").isNull().alias("_none"),
        F.monotonically_increasing_id().alias("_row")), "resample-scores")
    able = F.col("n_features") >= 2 * least_words - 1
    keys = rows.filter(able)
    take = percent * keys.count() // 100
    if not take:
        return rows.select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    last = cutoff(keys.select(*KEY), take, small)
    wins = able & (_before(last) | _same(last))
    ranked = global_index(rows.filter(wins), KEY, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.select(*scored.columns, "rank").union(
        rows.filter(~wins).select(*scored.columns, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn."""
    return drawn(scores(docs, target, seed), percent, least_words)


#: CRC-32 is written out: a register goes through a table of 256 entries byte by byte.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
worded AS (
  SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
found AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM worded),
named AS (SELECT DISTINCT f FROM found),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(f) + 1),
    lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM named, crc),
placed AS (SELECT side, r, bucket FROM found JOIN hashed USING (f)),
counts AS (
  SELECT b AS bucket, count(bucket) FILTER (side = 0) AS s, count(bucket) FILTER (side = 1) AS t
  FROM range(10000) x(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (
  SELECT r, count(*) AS n, (sum(gain) - (sum(gain) % count(*) + count(*)) % count(*)) // count(*) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::UBIGINT::DOUBLE + 0.5)
      / 4294967296))))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END
    AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""
